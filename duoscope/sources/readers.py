"""Readers of annotation, matrix, motif and sequence files, and of dataset folders, through Spark's own sources.

Parsing works on a table of lines, so that it can be tested without files; gzip is transparent (and not splittable).
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.functions.names import gtf_attribute
from duoscope.schemas import require_columns


def parse_gtf(lines: DataFrame) -> DataFrame:
    """Chromosome, Start, End, Strand, gene_name, gene_id of the gene rows that have a name; coordinates as they stand."""
    f = F.split("value", "\t")
    rows = lines.where(~F.col("value").startswith("#")).select(f.alias("f")).where("size(f) >= 9 and f[2] = 'gene'")
    chrom = F.when(F.col("f")[0].startswith("chr"), F.col("f")[0]).otherwise(F.concat(F.lit("chr"), F.col("f")[0]))
    rows = rows.select(
        chrom.alias("Chromosome"), F.col("f")[3].cast("long").alias("Start"), F.col("f")[4].cast("long").alias("End"), F.col("f")[6].alias("Strand"),
        gtf_attribute(F.col("f")[8], "gene_name").alias("gene_name"), F.coalesce(gtf_attribute(F.col("f")[8], "gene_id"), F.lit("")).alias("gene_id"),
    )
    return rows.where("gene_name is not null")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_gtf(spark.read.text(path))


def parse_mtx(lines: DataFrame) -> DataFrame:
    """(row, col, value), indices from 1, of MatrixMarket coordinate lines in file order ("line" numbers them).

    Comment lines and the first line after them (the dimensions) are left out.
    """
    body = lines.where(~F.col("value").startswith("%") & (F.trim("value") != ""))
    head = body.agg(F.min("line").alias("h"))
    x = body.join(F.broadcast(head), F.col("line") > F.col("h")).select(F.split(F.trim("value"), r"\s+").alias("p"))
    return x.select(F.col("p")[0].cast("long").alias("row"), F.col("p")[1].cast("long").alias("col"), F.coalesce(F.col("p")[2].cast("double"), F.lit(1.0)).alias("value"))


def numbered(lines: DataFrame) -> DataFrame:
    """Adds "line": grows in file order, with gaps between splits."""
    return lines.withColumn("line", F.monotonically_increasing_id())


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file, block, line: lines with their split of the file; line grows within a split."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    return numbered(spark.read.text(path).select("value", *where))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(ix from 1, name), a line each. A name list is as long as one side of the matrix, so a task numbers it."""
    rows = numbered(spark.read.text(path)).where(F.trim("value") != "")
    return rows.select(F.row_number().over(Window.orderBy("line")).alias("ix"), F.trim("value").alias("name"))


def read_mtx(spark: SparkSession, matrix: str, features: str, cells: str) -> DataFrame:
    """(cell_id, feature_name, value) of a features x cells matrix; indices beyond the name lists are left out."""
    m = parse_mtx(numbered(spark.read.text(matrix)))
    f, c = read_names(spark, features), read_names(spark, cells)
    return m.join(f.select(F.col("ix").alias("row"), F.col("name").alias("feature_name")), "row").join(c.select(F.col("ix").alias("col"), F.col("name").alias("cell_id")), "col").select("cell_id", "feature_name", "value")


def read_csv(spark: SparkSession, path: str, schema: str | None = None, index: str | None = None) -> DataFrame:
    """A headed CSV; index names an unnamed first column."""
    df = spark.read.csv(path, header=True, schema=schema)
    return df.withColumnRenamed(df.columns[0], index) if index else df


def read_feature_list(spark: SparkSession, path: str) -> DataFrame | None:
    """(pos, name) of a newline list; None where the file is missing."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return read_names(spark, path).select((F.col("ix") - 1).alias("pos"), "name")


def parse_motif_db(lines: DataFrame, tab: bool) -> DataFrame:
    """Accession, ID, Name, TFs, EnsemblID: tab-separated with a header, or quoted fields behind a row number."""
    names = ["Accession", "ID", "Name", "TFs", "EnsemblID"]
    if tab:
        p = lines.select(F.split("value", "\t").alias("p")).where("p[0] <> 'Accession'")
    else:
        p = lines.select(F.split(F.regexp_replace(F.trim("value"), r'^"?\d+"? (?=")', ""), '" "').alias("p"))
        p = p.select(F.transform("p", lambda x: F.regexp_replace(x, '^"|"$', "")).alias("p")).where("p[0] <> 'Accession'")
    return p.where("size(p) >= 5").select(*(F.col("p")[i].alias(n) for i, n in enumerate(names)))


def read_motif_db(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.text(path)
    first = lines.first()
    return parse_motif_db(lines, first is not None and "\t" in first["value"])


def read_pwm(spark: SparkSession, path: str) -> DataFrame:
    """motif_id, pos (from 0), base, weight from a CSV of these columns, or JSON lines {motif_id, matrix: 4 x W}."""
    if path.endswith(".json"):
        rows = spark.read.schema("motif_id string, matrix array<array<double>>").json(path)
        rows = rows.select("motif_id", F.posexplode("matrix").alias("b", "row")).select("motif_id", "b", F.posexplode("row").alias("pos", "weight"))
        return rows.select("motif_id", "pos", F.element_at(F.array(*map(F.lit, "ACGT")), F.col("b") + 1).alias("base"), "weight")
    return spark.read.csv(path, header=True, schema="motif_id string, pos int, base string, weight double")


def parse_fasta(lines: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """genome(chrom, chunk_ix, seq): sequences of `chunk` bases, from FASTA lines (value, file, block, line).

    No task holds more than a split of a file: lines are numbered within their split, and stretches between headers are
    placed by a table with a row per split and sequence, which says what the header before a split was and how many of its
    bases came before.
    """
    split, order = ["file", "block"], "line"
    here = Window.partitionBy(*split).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    is_head = F.col("value").startswith(">")
    rows = lines.withColumn("value", F.trim("value")).where("value <> ''")
    rows = rows.withColumn("part", F.count_if(is_head).over(here)).withColumn("n", F.when(is_head, 0).otherwise(F.length("value")))
    inside = Window.partitionBy(*split, "part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    parts = rows.groupBy(*split, "part").agg(F.max(F.when(is_head, F.regexp_extract("value", r"^>\s*(\S+)", 1))).alias("name"), F.sum("n").alias("n"))
    along = Window.partitionBy("file").orderBy("block", "part")
    parts = parts.withColumn("run", F.count("name").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    in_run = Window.partitionBy("file", "run").orderBy("block", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("base", F.coalesce(F.sum("n").over(in_run), F.lit(0)))
    parts = parts.withColumn("chrom", F.max("name").over(Window.partitionBy("file", "run"))).select(*split, "part", "chrom", "base")
    rows = rows.where(~is_head).join(parts, [*split, "part"]).withColumn("start", F.col("base") + F.col("at")).withColumn("end", F.col("start") + F.col("n"))
    part = F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("end") - 1) / chunk))).alias("chunk_ix")
    rows = rows.select("chrom", "start", "value", part)
    low = F.greatest(F.lit(0), F.col("chunk_ix") * chunk - F.col("start"))
    piece = F.substring("value", (low + 1).cast("int"), F.lit(chunk) - F.greatest(F.lit(0), F.col("start") - F.col("chunk_ix") * chunk).cast("int"))
    rows = rows.select("chrom", "chunk_ix", "start", piece.alias("s"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "s"))), lambda x: x["s"]), "")
    return rows.groupBy("chrom", "chunk_ix").agg(F.upper(joined).alias("seq"))


def read_fasta(spark: SparkSession, path: str, chunk: int = 1 << 16) -> DataFrame:
    return parse_fasta(read_lines(spark, path), chunk)


def peak_sequences(peaks: DataFrame, genome: DataFrame, chunk: int = 1 << 16) -> DataFrame:
    """(peak, seq): upper-case bases of each peak, clipped to the chromosome; unknown chromosomes and empty ones are out.

    peaks: peak, p_chrom, p_start, p_end. A peak joins the chunks that it touches.
    """
    p = peaks.select("peak", "p_chrom", F.greatest(F.lit(0), F.col("p_start")).alias("s"), F.col("p_end").alias("e")).where("e > s")
    p = p.withColumn("chunk_ix", F.explode(F.sequence(F.floor(F.col("s") / chunk), F.floor((F.col("e") - 1) / chunk))))
    j = p.join(genome.withColumnRenamed("chrom", "p_chrom"), ["p_chrom", "chunk_ix"])
    low = F.greatest(F.lit(0), F.col("s") - F.col("chunk_ix") * chunk)
    high = F.least(F.lit(chunk), F.col("e") - F.col("chunk_ix") * chunk)
    j = j.select("peak", "chunk_ix", F.substring("seq", (low + 1).cast("int"), (high - low).cast("int")).alias("x"))
    seq = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_ix", "x"))), lambda v: v["x"]), "")
    return j.groupBy("peak").agg(F.upper(seq).alias("seq")).where("seq <> ''")


def read_subset(spark: SparkSession, path: str, col: str, values: Sequence[str]) -> DataFrame:
    """Rows of a Parquet table with one of the values; the filter reaches the scan. KeyError if the column is missing."""
    return require_columns(spark.read.parquet(path), [col], path).where(F.col(col).isin(list(values)))


def read_dataset(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a dataset folder (counts, cells, features, ...), whichever are there."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    root = fs.Path(path)
    found = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(root)
    return {s.getPath().getName(): spark.read.parquet(s.getPath().toString()) for s in found if s.isDirectory()}


def find_runs(spark: SparkSession, pattern: str, suffix: str, mate: str) -> list[tuple[str, str, str]]:
    """(run, path, mate's path) for paths of the pattern whose name ends in suffix and that have a mate."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    where = fs.Path(pattern)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = []
    for s in system.globStatus(where) or []:
        path = s.getPath().toString()
        if path.endswith(suffix) and system.exists(fs.Path(path[: -len(suffix)] + mate)):
            out.append((path.rsplit("/", 1)[-1][: -len(suffix)], path, path[: -len(suffix)] + mate))
    return sorted(out)


def _hdf5(path: str):
    """HDF5 wants h5py; without it, containers have to be exported to Parquet or MatrixMarket."""
    if importlib.util.find_spec("h5py") is None:
        raise NotImplementedError(f"{path}: reading HDF5 needs h5py, which isn't installed; export the tables as Parquet or MatrixMarket")
    import h5py

    return h5py.File(path, "r")


def _texts(values: Iterable) -> list[str]:
    return [v.decode() if isinstance(v, bytes) else str(v) for v in values]


#: Names that a task reads at once.
_NAMES = 1 << 16


def _ranges(spark: SparkSession, n: int, rows: int) -> DataFrame:
    """a, b: ranges of `rows` below n in order, a few tasks a core, each with ranges side by side."""
    tasks = max(1, min(-(-n // rows), 4 * spark.sparkContext.defaultParallelism))
    return spark.range(0, n, rows, tasks).select(F.col("id").alias("a"), F.least(F.lit(n).cast("long"), F.col("id") + rows).alias("b"))


def _compressed(spark: SparkSession, path: str, group: str, n: int, major: str, minor: str, rows: int, opener: Callable) -> DataFrame:
    """(major, minor, value) longs and double of a compressed sparse matrix, by ranges of `rows` majors."""

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                f = opener(path)
                g = f[group] if group else f
                ends = np.asarray(g["indptr"][a : b + 1])
                lo, hi = int(ends[0]), int(ends[-1])
                yield pd.DataFrame({major: np.repeat(np.arange(a, b), np.diff(ends)), minor: np.asarray(g["indices"][lo:hi], np.int64), "value": np.asarray(g["data"][lo:hi], float)})

    return _ranges(spark, n, rows).mapInPandas(entries, f"{major} long, {minor} long, value double")


def _named(spark: SparkSession, path: str, n: int, ix: str, columns: dict[str, Sequence[str]], opener: Callable) -> DataFrame:
    """The index ix and text columns, each by its place in the file: tasks read ranges of names."""

    def names(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                out = {ix: np.arange(a, b)}
                for c, place in columns.items():
                    values = opener(path)
                    for step in place:
                        values = values[step]
                    out[c] = _texts(values[a:b])
                yield pd.DataFrame(out)

    return _ranges(spark, n, _NAMES).mapInPandas(names, ", ".join([f"{ix} long", *(f"{c} string" for c in columns)]))


def read_10x_h5(spark: SparkSession, path: str, rows: int = 2000, opener: Callable = _hdf5) -> dict[str, DataFrame]:
    """counts (cell_ix, feature_ix, value), cells (cell_ix, barcode), features (feature_ix, feature_id, feature_name,
    feature_type) of a 10x matrix file.

    Only the numbers of cells and features come to the driver; every task reads names of a range, or the entries of its own
    `rows` cells. opener(path) gives what h5py.File gives; the path must be visible to all executors.
    """
    m = opener(path)["matrix"]
    n_cells, n_features = len(m["barcodes"]), len(m["features"]["id"])
    fields = {"feature_id": "id", "feature_name": "name", "feature_type": "feature_type"}
    return {
        "counts": _compressed(spark, path, "matrix", n_cells, "cell_ix", "feature_ix", rows, opener),
        "cells": _named(spark, path, n_cells, "cell_ix", {"barcode": ("matrix", "barcodes")}, opener),
        "features": _named(spark, path, n_features, "feature_ix", {c: ("matrix", "features", f) for c, f in fields.items()}, opener),
    }


def _annotations(spark: SparkSession, g, index: str, ix: str) -> DataFrame:
    """The columns of an obs or var group: the index, plain columns, and categories by their codes (missing: null)."""
    key = g.attrs.get("_index", "_index")
    cols: dict[str, list] = {index: _texts(g[key][:])}
    for name in g.keys():
        if name == key:
            continue
        x = g[name]
        if hasattr(x, "keys"):  # a categorical column
            if "categories" in x.keys() and "codes" in x.keys():
                kinds = _texts(x["categories"][:])
                cols[name] = [kinds[c] if c >= 0 else None for c in np.asarray(x["codes"][:]).tolist()]
            continue
        values = x[:]
        cols[name] = _texts(values) if values.dtype.kind in "SUO" else np.asarray(values).tolist()
    rows = list(zip(range(len(cols[index])), *cols.values(), strict=True))
    kind = lambda v: next(("double" if isinstance(e, float) else "boolean" if isinstance(e, bool) else "long" if isinstance(e, int) else "string" for e in v if e is not None), "string")
    return spark.createDataFrame(rows, ", ".join([f"`{ix}` long", *(f"`{n}` {kind(v)}" for n, v in cols.items())]))


def read_h5ad(spark: SparkSession, path: str, layer: str | None = None, group: str = "", rows: int = 2000, opener: Callable = _hdf5) -> dict[str, DataFrame]:
    """counts (cell_ix, feature_ix, value), cells and features of an annotated matrix file, and what obsm holds.

    X or a named layer, stored by rows (CSR), by columns (CSC) or dense; absent rows are zeros. group: the place of the
    matrix within the file ("mod/rna" of a multimodal one). Entries are read by the executors, a range of rows each.
    """
    root = opener(path)
    root = root[group] if group else root
    prefix = f"{group}/" if group else ""
    where = f"layers/{layer}" if layer else "X"
    cells, features = _annotations(spark, root["obs"], "cell_id", "cell_ix"), _annotations(spark, root["var"], "feature_id", "feature_ix")
    n, x = len(root["obs"][root["obs"].attrs.get("_index", "_index")][:]), root[where]
    if not hasattr(x, "keys"):
        counts = _dense(spark, path, prefix + where, n, rows, opener)
    elif x.attrs.get("encoding-type", "csr_matrix") == "csc_matrix":
        counts = _compressed(spark, path, prefix + where, len(root["var"][root["var"].attrs.get("_index", "_index")][:]), "feature_ix", "cell_ix", rows, opener).select("cell_ix", "feature_ix", "value")
    else:
        counts = _compressed(spark, path, prefix + where, n, "cell_ix", "feature_ix", rows, opener)
    out = {"counts": counts, "cells": cells, "features": features}
    for name in root["obsm"].keys() if "obsm" in root.keys() else ():
        out[f"obsm/{name}"] = _dense(spark, path, f"{prefix}obsm/{name}", n, rows, opener).groupBy("cell_ix").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("feature_ix", "value"))), lambda v: v["value"]).alias("vec")
        )
    return out


def read_h5mu(spark: SparkSession, path: str, rows: int = 2000, opener: Callable = _hdf5) -> dict[str, dict[str, DataFrame]]:
    """The modalities of a multimodal file, each as read_h5ad() gives it."""
    return {m: read_h5ad(spark, path, group=f"mod/{m}", rows=rows, opener=opener) for m in opener(path)["mod"].keys()}


def _dense(spark: SparkSession, path: str, where: str, n: int, rows: int, opener: Callable) -> DataFrame:
    ranges = spark.createDataFrame([(a, min(n, a + rows)) for a in range(0, n, rows)], "a long, b long")
    keep_zero = where.split("/")[-2:-1] == ["obsm"]

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a, b in zip(pdf["a"], pdf["b"], strict=True):
                x = np.asarray(opener(path)[where][a:b], float)
                r, c = np.nonzero(np.ones_like(x) if keep_zero else x)
                yield pd.DataFrame({"cell_ix": r + a, "feature_ix": c, "value": x[r, c]})

    return ranges.repartition(max(1, len(range(0, n, rows)))).mapInPandas(entries, "cell_ix long, feature_ix long, value double")


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str | None:
    """The first of the paths that is there."""
    for p in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
            return p
    return None


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """(cell_id, label) from a CSV with an index column: what a trained cell-type model has put out."""
    df = read_csv(spark, path, index="cell_id")
    return df.select("cell_id", F.col(df.columns[1]).alias("label"))

