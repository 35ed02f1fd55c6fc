"""Writers: CSV tables, dataset folders, vectors and figures' data."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions.names import stringify_missing
from duoscope.functions.tables import numbered


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A headed CSV in one part: for result tables that people read."""
    df.coalesce(1).write.csv(path, header=True, mode=mode)


def write_dataset(tables: dict[str, DataFrame], path: str, partition: dict[str, Sequence[str]] | None = None, mode: str = "errorifexists") -> None:
    """A folder of Parquet tables, partitioned as asked (counts by modality and layer); mode "ignore" keeps what is there."""
    for name, df in tables.items():
        df.write.partitionBy(*(partition or {}).get(name, [])).parquet(f"{path}/{name}", mode=mode)


def sanitize(cells: DataFrame, keep: Sequence[str] | None = None) -> DataFrame:
    """The kept columns, with anything but numbers and booleans as text and missing text as "nan"."""
    plain = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")
    kinds = dict(cells.dtypes)
    return cells.select(*[F.col(c) if kinds[c] in plain else stringify_missing(F.col(c)).alias(c) for c in (keep or cells.columns) if c in kinds])


def write_in_order(small: dict[str, DataFrame], large: dict[str, DataFrame], path: str) -> list[str]:
    """Small tables first, as CSV; then the large ones. Returns what failed of these: no failure costs a small table."""
    for name, df in small.items():
        write_csv(df, f"{path}/{name}.csv", "overwrite")
    failed = []
    for name, df in large.items():
        try:
            df.write.parquet(f"{path}/{name}", mode="overwrite")
        except Exception as e:  # reported to the caller, who has the small tables
            failed.append(f"{name}: {type(e).__name__}")
    return failed


def write_vectors(df: DataFrame, path: str) -> None:
    """id and ARRAY columns as Parquet."""
    df.write.parquet(path)


def to_npy(df: DataFrame, path: str, col: str, order: str, limit_rows: int = 2_000_000) -> None:
    """A matrix file on the driver, for a subsample; refused beyond limit_rows."""
    import numpy as np

    if df.count() > limit_rows:
        raise ValueError(f"more than {limit_rows} rows: write_vectors() instead")
    np.save(path, np.stack(df.orderBy(order).select(col).toPandas()[col]))


def to_npz(matrix: DataFrame, path: str, row: str = "cell_id", vec: str = "peaks", name: str = "peak_matrix", limit_rows: int = 2_000_000) -> list:
    """A dense matrix of one named array in a .npz file on the driver, rows in order of their key; returns the keys.

    For the sample that a model is trained on; refused beyond limit_rows.
    """
    import numpy as np

    if matrix.count() > limit_rows:
        raise ValueError(f"more than {limit_rows} rows: write_vectors() instead")
    rows = matrix.orderBy(row).select(row, vec).toPandas()
    np.savez_compressed(path, **{name: np.stack(rows[vec]) if len(rows) else np.empty((0, 0))})
    return rows[row].tolist()


def to_npz_blocks(counts: DataFrame, cells: DataFrame, peaks: DataFrame, name: str = "peak_matrix", rows: int = 256) -> DataFrame:
    """block, npz BINARY: the matrix of cells and peaks as .npz archives of some `rows` rows each, made in tasks.

    counts: cell_id, peak, value (no pair twice); cells: cell_id; peaks: peak. An archive holds the keys of its rows
    (cell_id) and the compressed sparse rows (name_data, name_indices, name_indptr, name_shape): columns are the distinct
    peaks in order, as wide as the whole matrix, and what isn't stored is 0. So archives grow with the counts, where the
    dense matrix has cells times peaks numbers. read_npz() gives the arrays of one.
    """
    columns = numbered(peaks.select("peak").distinct(), "peak", "column")
    ids = cells.select("cell_id").distinct()
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(float(rows)))).cast("int")
    sizes = F.broadcast(ids.agg(F.count("*").alias("n")).select(blocks.alias("blocks")).crossJoin(columns.agg(F.count("*").alias("width"))))
    placed = counts.where("value <> 0").join(columns, "peak").select("cell_id", "column", F.col("value").cast("double").alias("value"))
    stored = ids.join(placed, "cell_id", "left").crossJoin(sizes).withColumn("block", F.pmod(F.xxhash64("cell_id"), F.col("blocks")).cast("int"))

    def archive(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cell_id", "column"])
        keys = np.sort(pdf["cell_id"].unique())
        full = pdf[pdf["column"].notna()]
        ends = np.r_[0, np.searchsorted(full["cell_id"].to_numpy(), keys, "right")]
        file = io.BytesIO()
        arrays = {"data": full["value"].to_numpy(), "indices": full["column"].to_numpy(np.int64), "indptr": ends, "shape": np.array([len(keys), pdf["width"].iloc[0]])}
        np.savez_compressed(file, cell_id=keys, **{f"{name}_{k}": v for k, v in arrays.items()})
        return pd.DataFrame({"block": pdf["block"].iloc[:1].to_numpy(), "npz": [file.getvalue()]})

    return stored.groupBy("block").applyInPandas(archive, "block int, npz binary")


def read_npz(content: bytes) -> dict[str, np.ndarray]:
    """The arrays of an archive of to_npz_blocks()."""
    with np.load(io.BytesIO(content)) as f:
        return {k: f[k] for k in f.files}


def bar_counts(cells: DataFrame, label: str) -> DataFrame:
    """label, n, share: the bars of a chart of label counts."""
    n = cells.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    return n.crossJoin(cells.agg(F.count("*").alias("__all"))).select("label", "n", (F.col("n") / F.col("__all")).alias("share"))


def violin_data(metrics: DataFrame, label: str, values: Sequence[str], at: Sequence[float] = (0.0, 0.25, 0.5, 0.75, 1.0), accuracy: int = 10_000) -> DataFrame:
    """label, metric, quantiles: what a violin or box of each metric and label needs; sketches of bounded size."""
    long = metrics.select(F.col(label).alias("label"), F.explode(F.array(*(F.struct(F.lit(v).alias("metric"), F.col(v).cast("double").alias("x")) for v in values))).alias("s"))
    return long.groupBy("label", "s.metric").agg(F.percentile_approx("s.x", list(at), accuracy).alias("quantiles"))


def plot_points(cells: DataFrame, vec: str, label: str) -> DataFrame:
    """x, y, label: the first two dimensions of an embedding, which a scatter plot needs."""
    return cells.select(F.col(vec)[0].alias("x"), F.col(vec)[1].alias("y"), F.col(label).alias("label"))
