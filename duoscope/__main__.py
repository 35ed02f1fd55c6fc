"""Command line: python -m duoscope COMMAND ...

A dataset is a folder of Parquet tables: counts (modality rna or atac, cell_id, feature_id, value), cells (cell_id, and
cell_type or donor_id where a command needs them) and features (feature_id, feature_name); see sources.sinks.write_dataset.
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.operators import hvg
from duoscope.plans import phases, reports
from duoscope.sources import readers, sinks


def _modality(data: dict[str, DataFrame], name: str) -> DataFrame:
    return data["counts"].where(F.col("modality") == name).select("cell_id", "feature_id", "value")


def _named(data: dict[str, DataFrame], name: str, column: str) -> DataFrame:
    names = data["features"].select("feature_id", F.col("feature_name").alias(column))
    return _modality(data, name).join(names, "feature_id").select("cell_id", column, "value")


def load_10x(spark: SparkSession, a: argparse.Namespace) -> None:
    """A 10x matrix file as a dataset: genes are rna, peaks atac."""
    found = readers.read_10x_h5(spark, a.path)
    kind = F.when(F.col("feature_type") == "Peaks", "atac").otherwise("rna").alias("modality")
    counts = found["counts"].join(found["features"].select("feature_ix", kind, F.col("feature_name").alias("feature_id")), "feature_ix")
    counts = counts.join(found["cells"].select("cell_ix", F.col("barcode").alias("cell_id")), "cell_ix").select("modality", "cell_id", "feature_id", "value")
    cells = found["cells"].select(F.col("barcode").alias("cell_id"), F.col("cell_ix"))
    features = found["features"].select(F.col("feature_name").alias("feature_id"), "feature_name", "feature_type")
    sinks.write_dataset({"counts": counts, "cells": cells, "features": features}, a.out, {"counts": ["modality"]})


def select(spark: SparkSession, a: argparse.Namespace) -> None:
    """The most variable features of a modality, best first, one name a line."""
    data = readers.read_dataset(spark, a.data)
    chosen = hvg.select_variable(_modality(data, a.modality), data["cells"].count(), a.n, a.span)
    chosen.orderBy(F.desc("norm_var"), "feature_id").coalesce(1).select(F.col("feature_id").cast("string")).write.text(a.out)


def subsample(spark: SparkSession, a: argparse.Namespace) -> None:
    """Cells drawn per type, variable features of both modalities, as a dataset."""
    data = readers.read_dataset(spark, a.data)
    s = phases.subsample(_modality(data, "rna"), _modality(data, "atac"), data["cells"], data["features"], a.per_type, a.genes, a.peaks, a.seed)
    counts = s["rna"].withColumn("modality", F.lit("rna")).unionByName(s["atac"].withColumn("modality", F.lit("atac")))
    sinks.write_dataset({"counts": counts, "cells": s["cells"], "features": data["features"]}, a.out, {"counts": ["modality"]})


def integrate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Joint embedding, neighbours and clusters of cells with both modalities."""
    data = readers.read_dataset(spark, a.data)
    p = phases.integrate_paired(_modality(data, "rna"), _modality(data, "atac"), a.genes, a.dims, a.k, data["cells"])
    sinks.write_dataset({"embedding": p["embedding"], "neighbors": p["lists"], "clusters": phases.clusters(p, a.resolution)}, a.out)


def relate(spark: SparkSession, a: argparse.Namespace) -> None:
    """Gene and peak pairs, triplets, labels and the peak table; motifs are optional."""
    data = readers.read_dataset(spark, a.data)
    rna, atac = _named(data, "rna", "gene"), _named(data, "atac", "peak")
    genes = readers.read_gtf(spark, a.annotation).select(F.col("Chromosome").alias("chrom"), F.col("Start").alias("start"), F.col("End").alias("end"), F.col("Strand").alias("strand"), "gene_name")
    with_motifs = a.motifs and a.pwm and a.genome
    found = phases.relate(
        genes, rna.select("gene").distinct(), rna, atac, data["cells"], atac.select("peak").distinct(), readers.read_motif_db(spark, a.motifs) if with_motifs else None,
        readers.read_pwm(spark, a.pwm) if with_motifs else None, readers.read_fasta(spark, a.genome) if with_motifs else None, threshold=a.threshold, seed=a.seed,
    )
    small = {"peak_gene_pairs": found.correlated, "motif_peak_pairs": found.matches, "triplets": found.triplets, "gene_labels": found.labels, "peak_info": found.peaks}
    if failed := sinks.write_in_order(small, {"peak_matrix": found.matrix}, a.out):
        raise SystemExit(f"not written: {failed}")


def report(spark: SparkSession, a: argparse.Namespace) -> None:
    """Columns, and counts of cells, donors and labels."""
    data = readers.read_dataset(spark, a.data)
    reports.columns_report(data).show(1000, truncate=False)
    reports.qc_summary({"cells": data["cells"]}).show(1000, truncate=False)


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    """A registered query over a folder of tables: shown, or written as Parquet."""
    from duoscope.queries import registry

    df = registry.QUERIES[a.name](spark, a.data)
    df.write.parquet(a.out) if a.out else df.show(a.rows, truncate=False)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("duoscope")
    sub = p.add_subparsers(dest="command", required=True)

    def add(f, *needs: str, **options) -> None:
        c = sub.add_parser(f.__name__.replace("_", "-"), help=f.__doc__)
        c.set_defaults(run=f)
        for name in needs:
            c.add_argument(name)
        for name, default in options.items():
            c.add_argument(f"--{name.replace('_', '-')}", default=default, type=type(default) if default is not None else str)

    add(load_10x, "path", "out")
    add(select, "data", "out", modality="rna", n=500, span=0.3)
    add(subsample, "data", "out", per_type=100, genes=500, peaks=10_000, seed=42)
    add(integrate, "data", "out", genes=2000, dims=20, k=20, resolution=0.8)
    add(relate, "data", "annotation", "out", motifs=None, pwm=None, genome=None, threshold=0.1, seed=42)
    add(report, "data")
    add(query, "name", "data", out=None, rows=20)
    return p


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    a.run(spark or SparkSession.builder.appName(f"duoscope {a.command}").getOrCreate(), a)


if __name__ == "__main__":
    main()
