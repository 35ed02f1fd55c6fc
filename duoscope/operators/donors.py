"""Donors: counts per modality, classification, pairing summaries; and audits of pairing keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions.names import composite_key
from duoscope.functions.tables import cut


def donor_counts(rna: DataFrame, atac: DataFrame, donor: str = "donor_id") -> DataFrame:
    """donor_id, n_rna, n_atac of every donor of either side; 0 where absent. A missing donor is no donor."""
    r = rna.where(F.col(donor).isNotNull()).groupBy(F.col(donor).alias("donor_id")).agg(F.count("*").alias("n_rna"))
    a = atac.where(F.col(donor).isNotNull()).groupBy(F.col(donor).alias("donor_id")).agg(F.count("*").alias("n_atac"))
    j = r.join(a, "donor_id", "full_outer")
    return j.select("donor_id", F.coalesce("n_rna", F.lit(0)).alias("n_rna"), F.coalesce("n_atac", F.lit(0)).alias("n_atac"))


def classify(rna: DataFrame, atac: DataFrame, donor: str = "donor_id", min_cells: int = 50) -> DataFrame:
    """donor_id, n_rna, n_atac, has_both, skip_reason (the first that holds, or empty)."""
    n = donor_counts(rna, atac, donor)
    why = F.when(F.col("n_rna") == 0, "no RNA cells").when(F.col("n_atac") == 0, "no ATAC cells").otherwise("")
    for m in ("rna", "atac"):
        few = F.format_string(f"too few {m.upper()} cells (%d < {min_cells})", F.col(f"n_{m}"))
        why = F.when((why == "") & (F.col(f"n_{m}") < min_cells), few).otherwise(why)
    return n.withColumn("skip_reason", why).select("donor_id", "n_rna", "n_atac", (F.col("skip_reason") == "").alias("has_both"), "skip_reason")


def pair_summary(donors: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per donor: n_rna, n_atac, min_modality, n_pairs, pair_fraction, anchor, mean_pair_distance, cell_type_agreement, status, skip_reason."""
    p = pairs.groupBy("donor_id").agg(
        F.count("*").alias("n_pairs"), F.first("anchor").alias("anchor"), F.avg("distance").alias("mean_pair_distance"),
        F.avg((F.col("cell_type") == F.col("atac_cell_type")).cast("double")).alias("cell_type_agreement"),
    )
    d = donors.join(p, "donor_id", "left").withColumn("min_modality", F.least("n_rna", "n_atac"))
    done = F.col("has_both") & F.col("n_pairs").isNotNull()
    return d.select(
        "donor_id", "n_rna", "n_atac", "min_modality", F.when(done, F.col("n_pairs")).alias("n_pairs"), F.when(done, F.try_divide(F.col("n_pairs").cast("double"), F.col("min_modality"))).alias("pair_fraction"),
        F.when(done, F.col("anchor")).alias("anchor"), F.when(done, F.col("mean_pair_distance")).alias("mean_pair_distance"), F.when(done, F.col("cell_type_agreement")).alias("cell_type_agreement"),
        F.when(done, "aligned").otherwise("skipped").alias("status"), "skip_reason",
    )


def overall(summary: DataFrame) -> DataFrame:
    a = summary.where("status = 'aligned'")
    return a.agg(F.count("*").alias("donors"), F.sum("n_pairs").alias("pairs"), F.median("n_pairs").alias("median_pairs"), F.avg("pair_fraction").alias("mean_fraction"), F.min("cell_type_agreement").alias("min_agreement"), F.max("cell_type_agreement").alias("max_agreement"))


def audit_keys(rna: DataFrame, atac: DataFrame, candidates: dict[str, Sequence[str]]) -> DataFrame:
    """key, n_rna, n_atac, shared, pct (of the smaller side) for each candidate whose columns both sides have."""
    out = None
    for name, cols in candidates.items():
        if not set(cols) <= set(rna.columns) & set(atac.columns):
            continue
        a = rna.select(composite_key(*map(F.col, cols)).alias("k")).distinct().withColumn("r", F.lit(1))
        b = atac.select(composite_key(*map(F.col, cols)).alias("k")).distinct().withColumn("a", F.lit(1))
        n = a.join(b, "k", "full_outer").agg(F.count("r").alias("n_rna"), F.count("a").alias("n_atac"), F.count_if(F.col("r").isNotNull() & F.col("a").isNotNull()).alias("shared"))
        n = n.select(F.lit(name).alias("key"), "n_rna", "n_atac", "shared", F.coalesce(F.try_divide(F.col("shared") * 100.0, F.least("n_rna", "n_atac")), F.lit(0.0)).alias("pct"))
        out = n if out is None else out.union(n)
    return out


def best_key(audit: DataFrame) -> DataFrame:
    """The key with the most shared cells, and a verdict: paired from 90 %, partial from 50 %, else unpaired."""
    best = audit.agg(F.max_by(F.struct("key", "shared", "pct"), F.struct("shared", "key")).alias("b")).select("b.*")
    return best.withColumn("verdict", F.when(F.col("pct") >= 90, "paired").when(F.col("pct") >= 50, "partial").otherwise("unpaired"))


def shared_barcodes(rna: DataFrame, atac: DataFrame, key: str) -> DataFrame:
    return rna.select(key).intersect(atac.select(key))


def agreement(rna: DataFrame, atac: DataFrame, key: str, label: str = "cell_type") -> DataFrame:
    """n, pct of cells whose label agrees across modalities, and whether it is below 95."""
    j = rna.select(key, F.col(label).alias("a")).join(atac.select(key, F.col(label).alias("b")), key)
    s = j.agg(F.count("*").alias("n"), (F.avg((F.col("a") == F.col("b")).cast("double")) * 100).alias("pct"))
    return s.withColumn("warn", F.col("pct") < 95)


def split_by_modality(rna: DataFrame, atac: DataFrame, key: str, method: str = "method", value: str = "10xMulti", least: float = 90.0) -> dict[str, DataFrame]:
    """paired_rna, paired_atac (the shared keys of the multiome rows), unpaired_rna, unpaired_atac.

    Below `least` per cent of shared keys the multiome rows go to the unpaired side as well; 0 always intersects.
    """
    from duoscope.operators.filters import multiome

    r, a = multiome(rna, value, method), multiome(atac, value, method)
    both = cut(r.select(key).intersect(a.select(key)), "shared")
    n = min(r.count(), a.count())
    single = {"unpaired_rna": multiome(rna, value, method, other=True), "unpaired_atac": multiome(atac, value, method, other=True)}
    if n and 100.0 * both.count() / n < least:
        return {"paired_rna": r.limit(0), "paired_atac": a.limit(0), "unpaired_rna": single["unpaired_rna"].unionByName(r), "unpaired_atac": single["unpaired_atac"].unionByName(a)}
    return {"paired_rna": r.join(both, key, "left_semi"), "paired_atac": a.join(both, key, "left_semi")} | single
