"""Spearman correlation of gene and peak counts over candidate pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _average_rank(value: str, count: str, *keys: str) -> Column:
    """Ranks from 1, ties averaged, of values that stand for `count` cells each."""
    upto = F.sum(count).over(Window.partitionBy(*keys).orderBy(value))  # with the value's own cells
    return upto - (F.sum(count).over(Window.partitionBy(*keys, value)) - 1) / F.lit(2.0)


#: How counts (cell_id, gene, x) and (cell_id, peak, y) meet: (gene, peak, x, y, c), c cells with these values.
Meeting = Callable[[DataFrame, DataFrame], DataFrame]


def meet_in(pairs: DataFrame) -> Meeting:
    """By any pairs (gene, peak), which meet the peaks' counts first: those are the sparser side. Where the pairs come from
    places, intervals.meetings() gives the same by a far smaller join."""
    return lambda x, y: y.join(pairs.select("gene", "peak"), "peak").join(x, ["cell_id", "gene"]).groupBy("gene", "peak", "x", "y").agg(F.count("*").alias("c"))


def spearman_counts(meet: DataFrame | Meeting, rna: DataFrame, atac: DataFrame, threshold: float = 0.1, min_cells: int = 2) -> DataFrame:
    """(gene, peak, spearman_r), |r| > threshold, over the cells in which both are positive; constant ranks give none.

    meet: the pairs (gene, peak), or how the counts meet in them; rna: cell_id, gene, value; atac: cell_id, peak, value.
    Ranks are within a pair, so they are made after the join, but not cell by cell: a pair's cells are counted by their two
    values, with map-side sums, and what is ranked is the distinct values, a few for counts, however many cells there are.
    r is rounded to 9 places before the threshold, that the last bit of a sum doesn't decide.
    """
    x = rna.where("value > 0").select("cell_id", "gene", F.col("value").cast("double").alias("x"))
    y = atac.where("value > 0").select("cell_id", "peak", F.col("value").cast("double").alias("y"))
    both = (meet_in(meet) if isinstance(meet, DataFrame) else meet)(x, y)
    both = both.withColumn("rx", _average_rank("x", "c", "gene", "peak")).withColumn("ry", _average_rank("y", "c", "gene", "peak"))
    c, rx, ry = F.col("c"), F.col("rx"), F.col("ry")
    sums = both.groupBy("gene", "peak").agg(F.sum(c).alias("n"), F.sum(c * rx).alias("sx"), F.sum(c * ry).alias("sy"), F.sum(c * rx * rx).alias("sxx"), F.sum(c * ry * ry).alias("syy"), F.sum(c * rx * ry).alias("sxy"))
    spread = F.expr("(n * sxx - sx * sx) * (n * syy - sy * sy)")
    r = F.try_divide(F.expr("n * sxy - sx * sy"), F.sqrt(F.greatest(F.lit(0.0), spread)))
    out = sums.select("gene", "peak", "n", F.round(r, 9).alias("spearman_r"))
    return out.where((F.col("n") >= min_cells) & (F.abs("spearman_r") > threshold)).select("gene", "peak", "spearman_r")


def spearman_binary(pairs: DataFrame, rna: DataFrame, atac: DataFrame, n_cells: int, threshold: float = 0.1, min_cells: int = 2, meet: Meeting | None = None) -> DataFrame:
    """The same over all cells where a peak is open (1) or not, without a dense matrix.

    A gene's ranks are made once, of its distinct values and how many cells have them; its zeros share one rank; a peak has
    two ranks. So a pair needs no more than the sum of the gene's ranks over the cells that have both, and that is a sum
    over values of how many such cells there are.
    """
    n = F.lit(float(n_cells))
    x = rna.where("value > 0").select("cell_id", "gene", F.col("value").cast("double").alias("x"))
    values = x.groupBy("gene", "x").agg(F.count("*").alias("c")).withColumn("local", _average_rank("x", "c", "gene"))
    values = values.withColumn("n0", n - F.sum("c").over(Window.partitionBy("gene"))).withColumn("r", F.col("n0") + F.col("local"))
    per_gene = values.groupBy("gene").agg(F.first("n0").alias("n0"), F.sum(F.col("c") * F.col("r") * F.col("r")).alias("sr2"))
    p = atac.where("value > 0").select("cell_id", "peak").distinct()
    per_peak = p.groupBy("peak").agg(F.count("*").cast("double").alias("n1"))
    both = (meet or meet_in(pairs))(x, p.withColumn("y", F.lit(1.0))).select("gene", "peak", "x", "c")
    both = both.join(values.select("gene", "x", "r"), ["gene", "x"]).groupBy("gene", "peak").agg(F.sum(F.col("c") * F.col("r")).alias("sr"), F.sum("c").alias("nb"))
    rows = pairs.select("gene", "peak").join(per_gene, "gene").join(per_peak, "peak").join(both, ["gene", "peak"], "left")
    rows = rows.where(F.col("n1") >= min_cells).withColumn("z", (F.col("n0") + 1) / 2)
    rows = rows.withColumn("s1", F.coalesce("sr", F.lit(0.0)) + (F.col("n1") - F.coalesce("nb", F.lit(0))) * F.col("z"))
    r0, r1 = (n - F.col("n1") + 1) / 2, (n - F.col("n1")) + (F.col("n1") + 1) / 2
    total, mean = n * (n + 1) / 2, (n + 1) / 2
    sxy = F.col("s1") * r1 + (total - F.col("s1")) * r0
    sxx = F.col("sr2") + F.col("n0") * F.col("z") * F.col("z")
    syy = F.col("n1") * r1 * r1 + (n - F.col("n1")) * r0 * r0
    r = F.try_divide(sxy / n - mean * mean, F.sqrt(F.greatest(F.lit(0.0), (sxx / n - mean * mean) * (syy / n - mean * mean))))
    rows = rows.withColumn("spearman_r", F.round(r, 9))
    return rows.where(F.abs("spearman_r") > threshold).select("gene", "peak", "spearman_r")


def is_binary(atac: DataFrame) -> DataFrame:
    """One row: whether every stored count is 1; true without any."""
    return atac.agg(F.coalesce(F.bool_and(F.col("value") == 1), F.lit(True)).alias("binary"))


def filter_by_correlation(pairs: DataFrame, rna: DataFrame, atac: DataFrame, cells: DataFrame, threshold: float = 0.1, min_cells: int = 2, meet: Meeting | None = None) -> DataFrame:
    """Binary mode if all stored peak counts are 1, count mode else: one small aggregate decides. meet: how counts meet in the pairs."""
    if is_binary(atac).first()["binary"]:
        return spearman_binary(pairs, rna, atac, cells.count(), threshold, min_cells, meet)
    return spearman_counts(meet or pairs, rna, atac, threshold, min_cells)
