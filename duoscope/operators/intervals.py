"""Strand-aware range joins of genes and peaks.

Both sides are cut into bins of a fixed width per chromosome, so that the join is an equi-join on (chrom, bin) with the
overlap as a residual: no nested loop, however many intervals a chromosome has. A pair is kept in the first bin that it
shares, greatest(bin of either start), which needs no distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.functions.names import parse_peak


def tss_window(upstream: int = 250_000, downstream: int = 250_000) -> tuple[Column, Column]:
    """(start, end) around a gene's TSS. A strand other than "-" counts as plus; the start isn't below 0."""
    minus = F.col("strand").eqNullSafe("-")
    low = F.when(minus, F.col("end") - downstream).otherwise(F.col("start") - upstream)
    high = F.when(minus, F.col("end") + upstream).otherwise(F.col("start") + downstream)
    return F.greatest(F.lit(0), low), high


def body_window(upstream: int = 2_000) -> tuple[Column, Column]:
    """(start, end) of a gene's body, longer by `upstream` on its 5' side; a strand other than + and - adds nothing."""
    low = F.when(F.col("strand") == "+", F.greatest(F.lit(0), F.col("start") - upstream)).otherwise(F.col("start"))
    high = F.when(F.col("strand") == "-", F.col("end") + upstream).otherwise(F.col("end"))
    return low, high


def overlap_join(genes: DataFrame, peaks: DataFrame, bin_width: int = 500_000, on: Sequence[str] = ()) -> DataFrame:
    """All (genes.*, peaks.*) with p_start < win_end and p_end > win_start on one chromosome, repeats kept.

    genes: chrom, win_start, win_end, ...; peaks: p_chrom, p_start, p_end, .... on: columns of both that must be equal too.
    """
    for c in on:
        peaks = peaks.withColumnRenamed(c, f"__{c}")
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bin_width), F.floor(F.greatest(F.col(a), F.col(b)) / bin_width)))
    g = genes.where("chrom is not null").withColumn("__bin", bins("win_start", "win_end"))
    p = peaks.where("p_chrom is not null").withColumn("__bin", bins("p_start", "p_end"))
    hit = (F.col("p_start") < F.col("win_end")) & (F.col("p_end") > F.col("win_start"))
    first = F.greatest(F.floor(F.col("win_start") / bin_width), F.floor(F.col("p_start") / bin_width))
    same = (F.col("chrom") == F.col("p_chrom")) & (g["__bin"] == p["__bin"]) & (g["__bin"] == first)
    for c in on:
        same = (F.col(c) == F.col(f"__{c}")) & same
    return g.join(p, same & hit).drop("__bin", *(f"__{c}" for c in on))


def peak_table(peaks: DataFrame, col: str = "peak") -> DataFrame:
    """peak, p_chrom, p_start, p_end of the names that parse."""
    rows = peaks.select(F.col(col).alias("peak"), parse_peak(F.col(col)).alias("p")).where("p is not null")
    return rows.select("peak", F.col("p.chrom").alias("p_chrom"), F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))


def _gene_windows(genes: DataFrame, gene_set: DataFrame, upstream: int, downstream: int) -> DataFrame:
    """Distinct (chrom, gene, win_start, win_end) of the genes of the set."""
    low, high = tss_window(upstream, downstream)
    g = genes.join(gene_set.select(F.col(gene_set.columns[0]).alias("gene_name")).distinct(), "gene_name", "left_semi")
    return g.select("chrom", F.col("gene_name").alias("gene"), low.alias("win_start"), high.alias("win_end")).distinct()


def peak_gene_overlaps(genes: DataFrame, peaks: DataFrame, gene_set: DataFrame, upstream: int = 250_000, downstream: int = 250_000) -> DataFrame:
    """Distinct (gene, peak) of peaks in a gene's TSS window; genes: chrom, start, end, strand, gene_name.

    Windows and peak names are made distinct before they meet. A gene of one window meets a peak once, so that the pairs,
    which are many times the genes, are made distinct for genes of several windows only.
    """
    g = _gene_windows(genes, gene_set, upstream, downstream)
    g = g.withColumn("__n", F.count("*").over(Window.partitionBy("gene")))
    p = peak_table(peaks.select("peak").distinct())
    once, more = (overlap_join(g.where(which).drop("__n"), p).select("gene", "peak") for which in ("__n = 1", "__n > 1"))
    return once.union(more.distinct())


def meetings(genes: DataFrame, peaks: DataFrame, gene_set: DataFrame, upstream: int = 250_000, downstream: int = 250_000) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """How counts of genes (cell_id, gene, x) and of peaks (cell_id, peak, y) meet in the pairs of peak_gene_overlaps():
    (gene, peak, x, y, c), c cells with these values.

    The counts carry their windows and places and meet in a cell and a bin. So a peak's count is not repeated for each
    gene around it, of which few have a count in that cell, and the pairs themselves are not needed.
    """
    order = Window.partitionBy("gene").orderBy("chrom", "win_start", "win_end")
    g = _gene_windows(genes, gene_set, upstream, downstream).withColumn("__w", F.row_number().over(order))
    p = peak_table(peaks.select("peak").distinct())

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        hit = overlap_join(x.join(g, "gene"), y.join(p, "peak"), on=["cell_id"])
        counts = hit.groupBy("gene", "peak", "__w", "x", "y").agg(F.count("*").alias("c"))
        # a peak meets the same windows of a gene in every cell; it counts in the first
        counts = counts.withColumn("__first", F.min("__w").over(Window.partitionBy("gene", "peak")))
        return counts.where("__w = __first").select("gene", "peak", "x", "y", "c")

    return meet


def body_overlaps(genes: DataFrame, peaks: DataFrame, upstream: int = 2_000) -> DataFrame:
    """(gene, peak), once for every annotation row that a peak overlaps: multiplicity counts in gene activity."""
    low, high = body_window(upstream)
    g = genes.select("chrom", F.col("gene_name").alias("gene"), low.alias("win_start"), high.alias("win_end"))
    return overlap_join(g, peak_table(peaks)).select("gene", "peak")


def gene_activity(atac: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(cell_id, gene, value): the counts of the peaks that overlap a gene, as often as they do.

    atac: cell_id, peak, value. Repeated overlaps are counted first, so that a count row joins once per (gene, peak). The
    counts are many times the pairs and are not sorted to meet them.
    """
    times = overlaps.groupBy("gene", "peak").agg(F.count("*").alias("times")).hint("shuffle_hash")
    return atac.join(times, "peak").groupBy("cell_id", "gene").agg(F.sum(F.col("value") * F.col("times")).alias("value"))


def peaks_per_gene(pairs: DataFrame) -> DataFrame:
    n = pairs.groupBy("gene").agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("genes"), F.median("n").alias("median"), F.avg("n").alias("mean"), F.min("n").alias("min"), F.max("n").alias("max"))
