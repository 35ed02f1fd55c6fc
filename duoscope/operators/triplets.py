"""TF, peak and target gene triplets, gene labels and peak tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions.names import split_tfs


def motif_tfs(motif_db: DataFrame, gene_set: DataFrame) -> DataFrame:
    """Distinct (motif_id, TF) with TFs of the gene set, names stripped."""
    tf = motif_db.select(F.col("Accession").alias("motif_id"), F.explode(split_tfs(F.col("TFs"))).alias("TF"))
    return tf.join(gene_set.select(F.col(gene_set.columns[0]).alias("TF")), "TF", "left_semi").select("motif_id", "TF").distinct()


def tf_peaks(matches: DataFrame, tfs: DataFrame) -> DataFrame:
    """Distinct (TF, peak). Peaks of the same motifs have the same TFs, so each set of motifs is made distinct once, and the
    pairs themselves, which are the product of peaks and TFs of a motif, need no shuffle."""
    sets = matches.groupBy("peak").agg(F.array_sort(F.collect_set("motif_id")).alias("motifs"))
    each = sets.select("motifs").distinct().select("motifs", F.explode("motifs").alias("motif_id"))
    of = each.join(tfs, "motif_id").groupBy("motifs").agg(F.collect_set("TF").alias("of"))
    return sets.join(of, "motifs").select(F.explode("of").alias("TF"), "peak")


def relate(correlated: DataFrame, matches: DataFrame, tfs: DataFrame) -> DataFrame:
    """assemble() of the motifs' TFs; only matches in correlated peaks are expanded."""
    wanted = matches.join(correlated.select("peak").distinct(), "peak", "left_semi")
    return assemble(correlated, tf_peaks(wanted, tfs))


def assemble(correlated: DataFrame, tf_peak: DataFrame) -> DataFrame:
    """target_gene, peak, spearman_r, TF; a gene isn't its own target. Without matches a typed empty table."""
    rows = correlated.join(tf_peak, "peak").where(F.col("TF") != F.col("gene"))
    return rows.select(F.col("gene").alias("target_gene"), "peak", "spearman_r", "TF")


def label_genes(triplets: DataFrame, gene_set: DataFrame) -> DataFrame:
    """gene, type (TF if it acts as one in a triplet, else target), associated_peaks, associated_TFs (sorted, distinct)."""
    genes = gene_set.select(F.col(gene_set.columns[0]).alias("gene"))
    packed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    per = triplets.groupBy(F.col("target_gene").alias("gene")).agg(packed("peak").alias("associated_peaks"), packed("TF").alias("associated_TFs"))
    acting = triplets.select(F.col("TF").alias("gene")).distinct().withColumn("acts", F.lit(True))
    rows = genes.join(acting, "gene", "left").join(per, "gene", "left")
    return rows.select("gene", F.when(F.col("acts"), "TF").otherwise("target").alias("type"), F.coalesce("associated_peaks", F.lit("")).alias("associated_peaks"), F.coalesce("associated_TFs", F.lit("")).alias("associated_TFs"))


def peak_info(correlated: DataFrame, order: str = "pair_ix") -> DataFrame:
    """peak, associated_genes: comma-joined in the order of the pairs, repeats kept."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, "gene"))), lambda s: s["gene"])
    return correlated.groupBy("peak").agg(F.array_join(listed, ",").alias("associated_genes"))


def select_motifs(motif_db: DataFrame, gene_set: DataFrame) -> DataFrame:
    """Motifs of which any TF is in the gene set. Names aren't stripped here: "A; B" offers "A" and " B"."""
    tf = motif_db.select("Accession", F.explode(split_tfs(F.col("TFs"), strip=False)).alias("TF"))
    hit = tf.join(gene_set.select(F.col(gene_set.columns[0]).alias("TF")), "TF", "left_semi").select("Accession").distinct()
    return motif_db.join(hit, "Accession", "left_semi")


def peak_matrix(cells: DataFrame, peaks: DataFrame, atac: DataFrame, noise_sd: float = 0.0, seed: int = 42) -> DataFrame:
    """(cell_id, peak, value): the dense grid of cells and (sorted, distinct) peaks, absent counts 0, plus noise.

    The grid is as large as the matrix that model training wants: cells times correlated peaks.
    """
    grid = cells.select("cell_id").crossJoin(peaks.select("peak").distinct())
    rows = grid.join(atac.select("cell_id", "peak", "value"), ["cell_id", "peak"], "left").withColumn("value", F.coalesce(F.col("value").cast("double"), F.lit(0.0)))
    return rows.withColumn("value", F.col("value") + F.randn(seed) * noise_sd) if noise_sd else rows


def peak_vectors(matrix: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """cell_id, peaks ARRAY<DOUBLE> in the order of the peak names. cells: those that have a row even where there is no peak."""
    rows = matrix.groupBy("cell_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("peak", "value"))), lambda s: s["value"]).alias("peaks"))
    if cells is None:
        return rows
    rows = cells.select("cell_id").distinct().join(rows, "cell_id", "left")
    return rows.select("cell_id", F.coalesce("peaks", F.array().cast("array<double>")).alias("peaks"))
