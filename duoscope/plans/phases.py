"""The phases from counts to triplets, as lazy plans over DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions.names import standardize_peak
from duoscope.functions.tables import cut, release
from duoscope.operators import communities, correlate, donors, embed, filters, harmony, hvg, intervals, motifs, neighbors, normalize, qc, sampling, triplets
from duoscope.sources.readers import peak_sequences


@dataclass
class Relations:
    overlaps: DataFrame
    correlated: DataFrame
    matches: DataFrame
    triplets: DataFrame
    labels: DataFrame
    peaks: DataFrame
    matrix: DataFrame


def relate(
    genes: DataFrame, gene_set: DataFrame, rna: DataFrame, atac: DataFrame, cells: DataFrame, peak_names: DataFrame, motif_db: DataFrame | None = None, pwm: DataFrame | None = None, genome: DataFrame | None = None,
    matches: DataFrame | None = None, upstream: int = 250_000, downstream: int = 250_000, threshold: float = 0.1, motif_p: float = motifs.MOTIF_P, noise_sd: float = 1e-5, seed: int = 42,
) -> Relations:
    """Overlaps, correlated pairs, motif hits, triplets, labels, peak table and model matrix.

    The correlated pairs feed three branches and are written; only their peaks are scanned. Without motifs the triplets
    are a typed empty table, and every gene is a target.
    """
    spark = genes.sparkSession
    overlaps = intervals.peak_gene_overlaps(genes, peak_names, gene_set, upstream, downstream)
    correlated = cut(correlate.filter_by_correlation(overlaps, rna, atac, cells, threshold, meet=intervals.meetings(genes, peak_names, gene_set, upstream, downstream)), "correlated")
    peaks = correlated.select("peak").distinct()
    if matches is None and motif_db is not None and pwm is not None and genome is not None:
        chosen = triplets.select_motifs(motif_db, gene_set).select(F.col("Accession").alias("motif_id"))
        pwm = pwm.join(chosen, "motif_id", "left_semi")
        seqs = peak_sequences(intervals.peak_table(peaks), genome)
        matches = motifs.scan(seqs, pwm, motifs.exact_thresholds(pwm, motif_p))
    if matches is None or motif_db is None:
        matches = spark.createDataFrame([], "motif_id string, peak string")
        tfs = spark.createDataFrame([], "motif_id string, TF string")
    else:
        tfs = triplets.motif_tfs(motif_db, gene_set)
    found = triplets.relate(correlated, matches, tfs)
    labels = triplets.label_genes(found, gene_set)
    info = triplets.peak_info(correlated.withColumn("pair_ix", F.struct("gene", "peak")))
    matrix = triplets.peak_vectors(triplets.peak_matrix(cells, peaks, atac, noise_sd, seed), cells)
    return Relations(overlaps, correlated, matches, found, labels, info, matrix)


def subsample(rna: DataFrame, atac: DataFrame, cells: DataFrame, features: DataFrame, n_per_type: int = 100, n_genes: int = 500, n_peaks: int = 10_000, seed: int = 42, embedding: DataFrame | None = None, k: int = 20) -> dict[str, DataFrame]:
    """Cells drawn once and used for both modalities, variable genes and chr peaks, and neighbours of the drawn cells.

    rna, atac: cell_id, feature_id, value; cells: cell_id, cell_type; features: feature_id, feature_name.
    """
    chosen = cut(sampling.stratified(cells, "cell_type", "cell_id", n_per_type, seed), "drawn")
    n = chosen.count()
    chr_only = filters.chr_features(features).select("feature_id")
    r, a = rna.join(chosen.select("cell_id"), "cell_id", "left_semi"), atac.join(chosen.select("cell_id"), "cell_id", "left_semi").join(chr_only, "feature_id", "left_semi")
    genes, peaks = hvg.select_variable(r, n, n_genes, 0.3), hvg.select_variable(a, n, n_peaks, 0.5)
    out = {"cells": chosen, "rna": r.join(genes.select("feature_id"), "feature_id", "left_semi"), "atac": a.join(peaks.select("feature_id"), "feature_id", "left_semi")}
    if embedding is not None:
        e = embedding.join(chosen.select("cell_id"), "cell_id", "left_semi").select(F.col("cell_id").alias("id"), "vec")
        out["neighbors"] = neighbors.knn(e, k)
    return out


def integrate_paired(rna: DataFrame, atac: DataFrame, n_hvgs: int = 2000, n_pcs: int = 20, k: int = 20, cells: DataFrame | None = None, batch: str | None = None) -> dict[str, DataFrame]:
    """Joint embedding, weighted neighbours and their top-k lists, of cells with both modalities."""
    cells = rna.select("cell_id").union(atac.select("cell_id")).distinct() if cells is None else cells
    n = cells.count()
    x = rna.join(filters.detected_features(rna, 3), "feature_id", "left_semi")
    logged = normalize.log1p(normalize.total(x))
    top = hvg.select_by_dispersion(logged, cells, batch, n_hvgs) if batch else hvg.select_variable(x, n, n_hvgs)
    r = embed.pca(logged.join(top.select("feature_id"), "feature_id", "left_semi"), max(n_pcs, 2))
    a = embed.lsi(normalize.tfidf(atac.join(filters.positive_sum_features(atac), "feature_id", "left_semi"), n), max(n_pcs, 2))
    from duoscope.functions.vectors import joint, l2_normalize

    r, a = r.select(F.col("cell_id").alias("id"), l2_normalize(F.col("vec")).alias("vec")), a.select(F.col("cell_id").alias("id"), l2_normalize(F.col("vec")).alias("vec"))
    both = r.join(a.withColumnRenamed("vec", "w"), "id").select("id", joint(F.col("vec"), F.col("w"), n_pcs).alias("vec"))
    w = cut(neighbors.wnn(cut(r, "vectors"), cut(a, "vectors"), k), "neighbors")
    return {"embedding": both, "neighbors": w, "lists": neighbors.top_k(w, k)}


def clusters(paired: dict[str, DataFrame], resolution: float = 0.8) -> DataFrame:
    """id, cluster of the neighbour graph that integrate_paired() returns: Leiden's communities at the resolution."""
    return communities.leiden(paired["neighbors"].select("src", "dst", "weight"), resolution)


def integrate_unpaired(rna: DataFrame, atac: DataFrame, rna_cells: DataFrame, atac_cells: DataFrame, genes: DataFrame, n_hvgs: int = 2000, n_pcs: int = 50, dims: int = 20, lam: float = 1.0, least_shared: int = 200, min_cells: int = 50) -> dict[str, DataFrame]:
    """Gene activity, shared variable genes, one embedding of both modalities, batch correction, and pairs per donor.

    rna: cell_id, gene, value; atac: cell_id, peak, value; *_cells: cell_id, donor_id, cell_type. Cell ids of the two
    modalities are told apart by a prefix within the joint embedding. Totals are taken after the genes are subset. The variable
    genes are those of all cells: sums of a gene cost no more memory, however many cells there are.

    The counts of either modality are made once and written, as several steps read them; cells and donors are written
    too, so that Spark knows how few they are beside the counts.
    """
    usable = cut(donors.classify(rna_cells, atac_cells, min_cells=min_cells), "donors")
    good = usable.where("has_both").select("donor_id")
    rc, ac = (cut(c.join(good, "donor_id", "left_semi"), "cells") for c in (rna_cells, atac_cells))
    a = cut(atac.join(ac.select("cell_id"), "cell_id", "left_semi"), "counts")
    peaks = cut(a.select("peak").distinct(), "peaks")  # else names would be parsed for each count, before they are distinct
    activity = cut(intervals.gene_activity(a, intervals.body_overlaps(genes, peaks)), "activity")
    release(a, peaks)
    r = cut(rna.join(rc.select("cell_id"), "cell_id", "left_semi").withColumnRenamed("gene", "feature_id"), "counts")
    top = hvg.select_variable(r, rc.count(), n_hvgs).select("feature_id")
    shared = cut(top.intersect(activity.select(F.col("gene").alias("feature_id")).distinct()), "shared")
    if (n := shared.count()) < least_shared:
        raise ValueError(f"{n} shared genes; {least_shared} are wanted")
    tag = lambda d, m: d.select(F.concat(F.lit(f"{m}:"), F.col("cell_id").cast("string")).alias("cell_id"), "feature_id", "value")
    of = lambda d: d.join(shared, "feature_id", "left_semi")
    both = [normalize.log1p(normalize.total(d)) for d in (tag(of(r), "rna"), tag(of(activity.withColumnRenamed("gene", "feature_id")), "atac"))]
    e, _ = embed.svd(both[0].union(both[1]), n_pcs)
    e = e.select("cell_id", F.element_at(F.split("cell_id", ":"), 1).alias("batch"), F.slice("vec", 1, dims).alias("vec"))
    e = cut(e, "embedding")  # each iteration reads it
    release(r, activity)
    h = harmony.harmony(e, lam=lam).withColumn("m", F.element_at(F.split("cell_id", ":"), 1)).withColumn("cell", F.regexp_replace("cell_id", "^[a-z]+:", ""))
    side = lambda m, c: h.where(F.col("m") == m).join(c.select(F.col("cell_id").cast("string").alias("cell"), "donor_id", "cell_type"), "cell").select(F.col("cell").alias("cell_id"), "donor_id", "cell_type", "vec")
    pairs = neighbors.cross_modal(side("rna", rc), side("atac", ac))
    return {"embedding": h.select("cell_id", "vec"), "pairs": pairs, "donors": donors.pair_summary(usable, pairs)}


def load_and_filter(cells: DataFrame, rna: DataFrame, atac: DataFrame, features: DataFrame, labels: DataFrame, mapping: dict[str, str], **bounds) -> dict[str, DataFrame]:
    """Quality filter (bounds as of qc_filter()), cells of both modalities, mapped labels; cells without one are out."""
    from duoscope.functions.names import map_labels

    good = qc.qc_filter(qc.qc_metrics(cells, rna, features), **bounds).select("cell_id")
    both = good.join(atac.select("cell_id").distinct(), "cell_id", "left_semi")
    kept = both.join(labels, "cell_id").withColumn("cell_type", map_labels(F.col("label"), mapping)).where("cell_type is not null")
    ids = kept.select("cell_id")
    return {"cells": kept, "rna": rna.join(ids, "cell_id", "left_semi"), "atac": atac.join(ids, "cell_id", "left_semi")}


def standard_peaks(names: DataFrame, col: str = "peak") -> DataFrame:
    return names.withColumn(col, standardize_peak(F.col(col), strict=False)).where(F.col(col).isNotNull())
