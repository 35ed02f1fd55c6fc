"""Normalizations of the long count table; zeros stay absent throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _cell() -> WindowSpec:
    return Window.partitionBy("cell_id")


def total(counts: DataFrame, target: float = 1e4) -> DataFrame:
    """Each cell scaled to the target; a cell that sums to 0 keeps its zeros."""
    s = F.sum("value").over(_cell())
    return counts.withColumn("value", F.coalesce(F.try_divide(F.col("value") * F.lit(target), s), F.lit(0.0)))


def log1p(counts: DataFrame) -> DataFrame:
    return counts.withColumn("value", F.log1p("value"))


def tfidf(counts: DataFrame, n_cells: int, scale: float = 1e4) -> DataFrame:
    """log1p(scale * count / cell sum) * log1p(cells / feature sum)."""
    idf = counts.groupBy("feature_id").agg(F.sum("value").alias("s")).select("feature_id", F.log1p(F.lit(float(n_cells)) / F.col("s")).alias("idf"))
    tf = counts.withColumn("tf", F.log1p(F.col("value") * F.lit(scale) / F.sum("value").over(_cell())))
    return tf.join(idf, "feature_id").select("cell_id", "feature_id", (F.col("tf") * F.col("idf")).alias("value"))


def moments(counts: DataFrame, n_cells: int) -> DataFrame:
    """feature_id, mean, var (ddof 1) over all cells, absent rows being zeros."""
    return with_moments(counts.groupBy("feature_id").agg(*sums()), n_cells).select("feature_id", "mean", "var")


def sums() -> list[Column]:
    return [F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q")]


def with_moments(features: DataFrame, n_cells: int) -> DataFrame:
    """The rows, which have sums(), with mean and var."""
    n = F.lit(float(n_cells))
    mean = F.col("s") / n
    return features.select("*", mean.alias("mean"), F.greatest(F.lit(0.0), (F.col("q") - n * mean * mean) / (n - 1)).alias("var"))


def scaled(counts: DataFrame, n_cells: int, clip: float | None = None) -> DataFrame:
    """z-scores of the stored values, with the z-score of a zero beside them (zero_value), so that nothing is densified."""
    m = moments(counts, n_cells).where("var > 0").withColumn("sd", F.sqrt("var"))
    z = lambda x: (x - F.col("mean")) / F.col("sd")
    top = (lambda c: F.least(F.lit(clip), c)) if clip is not None else (lambda c: c)
    return counts.join(m, "feature_id").select("cell_id", "feature_id", top(z(F.col("value"))).alias("value"), top(z(F.lit(0.0))).alias("zero_value"))
