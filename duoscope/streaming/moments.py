"""Running feature moments over arriving batches of counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_sums(stream: DataFrame) -> DataFrame:
    """feature_id, s, q, nnz: sums that merge, kept by Structured Streaming as state per feature; stream: feature_id, value."""
    return stream.groupBy("feature_id").agg(F.sum("value").alias("s"), F.sum(F.col("value") * F.col("value")).alias("q"), F.count_if(F.col("value") != 0).alias("nnz"))


def windowed_counts(stream: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, key, n per tumbling window; rows later than `late` behind the watermark are not counted."""
    w = stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return w.select(F.col("w.start").alias("window_start"), "key", "n")


def finish(sums: DataFrame, n_cells: int) -> DataFrame:
    """feature_id, mean, var (ddof 1), nnz of what has come so far."""
    n = F.lit(float(n_cells))
    mean = F.col("s") / n
    return sums.select("feature_id", mean.alias("mean"), F.greatest(F.lit(0.0), (F.col("q") - n * mean * mean) / (n - 1)).alias("var"), "nnz")
