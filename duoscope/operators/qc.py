"""Per-cell quality metrics and label counts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def qc_metrics(cells: DataFrame, counts: DataFrame, features: DataFrame, mt: Column | None = None) -> DataFrame:
    """cell_id, n_genes, total_counts, pct_mt; cells without counts have zeros (and no percentage)."""
    mt = F.col("feature_name").startswith("MT-") if mt is None else mt
    c = counts.join(features.select("feature_id", mt.alias("is_mt")), "feature_id")
    per = c.groupBy("cell_id").agg(F.count_if(F.col("value") > 0).alias("n_genes"), F.sum("value").alias("total_counts"), F.sum(F.when(F.col("is_mt"), F.col("value")).otherwise(0)).alias("mt"))
    rows = cells.select("cell_id").join(per, "cell_id", "left")
    pct = F.try_divide(F.col("mt") * 100.0, F.col("total_counts"))
    return rows.select("cell_id", F.coalesce("n_genes", F.lit(0)).alias("n_genes"), F.coalesce(F.col("total_counts").cast("double"), F.lit(0.0)).alias("total_counts"), pct.alias("pct_mt"))


def qc_filter(metrics: DataFrame, min_genes: int = 200, max_genes: int = 4500, max_pct_mt: float = 15.0) -> DataFrame:
    """Strictly between the bounds; a cell without a percentage fails."""
    return metrics.where((F.col("n_genes") > min_genes) & (F.col("n_genes") < max_genes) & (F.col("pct_mt") < max_pct_mt))


def value_counts(df: DataFrame, col: str, dropna: bool = True) -> DataFrame:
    rows = df.where(F.col(col).isNotNull()) if dropna else df
    return rows.groupBy(F.col(col).alias("value")).agg(F.count("*").alias("n"))


def value_counts_preview(df: DataFrame, col: str, all_up_to: int = 30, top: int = 15, bottom: int = 5) -> DataFrame:
    """value, n, place, others: all values if there are few, else the most and the least frequent and how many more.

    The counts are one row a value, and only as many as are shown are ranked: two bounded top-k, no global sort.
    """
    n = value_counts(df, col)
    total = n.agg(F.count("*").alias("values"))
    up = n.orderBy(F.desc("n"), "value").limit(all_up_to).withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "value")))
    down = n.orderBy("n", F.desc("value")).limit(bottom).withColumn("back", F.row_number().over(Window.orderBy("n", F.desc("value"))))
    rows = up.crossJoin(total).where((F.col("values") <= all_up_to) | (F.col("place") <= top)).select("value", "n", "place", "values")
    rest = down.crossJoin(total).where(F.col("values") > all_up_to).select("value", "n", (F.col("values") - F.col("back") + 1).cast("int").alias("place"), "values")
    return rows.union(rest).select("value", "n", "place", F.when(F.col("values") > all_up_to, F.col("values") - top - bottom).otherwise(0).alias("others"))


def crosstab(df: DataFrame, rows: str, cols: str) -> DataFrame:
    """Long form: row, col, n, and the share of the row."""
    n = df.groupBy(F.col(rows).alias("row"), F.col(cols).alias("col")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("row")))


def crosstab_wide(df: DataFrame, rows: str, cols: str, values: list) -> DataFrame:
    return df.groupBy(F.col(rows).alias("row")).pivot(cols, values).agg(F.count(F.lit(1))).fillna(0)


def check_expected(df: DataFrame, col: str, expected: DataFrame) -> DataFrame:
    """label, expected, observed (0 if absent), status OK or MISMATCH; expected: (label, expected)."""
    seen = value_counts(df, col).select(F.col("value").alias("label"), F.col("n").alias("observed"))
    rows = expected.join(seen, "label", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    return rows.withColumn("status", F.when(F.col("observed") == F.col("expected"), "OK").otherwise("MISMATCH"))


def feature_sums(counts: DataFrame) -> DataFrame:
    return counts.groupBy("feature_id").agg(F.sum("value").alias("total"), F.count_if(F.col("value") != 0).alias("nnz"))


def quantiles(counts: DataFrame, at: tuple[float, ...] = (0.5, 0.9, 0.99, 0.999, 1.0), bins: int = 4096) -> DataFrame:
    """(q, value) of the non-zero counts, exact with linear interpolation; null without any.

    No task holds the distinct values: each round counts `bins` equal parts of the intervals in which wanted ranks lie, and
    goes on with the parts that hold them, until such a part holds one value. A round is one scan with map-side sums, and
    narrows an interval 4096 times: a double is settled after six rounds at most, whole numbers after one or two.
    """
    x = counts.where("value <> 0").select(F.col("value").cast("double").alias("v"))
    n, lo, hi = x.agg(F.count("*"), F.min("v"), F.max("v")).first()
    spark = counts.sparkSession
    if not n:
        return spark.createDataFrame([(q, None) for q in at], "q double, value double")
    place = {q: q * (n - 1) for q in at}
    found: dict[int, float] = {}
    # intervals [lo, hi] with the number of values below them, and the ranks (from 0) sought in them
    todo = [(lo, hi, 0, {r for p in place.values() for r in (math.floor(p), math.ceil(p))})]
    while todo:
        places = []
        for i, (a, b, _, _) in enumerate(todo):
            step = (b - a) / bins
            part = F.least(F.lit(bins - 1), F.floor((F.col("v") - a) / step)).cast("int") if step > 0 else F.lit(0)
            places.append(F.when((F.col("v") >= a) & (F.col("v") <= b), F.struct(F.lit(i).alias("i"), part.alias("b"))))
        counted = x.select(F.coalesce(*places).alias("at"), "v").where("at is not null").groupBy("at").agg(F.count("*").alias("c"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        rows, further = sorted((r["at"]["i"], r["at"]["b"], r["c"], r["lo"], r["hi"]) for r in counted.collect()), []
        for i, (_, _, below, ranks) in enumerate(todo):
            for _, _, c, a, b in (r for r in rows if r[0] == i):
                here = {r for r in ranks if below <= r < below + c}
                if a == b:
                    found |= dict.fromkeys(here, a)
                elif here:
                    further.append((a, b, below, here))
                below += c
        todo = further
    value = {q: found[math.floor(p)] + (found[math.ceil(p)] - found[math.floor(p)]) * (p - math.floor(p)) for q, p in place.items()}
    return spark.createDataFrame([(q, float(value[q])) for q in at], "q double, value double")


def preview(df: DataFrame, order: str, head: int = 10, tail: int = 5) -> DataFrame:
    """The first and the last rows by a column, with their part ("head" or "tail"): two bounded top-k, no global sort."""
    first = df.orderBy(order).limit(head).withColumn("part", F.lit("head"))
    return first.union(df.orderBy(F.desc(order)).limit(tail).withColumn("part", F.lit("tail")))


def top_values(counts: DataFrame, k: int = 10) -> DataFrame:
    """(value, n, pct): the k most frequent non-zero counts."""
    x = counts.where("value <> 0")
    total = x.agg(F.count("*").alias("total"))
    n = x.groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(k)
    return n.crossJoin(total).select("value", "n", (F.col("n") * 100.0 / F.col("total")).alias("pct"))


def sparsity(counts: DataFrame, cells: DataFrame, features: DataFrame) -> DataFrame:
    nnz = counts.agg(F.count_if(F.col("value") != 0).alias("nnz"))
    size = cells.agg(F.count("*").alias("c")).crossJoin(features.agg(F.count("*").alias("f")))
    return nnz.crossJoin(size).select("nnz", (1 - F.col("nnz") / (F.col("c") * F.col("f"))).alias("sparsity"))


def verdict(counts: DataFrame) -> DataFrame:
    """What the stored values look like: raw counts (whole, at most 200), normalized (0 to 20) or ambiguous.

    Whole values of at most 1 count as raw too: the first rule takes them before one for binarized values could.
    """
    v = F.col("value")
    a = counts.agg(F.bool_and(v == F.floor(v)).alias("whole"), F.max(v).alias("max"), F.min(v).alias("min"))
    a = a.select("whole", F.col("max").cast("double").alias("max"), F.col("min").cast("double").alias("min"))
    raw = F.format_string("LIKELY RAW COUNTS (integer, max=%.0f)", "max")
    normalized = F.format_string("LIKELY NORMALIZED (float, max=%.4f)", "max")
    other = F.format_string("AMBIGUOUS (int=%s, min=%s, max=%s)", F.initcap(F.col("whole").cast("string")), "min", "max")
    name = F.when(F.col("whole") & (F.col("max") <= 200), raw).when(~F.col("whole") & (F.col("min") >= 0) & (F.col("max") <= 20), normalized).otherwise(other)
    return a.withColumn("verdict", name)


def covariate_summary(df: DataFrame, numeric: str) -> DataFrame:
    return df.agg(F.avg(numeric).alias("mean"), F.min(numeric).alias("min"), F.max(numeric).alias("max"))


def top_categories(df: DataFrame, col: str, k: int = 12) -> DataFrame:
    """The rows with col replaced by "other" outside the k most frequent labels."""
    top = value_counts(df, col).orderBy(F.desc("n"), "value").limit(k).select(F.col("value").alias(col), F.lit(True).alias("__top"))
    return df.join(F.broadcast(top), col, "left").withColumn(col, F.when(F.col("__top"), F.col(col)).otherwise("other")).drop("__top")


def largest_groups(df: DataFrame, col: str, k: int) -> DataFrame:
    return value_counts(df, col).orderBy(F.desc("n"), "value").limit(k)
