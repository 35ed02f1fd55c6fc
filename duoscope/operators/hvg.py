"""Highly variable features: variance stabilized by a fit of log variance on log mean, or binned dispersions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.functions.tables import cut
from duoscope.operators.normalize import sums, with_moments


def local_fit(points: DataFrame, span: float = 0.3, bins: int = 400) -> DataFrame:
    """The points (x, y and any other columns) with `fit`: a local quadratic regression of y on x with tricube weights.

    The points are summed up in `bins` bins of x, each of which stands at the mean of its points; a fit is made at each
    bin, over the bins that hold the nearest `span` of the points, by a 3 x 3 solve of their weighted sums, and lies
    between two fits on a line. One pass over the points makes the bins, another reads off the fits: what is between is
    bins x bins rows, whatever the number of points. Bins that determine no quadratic have their weighted mean as fit.
    """
    ends = points.agg(F.min("x").alias("__lo"), F.max("x").alias("__hi"), F.count("*").alias("__all"))
    step = F.when(F.col("__hi") > F.col("__lo"), (F.col("__hi") - F.col("__lo")) / bins).otherwise(1.0)
    placed = points.crossJoin(ends).withColumn("__bin", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("__lo")) / step)))
    bin_ = cut(placed.groupBy("__bin").agg(F.count("*").alias("n"), F.avg("x").alias("m"), F.avg("y").alias("v"), F.first("__all").alias("n_all"), F.first(step).alias("step")), "bins")
    at, of = bin_.select(F.col("__bin").alias("knot"), F.col("m").alias("c"), "n_all", "step"), bin_.select("__bin", "n", "m", "v")
    pairs = at.crossJoin(of).withColumn("d", F.abs(F.col("m") - F.col("c")))
    upto = F.sum("n").over(Window.partitionBy("knot").orderBy("d", "__bin"))
    pairs = pairs.withColumn("upto", upto).withColumn("k", F.greatest(F.lit(4), F.ceil(F.col("n_all") * span)))
    reach = F.min(F.when(F.col("upto") >= F.least("k", "n_all"), F.col("d"))).over(Window.partitionBy("knot"))
    pairs = pairs.withColumn("h", F.greatest(reach, F.col("step"))).where("d < h")
    u, w = (F.col("m") - F.col("c")) / F.col("h"), F.col("n") * F.pow(1 - F.pow(F.col("d") / F.col("h"), 3), 3)
    sums = pairs.groupBy("knot", "c").agg(*(F.sum(w * F.pow(u, i)).alias(f"s{i}") for i in range(5)), *(F.sum(w * F.pow(u, i) * F.col("v")).alias(f"t{i}") for i in range(3)))
    det = "(s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2))"
    value = F.expr(f"case when {det} > 1e-9D * s0 * s2 * s4 then (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / {det} else t0 / s0 end")
    order = Window.orderBy("c")  # a row for each bin
    fits = sums.select("knot", "c", value.alias("a"))
    for name, beside in (("after", F.lead), ("before", F.lag)):
        fits = fits.withColumn(f"c_{name}", beside("c").over(order)).withColumn(f"a_{name}", beside("a").over(order))
    line = lambda c, a: F.col("a") + (F.col("x") - F.col("c")) / (F.col(c) - F.col("c")) * (F.col(a) - F.col("a"))
    side = F.when((F.col("x") >= F.col("c")) & F.col("c_after").isNotNull(), line("c_after", "a_after")).when((F.col("x") < F.col("c")) & F.col("c_before").isNotNull(), line("c_before", "a_before"))
    found = placed.join(F.broadcast(fits), F.col("__bin") == F.col("knot"))  # a row for each bin
    return found.select(*points.columns, F.coalesce(side, F.col("a")).alias("fit"))


def fitted_sd(feature_moments: DataFrame, span: float = 0.3) -> DataFrame:
    """The features (feature_id, mean, var and any other columns) with sd_hat: what a local fit of log10 var on log10 mean expects of a feature of that mean."""
    m = feature_moments.where("var > 0 and mean > 0").select("*", F.log10("mean").alias("x"), F.log10("var").alias("y"))
    return local_fit(m, span).select(*feature_moments.columns, F.sqrt(F.pow(F.lit(10.0), F.col("fit"))).alias("sd_hat"))


def standardized_variance(counts: DataFrame, fit: DataFrame, n_cells: int) -> DataFrame:
    """feature_id, norm_var: variance of the counts clipped at mean + sd_hat * sqrt(N), over sd_hat**2."""
    s = counts.join(fit.select("feature_id", "mean", "sd_hat"), "feature_id").withColumn("c", F.least(F.col("value").cast("double"), _limit(n_cells)))
    s = s.groupBy("feature_id", "mean", "sd_hat").agg(F.sum("c").alias("s"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return s.select("feature_id", _norm_var(n_cells))


def _limit(n_cells: int) -> Column:
    return F.col("mean") + F.col("sd_hat") * F.lit(float(n_cells) ** 0.5)


def _norm_var(n_cells: int) -> Column:
    """Of the sums s and q of clipped counts and of their squares."""
    n, mean, sd = float(n_cells), F.col("mean"), F.col("sd_hat")
    return ((F.lit(n) * mean * mean + F.col("q") - 2 * mean * F.col("s")) / (F.lit(n - 1) * sd * sd)).alias("norm_var")


def top_features(scores: DataFrame, n: int, by: str = "norm_var") -> DataFrame:
    """Ties of all but the last bits go by feature_id."""
    return scores.orderBy(F.desc(F.round(by, 9)), "feature_id").limit(n)


def select_variable(counts: DataFrame, n_cells: int, n_features: int, span: float = 0.3, min_cells: int = 3, fit: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The n most variable features by standardized variance of raw counts, among those detected in min_cells cells.

    n_cells are the cells that the counts are of, absent ones included. fit makes sd_hat from moments: fitted_sd() by default,
    or quadratic_fit(). One pass over the counts makes all sums of a feature; a second, without a shuffle while they are few,
    clips the counts of those features that have one beyond their limit.
    """
    fit = fit or (lambda m: fitted_sd(m, span))
    most = F.max(F.coalesce(F.col("value").cast("double"), F.lit(float("inf")))).alias("most")
    of = counts.where("feature_id is not null").groupBy("feature_id").agg(F.count_if(F.col("value") > 0).alias("detected"), *sums(), most)
    of = cut(with_moments(of.where((F.col("detected") >= min_cells) & (F.col("s") > 0)), n_cells), "moments")
    fitted, beyond = cut(fit(of), "fit"), F.col("most") > _limit(n_cells)
    clipped = standardized_variance(counts, cut(fitted.where(beyond), "beyond"), n_cells)
    return top_features(fitted.where(~beyond).select("feature_id", _norm_var(n_cells)).union(clipped), n_features)


def quadratic_fit(feature_moments: DataFrame) -> DataFrame:
    """feature_id, mean, var, sd_hat by one quadratic of log10 var on log10 mean: closed form, so SQL can follow it."""
    m = feature_moments.where("var > 0 and mean > 0").select("*", F.log10("mean").alias("x"), F.log10("var").alias("y"))
    x, y = F.col("x"), F.col("y")
    s = m.agg(F.count("*").cast("double").alias("n"), *(F.sum(F.pow(x, k)).alias(f"x{k}") for k in (1, 2, 3, 4)), *(F.sum(F.pow(x, k) * y).alias(f"y{k}") for k in (0, 1, 2)))
    c = lambda e: F.expr(e)
    det = "(n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x3 * x2) + x2 * (x1 * x3 - x2 * x2))"
    s = s.select(
        c(f"(y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - x3 * y2) + x2 * (y1 * x3 - x2 * y2)) / {det}").alias("a"),
        c(f"(n * (y1 * x4 - x3 * y2) - y0 * (x1 * x4 - x3 * x2) + x2 * (x1 * y2 - y1 * x2)) / {det}").alias("b"),
        c(f"(n * (x2 * y2 - y1 * x3) - x1 * (x1 * y2 - y1 * x2) + y0 * (x1 * x3 - x2 * x2)) / {det}").alias("c"),
    )
    return m.crossJoin(F.broadcast(s)).select(*feature_moments.columns, F.sqrt(F.pow(F.lit(10.0), F.col("a") + F.col("b") * x + F.col("c") * x * x)).alias("sd_hat"))


def dispersions(counts: DataFrame, cells: DataFrame, batch: str, bins: int = 20) -> DataFrame:
    """batch, feature_id, mean, dispersion, z: log(var / mean) of de-logged values, standardized within bins of the mean."""
    sizes = cells.groupBy(F.col(batch).alias("batch")).agg(F.count("*").cast("double").alias("n"))
    x = counts.join(cells.select("cell_id", F.col(batch).alias("batch")), "cell_id").withColumn("v", F.expm1("value"))
    s = x.groupBy("batch", "feature_id").agg(F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q")).join(sizes, "batch").where("n > 1")
    s = s.withColumn("mean", F.col("s") / F.col("n")).withColumn("var", (F.col("q") - F.col("n") * F.col("mean") * F.col("mean")) / (F.col("n") - 1))
    s = s.where("mean > 0 and var > 0").select("batch", "feature_id", F.log1p("mean").alias("mean"), F.ln(F.col("var") / F.col("mean")).alias("dispersion"))
    ends = s.groupBy("batch").agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width: Column = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-12))
    s = s.join(ends, "batch").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("mean") - F.col("lo")) / width)))
    per = s.groupBy("batch", "bin").agg(F.avg("dispersion").alias("m"), F.stddev_samp("dispersion").alias("sd"))
    # a bin of one feature has no spread: its z is 1, as the bin's own dispersion stands for the spread
    z = F.when(F.col("sd").isNull() | (F.col("sd") == 0), F.lit(1.0)).otherwise((F.col("dispersion") - F.col("m")) / F.col("sd"))
    return s.join(per, ["batch", "bin"]).select("batch", "feature_id", "mean", "dispersion", F.round(z, 9).alias("z"))


def select_by_dispersion(counts: DataFrame, cells: DataFrame, batch: str, n_features: int, bins: int = 20) -> DataFrame:
    """feature_id, batches, z: by the number of batches in whose top n a feature is, then by its mean z."""
    d = dispersions(counts, cells, batch, bins)
    d = d.withColumn("r", F.row_number().over(Window.partitionBy("batch").orderBy(F.desc("z"), "feature_id")))
    s = d.groupBy("feature_id").agg(F.count_if(F.col("r") <= n_features).alias("batches"), F.avg("z").alias("z"))
    return s.orderBy(F.desc("batches"), F.desc(F.round("z", 9)), "feature_id").limit(n_features)

