"""Row and feature filters over the long count table (absent rows are zeros)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Names of layers with raw counts, in the order in which they are looked for.
RAW_LAYERS = ("UMIs", "UMI", "raw", "counts", "raw_counts")


def chr_features(features: DataFrame, col: str = "feature_name") -> DataFrame:
    return features.where(F.col(col).startswith("chr"))


def by_feature_type(features: DataFrame, kind: str, col: str = "feature_type") -> DataFrame:
    return features.where(F.col(col) == kind)


def isin(df: DataFrame, col: str, wanted: DataFrame | Sequence) -> DataFrame:
    """Rows whose value is wanted: a list in the plan, or a semi-join with a table of one column."""
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(wanted.columns[0]).alias(col)), col, "left_semi")
    return df.where(F.col(col).isin(list(wanted)))


def multiome(df: DataFrame, value: str = "10xMulti", col: str = "method", other: bool = False) -> DataFrame:
    """Rows of the paired method, or the others; a missing method is another one."""
    same = F.col(col).eqNullSafe(value)
    return df.where(~same if other else same)


def positive_sum_features(counts: DataFrame) -> DataFrame:
    """feature_id of features whose counts sum to more than 0."""
    return counts.groupBy("feature_id").agg(F.sum("value").alias("total")).where("total > 0").select("feature_id")


def detected_features(counts: DataFrame, min_cells: int = 3) -> DataFrame:
    """feature_id of features with a positive count in min_cells cells or more."""
    return counts.groupBy("feature_id").agg(F.count_if(F.col("value") > 0).alias("n")).where(F.col("n") >= min_cells).select("feature_id")


def select_by_name(features: DataFrame, names: DataFrame, col: str = "feature_name") -> DataFrame:
    """The listed features with their place in the list; names: (pos, name). Names without a feature are left out."""
    return features.join(names.select(F.col("name").alias(col), "pos"), col)


def resolve_layer(counts: DataFrame, available: Sequence[str], cells: int = 500) -> tuple[DataFrame, bool]:
    """The counts of the first raw layer there is, else of X; and whether they look like raw counts.

    X passes if the stored values of the first cells are whole within 1e-8 + 1e-5 |round|.
    """
    for layer in RAW_LAYERS:
        if layer in available:
            return counts.where(F.col("layer") == layer), True
    x = counts.where(F.col("layer") == "X")
    return x, whole_numbers(x.where(F.col("cell_ix") < cells)).first()["whole"]


def whole_numbers(counts: DataFrame) -> DataFrame:
    """One row: whether all values are whole; true without any."""
    v, r = F.col("value"), F.round("value")
    near = F.abs(v - r) <= F.lit(1e-8) + F.abs(r) * 1e-5
    return counts.agg(F.coalesce(F.bool_and(near), F.lit(True)).alias("whole"))


def misaligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """(cell_ix, cell_id) rows that only one side has; none if both have the same cells in the same order."""
    x, y = a.select("cell_ix", "cell_id").withColumn("l", F.lit(1)), b.select("cell_ix", "cell_id").withColumn("r", F.lit(1))
    return x.join(y, ["cell_ix", "cell_id"], "full_outer").where("l is null or r is null").select("cell_ix", "cell_id")


def realign(b: DataFrame, a: DataFrame) -> DataFrame:
    """b's rows for a's cells, in a's order (cell_ix)."""
    return b.drop("cell_ix").join(a.select("cell_id", "cell_ix"), "cell_id")
