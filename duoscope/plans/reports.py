"""Reports on loaded tables: columns, label counts, donors, coordinates and gene panels, as small DataFrames."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.operators import qc

#: Columns that tell of the state of the disease, the first that is there counts.
COVARIATES = ("Overall AD neuropathological Change", "Continuous Pseudo-progression Score", "ADNC")


def columns_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """table, position, column, type of every column; no table is read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, i, c, kind) for t, df in tables.items() for i, (c, kind) in enumerate(df.dtypes)]
    return spark.createDataFrame(rows, "table string, position int, column string, type string")


def label_counts(cells: DataFrame, cols: Sequence[str]) -> DataFrame:
    """column, value, n, place, others: the most and least frequent values of each column (see value_counts_preview())."""
    one = lambda c: qc.value_counts_preview(cells.select(F.col(c).cast("string").alias("v")), "v").select(F.lit(c).alias("column"), "value", "n", "place", "others")
    return reduce(DataFrame.union, map(one, cols))


def qc_summary(splits: Mapping[str, DataFrame], donor: str = "donor_id", label: str = "cell_type") -> DataFrame:
    """split, item, value, n: cells, donors, label counts, and the first covariate that is there (counts, or mean and range)."""

    def one(name: str, df: DataFrame) -> list[DataFrame]:
        row = lambda item, d: d.select(F.lit(name).alias("split"), F.lit(item).alias("item"), F.col("value").cast("string").alias("value"), F.col("n").cast("double").alias("n"))
        out = [row("cells", df.agg(F.lit(None).alias("value"), F.count("*").alias("n")))]
        if donor in df.columns:
            out.append(row("donors", df.agg(F.lit(None).alias("value"), F.countDistinct(donor).alias("n"))))
        if label in df.columns:
            out.append(row("label", qc.value_counts(df, label)))
        for c in COVARIATES:
            if c in df.columns:
                if dict(df.dtypes)[c] == "string":
                    out.append(row(c, qc.value_counts(df, c)))
                else:
                    s = qc.covariate_summary(df, f"`{c}`")
                    out.append(row(c, s.select(F.explode(F.array(*(F.struct(F.lit(k).alias("value"), F.col(k).cast("double").alias("n")) for k in ("mean", "min", "max")))).alias("s")).select("s.*")))
                break
        return out

    return reduce(DataFrame.union, [x for name, df in splits.items() for x in one(name, df)])


def coordinate_ranges(cells: DataFrame, vec: str = "spatial") -> DataFrame:
    """dim, min, max, mean of each dimension of a coordinate column."""
    x = cells.select(F.posexplode(vec).alias("dim", "x"))
    return x.groupBy("dim").agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"))


def panel(features: DataFrame, name: str = "feature_name", blank: str = "Blank-") -> DataFrame:
    """features, genes, blanks: a panel's real features and its blank controls."""
    is_blank = F.col(name).startswith(blank)
    return features.agg(F.count("*").alias("features"), F.count_if(~is_blank).alias("genes"), F.count_if(is_blank).alias("blanks"))


def largest_section(cells: DataFrame, section: str, vec: str, layer: str, label: str, top: int = 6) -> DataFrame:
    """x, y, layer, label of the cells of the section with the most cells: rarer labels are "other", missing layers too."""
    best = qc.largest_groups(cells, section, 1).select(F.col("value").alias(section))
    x = cells.join(best, section, "left_semi")
    x = qc.top_categories(x.select(vec, layer, label), label, top)
    return x.select(F.col(vec)[0].alias("x"), F.col(vec)[1].alias("y"), F.coalesce(layer, F.lit("other")).alias("layer"), F.col(label).alias("label"))


def share_of_labels(cells: DataFrame, label: str, wanted: Sequence[str]) -> DataFrame:
    """n, share of the cells with one of the labels."""
    return cells.agg(F.count_if(F.col(label).isin(list(wanted))).alias("n"), F.avg(F.col(label).isin(list(wanted)).cast("double")).alias("share"))
