"""Stratified samples that any engine reproduces: the order is by MD5 of seed and key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(df: DataFrame, stratum: str, key: str, n: int, seed: int = 42, sub: int = 64) -> DataFrame:
    """n rows of each stratum, all where there are fewer.

    A first pass keeps the n smallest of each of `sub` parts of a stratum, dealt by hash: a stratum that holds a third of
    all rows is no single task, and what the second pass ranks is at most n * sub rows of a stratum.
    """
    rows = df.withColumn("__o", draw_order(key, seed)).withColumn("__p", F.pmod(F.xxhash64("__o"), F.lit(sub)))
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum, "__p").orderBy("__o", key))).where(F.col("__r") <= n)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(stratum).orderBy("__o", key))).where(F.col("__r") <= n)
    return rows.drop("__o", "__p", "__r")


def pairs(pair_table: DataFrame, n: int, seed: int = 42, stratum: str = "cell_type", key: str = "rna_cell") -> DataFrame:
    """The sampled pairs with new names cell_0, cell_1, ... in order of (stratum, key); the sample bounds the sort."""
    s = stratified(pair_table, stratum, key, n, seed)
    return s.withColumn("name", F.concat(F.lit("cell_"), F.row_number().over(Window.orderBy(stratum, key)) - 1))


def per_donor(df: DataFrame, donor: str, key: str, total: int = 200_000, seed: int = 0) -> DataFrame:
    """All rows where there are total or fewer; else total // donors rows of each donor, one at least."""
    if df.count() <= total:
        return df
    donors = df.select(donor).distinct().count()
    return stratified(df, donor, key, max(1, total // max(1, donors)), seed)
