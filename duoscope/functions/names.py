"""Peak names, attribute strings, packed lists and keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PEAK_RE = r"^(chr\w+)[:-](\d+)-(\d+)$"


def parse_peak(name: Column) -> Column:
    """STRUCT<chrom, start, end> of "chr1:100-200" or "chr1-100-200"; null for anything else."""
    part = [F.regexp_extract(name, PEAK_RE, i) for i in (1, 2, 3)]
    ends = [p.try_cast("bigint") for p in part[1:]]
    found = F.struct(part[0].alias("chrom"), ends[0].alias("start"), ends[1].alias("end"))
    return F.when(name.rlike(PEAK_RE), found)


def standardize_peak(name: Column, strict: bool = True) -> Column:
    """"chrom:start-end"; a bad name raises (strict) or gives null."""
    p = parse_peak(name)
    good = F.concat(p["chrom"], F.lit(":"), p["start"], F.lit("-"), p["end"])
    if not strict:
        return good
    return F.when(p.isNotNull(), good).otherwise(F.raise_error(F.concat(F.lit("bad peak name: "), F.coalesce(name, F.lit("null")))))


def peaks_to_table(peaks: DataFrame, col: str = "peak") -> DataFrame:
    """Chromosome, Start, End, Name; names that don't parse are left out."""
    rows = peaks.select(F.col(col).alias("Name"), parse_peak(F.col(col)).alias("p")).where("p is not null")
    return rows.select(F.col("p.chrom").alias("Chromosome"), F.col("p.start").alias("Start"), F.col("p.end").alias("End"), "Name")


def gtf_attribute(attributes: Column, key: str) -> Column:
    """The text between the first quotes after `key` in a GTF attribute string; null without one."""
    found = F.regexp_extract(attributes, rf'(?:^|;)\s*{key} "([^"]*)', 1)
    return F.nullif(found, F.lit(""))


def split_tfs(packed: Column, strip: bool = True) -> Column:
    """The names of a ;-packed list, without empty ones."""
    parts = F.split(packed, ";")
    if strip:
        parts = F.transform(parts, lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def composite_key(*cols: Column) -> Column:
    """col1:col2:...; a null part reads "nan", as text made of missing values does."""
    return F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("nan")) for c in cols))


def stringify_missing(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("nan"))


def uniquify(df: DataFrame, name: str, order: str) -> DataFrame:
    """Repeats of a name get -1, -2, ... in the given order; the first stays."""
    r = F.row_number().over(Window.partitionBy(name).orderBy(order))
    return df.withColumn("__r", r - 1).withColumn(name, F.when(F.col("__r") > 0, F.concat(F.col(name), F.lit("-"), F.col("__r"))).otherwise(F.col(name))).drop("__r")


def map_labels(label: Column, mapping: dict[str, str]) -> Column:
    """The mapped label; null where the mapping has none."""
    if not mapping:
        return F.lit(None).cast("string")
    return F.element_at(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]), label)


def first_existing(df: DataFrame, candidates: Sequence[str]) -> str | None:
    return next((c for c in candidates if c in df.columns), None)
