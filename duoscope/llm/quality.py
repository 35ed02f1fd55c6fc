"""Quality rules: repetition within a text, and lines that repeat across the documents of a host."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import cut, map_texts, quoted, text_key, whole_row

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_SPACES = " \t\n\x0b\x0c\r"


def text_measures(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; zeros for null."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, _SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    repeated = 0
    seen = Counter(windows)
    if len(seen) < len(windows):
        upto = 0  # positions before it are counted
        for i, w in enumerate(windows):
            if seen[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def measures(docs: DataFrame, text_col: str, keep: list[Column]) -> DataFrame:
    """The kept columns and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row."""
    return map_texts(docs, keep, text_col, MEASURES, lambda: text_measures)


def _normal(line: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")))


def _line_hash(line: Column) -> Column:
    return F.xxhash64(_normal(line))


def host_lines(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(host, __k1, __k2, line, words, times): each distinct normalised line of each distinct (host, text)."""
    one = docs.select(F.col(host_col).alias("host"), *text_key(F.col(host_col), F.col(text_col)), F.explode(F.split(text_col, "\n")).alias("x"))
    one = one.select("host", "__k1", "__k2", _normal(F.col("x")).alias("x")).where("x <> ''")
    words = F.size(F.split("x", " ")).cast("long")
    return one.groupBy("host", "__k1", "__k2", F.xxhash64("x").alias("line")).agg(F.max(words).alias("words"), F.count("*").alias("times"))


def common_lines(lines: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, line): lines in more than max(min_docs, share * documents of the host) distinct documents of a host."""
    totals = lines.select("host", "__k1", "__k2").distinct().groupBy("host").agg(F.count("*").alias("docs"))
    n = lines.groupBy("host", "line").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    over = n.join(totals.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return over.where(F.col("n") > F.col("docs") * share).select("host", "line")


def line_frequency(docs: DataFrame, text_col: str, host_col: str, min_docs: int, share: float) -> DataFrame:
    """(__k1, __k2, common_words, common): for each distinct (host, text) with common lines, their words and hashes.

    A document counts once for a line however often it has it, and equal texts of one host are one document: a page
    isn't condemned by its own copies. Counting groups by (host, line) with map-side sums, so that a line of a third of
    all rows is a row per task.
    """
    lines = cut(host_lines(docs, text_col, host_col), "lines")
    over = cut(common_lines(lines, min_docs, share), "common")
    hit = lines.join(over.withColumnRenamed("host", "h"), ["line"]).where(F.col("host").eqNullSafe(F.col("h")))
    hit = hit.groupBy("__k1", "__k2").agg(F.sum(F.col("words") * F.col("times")).alias("all_words"), F.collect_set("line").alias("common"))
    # every copy of a text has added its lines once
    copies = docs.select(*text_key(F.col(host_col), F.col(text_col))).groupBy("__k1", "__k2").agg(F.count("*").alias("copies")).where("copies > 1")
    hit = hit.join(copies, ["__k1", "__k2"], "left")
    return hit.select("__k1", "__k2", F.expr("all_words div coalesce(copies, 1)").alias("common_words"), "common")


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_words: int = 50, max_repeat_per_cent: int = 50, min_docs: int = 10, share: float = 0.02, min_left: float = 0.4,
) -> DataFrame:
    """Verdicts, a row per input row: id, measures, base_failed, kept, common_words.

    base_failed: n_words < min_words or 100 * n_repeat_words > max_repeat_per_cent * n_words. Lines (lower-cased, white
    space collapsed) that more than max(min_docs, share * distinct documents of the host) distinct documents of a host
    have are common; a document of which less than min_left of the words are in other lines is depleted. kept: neither.
    A null text has no words, a null host is a host of its own, repeated rows get the same verdict. An empty table gives
    an empty one; other columns are not read.
    """
    base = measures(docs, text_col, [F.col(id_col).alias("doc_id"), *text_key(F.col(host_col), F.col(text_col))])
    found = line_frequency(docs, text_col, host_col, min_docs, share).drop("common")
    out = base.join(found, ["__k1", "__k2"], "left").withColumn("common_words", F.coalesce("common_words", F.lit(0)))
    failed = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_per_cent)
    kept = ~F.col("base_failed") & ((F.col("n_words") - F.col("common_words")) >= F.col("n_words") * min_left)
    return out.withColumn("base_failed", failed).withColumn("kept", kept).drop("__k1", "__k2")


def clean_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", length_col: str = "n_chars", **rules) -> DataFrame:
    """The kept documents with all their columns; common lines are gone from their texts, and n_chars follows.

    The verdicts are those of quality_rules(), found by the key of (host, text), so that null or repeated ids matter
    nothing. A text without common lines stays as it is.
    """
    r = {"min_words": 50, "max_repeat_per_cent": 50, "min_docs": 10, "share": 0.02, "min_left": 0.4} | rules
    columns = docs.columns
    found = line_frequency(docs, text_col, host_col, r["min_docs"], r["share"])
    rows = measures(docs, text_col, [whole_row(docs).alias("__row"), *text_key(F.col(host_col), F.col(text_col))])
    rows = rows.where((F.col("n_words") >= r["min_words"]) & (F.col("n_repeat_words") * 100 <= F.col("n_words") * r["max_repeat_per_cent"]))
    rows = rows.select("__row", "__k1", "__k2", "n_words").join(found, ["__k1", "__k2"], "left")
    rows = rows.where((F.col("n_words") - F.coalesce("common_words", F.lit(0))) >= F.col("n_words") * r["min_left"])
    text = F.col(f"__row.{quoted(text_col)}")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains("common", _line_hash(x))), "\n")
    text = F.when(F.col("common").isNull(), text).otherwise(left)
    out = rows.select(*[text.alias(c) if c == text_col else F.col(f"__row.{quoted(c)}").alias(c) for c in columns])
    if length_col in columns:
        kind = dict(docs.dtypes)[length_col]
        out = out.withColumn(length_col, F.length(text_col).cast(kind))
    return out


QUALITY_SQL = r"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
dup as (select rid, count(*) - count(distinct l) as n from (select rid, unnest(string_split(text, chr(10))) as l from d) where regexp_matches(l, '[^\x20\x09-\x0D]') group by rid),
win as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as x from (select rid, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, x) as c from win) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest([i, i + 1, i + 2]) as p from rep) group by rid),
lines as (
  select source, text, x, len(string_split(x, ' ')) as words, count(*) as times
  from (select source, text, lower(trim(regexp_replace(unnest(string_split(text, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g'))) as x from (select distinct source, text from d))
  where x <> '' group by source, text, x),
hosts as (select source, count(distinct text) as docs from lines group by source),
common as (select l.source, x from lines l join hosts h on l.source is not distinct from h.source group by l.source, x, docs having count(distinct text) > 10 and count(distinct text) > docs * 0.02::double),
hit as (select l.source, text, sum(words * times) as n from lines l join common c on l.source is not distinct from c.source and l.x = c.x group by l.source, text),
base as (
  select d.doc_id, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) as bigint) as word_chars,
         cast(length(regexp_replace(d.text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(coalesce(dup.n, 0) as bigint) as n_dup_lines, cast(coalesce(cov.n, 0) as bigint) as n_repeat_words, cast(coalesce(hit.n, 0) as bigint) as common_words
  from d left join dup on d.rid = dup.rid left join cov on d.rid = cov.rid left join hit on d.source is not distinct from hit.source and d.text = hit.text)
select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - common_words >= n_words * 0.4::double as kept
from base
"""
