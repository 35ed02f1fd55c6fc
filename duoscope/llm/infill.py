"""Fill-in-middle transformation in Spark SQL alone: cut, rearrange with sentinels, and restore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word with the white space before it, or white space at the end of the text.
UNIT_RE = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def draws(key: Column, seed: int, how_many: int = 4) -> list[Column]:
    """32-bit numbers that the seed and the key fix: 8-digit groups of a sha256, read as unsigned integers."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(how_many)]


def rearrange(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, infill_per_cent: int = 50, spm_per_cent: int = 80
) -> DataFrame:
    """(id, n, form, prefix, middle, suffix, output): a row per input row.

    n is the number of units of the whole text, which two numbers drawn from the id cut in three; form is plain, psm or
    spm. A plain row has its text as output, and null parts: so has an empty or null text (whose output is empty), and a
    text that holds a sentinel, as it couldn't be told apart afterwards. A null id draws as the empty string. Repeated
    rows, and rows that share an id and a text, come out alike; ties can't arise, as no row looks at another. Other columns
    of the input, whatever their names, are not read. There is no shuffle. A text's units are held at once, some 30 times
    the text's bytes for short words.
    """
    h = draws(F.col("id"), seed)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # each array and number is made once, as the projections after it refer to it several times
    rows = rows.select("id", "text", F.regexp_extract_all("text", F.lit(UNIT_RE), F.lit(0)).alias("unit"), *(x.alias(f"h{i}") for i, x in enumerate(h, 1)))
    rows = rows.withColumn("n", F.size("unit").cast("long"))
    cut = [(F.col(c) % (F.col("n") + 1)).cast("int") for c in ("h1", "h2")]
    plain = (F.col("n") == 0) | (F.col("h3") % 100 >= infill_per_cent)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain |= F.contains("text", F.lit(mark))
    form = F.when(plain, "plain").when(F.col("h4") % 100 < spm_per_cent, "spm").otherwise("psm")
    rows = rows.select("id", "n", "text", "unit", form.alias("form"), F.least(*cut).alias("lo"), F.greatest(*cut).alias("hi"))
    part = lambda start, length: F.when(F.col("form") != "plain", F.array_join(F.slice("unit", start, length), ""))
    rows = rows.select(
        "id", "n", "form", "text",
        part(F.lit(1), F.col("lo")).alias("prefix"),
        part(F.col("lo") + 1, F.col("hi") - F.col("lo")).alias("middle"),
        part(F.col("hi") + 1, F.col("n").cast("int") - F.col("hi")).alias("suffix"),
    )
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("text"))
    return rows.select("id", "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output of rearrange() was made from.

    The parts lie between the sentinels, none of which stands in a rearranged text or can arise where a part meets a
    sentinel: a sentinel's first character is none of its others. A null output or form gives null.
    """
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)


def infill_report(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """rearrange() by digests and lengths: (id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    rows = rearrange(docs, id_col, **how).select("id", "n", "form", "prefix", "middle", "output")
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return rows.select(
        F.col("id").alias(id_col), "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"), digest(restore(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


INFILL_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') as u, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as s from documents),
h as (select doc_id, text, u, cast(len(u) as bigint) as n, cast('0x' || s[1:8] as bigint) as h1, cast('0x' || s[9:16] as bigint) as h2, cast('0x' || s[17:24] as bigint) as h3, cast('0x' || s[25:32] as bigint) as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h3 % 100 >= 50 then 'plain' when h4 % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, coalesce(array_to_string(u[1:lo], ''), '') as prefix, coalesce(array_to_string(u[lo + 1:hi], ''), '') as middle, coalesce(array_to_string(u[hi + 1:n], ''), '') as suffix from c)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
