"""Line dedup by a deletion-neighbourhood join, with DataFrame functions only.

One law for every line that isn't empty: two lines are one if they are equal, lower-cased and with white space collapsed,
or near, if one edit in eight units parts them. The unit is the word where both have eight words or more, and the
character else; so two lines are near if they differ by one unit changed, added or taken out, and either has eight units
or more. Lines of less than eight characters have no budget for an edit: there equal is near.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.common import cut, quoted, release, whole_row

_DOC = ["doc_id", "k1"]
_SPACES = " \t\r\x0b\x0c"


def _normal(line: Column) -> Column:
    plain = ~(F.contains(line, F.lit("  ")) | F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\x0c")))
    # the regex is for the few lines that need it
    return F.lower(F.trim(F.when(plain, line).otherwise(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def _count_words(norm: Column) -> Column:
    return F.when(norm == "", 0).otherwise(F.octet_length(norm) - F.octet_length(F.replace(norm, F.lit(" "), F.lit(""))) + 1)


def _text_key(text: Column) -> Column:
    return F.xxhash64(text.isNull(), text)


def lines_of(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, k1, pos, norm, n, lh, l2): each line that isn't empty, its words, and 96 bits of hash."""
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("k1"), F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    rows = rows.select(*_DOC, "pos", _normal(F.col("line")).alias("norm")).where("norm <> ''").withColumn("n", _count_words(F.col("norm")))
    return rows.withColumn("lh", F.xxhash64("norm")).withColumn("l2", F.hash("norm"))


def _half_keys() -> list[Column]:
    """What two lines within one edit must share: the words before, or those after, the middle of the shorter one.

    A line of n words is the shorter of a pair of n words (or n + 1), and the longer of one of n - 1. So it has a prefix
    of n div 2 and one of (n - 1) div 2 words, and the suffixes that are left. Two of these four are alike: the suffixes
    if n is even, the prefixes if it is odd.
    """

    def words(length: Column) -> Column:
        return F.call_function("substring_index", F.col("norm"), F.lit(" "), length.cast("int"))

    half, less = F.expr("n div 2"), F.expr("(n - 1) div 2")
    even = F.col("n") % 2 == 0
    third = F.when(even, F.xxhash64(F.lit("p"), less, words(less))).otherwise(F.xxhash64(F.lit("s"), F.col("n") - 1 - less, words(less + 1 - F.col("n"))))
    return [F.xxhash64(F.lit("p"), half, words(half)).alias("p0"), F.xxhash64(F.lit("s"), F.col("n") - half, words(half - F.col("n"))).alias("s0"), third.alias("t0")]


def _half_chars() -> list[Column]:
    """_half_keys() with the m characters of a line in place of its words."""

    def keys(prefix: Column, suffix: Column) -> tuple[Column, Column]:
        before = F.xxhash64(F.lit("cp"), prefix, F.substring(F.col("norm"), F.lit(1), prefix.cast("int")))
        return before, F.xxhash64(F.lit("cs"), suffix, F.substring(F.col("norm"), (F.col("m") - suffix + 1).cast("int"), suffix.cast("int")))

    half, less = F.expr("m div 2"), F.expr("(m - 1) div 2")
    p, s = keys(half, F.col("m") - half)
    third = F.when(F.col("m") % 2 == 0, keys(less, less)[0]).otherwise(keys(less, F.col("m") - 1 - less)[1])
    return [F.when(F.col("m").isNotNull(), k).alias(name) for k, name in ((p, "cp"), (s, "cs"), (third, "ct"))]


def kept_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = 8) -> DataFrame:
    """(doc_id, k1, pos) of the lines that stay.

    A line stays if neither an equal line nor a near one (see above; units is the eight) comes earlier; earlier means by
    (doc_id, text hash, line number), a null id first. An earlier line counts whether it stays itself or not, so that
    the outcome doesn't hang on any order of work.

    1. Equal lines are one by 96 bits of hash, with the earliest place of each: map-side minima, so that a line that a
       third of all documents have is a row per task. Distinct lines get numbers, which stand for them from then on.
    2. Near lines share a half (see _half_keys). Lines none of whose halves another line has are out, without loss: a
       line emits three keys here, not a variant per word.
    3. The rest emit every variant with one word deleted, as a key: the XOR of word hashes by position, from two running
       XORs. Lines with the same variant by deleting the same position differ in that word only, so all of such a group
       are near each other and each needs nothing but the group's earliest. A variant equal to a whole line is an
       insertion. So no group is expanded into pairs.
    4. Each pair found is verified word by word before it counts.

    Lines that may be a character from another go the same way, character by character, as entries of their own kind: a
    line of `units` words is in both, as one of a word less may be a character from it. n counts an entry's units.
    """
    where = F.struct("doc_id", "k1", "pos")
    m = F.length("norm")
    rows = lines_of(docs, id_col, text_col).withColumn("m", F.when((F.col("n") <= units) & (m >= units), m))
    rows = rows.select(where.alias("at"), "n", "m", "lh", "l2", *_half_keys(), *_half_chars())
    each = rows.groupBy("lh", "l2").agg(F.min("at").alias("first"), F.max("n").alias("n"), F.max("m").alias("m"), *(F.max(c).alias(c) for c in ("p0", "s0", "t0", "cp", "cs", "ct")))
    each = cut(each.drop("lh", "l2").withColumn("line", F.monotonically_increasing_id()), "lines")
    own = F.col("line").alias("own")
    long = each.where(F.col("n") >= units).select((F.col("line") * 2).alias("lh"), own, "first", "n", F.lit(False).alias("short"), F.array("p0", "s0", "t0").alias("keys"))
    short = each.where(F.col("m").isNotNull()).select((F.col("line") * 2 + 1).alias("lh"), own, "first", F.col("m").alias("n"), F.lit(True).alias("short"), F.array("cp", "cs", "ct").alias("keys"))
    entries = long.union(short)
    keys = entries.select("lh", F.explode(F.array_distinct("keys")).alias("key"))
    shared = keys.groupBy("key").agg(F.min("lh").alias("a"), F.max("lh").alias("b")).where("a <> b").select("key")
    near = keys.join(shared, "key", "left_semi").select("lh").distinct()
    near = cut(entries.join(near, "lh", "left_semi").select("lh", "own", "first", "n", "short"), "near")
    # their words come from the documents where they stand first
    texts = docs.select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("k1"), F.col(text_col).alias("text"))
    of = near.groupBy(F.col("first.doc_id").alias("d"), F.col("first.k1").alias("k")).agg(F.collect_list(F.struct("lh", "own", "first", "n", "short")).alias("all"))
    texts = texts.join(of, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("k"))).select(F.split("text", "\n").alias("x"), F.explode("all").alias("o"))
    texts = texts.select("o.*", _normal(F.element_at("x", F.col("o.first.pos") + 1)).alias("norm"))
    slim, near = near, cut(texts.dropDuplicates(["lh"]), "near")
    release(slim)

    units = F.when(F.col("short"), F.split("norm", "")).otherwise(F.split("norm", " "))
    words = near.select("lh", "n", "short", F.posexplode(units).alias("i", "w"))
    words = words.select("lh", "n", "i", F.xxhash64("w", F.col("i"), "short").alias("h"), F.xxhash64("w", F.col("i") - 1, "short").alias("g"))
    order = Window.partitionBy("lh").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("lh")
    x, y = F.bit_xor("h").over(order), F.bit_xor("g").over(order)
    variants = words.select(
        "lh", "i", x.bitwiseXOR(F.col("h")).alias("before"), F.bit_xor("g").over(whole).bitwiseXOR(y).alias("after"), F.bit_xor("h").over(whole).alias("line")
    )
    variants = variants.select("lh", "i", F.col("before").bitwiseXOR(F.col("after")).alias("v"), "line")
    variants = cut(variants.join(near.select("lh", "first"), "lh"), "variants")

    groups = variants.groupBy("v", "i").agg(F.min(F.struct("first", "lh")).alias("e"), F.min("lh").alias("x"), F.max("lh").alias("y")).where("x <> y").select("v", "i", F.col("e.lh").alias("other"))
    changed = variants.join(groups, ["v", "i"]).where("lh <> other").select("lh", "other", "i")
    lone = variants.where("i = 0").select(F.col("lh").alias("other"), F.col("line").alias("v"))
    added = variants.join(lone, "v").where("lh <> other").select("lh", "other", "i")

    def word_but(norm: Column, n: Column, i: Column) -> Column:
        """The words (characters) before word i, and those after it."""
        head = F.call_function("substring_index", norm, F.lit(" "), i.cast("int"))
        tail = F.call_function("substring_index", norm, F.lit(" "), (i + 1 - n).cast("int"))
        head = F.when(F.col("short"), F.substring(norm, F.lit(1), i.cast("int"))).otherwise(head)
        tail = F.when(F.col("short"), F.substring(norm, (i + 2).cast("int"), F.greatest(n - i - 1, F.lit(0)).cast("int"))).otherwise(tail)
        return F.struct(head.alias("col1"), tail.alias("col2"))

    text = near.select("lh", "own", "norm", "n", "first", "short")
    other = near.select(F.col("lh").alias("other"), F.col("own").alias("o_own"), F.col("norm").alias("o_norm"), F.col("n").alias("o_n"), F.col("first").alias("o_first"), F.col("short").alias("o_short"))
    pairs = changed.withColumn("same", F.lit(True)).union(added.withColumn("same", F.lit(False))).join(text, "lh").join(other, "other")
    mine, its = word_but(F.col("norm"), F.col("n"), F.col("i")), word_but(F.col("o_norm"), F.col("o_n"), F.col("i"))
    without = F.when(F.col("short"), F.concat(mine["col1"], mine["col2"])).otherwise(F.concat_ws(" ", *(F.nullif(mine[c], F.lit("")) for c in ("col1", "col2"))))
    true = F.when(F.col("same"), (F.col("n") == F.col("o_n")) & (mine == its)).otherwise((F.col("n") == F.col("o_n") + 1) & (without == F.col("o_norm")))
    pairs = pairs.where(true).where("first <> o_first and short = o_short")
    later = pairs.select(F.when(F.col("o_first") < F.col("first"), F.col("own")).otherwise(F.col("o_own")).alias("line")).distinct()
    stay = cut(each.join(later, "line", "left_anti").select("first.*"), "stay")
    release(each, near, variants)
    return stay


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = 8) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_lines, a row per document (equal rows are one document).

    n_lines counts the lines that aren't empty, kept_lines lists the numbers (from 0) of those that stay, in order. Null
    and empty texts have no lines; a null id is an id that comes before any other; rows of one id with different texts
    are different documents. An empty table gives an empty one; very long lines are compared whole. Other columns are not
    read.
    """
    stay = kept_lines(docs, id_col, text_col, units)
    kept = stay.groupBy(F.col("doc_id").alias("d"), F.col("k1").alias("k")).agg(F.array_sort(F.collect_list("pos")).alias("kept_lines"))
    n = F.size(F.filter(F.split(F.coalesce(text_col, F.lit("")), "\n"), lambda x: F.trim(x, F.lit(_SPACES)) != "")).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), _text_key(F.col(text_col)).alias("k1"), n.alias("n_lines")).distinct()
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("k1") == F.col("k")), "left")
    found = F.coalesce("kept_lines", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", (F.col("n_lines") - F.size(found)).alias("n_dropped"), found.alias("kept_lines"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", units: int = 8) -> DataFrame:
    """The documents with all their columns, whatever their names, their dropped lines gone from the text.

    See kept_lines(). Empty lines stay, as do null texts and rows without a line that is dropped; repeated rows keep the
    same lines; an empty table stays empty.
    """
    stay = kept_lines(docs, id_col, text_col, units)
    kept = stay.groupBy(F.col("doc_id").alias("__d"), F.col("k1").alias("__k")).agg(F.collect_list("pos").alias("__kept"))
    rows = docs.select(whole_row(docs).alias("__row"), F.col(id_col).alias("__id"), _text_key(F.col(text_col)).alias("__k1"))
    rows = rows.join(kept, F.col("__id").eqNullSafe(F.col("__d")) & (F.col("__k1") == F.col("__k")), "left")
    text = F.col(f"__row.{quoted(text_col)}")
    stays = F.filter(F.split(text, "\n"), lambda x, i: (F.trim(x, F.lit(_SPACES)) == "") | F.coalesce(F.array_contains("__kept", i), F.lit(False)))
    return rows.select(*[F.array_join(stays, "\n").alias(c) if c == text_col else F.col(f"__row.{quoted(c)}").alias(c) for c in docs.columns])
