"""Weighted rendezvous hashing of record keys over shards, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.common import cut


def rendezvous(key: Column, weights: Sequence[float]) -> list[Column]:
    """A struct (score, shard) for every shard; the least one wins.

    The score is -ln(u) / weight, u in (0, 1) from xxhash64(shard, key): a shard wins in proportion to its weight. As a
    shard's score depends on nothing but the key and the shard, one more shard only takes keys into itself.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    key = F.coalesce(key.cast("string"), F.lit(""))
    out = []
    for shard, weight in enumerate(weights):
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(shard), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        out.append(F.struct((-F.ln(u) / F.lit(float(weight))).alias("score"), F.lit(shard).alias("shard")))
    return out


#: Rows that one task numbers, about; and how many equal rows one task writes out.
BUCKET_ROWS, COPIES = 1 << 18, 1 << 20


def shard_by_key(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 24, grown_weight: float = 1.0, slot_buckets: int | None = None) -> DataFrame:
    """Shards of rows by their key: doc_id, size, text_crc32, law ("key"), shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 8, text_crc32 that of the text (a null text has no bytes, so 0). A null key
    hashes as the empty string. slot numbers a shard's rows from 0 without gaps, by (sub-bucket, key, crc, size): equal
    keys are told apart by their texts, and rows alike in all of these are interchangeable. grown_shard is the shard
    if one more, of grown_weight, were there. An empty table gives an empty one; other columns are not read.

    Slots need no sort of a whole shard in one task: each shard is cut into sub-buckets by a hash of key and text, as many
    (slot_buckets, at least 16) as leave some BUCKET_ROWS rows in each. Rows that are alike are counted first, with
    map-side sums, numbered as one and written out by several tasks where they are many; so a key and text of a third of
    all rows is no large group. The sub-buckets' sizes are the offsets of the numbers within them.
    """
    each = rendezvous(F.col("doc_id"), [*weights, grown_weight])
    buckets = slot_buckets or max(16, -(-docs.count() // (len(weights) * BUCKET_ROWS)))
    keyed = docs.select(
        F.col(key_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))).alias("text_crc32"),
    ).groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("__n"))
    best = keyed.withColumn("__best", F.least(*each[:-1]) if len(weights) > 1 else each[0]).withColumn("__grown", F.least("__best", each[-1]))
    sub = F.pmod(F.hash("doc_id", "text_crc32"), F.lit(buckets)).alias("__sub")
    placed = cut(best.select("doc_id", "size", "text_crc32", "__n", F.col("__best.shard").alias("shard"), F.col("__grown.shard").alias("grown_shard"), sub), "shards")
    counts = placed.groupBy("shard", "__sub").agg(F.sum("__n").alias("n"))
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__off"))
    within = Window.partitionBy("shard", "__sub").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("__r", F.coalesce(F.sum("__n").over(within), F.lit(0))).join(offsets, ["shard", "__sub"])
    numbered = numbered.withColumn("__from", F.col("__off") + F.col("__r"))
    many = numbered.where(F.col("__n") > COPIES).withColumn("__at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__n") - 1, F.lit(COPIES).cast("long"))))
    many = many.withColumn("__from", F.col("__from") + F.col("__at")).withColumn("__n", F.least(F.lit(COPIES), F.col("__n") - F.col("__at"))).drop("__at")
    rows = numbered.where(F.col("__n") <= COPIES).unionByName(many.repartition("__from"))
    rows = rows.withColumn("slot", F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("__n") - 1)))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
