"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.llm.common import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, comp): the smallest node that each node of an edge reaches.

    Large-star and small-star rounds (Kiveris et al. 2014): every round is two aggregations and two joins of the edge
    table, and the number of rounds grows with the logarithm of the number of nodes. Nothing is collected but one count.
    Self-loops and repeated edges are allowed; an empty table gives an empty table. Nodes without an edge are absent.
    """
    e = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges", small=True)
    before = None
    for _ in range(max_rounds):
        # large star: the larger neighbours of u are linked to the smallest of u and its neighbours. A hub has many:
        # its minimum is found by map-side aggregation, and the join can split its rows
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours are linked to the smallest of them, found in the same way, so that
        # equal edges of a round (a last hub has as many as its bucket has classes) meet in no one task
        near = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        last, e = e, cut(small.where("u <> v").distinct(), "edges", small=True)
        release(last)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components: no fixed point")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v"), F.col("v"))).distinct()
