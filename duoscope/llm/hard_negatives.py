"""Hard-negative mining by bit-sliced integer products.

A component of a vector is an integer, and so a sum of bit-planes; the highest has a negative weight. A task multiplies its
anchors with one plane of its candidates after the other, most significant first. Once the planes down to bit t are in, what
the lower ones can still add lies between (2 ** t - 1) times the sum of the anchor's negative components and as many times
that of its positive ones: a score interval of the same width for all candidates of the anchor. A candidate goes when its
interval misses the window of wanted scores, or when as many others as are wanted lie in the window for certain and above it.
The planes below are multiplied for the candidates that are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.common import cut, release

#: Rows of a block of candidates and of a block of anchors: 64 components of 8 bytes are 16 MB.
BLOCK_ROWS = 1 << 15
#: Anchors that a task multiplies at once with a block of candidates.
_SLICE = 64


def narrowed(score: np.ndarray, rest: int, low: int, high: int, windows: list[tuple[float, float]], want: int) -> np.ndarray:
    """Which of the candidates of an anchor may still be among the `want` best of one of the windows.

    score: sums of the planes so far; rest: 2 ** t - 1; low and high: sums of the anchor's negative and positive components.
    """
    order = np.sort(score)
    keep = np.zeros(len(score), bool)
    for least, most in windows:
        if least > most:
            continue
        floor = least - rest * high  # below it even all of the rest isn't enough
        sure = np.searchsorted(order, most - rest * high, "right") - want
        if sure >= 0 and order[sure] + rest * low >= least:  # so many are in the window, whatever the rest
            floor = max(floor, order[sure] + rest * low - rest * high)
        keep |= (score >= floor) & (score <= most - rest * low)
    return keep


def best_in_windows(
    anchors: np.ndarray, vectors: np.ndarray, ids: np.ndarray, allowed: Callable[[int], np.ndarray], windows: list[list[tuple[float, float]]], want: int
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(anchor, window, candidates, scores): the `want` best of each anchor's windows, ties by id, as indices.

    allowed(i): which candidates anchor i may have. Sums of planes are exact in floating point, as vectors with a component
    too large for that are multiplied in Python's integers instead; their scores stop at the ends of a long.
    """
    width = (50 - max(1, anchors.shape[1]).bit_length()) // 2
    size = lambda v: np.where(v < 0, ~v, v).max(axis=1, initial=0)
    usual, a_usual = size(vectors) < 1 << width, size(anchors) < 1 << width
    bits = int(size(vectors)[usual].max(initial=0)).bit_length()
    a = np.where(a_usual[:, None], anchors, 0).astype(float)
    low, high = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
    plane = lambda t, rows=slice(None): ((vectors[rows] >> t) & 1).astype(float)
    for start in range(0, len(a), _SLICE):
        some = range(start, min(len(a), start + _SLICE))
        every = [np.flatnonzero(allowed(i)) if windows[i] else np.empty(0, np.int64) for i in some]
        near = [x[usual[x]] if a_usual[i] else x[:0] for i, x in zip(some, every, strict=True)]
        dense = np.zeros((len(some), len(vectors)))
        score: list[np.ndarray] | None = None  # of the candidates that are left, once they are few
        for t in range(bits, -1, -1):
            weight = -float(1 << t) if t == bits else float(1 << t)
            if score is None and 4 * sum(map(len, near)) < dense.size:
                score = [dense[k, x] for k, x in enumerate(near)]
            if score is None:
                dense += weight * (a[some.start : some.stop] @ plane(t).T)
                now = [dense[k, x] for k, x in enumerate(near)]
            else:
                now = score = [x + weight * (plane(t, rows) @ a[i]) for i, rows, x in zip(some, near, score, strict=True)]
            for k, i in enumerate(some):
                keep = narrowed(now[k], (1 << t) - 1, low[i], high[i], windows[i], want)
                near[k], now[k] = near[k][keep], now[k][keep]
        for k, i in enumerate(some):
            rest = every[k][~usual[every[k]]] if a_usual[i] else every[k]
            rows = np.concatenate([near[k], rest])
            exact = np.concatenate([now[k].astype(np.int64), _products(vectors[rest], anchors[i])])
            for w, (least, most) in enumerate(windows[i]):
                here = np.flatnonzero((exact >= least) & (exact <= most))
                top = here[np.lexsort((ids[rows[here]], ~exact[here]))[:want]]
                yield i, w, rows[top], exact[top]


def _products(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    long = np.iinfo(np.int64)
    exact = rows.astype(object) @ anchor.astype(object)
    return np.array([max(long.min, min(long.max, s)) for s in exact], np.int64)


def _matrix(t: pa.Table, name: str, d: int) -> np.ndarray:
    flat = t.column(name).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(t), d)


def _positives(d: int, want: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best `want` other rows of the label that all rows of both blocks have."""

    def find(q: pa.Table, t: pa.Table) -> pa.Table:
        own, ids = q.column("id").to_numpy(), t.column("id").to_numpy()
        out: list[tuple] = []
        if len(q) and len(t):
            everything = [[(-np.inf, np.inf)]] * len(q)
            for i, _, rows, score in best_in_windows(_matrix(q, "vec", d), _matrix(t, "vec", d), ids, lambda i: ids != own[i], everything, want):
                out += [(own[i], x, s) for x, s in zip(ids[rows], score, strict=True)]
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("anchor_id", "positive_id", "positive_score"))})

    return find


def _negatives(d: int, want: int, least: int, most: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The best `want` rows of another label whose score is between `least` and `most` per cent of a positive's."""

    def find(q: pa.Table, t: pa.Table) -> pa.Table:
        own, ids, label = q.column("id").to_numpy(), t.column("id").to_numpy(), t.column("label").to_numpy()
        out: list[tuple] = []
        if len(q) and len(t):
            positives = q.column("positives").to_pylist()
            bounds = lambda s: (-(-least * s // 100), most * s // 100)  # noqa: E731  whole scores within the per cents
            windows = [[bounds(p["positive_score"]) for p in of] for of in positives]
            of_anchor = q.column("label").to_numpy()
            for i, w, rows, score in best_in_windows(_matrix(q, "vec", d), _matrix(t, "vec", d), ids, lambda i: label != of_anchor[i], windows, want):
                p = positives[i][w]
                out += [(own[i], p["r"], p["positive_id"], x, p["positive_score"], s) for x, s in zip(ids[rows], score, strict=True)]
        names = ("anchor_id", "positive_rank", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(names)})

    return find


def integer_vectors(rows: DataFrame, id_col: str, label_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """(id, label, vec array<long>): floor(scale * x) of each component; rows without an id, a label or a whole vector go."""
    x = F.col("x")
    doubles = F.col(vec_col).cast("array<double>")
    v = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), doubles.alias("x"))
    whole = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    v = v.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & F.coalesce(whole, F.lit(False)))
    return v.select("id", "label", F.transform("x", lambda e: F.floor(e * F.lit(float(scale))).cast("long")).alias("vec"))


def hard_negatives(vectors: DataFrame, every: int = 50, n_positives: int = 5, n_negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score, positive_rank), anchors by an id that divides by `every`.

    vectors: id, label, vec of integers, as integer_vectors() makes them. An anchor's positives are its n_positives best
    rows of its label with another id; each of them gets the n_negatives best rows of other labels whose score is between
    `least` and `most` per cent of its own (none where that is negative). Ties go to the smaller id. A row's copies are
    rows of their own; of rows that share an anchor's id the one with the smallest label and vector is the anchor. Shorter
    vectors are as if filled up with zeros, so an empty one scores 0. A component or score beyond a long counts as its end.
    An empty table, or one of a single label, gives no rows. Texts take no part.

    The anchors meet all rows in blocks: first those of their label, which are dealt by the counted size of the label, so
    that one with a third of all rows is as many tasks as it needs; then all, as the positives' scores bound the negatives'.
    A block pair passes on at most n_positives or n_positives * n_negatives rows an anchor, however many there are.
    """
    spark = vectors.sparkSession
    d, n = vectors.agg(F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count("*")).first()
    padded = F.concat("vec", F.array_repeat(F.lit(0).cast("long"), F.lit(d) - F.size("vec")))
    rows = cut(vectors.select("id", "label", padded.alias("vec")), "vectors")
    anchors = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "vec")).alias("a")).select("id", "a.label", "a.vec")
    count = lambda by: F.greatest(F.ceil(by / F.lit(float(BLOCK_ROWS))), F.lit(1)).cast("int")
    sizes = rows.groupBy("label").agg(count(F.count("*")).alias("bt"), count(F.count_if(F.col("id") % every == 0)).alias("bq"))
    part = lambda blocks: F.pmod(F.xxhash64("id"), F.col(blocks)).cast("int")
    all_of = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    q = anchors.join(sizes, "label").select("label", part("bq").alias("x"), all_of("bt").alias("y"), "id", "vec")
    t = rows.join(sizes, "label").select("label", all_of("bq").alias("x"), part("bt").alias("y"), "id", "vec")
    keys = ["label", "x", "y"]
    found = _each_side(q).groupBy(*keys).cogroup(_each_side(t).groupBy(*keys)).applyInArrow(_positives(d, n_positives), "anchor_id long, positive_id long, positive_score long")
    by_score = Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")
    best = found.withColumn("r", F.row_number().over(by_score)).where(F.col("r") <= n_positives)
    lists = best.groupBy(F.col("anchor_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("r", "positive_id", "positive_score"))).alias("positives"))
    armed = cut(anchors.join(lists, "id"), "anchors")

    # at least a few block pairs a core; a block has BLOCK_ROWS rows at most, about
    bt = max(-(-n // BLOCK_ROWS), 2 * spark.sparkContext.defaultParallelism)
    bq = max(1, -(-n // every // BLOCK_ROWS))
    sides = [armed.withColumn("bt", F.lit(bt)).withColumn("bq", F.lit(bq)), rows.withColumn("bt", F.lit(bt)).withColumn("bq", F.lit(bq))]
    q = sides[0].select(part("bq").alias("x"), all_of("bt").alias("y"), "id", "label", "vec", "positives")
    t = sides[1].select(all_of("bq").alias("x"), part("bt").alias("y"), "id", "label", "vec")
    keys = ["x", "y"]
    schema = "anchor_id long, positive_rank long, positive_id long, negative_id long, positive_score long, negative_score long"
    mined = _each_side(q).groupBy(*keys).cogroup(_each_side(t).groupBy(*keys)).applyInArrow(_negatives(d, n_negatives, least, most), schema)
    order = Window.partitionBy("anchor_id", "positive_rank").orderBy(F.desc("negative_score"), "negative_id")
    out = mined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n_negatives)
    out = cut(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "positive_rank"), "negatives")
    release(rows, armed)
    return out


def _each_side(df: DataFrame) -> DataFrame:
    """Columns of their own, as both sides of a cogroup stem from the same rows."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def with_planted_labels(rows: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """The rows, with the next label (label + 1) % labels in those whose id divides by `every`."""
    return rows.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


NEGATIVES_SQL = """
with e as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as same, cast(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as bigint) as score from e a join e b on a.id % 50 = 0 and a.id <> b.id),
p as (select a, b, score from (select *, row_number() over (partition by a order by score desc, b) as r from s where same) where r <= 5),
n as (select p.a, p.b, p.score as ps, s.b as nb, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as r from p join s on p.a = s.a and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select a as anchor_id, b as positive_id, cast(r as integer) as rank, nb as negative_id, ps as positive_score, ns as negative_score from n where r <= 3
"""
