"""Exact nearest neighbours by a metric join: Voronoi cells, distance bounds, and two passes over blocks of cells.

1. Pivots come from a bounded sample; every target belongs to the cell of its nearest pivot, and remembers its distance to
   it. A cell with more targets than a block holds is split into rings by that distance, and a ring of equal distances by
   a hash, so that no cell is larger than about a block, whatever the data.
2. Cells that lie side by side make up blocks. A query's first pass is over the block that its nearest cell is in: there it
   finds k neighbours, and so a distance beyond which it needn't look.
3. In the second pass it goes to those blocks only that hold a cell which may be nearer, by the triangle inequality:
   a cell is no nearer than |q, pivot| less the cell's outer radius, than its inner radius less |q, pivot|, and than the
   plane between its pivot and the query's own. Within a cell the same inequality leaves a window of the targets, which are
   sorted by their distance to the pivot; only they are compared.

Where no bound helps (many dimensions without clusters) a query meets every block, which is what comparing all pairs in
blocks costs, no more: such blocks are compared by one matrix product. Equal vectors are looked up once, and of equal targets only the first k + 1 by id take part, so
copies, however many, cost no more than one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Accumulator, Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.functions.tables import cut, release

#: Targets of a block at most, about: 16 MB of 64 doubles.
BLOCK_ROWS = 1 << 15
#: Targets of a block for each neighbour that is looked for, where that is more.
_PER_NEIGHBOUR = 512
#: Pivots at most, and how many vectors of the sample there are for each.
PIVOTS, PER_PIVOT = 1024, 32
#: Queries that are compared with a window of targets at once.
_SLICE = 128
#: Where a larger share of a block's pairs is left, the block is compared as a whole, so many queries and targets at a time.
_MOST_LEFT, _ROWS, _TARGETS = 0.25, 256, 4096
_SLACK = 1e-6


def _sample_pivots(targets: DataFrame, rounds: int = 5, seed: int = 3) -> np.ndarray | None:
    """Centres of a bounded sample of the targets by Lloyd's rounds, in an order in which neighbours follow each other."""
    x = targets.orderBy(F.xxhash64("vec", F.lit(seed))).limit(PIVOTS * PER_PIVOT).select("vec").toPandas()
    if x.empty:
        return None
    x = np.unique(np.stack(x["vec"]), axis=0)
    c = x[np.random.RandomState(seed).choice(len(x), max(1, min(len(x) // 4, int(len(x) ** 0.5), PIVOTS)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    centred = c - c.mean(axis=0)
    return c[np.argsort(centred @ np.linalg.svd(centred.T @ centred)[0][:, 0], kind="stable")]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All distances between rows of x and rows of y; right to some 1e-7 of the vectors' size."""
    return np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T))


def _loose(bound: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The bound, and what rounding in distances() may have taken from it."""
    size = max(float((v * v).sum(axis=1).max(initial=0)) for v in (x, y)) ** 0.5
    return bound * (1 + _SLACK) + _SLACK * (1 + size)


def _home(sent: Broadcast) -> Callable[[Column], Column]:
    """The nearest pivot of a vector, and the distance to it."""

    @F.pandas_udf("pivot int, at double")
    def home(vecs: pd.Series) -> pd.DataFrame:
        p = sent.value
        if not len(vecs):
            return pd.DataFrame({"pivot": pd.Series([], dtype="int32"), "at": pd.Series([], dtype=float)})
        x = np.stack(vecs)
        near = np.concatenate([((p * p).sum(axis=1)[None] - 2 * x[i : i + 4096] @ p.T).argmin(axis=1) for i in range(0, len(x), 4096)])
        return pd.DataFrame({"pivot": near.astype(np.int32), "at": np.sqrt(((x - p[near]) ** 2).sum(axis=1))})

    return home


def _cells(placed: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """The targets with their cell and block; and (group, block, cell, pivot, inner, outer, n), a row per cell.

    placed: group, id, vec, pivot, at. A cell is a pivot's ring's salt; blocks hold cells of about `rows` targets.
    """
    by_pivot = placed.groupBy("group", "pivot").agg(F.count("*").alias("n"))
    heavy = by_pivot.where(F.col("n") > rows).select("group", "pivot", F.ceil(F.col("n") / F.lit(float(rows))).cast("int").alias("rings"))
    some = placed.join(heavy, ["group", "pivot"])
    edges = some.groupBy("group", "pivot").agg(F.percentile_approx("at", F.array(*(F.lit(i / 16) for i in range(1, 16))), 1000).alias("q"), F.first("rings").alias("rings"))
    # of 15 quantiles those are taken that leave as many rings as blocks are wanted; heavier cells get salts beside
    step = F.greatest(F.lit(1), F.floor(F.lit(16) / F.col("rings")).cast("int"))
    edges = edges.select("group", "pivot", F.filter("q", lambda x, i: (i + 1) % step == 0).alias("edges"))
    ringed = placed.join(edges, ["group", "pivot"], "left")
    ring = F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("at"))), F.lit(0))
    ringed = ringed.withColumn("ring", F.when(F.col("edges").isNull(), 0).otherwise(ring)).drop("edges")
    sizes = ringed.groupBy("group", "pivot", "ring").agg(F.ceil(F.count("*") / F.lit(float(rows))).cast("int").alias("salts"))
    salted = ringed.join(sizes, ["group", "pivot", "ring"]).withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int")).drop("salts")
    salted = cut(salted, "rings")
    key = ["group", "pivot", "ring", "salt"]
    cells = salted.groupBy(*key).agg(F.min("at").alias("inner"), F.max("at").alias("outer"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("pivot", "ring", "salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = cells.withColumn("block", F.floor(before / F.lit(float(rows))).cast("int"))
    cells = cut(cells.withColumn("cell", F.monotonically_increasing_id()), "cells")
    return salted.join(cells.select(*key, "cell", "block"), key).select("group", "block", "cell", "pivot", "id", "vec", "at"), cells


def _lower(q: np.ndarray, pivots: np.ndarray, cells: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(queries x cells): a bound that no distance into the cell is below; and the distances to the cells' pivots."""
    every = distances(q, pivots)
    own = every.argmin(axis=1)
    pivot, inner, outer = (cells.column(c).to_numpy() for c in ("pivot", "inner", "outer"))
    d = every[:, pivot]
    low = np.maximum(d - outer, inner - d)
    apart = distances(pivots, pivots)[own][:, pivot]
    plane = np.divide(d**2 - every[np.arange(len(q)), own][:, None] ** 2, 2 * apart, out=np.zeros_like(d), where=apart > 0)
    return np.maximum(np.maximum(low, plane), 0), d


def _vecs(t: pa.Table, name: str = "vec") -> np.ndarray:
    return t.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)


def _routes(sent: Broadcast, k: int, first: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(group, key, vec, block, bound) for queries of a group and its cells: the block of the nearest cell (first), or
    all others that may hold a nearer target than kth.

    kth is what the first pass has found, or null. The cells alone give a bound too: so far away k targets lie for certain.
    """

    def go(q: pa.Table, cells: pa.Table) -> pa.Table:
        block, n, outer = (cells.column(c).to_numpy() for c in ("block", "n", "outer"))
        out: list[tuple[np.ndarray, ...]] = []
        for at in range(0, len(q) if len(cells) else 0, 2048):
            some = q.slice(at, 2048)
            x = _vecs(some)
            low, d = _lower(x, sent.value, cells)
            far = d + outer
            order = far.argsort(axis=1, kind="stable")
            enough = np.cumsum(n[order], axis=1) >= k
            every = np.arange(len(some))
            bound = np.where(enough.any(axis=1), np.take_along_axis(far, order, 1)[every, enough.argmax(axis=1)], np.inf)
            home = block[np.lexsort((np.broadcast_to(block, low.shape), low), axis=1)[:, 0]]
            if first:
                out.append((at + every, home, bound))
                continue
            kth = some.column("kth").to_numpy(zero_copy_only=False).astype(float)
            bound = np.fmin(bound, kth)
            may = low <= _loose(bound, x, sent.value)[:, None]
            for b in np.unique(block):
                go_on = np.flatnonzero(may[:, block == b].any(axis=1) & (home != b))
                out.append((at + go_on, np.full(len(go_on), b), bound[go_on]))
        rows, to, bound = (np.concatenate([x[i] for x in out]) if out else np.empty(0) for i in range(3))
        taken = q.take(pa.array(rows.astype(np.int64)))
        return pa.table({"group": taken.column("group"), "key": taken.column("key"), "vec": taken.column("vec"), "block": pa.array(to.astype(np.int32)), "bound": pa.array(bound.astype(float))})

    return go


def _whole(x: np.ndarray, y: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of x, rows of y): the k nearest of each x within its bound, and what rounding leaves beside them.

    One matrix product of single precision is compared with a limit of each query, which the k nearest so far raise; where
    single precision is too coarse for the bounds, it is double. Exact distances are left to the caller.
    """
    middle = y.mean(axis=0)
    x, y = x - middle, y - middle
    sx, sy = (x * x).sum(axis=1), (y * y).sum(axis=1)
    size = max(sx.max(initial=0), sy.max(initial=0))
    tie = 4e-9 * size**0.5 + 1e-17  # distances that are equal to 9 places
    coarse = (x.shape[1] + 8) * 1.2e-7 * size
    kind = np.float32 if coarse <= 1e-3 * np.median(np.minimum(bound, size**0.5)) ** 2 else np.float64
    slack = tie + (coarse if kind is np.float32 else (x.shape[1] + 8) * 2.3e-16 * size)
    x, y = (np.column_stack([v, last]).astype(kind) for v, last in ((x, np.ones(len(x))), (y, -sy / 2)))
    room = np.empty(min(_ROWS, len(x)) * min(_TARGETS, len(y)), kind)
    for at in range(0, len(x), _ROWS):
        some = x[at : at + _ROWS]
        limit = ((sx[at : at + _ROWS] - bound[at : at + _ROWS] ** 2) / 2 - slack).astype(kind)  # of x.y - y.y / 2
        held: list[tuple[np.ndarray, ...]] = []
        many = 0

        def best() -> list[tuple[np.ndarray, ...]]:
            i, j, s = (np.concatenate([h[c] for h in held]) for c in range(3))  # noqa: B023
            order = np.lexsort((-s, i))
            i, j, s = i[order], j[order], s[order]
            starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]]) if len(i) else i
            full = starts[np.diff(np.r_[starts, len(i)]) >= k]
            limit[i[full]] = np.maximum(limit[i[full]], s[full + k - 1] - 2 * slack)  # noqa: B023
            keep = s >= limit[i]  # noqa: B023
            return [(i[keep], j[keep], s[keep])]

        for a in range(0, len(y), _TARGETS):
            some_y = y[a : a + _TARGETS]
            score = np.matmul(some, some_y.T, out=room[: len(some) * len(some_y)].reshape(len(some), len(some_y)))
            if not a and score.shape[1] > k and np.count_nonzero(score >= limit[:, None]) > 4 * k * len(some):
                limit = np.maximum(limit, np.partition(score, -k, axis=1)[:, -k] - 2 * kind(slack))
            near = np.flatnonzero(score >= limit[:, None])
            i, j = np.divmod(near, score.shape[1])
            held.append((i, j + a, score.ravel()[near]))
            many += len(near)
            if many > 4 * k * len(some):
                held = best()
                many = len(held[0][0]) // 2
        i, j, _ = best()[0]
        yield i + at, j


def _compare(sent: Broadcast, k: int, counted: Accumulator | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """(group, key, dst, dist): up to k nearest targets of a block for each query that came to it, ties by id."""

    def go(q: pa.Table, t: pa.Table) -> pa.Table:
        found: list[tuple[np.ndarray, ...]] = []
        if len(q) and len(t):
            x, y, at, cell, ids = _vecs(q), _vecs(t), t.column("at").to_numpy(), t.column("cell").to_numpy(), t.column("id")
            bound = _loose(q.column("bound").to_numpy(), x, y)
            order = np.lexsort((at, cell))
            starts = np.flatnonzero(np.r_[True, cell[order][1:] != cell[order][:-1]])
            ends = np.r_[starts[1:], len(order)]
            here = pa.table({"pivot": t.column("pivot").take(pa.array(order[starts])), "inner": at[order[starts]], "outer": at[order[ends - 1]]})
            for part in np.array_split(np.arange(len(x)), -(-len(x) // 2048)):
                low, d = _lower(x[part], sent.value, here)
                if ((low <= bound[part][:, None]) @ (ends - starts)).sum() > _MOST_LEFT * len(part) * len(y):
                    if counted is not None:
                        counted.add(len(part) * len(y))
                    for i, j in _whole(x[part], y, bound[part], k):
                        rows = part[i]
                        found.append((rows, j, np.round(np.sqrt(((x[rows] - y[j]) ** 2).sum(axis=1)), 9)))
                    continue
                for c, (a, b) in enumerate(zip(starts, ends, strict=True)):
                    span = at[order[a:b]]
                    for sub in _slices(np.flatnonzero(low[:, c] <= bound[part]), d[:, c]):
                        rows, most = part[sub], bound[part[sub]]
                        lo, hi = np.searchsorted(span, (d[sub, c] - most).min(), "left"), np.searchsorted(span, (d[sub, c] + most).max(), "right")
                        if lo >= hi:
                            continue
                        near = order[a + lo : a + hi]
                        if counted is not None:
                            counted.add(len(rows) * len(near))
                        rough = distances(x[rows], y[near])
                        if len(near) >= k:  # k are found: nothing beyond the last of them counts any more
                            most = np.minimum(most, _loose(np.partition(rough, k - 1, axis=1)[:, k - 1], x[rows], y[near]))
                            bound[rows] = most
                        i, j = np.nonzero(rough <= most[:, None])
                        exact = np.round(np.sqrt(((x[rows[i]] - y[near[j]]) ** 2).sum(axis=1)), 9)
                        found.append((rows[i], near[j], exact))
        rows, near, dist = (np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(3))
        rows, near = rows.astype(np.int64), near.astype(np.int64)
        if len(rows):
            rank_of_id = np.empty(len(t), np.int64)
            rank_of_id[pc.sort_indices(t.column("id")).to_numpy()] = np.arange(len(t))
            order = np.lexsort((rank_of_id[near], dist, rows))
            rows, near, dist = rows[order], near[order], dist[order]
            first = np.r_[0, np.flatnonzero(np.diff(rows)) + 1]
            best = np.arange(len(rows)) - np.repeat(first, np.diff(np.r_[first, len(rows)])) < k
            rows, near, dist = rows[best], near[best], dist[best]
        taken = q.take(pa.array(rows))
        return pa.table({"group": taken.column("group"), "key": taken.column("key"), "dst": t.column("id").take(pa.array(near)), "dist": pa.array(dist.astype(float))})

    return go


def _slices(rows: np.ndarray, d: np.ndarray) -> Iterator[np.ndarray]:
    rows = rows[np.argsort(d[rows], kind="stable")]
    for at in range(0, len(rows), _SLICE):
        yield rows[at : at + _SLICE]


def nearest(queries: DataFrame, targets: DataFrame, k: int, group: str | None = None, same_side: bool = False, counted: Accumulator | None = None) -> DataFrame:
    """src, dst, dist, rank (and the group): the k nearest targets of each query, by Euclidean distance rounded to 9 places.

    queries, targets: id, vec (and a group within which they meet). Exact; ties go to the smaller id. same_side: queries
    are targets too, and a row isn't its own neighbour. Rows without a vector or a group take no part; ids of targets are
    unique within a group; queries may repeat, and do so in the result. Vectors have one length. counted adds up the pairs
    whose distances were computed.

    Two cogroups of queries with the cells of their group say where a query goes, two more compare; a block of targets
    meets queries in parts, as many as a fixed number of queries in each leaves. What reaches the driver is the sample for the pivots: PIVOTS * PER_PIVOT vectors.
    """
    spark = queries.sparkSession
    wide = k + 1 if same_side else k  # room for the row itself
    g = F.col(group) if group else F.lit(0)
    bits = [F.xxhash64("vec").alias("__k1"), F.xxhash64(F.lit(1), "vec").alias("__k2")]
    shaped = lambda d: d.select(g.alias("group"), "id", F.col("vec").cast("array<double>").alias("vec")).where("vec is not null and `group` is not null").select("*", *bits)
    q, t = shaped(queries), shaped(targets)
    copies = Window.partitionBy("group", "__k1", "__k2").orderBy("id")
    t = t.withColumn("__r", F.row_number().over(copies)).where(F.col("__r") <= wide).drop("__r", "__k1", "__k2")
    ids, group_kind = dict(targets.dtypes)["id"], dict(t.dtypes)["group"]
    pivots = _sample_pivots(t)
    if pivots is None:
        found = [f"src {dict(queries.dtypes)['id']}", f"dst {ids}", "dist double", "rank int", *([f"`{group}` {group_kind}"] if group else [])]
        return spark.createDataFrame([], ", ".join(found))
    sent = spark.sparkContext.broadcast(pivots)
    placed = cut(t.withColumn("h", _home(sent)("vec")).select("group", "id", "vec", "h.pivot", "h.at"), "homes")
    # a square of blocks and parts that gives each core some tasks; each block may send k rows a query, so that many
    # neighbours want larger ones
    tasks = 4 * spark.sparkContext.defaultParallelism
    rows = max(64, min(max(BLOCK_ROWS, _PER_NEIGHBOUR * wide), int(placed.count() / tasks**0.5)))
    held, cells = _cells(placed, rows)
    once = q.groupBy("group", "__k1", "__k2").agg(F.first("vec").alias("vec")).withColumn("key", F.monotonically_increasing_id())
    once = cut(once, "queries")
    own = lambda d: d.select(*(F.col(f"`{c}`").alias(c) for c in d.columns))  # noqa: E731  columns of their own for either side of a cogroup
    parts = once.groupBy("group").agg(F.ceil(F.count("*") / F.lit(float(min(rows, BLOCK_ROWS)))).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    all_parts = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    summary = cells.select("group", "block", "pivot", "inner", "outer", "n").join(parts, "group").withColumn("part", all_parts).drop("parts")
    targets_of = held.join(parts, "group").withColumn("part", all_parts).drop("parts")

    def searched(asked: DataFrame, first: bool) -> DataFrame:
        at = asked.join(parts, "group").withColumn("part", part).drop("parts")
        schema = f"group {group_kind}, key long, vec array<double>, block int, bound double"
        going = own(at).groupBy("group", "part").cogroup(own(summary).groupBy("group", "part")).applyInArrow(_routes(sent, wide, first), schema)
        going = going.join(parts, "group").withColumn("part", part).drop("parts")
        keys = ["group", "block", "part"]
        return own(going).groupBy(*keys).cogroup(own(targets_of).groupBy(*keys)).applyInArrow(_compare(sent, wide, counted), f"group {group_kind}, key long, dst {ids}, dist double")

    at_home = cut(searched(once.select("group", "key", "vec", F.lit(None).cast("double").alias("kth")), True), "near")
    kth = at_home.groupBy("key").agg(F.when(F.count("*") >= wide, F.max("dist")).alias("kth"))
    near = at_home.union(searched(once.select("group", "key", "vec").join(kth, "key", "left").select("group", "key", "vec", "kth"), False))
    near = near.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("dist", "dst"))).where(F.col("r") <= wide)
    lists = near.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near")).join(once.select("key", "group", "__k1", "__k2"), "key")
    every = q.select("group", F.col("id").alias("src"), "__k1", "__k2").join(lists.drop("key"), ["group", "__k1", "__k2"])
    own_list = F.filter("near", lambda m: m["dst"] != F.col("src")) if same_side else F.col("near")
    every = every.select("group", "src", F.posexplode(F.slice(own_list, 1, k)).alias("at", "m"))
    every = every.select("src", "m.dst", "m.dist", (F.col("at") + 1).alias("rank"), *([F.col("group").alias(group)] if group else []))
    out = cut(every, "nearest")
    release(placed, cells, once, at_home)
    return out
