"""Neighbours: k-NN and cross-modal joins, weighted fusion, and top-k lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoscope.functions.tables import cut, release
from duoscope.functions.vectors import distance
from duoscope.operators.metric_join import _vecs, nearest


#: A block of vectors that one task compares with another block: some 16 MB of 64 doubles.
BLOCK_ROWS = 1 << 15


def block_count(rows: int, at_least: int = 8) -> int:
    """Blocks of at most about BLOCK_ROWS rows: a task's memory doesn't grow with the table."""
    return max(at_least, -(-rows // BLOCK_ROWS))


def _nearest(x: np.ndarray, y: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int, include_self: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(indices into y, distances) of the k nearest of each row of x; ties by id. One matrix product chooses, exact sums decide."""
    out = []
    rough = (x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None] - 2 * x @ y.T
    slack = 1e-6 * (1 + np.abs(rough).max(initial=0))
    for i in range(len(x)):
        near = np.arange(len(y))
        if len(y) > k + 1:
            near = np.nonzero(rough[i] <= np.partition(rough[i], k)[k] + slack)[0]
        if not include_self:
            near = near[ids[near] != own[i]]
        d = np.round(np.sqrt(((y[near] - x[i]) ** 2).sum(axis=1)), 9)
        best = np.lexsort((ids[near], d))[:k]
        out.append((near[best], d[best]))
    return out


def _block_task(k: int, include_self: bool, rows: int = 1024):
    """The k nearest targets of a block for the queries of a block, in slices of queries."""

    def near(q: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        if q.empty or t.empty:
            return pd.DataFrame({"src": [], "dst": [], "dist": []})
        y, ids = np.stack(t["vec"]), t["id"].to_numpy()
        out = []
        for at in range(0, len(q), rows):
            some = q.iloc[at : at + rows]
            for s, (best, d) in zip(some["id"], _nearest(np.stack(some["vec"]), y, ids, some["id"].to_numpy(), k, include_self), strict=True):
                out.append(pd.DataFrame({"src": s, "dst": ids[best], "dist": d}))
        return pd.concat(out, ignore_index=True)

    return near


def _best_of_lists(d: DataFrame, k: int) -> DataFrame:
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy("dist", "dst")))
    return d.where(F.col("rank") <= k).select("src", "dst", "dist", "rank")


def knn(vectors: DataFrame, k: int = 20, include_self: bool = False) -> DataFrame:
    """src, dst, dist, rank: the k nearest by Euclidean distance (rounded to 9 places, ties by id). vectors: id, vec.

    Exact, by nearest(): on clustered vectors a small share of the pairs is compared, without clusters all of them, in blocks.
    """
    return nearest(vectors, vectors, k, same_side=not include_self)


def centroids(vectors: DataFrame, lists: int, sample: int = 50_000, rounds: int = 8, seed: int = 3) -> np.ndarray:
    """Centres of `lists` clusters, by Lloyd's rounds over a bounded sample of the vectors (by hash of the id)."""
    x = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(sample).select(F.col("vec").cast("array<double>").alias("vec")).toPandas()
    x = np.stack(x["vec"])
    c = x[np.random.RandomState(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = ((c * c).sum(axis=1)[None] - 2 * x @ c.T).argmin(axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, x[:, j], len(c)) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(1, n)[:, None], c)
    return c


def knn_indexed(vectors: DataFrame, k: int = 20, include_self: bool = False, lists: int | None = None, probes: int = 8, queries: DataFrame | None = None) -> DataFrame:
    """knn() over an inverted file of clusters: each query looks into the lists of its `probes` nearest centres.

    Every vector is in the index, in the list of its nearest centre; only the centres come from a sample. A list of more
    than BLOCK_ROWS vectors is dealt over salts, and its queries go to each of them, so a cluster that holds a third of all
    vectors is many tasks. With probes = lists the result is exact; else distances and ranks are exact among what was
    looked at (the tests measure the recall). queries: (id, vec), by default all vectors.
    """
    n = vectors.count()
    if not n:
        return knn(vectors, k, include_self)
    lists = lists or max(1, int(n**0.5))
    c = centroids(vectors, lists)
    probes = min(probes, len(c))
    sent = vectors.sparkSession.sparkContext.broadcast(c)

    @F.pandas_udf("array<int>")
    def nearest_lists(vecs: pd.Series, m: pd.Series) -> pd.Series:
        y = sent.value
        x = np.stack(vecs) if len(vecs) else np.empty((0, y.shape[1]))
        order = ((y * y).sum(axis=1)[None] - 2 * x @ y.T).argsort(axis=1, kind="stable")
        return pd.Series([o[:most].tolist() for o, most in zip(order, m, strict=True)])

    kind = dict(vectors.dtypes)["id"]
    side = lambda d, m: d.select("id", F.col("vec").cast("array<double>").alias("vec")).withColumn("list", F.explode(nearest_lists("vec", F.lit(m))))
    held = side(vectors, 1)
    sizes = held.groupBy("list").agg(F.ceil(F.count("*") / F.lit(float(BLOCK_ROWS))).cast("int").alias("salts"))
    own = [F.col(x).alias(x) for x in ("id", "vec", "list")]
    t = held.join(sizes, "list").select(*own, F.pmod(F.hash("id"), F.col("salts")).alias("salt"))
    q = side(vectors if queries is None else queries, probes).join(sizes, "list").select(*own, F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    q = q.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(block_count(n * probes // lists, 1))).cast("int"))
    t = t.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(block_count(n * probes // lists, 1) - 1))))
    keys = ["list", "salt", "part"]
    d = q.groupBy(*keys).cogroup(t.groupBy(*keys)).applyInPandas(_block_task(k, include_self), f"src {kind}, dst {kind}, dist double")
    return _best_of_lists(d, k)


def cross_modal(rna: DataFrame, atac: DataFrame) -> DataFrame:
    """Per donor, each cell of the smaller modality (RNA if equal) with its nearest cell of the other; targets may repeat.

    rna, atac: cell_id, donor_id, cell_type, vec. Returns rna_cell, atac_cell, cell_type, atac_cell_type, distance,
    donor_id, anchor. The metric join of nearest() with the donor as its group.
    """
    n = rna.groupBy("donor_id").agg(F.count("*").alias("nr")).join(atac.groupBy("donor_id").agg(F.count("*").alias("na")), "donor_id")
    n = cut(n.select("donor_id", F.when(F.col("nr") <= F.col("na"), "rna").otherwise("atac").alias("anchor")), "anchors")
    of = lambda d, anchor: d.join(n.where(F.col("anchor") == anchor), "donor_id").select("donor_id", F.col("cell_id").alias("id"), "vec")
    found = nearest(of(rna, "rna").union(of(atac, "atac")), of(atac, "rna").union(of(rna, "atac")), 1, group="donor_id").join(n, "donor_id")
    by_rna = F.col("anchor") == "rna"
    found = found.select(F.when(by_rna, F.col("src")).otherwise(F.col("dst")).alias("rna_cell"), F.when(by_rna, F.col("dst")).otherwise(F.col("src")).alias("atac_cell"), F.col("dist").alias("distance"), "donor_id", "anchor")
    kinds = lambda d, m, c: d.select(F.col("cell_id").alias(f"{m}_cell"), "donor_id", F.col("cell_type").alias(c))
    found = found.join(kinds(rna, "rna", "cell_type"), ["rna_cell", "donor_id"]).join(kinds(atac, "atac", "atac_cell_type"), ["atac_cell", "donor_id"])
    return found.select("rna_cell", "atac_cell", "cell_type", "atac_cell_type", "distance", "donor_id", "anchor")


def top_k(edges: DataFrame, k: int, nodes: DataFrame | None = None) -> DataFrame:
    """id, neighbors: each node's heaviest k (weight above 0; ties by smaller index), padded with -1."""
    r = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst"))
    e = edges.where("weight > 0").withColumn("r", r).where(F.col("r") <= k)
    found = e.groupBy(F.col("src").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "dst"))), lambda s: s["dst"].cast("long")).alias("n"))
    rows = (nodes if nodes is not None else edges.select(F.col("src").alias("id"))).select("id").distinct().join(found, "id", "left")
    n = F.coalesce("n", F.array().cast("array<long>"))
    return rows.select("id", F.concat(n, F.array_repeat(F.lit(-1).cast("long"), F.lit(k) - F.size(n))).alias("neighbors"))


def memberships(lists: DataFrame, with_self: bool = False, halvings: int = 64) -> DataFrame:
    """src, dst, weight from neighbour lists (src, dst, dist): how surely dst is in the neighbourhood of src, 0 to 1.

    exp(-(dist - nearest) / bandwidth), where nearest is the smallest distance above 0, and the bandwidth is such that a
    node's weights sum to log2 of the number of its neighbours, or of one more where the node counts as its own
    (with_self). The bandwidth is found by a fixed number of halvings, a fold over the node's list in the JVM, and is a
    thousandth of the mean distance at least. A row holds a node's list, so lists are to be of some hundred neighbours.
    """
    near = lists.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("dist", "dst"))).alias("near"))
    nearest_one = F.coalesce(F.array_min(F.filter(F.transform("near", lambda x: x["dist"]), lambda d: d > 0)), F.lit(0.0))
    near = near.select("src", "near", nearest_one.alias("nearest"))
    near = near.withColumn("far", F.transform("near", lambda x: F.greatest(x["dist"] - F.col("nearest"), F.lit(0.0))))
    target = F.log2((F.size("far") + int(with_self)).cast("double"))
    endless = float("inf")

    def middle(s):
        return F.when(s["high"] < endless, (s["low"] + s["high"]) / 2).when(s["low"] > 0, 2 * s["low"]).otherwise(1.0)

    def halve(s, _):
        total = F.aggregate("far", F.lit(0.0), lambda t, d: t + F.exp(-d / middle(s)))
        return F.when(total > target, F.struct(s["low"].alias("low"), middle(s).alias("high"))).otherwise(F.struct(middle(s).alias("low"), s["high"].alias("high")))

    start = F.struct(F.lit(0.0).alias("low"), F.lit(endless).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), start, halve, middle)
    mean = F.aggregate("near", F.lit(0.0), lambda t, x: t + x["dist"]) / (F.size("near") + int(with_self))
    near = near.withColumn("bandwidth", F.greatest(found, 1e-3 * mean))
    each = near.select("src", "nearest", "bandwidth", F.explode("near").alias("e"))
    weight = F.when(F.col("e.dist") <= F.col("nearest"), 1.0).otherwise(F.exp(-(F.col("e.dist") - F.col("nearest")) / F.col("bandwidth")))
    return each.select("src", "e.dst", weight.alias("weight"))


def fuzzy_union(directed: DataFrame) -> DataFrame:
    """src, dst, weight for either direction: a + b - a * b of the two weights."""
    both = directed.union(directed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg((1 - F.product(1 - F.col("weight"))).alias("weight"))


def neighbour_graph(vectors: DataFrame, k: int = 15) -> DataFrame:
    """src, dst, weight, both directions of each edge: the fuzzy graph of k neighbours, the cell itself being one of them."""
    return fuzzy_union(memberships(knn(vectors, k - 1).select("src", "dst", "dist"), with_self=True))


def pair_distances(pairs: DataFrame, vectors: DataFrame, columns: tuple[str, ...] = ("vec",)) -> DataFrame:
    """The pairs (src, dst and any other columns), each once, with d_<column>: the distance of its ends to 9 places.

    vectors: id and columns of vectors. Pairs meet the vectors by a block of src and a block of dst: a vector is sent to twice
    as many tasks as there are blocks, not once a pair, of which a cell may have hundreds. Pairs without a vector are left out.
    """
    vectors = vectors.dropna(subset=list(columns))
    kind, blocks = dict(vectors.dtypes)["id"], block_count(vectors.count())
    block = lambda c: F.pmod(F.xxhash64(F.col(c).cast(kind)), F.lit(blocks)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    ends = [F.col(c).alias(c) for c in ("id", *columns)]
    sides = vectors.select(*ends, block("id").alias("of_src"), every.alias("of_dst")).union(vectors.select(*ends, every.alias("of_src"), block("id").alias("of_dst")))
    names = pairs.columns

    def go(p: pa.Table, v: pa.Table) -> pa.Table:
        ids = v.column("id").combine_chunks()
        i, j = (pc.fill_null(pc.index_in(p.column(c).cast(ids.type), value_set=ids), -1).to_numpy().astype(np.int64) for c in ("src", "dst"))
        known = np.flatnonzero((i >= 0) & (j >= 0))
        known = known[np.unique(i[known] * max(1, len(v)) + j[known], return_index=True)[1]]
        out = p.select(names).take(pa.array(known))
        i, j = i[known], j[known]
        for c in columns:
            x, d = _vecs(v, c) if len(known) else None, np.empty(len(known))
            for at in range(0, len(known), 1 << 16):
                some = slice(at, at + (1 << 16))
                d[some] = np.round(np.sqrt(((x[i[some]] - x[j[some]]) ** 2).sum(axis=1)), 9)
            out = out.append_column(f"d_{c}", pa.array(d))
        return out

    keys = ["of_src", "of_dst"]
    asked = pairs.select(*(F.col(c).alias(c) for c in names), block("src").alias("of_src"), block("dst").alias("of_dst"))
    schema = ", ".join([*(f"`{c}` {t}" for c, t in pairs.dtypes), *(f"`d_{c}` double" for c in columns)])
    return asked.groupBy(*keys).cogroup(sides.groupBy(*keys)).applyInArrow(go, schema)


def shared_neighbour_bandwidth(lists: DataFrame, vectors: DataFrame, k: int, cells: int = 20) -> DataFrame:
    """id, sigma: the mean distance of each cell to the `cells` that it has least in common with, of those it shares with.

    lists: src, dst, dist of k neighbours; vectors: id, vec. Which cells share a neighbour is found by an inverted list:
    the lists meet on the neighbour. Two cells are alike by the Jaccard similarity of their lists, which grows with the number
    shared; of the least similar cells the farthest come first, then those of the smallest id. A cell that shares with
    none has the distance of its last neighbour.
    """
    ends = lists.select("src", "dst")
    pairs = ends.join(ends.select(F.col("src").alias("other"), "dst"), "dst").where("src <> other").groupBy("src", "other").agg(F.count("*").alias("shared"))
    least = pairs.withColumn("r", F.rank().over(Window.partitionBy("src").orderBy("shared"))).where(F.col("r") <= cells)
    far = pair_distances(least.select("src", F.col("other").alias("dst"), "shared"), vectors).select("src", F.col("dst").alias("other"), "shared", F.col("d_vec").alias("d"))
    far = far.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("shared", F.desc("d"), "other"))).where(F.col("r") <= cells)
    sigma = far.groupBy("src").agg(F.avg("d").alias("mean"))
    last = lists.groupBy("src").agg(F.max("dist").alias("last"))
    return last.join(sigma, "src", "left").select(F.col("src").alias("id"), F.coalesce("mean", "last").alias("sigma"))


def wnn(rna: DataFrame, atac: DataFrame, k: int = 20, candidates: int = 200, bandwidth_cells: int = 20, eps: float = 1e-4) -> DataFrame:
    """src, dst, weight, rna_weight: weighted nearest neighbours of two modalities of the same cells (Hao et al. 2021).

    For each cell and modality its vector is predicted as the mean over its own-modality neighbours and over the other
    modality's; the ratio of the two affinities gives the modality's weight (a softmax). The bandwidth of the affinities
    comes from the cells that share least of their neighbours. The nearest `candidates` of either modality are ranked by the
    weighted affinities, and the best k are kept. No vector is shuffled for a candidate.
    """
    x = {m: d.select("id", F.col("vec").cast("array<double>").alias("vec")) for m, d in (("rna", rna), ("atac", atac))}
    wide = {m: knn(d, max(k, candidates)) for m, d in x.items()}
    edges = {m: e.where(F.col("rank") <= k) for m, e in wide.items()}
    near = {m: e.groupBy(F.col("src").alias("id")).agg(F.min("dist").alias("d1")).join(shared_neighbour_bandwidth(e, x[m], k, bandwidth_cells), "id") for m, e in edges.items()}
    near = {m: cut(d, "bandwidths") for m, d in near.items()}

    def affinity(d, d1, sigma):
        return F.exp(-F.greatest(d - d1, F.lit(0.0)) / F.greatest(sigma - d1, F.lit(1e-9)))

    def predicted(e: DataFrame, v: DataFrame) -> DataFrame:
        one = v.select(F.size("vec").alias("n")).first()
        p = e.select("src", "dst").join(v.select(F.col("id").alias("dst"), "vec"), "dst").groupBy(F.col("src").alias("id"))
        return p.agg(F.array(*(F.avg(F.col("vec")[i]) for i in range(one["n"] if one else 0))).cast("array<double>").alias("p"))

    scores = []
    for m, o in (("rna", "atac"), ("atac", "rna")):
        s = x[m].join(near[m], "id").join(predicted(edges[m], x[m]).withColumnRenamed("p", "own"), "id").join(predicted(edges[o], x[m]).withColumnRenamed("p", "cross"), "id")
        own, cross = (affinity(distance(F.col("vec"), F.col(c)), F.col("d1"), F.col("sigma")) for c in ("own", "cross"))
        scores.append(s.select("id", (own / (cross + eps)).alias(f"s_{m}")))
    w = scores[0].join(scores[1], "id").select("id", (1 / (1 + F.exp(F.col("s_atac") - F.col("s_rna")))).alias("rna_weight"))
    both = cut(x["rna"].withColumnRenamed("vec", "rna").join(x["atac"].withColumnRenamed("vec", "atac"), "id"), "vectors")
    e = pair_distances(wide["rna"].select("src", "dst").union(wide["atac"].select("src", "dst")), both, ("rna", "atac"))
    for m in ("rna", "atac"):
        e = e.join(near[m].withColumnRenamed("id", "src"), "src").withColumn(f"f_{m}", affinity(F.col(f"d_{m}"), F.col("d1"), F.col("sigma"))).drop("d1", "sigma")
    e = e.join(w.withColumnRenamed("id", "src"), "src").withColumn("weight", F.col("rna_weight") * F.col("f_rna") + (1 - F.col("rna_weight")) * F.col("f_atac"))
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(F.desc(F.round("weight", 9)), "dst"))).where(F.col("r") <= k)
    out = cut(e.select("src", "dst", "weight", "rna_weight"), "fused")
    release(*wide.values(), *near.values(), both)
    return out
