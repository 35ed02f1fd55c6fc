"""The metric join, the fuzzy graph, fused neighbours and communities against plain versions."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.operators import cluster, communities, metric_join, neighbors


def table(spark, x, ids=None):
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids if ids is not None else range(len(x)), x, strict=True)], "id long, vec array<double>")


def by_hand(q, t, k, same):
    out = set()
    for i, v in q:
        d = sorted((round(math.dist(v, w), 9), j) for j, w in t if not (same and i == j))
        out |= {(i, j, x, r) for r, (x, j) in enumerate(d[:k], 1)}
    return out


def clustered(n, dims=8, centres=40, seed=6):
    r = np.random.RandomState(seed)
    return r.randn(n, dims) * 0.3 + 8 * r.randn(centres, dims)[r.randint(0, centres, n)]


@pytest.mark.parametrize("k", [1, 7])
def test_metric_join_against_all_pairs(spark, monkeypatch, k):
    """Clusters, copies, a far point, and blocks so small that cells are split into rings and salts."""
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 64)
    x = clustered(700)
    x[100:160] = x[100]  # copies
    x[160:330] = x[160] + np.random.RandomState(2).randn(170, 8) * 1e-3  # a heavy cell
    x[5] = 1e4
    got = neighbors.knn(table(spark, x), k)
    assert {(r.src, r.dst, r.dist, r["rank"]) for r in got.collect()} == by_hand(list(enumerate(x)), list(enumerate(x)), k, True)


def test_metric_join_compares_a_small_share_of_clustered_pairs(spark):
    n = 3000
    counted = spark.sparkContext.accumulator(0)
    v = table(spark, clustered(n))
    found = metric_join.nearest(v, v, 10, same_side=True, counted=counted)
    assert found.count() == 10 * n and 0 < counted.value < 0.2 * n * n


def test_metric_join_groups_and_edges(spark):
    r = np.random.RandomState(4)
    rows = lambda n, shift: [(i + shift, f"d{i % 3}", r.randn(5).tolist()) for i in range(n)] + [(999 + shift, None, [0.0] * 5), (998 + shift, "d0", None)]
    q, t = rows(60, 0), rows(90, 1000) + [(5000, "d9", [0.0] * 5)]
    schema = "id long, donor string, vec array<double>"
    got = {tuple(x) for x in metric_join.nearest(spark.createDataFrame(q, schema), spark.createDataFrame(t, schema), 2, group="donor").collect()}
    want = set()
    for d in ("d0", "d1", "d2"):
        of = lambda side: [(i, v) for i, g, v in side if g == d and v]  # noqa: B023, E731
        want |= {(*x, d) for x in by_hand(of(q), of(t), 2, False)}
    assert got == want
    few = table(spark, r.randn(3, 4))
    assert neighbors.knn(few, 10).count() == 6 and neighbors.knn(few, 10, include_self=True).count() == 9
    none = neighbors.knn(few.where("false"), 3)
    assert none.count() == 0 and none.columns == ["src", "dst", "dist", "rank"]
    names = few.select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("id"), "vec")
    assert {x.src for x in neighbors.knn(names, 1).collect()} == {"c0", "c1", "c2"}


def test_memberships_sum_to_the_target(spark):
    v = table(spark, clustered(120))
    lists = neighbors.knn(v, 9).select("src", "dst", "dist")
    for with_self, target in ((True, math.log2(10)), (False, math.log2(9))):
        w = neighbors.memberships(lists, with_self).groupBy("src").agg(F.sum("weight").alias("s"), F.max("weight").alias("m"), F.min("weight").alias("low")).collect()
        assert len(w) == 120 and all(abs(x.s - target) < 1e-9 and x.m == 1 and x.low >= 0 for x in w)
    same = table(spark, np.ones((4, 2)))
    assert {x.weight for x in neighbors.neighbour_graph(same, 3).collect()} == {1.0}
    g = {(x.src, x.dst): x.weight for x in neighbors.neighbour_graph(v, 10).collect()}
    assert all(g[b, a] == pytest.approx(w, abs=1e-12) for (a, b), w in g.items())


def test_bandwidth_by_shared_neighbours(spark):
    x = clustered(80, centres=4)
    v = table(spark, x)
    lists = neighbors.knn(v, 5)
    of = {}
    for r in lists.collect():
        of.setdefault(r.src, {})[r.dst] = r.dist
    got = {r.id: r.sigma for r in neighbors.shared_neighbour_bandwidth(lists, v, 5, cells=6).collect()}
    for i in range(80):
        jaccard = lambda j: len(set(of[i]) & set(of[j])) / len(set(of[i]) | set(of[j]))  # noqa: B023, E731
        with_any = sorted((jaccard(j), -round(math.dist(x[i], x[j]), 9), j) for j in range(80) if j != i and jaccard(j) > 0)
        want = np.mean([-d for _, d, _ in with_any[:6]]) if with_any else max(of[i].values())
        assert got[i] == pytest.approx(want, abs=1e-9)


def partitions(n):
    if not n:
        yield []
        return
    for p in partitions(n - 1):
        for c in range(max(p, default=-1) + 2):
            yield [*p, c]


def quality(edges, p, n, resolution):
    m = sum(w for *_, w in edges)
    k = [sum(w * ((a == i) + (b == i)) for a, b, w in edges) for i in range(n)]
    return sum(w for a, b, w in edges if p[a] == p[b]) / m - resolution * sum(sum(k[i] for i in range(n) if p[i] == c) ** 2 for c in set(p)) / (4 * m * m)


def well_connected(nodes, weight, degree, share):
    """Whether the set can be split again and again into two parts that are tied as well as chance would have it."""
    if len(nodes) == 1:
        return True
    for size in range(1, len(nodes) // 2 + 1):
        for some in itertools.combinations(nodes, size):
            rest = [v for v in nodes if v not in some]
            tie = sum(weight.get((a, b), 0) for a in some for b in rest)
            if tie >= share * sum(degree[a] for a in some) * sum(degree[b] for b in rest) - 1e-9 and well_connected(list(some), weight, degree, share) and well_connected(rest, weight, degree, share):
                return True
    return False


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_leiden_against_all_partitions(spark, seed):
    r = np.random.RandomState(seed)
    n = 9
    edges = [(a, b, float(round(r.rand() * (1.0 if a // 3 == b // 3 else 0.25), 3))) for a in range(n) for b in range(a) if r.rand() < (0.9 if a // 3 == b // 3 else 0.3)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = {x.id: x.cluster for x in communities.leiden(df, 0.8).collect()}
    p = [found.get(i, i) for i in range(n)]
    best = max(quality(edges, q, n, 0.8) for q in partitions(n))
    assert quality(edges, p, n, 0.8) == pytest.approx(best, abs=1e-9)
    assert cluster.modularity(df, communities.leiden(df, 0.8), 0.8) == pytest.approx(best, abs=1e-9)
    weight, degree = {}, dict.fromkeys(range(n), 0.0)
    for a, b, w in edges:
        weight[a, b] = weight[b, a] = w
        degree[a] += w
        degree[b] += w
    for c in set(p):
        assert c == min(i for i in range(n) if p[i] == c)
        assert well_connected([i for i in range(n) if p[i] == c], weight, degree, 0.8 / sum(degree.values()))


def test_leiden_takes_a_bridged_community_apart(spark):
    """A node that ties two groups leaves for a third: with moves alone the two would stay one community, in pieces."""
    ring = [(a, b, 1.0) for base in (0, 10, 20) for a, b in itertools.combinations(range(base, base + 4), 2)]
    edges = [*ring, (3, 30, 1.5), (30, 10, 1.5), (30, 20, 2.0), (30, 21, 2.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    found = {x.id: x.cluster for x in communities.leiden(df, 1.0).collect()}
    assert {found[i] for i in range(4)} == {0} and {found[i] for i in range(10, 14)} == {10} and found[0] != found[10]
    assert communities.leiden(df.where("false")).count() == 0
    text = df.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "weight")
    assert communities.leiden(text, 1.0).select("cluster").distinct().count() == len(set(found.values()))


@pytest.mark.parametrize(("far", "spread"), [(0.0, 1.0), (1e4, 1e-2)])
def test_a_whole_block_gives_the_nearest_within_the_bound(far, spread):
    """In single precision, and where that is too coarse for vectors far from the middle, in double."""
    r = np.random.RandomState(4)
    x, y = (far * r.randint(0, 2, (n, 1)) + spread * r.randint(-3, 4, (n, 6)) for n in (300, 9000))
    d = np.round(np.sqrt(((x[:, None] - y[None]) ** 2).sum(axis=2)), 9)
    kth = np.sort(d, axis=1)[:, 11]
    for bound in (kth, np.full(len(x), np.inf)):
        found = [set() for _ in x]
        for i, j in metric_join._whole(x, y, bound * (1 + 1e-6), 12):
            for a, b in zip(i, j, strict=True):
                found[a].add(b)
        assert all(set(np.flatnonzero(d[a] < kth[a])) <= found[a] for a in range(len(x)))
        assert all(len(f) >= 12 for f in found)


def test_many_neighbours_take_few_blocks(spark, monkeypatch):
    """Without clusters each block may send k rows for every query, so that blocks grow with k; the rows are as they were."""
    r = np.random.RandomState(6)
    n = 1500
    sizes = []
    cells = metric_join._cells
    monkeypatch.setattr(metric_join, "_cells", lambda placed, rows: sizes.append(rows) or cells(placed, rows))
    monkeypatch.setattr(metric_join, "BLOCK_ROWS", 128)
    x = r.standard_normal((n, 16))
    v = spark.createDataFrame([(i, [float(a) for a in x[i]]) for i in range(n)], "id long, vec array<double>")
    found = {(a.src, a.rank): (a.dst, a.dist) for a in metric_join.nearest(v, v, 40, same_side=True).collect()}
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)), 9)
    np.fill_diagonal(d, np.inf)
    for i in range(0, n, 7):
        best = np.lexsort((np.arange(n), d[i]))[:40]
        assert [found[i, at + 1] for at in range(40)] == [(int(j), float(d[i, j])) for j in best]
    assert sizes[0] > 128


def test_distances_of_pairs_shuffle_no_vector_a_pair(spark):
    """Pairs that repeat count once, pairs without a vector are left out; the vectors' columns don't follow the pairs."""
    r = np.random.RandomState(8)
    x, y = r.rand(50, 3), r.rand(50, 4)
    vectors = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(50)] + [(50, None, [0.0] * 4)], "id long, a array<double>, b array<double>")
    some = [(int(i), int(j), int(i + j)) for i, j in r.randint(0, 55, (400, 2))]
    pairs = spark.createDataFrame(some + some[:30], "src int, dst int, n int")
    found = neighbors.pair_distances(pairs, vectors, ("a", "b"))
    got = {(v.src, v.dst): (v.n, v.d_a, v.d_b) for v in found.collect()}
    want = {(i, j): (n, np.linalg.norm(x[i] - x[j]), np.linalg.norm(y[i] - y[j])) for i, j, n in some if max(i, j) < 50}
    assert got.keys() == want.keys() and found.count() == len(want) and all(np.allclose(got[p], want[p], atol=1e-9) for p in want)
    assert found.where("src = 60").count() == 0 and neighbors.pair_distances(pairs.limit(0), vectors, ("a",)).count() == 0
