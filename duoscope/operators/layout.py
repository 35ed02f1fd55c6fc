"""A two-dimensional layout of cells by uniform manifold approximation (McInnes et al. 2018)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions.tables import cut
from duoscope.operators import neighbors


def _place(start: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray, epochs: int, negatives: int, seed: int, a: float = 1.577, b: float = 0.8951) -> np.ndarray:
    """Stochastic gradient rounds: neighbours attract, random nodes repel. a and b are those of a minimal distance of 0.1."""
    r, y = np.random.RandomState(seed), start.copy()
    chance = weight / weight.max()
    for epoch in range(epochs):
        step = 1.0 - epoch / epochs
        go = r.rand(len(src)) < chance
        i, j = src[go], dst[go]
        d = y[i] - y[j]
        q = (d * d).sum(axis=1, keepdims=True)
        pull = np.clip(-2 * a * b * np.power(np.maximum(q, 1e-12), b - 1) / (1 + a * np.power(q, b)) * d, -4, 4)
        move = np.zeros_like(y)
        np.add.at(move, i, pull)
        np.add.at(move, j, -pull)
        for _ in range(negatives):
            k = r.randint(0, len(y), len(i))
            d = y[i] - y[k]
            q = (d * d).sum(axis=1, keepdims=True)
            np.add.at(move, i, np.clip(2 * b / ((0.001 + q) * (1 + a * np.power(q, b))) * d, -4, 4))
        # a node's moves of an epoch are averaged by their number, as they are made at once and not one by one
        n = np.bincount(i, minlength=len(y)) * (1 + negatives) + np.bincount(j, minlength=len(y))
        y += step * move / np.sqrt(np.maximum(1, n))[:, None]
    return y


def umap(vectors: DataFrame, k: int = 15, landmarks: int = 50_000, epochs: int = 200, negatives: int = 5, seed: int = 0) -> DataFrame:
    """id, x, y: a layout that keeps neighbours together; vectors: id, vec.

    Up to `landmarks` cells, chosen by a hash, are laid out on the driver from the graph of their own neighbours, which
    bounds the driver's memory and time. Every other cell is placed among its nearest landmarks, by their memberships;
    that is one indexed search of all cells, in parallel.
    """
    n = vectors.count()
    v = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    some = v if n <= landmarks else v.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(landmarks)
    some = cut(some, "landmarks")
    kind = dict(vectors.dtypes)["id"]
    search = neighbors.knn if min(n, landmarks) <= 2 * neighbors.BLOCK_ROWS else neighbors.knn_indexed
    graph = neighbors.fuzzy_union(neighbors.memberships(search(some, k).select("src", "dst", "dist"))).where("weight > 0").orderBy("src", "dst").toPandas()
    rows = some.orderBy("id").toPandas()
    ids = rows["id"].to_numpy()
    if len(ids) < 3:
        return v.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    x = np.stack(rows["vec"])
    x = x - x.mean(axis=0)
    start = x @ np.linalg.svd(x.T @ x)[0][:, :2]
    start = np.pad(start, ((0, 0), (0, 2 - start.shape[1])))
    start = 10 * start / max(1e-12, np.abs(start).max()) + np.random.RandomState(seed).normal(0, 1e-4, start.shape)
    place = {i: at for at, i in enumerate(ids)}
    src, dst = graph["src"].map(place).to_numpy(), graph["dst"].map(place).to_numpy()
    y = _place(start, src, dst, graph["weight"].to_numpy(), epochs, negatives, seed)
    spark = vectors.sparkSession
    placed = spark.createDataFrame(pd.DataFrame({"id": ids, "x": y[:, 0], "y": y[:, 1]}), f"id {kind}, x double, y double")
    if n <= landmarks:
        return placed
    rest = v.join(some.select("id"), "id", "left_anti")
    w = neighbors.memberships(neighbors.knn_indexed(some, k, queries=rest).select("src", "dst", "dist"))
    w = w.join(placed.withColumnRenamed("id", "dst"), "dst").groupBy(F.col("src").alias("id"))
    mean = lambda c: (F.sum(F.col("weight") * F.col(c)) / F.sum("weight")).alias(c)
    return placed.union(w.agg(mean("x"), mean("y")))
