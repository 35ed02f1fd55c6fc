"""Batch correction by soft clusters and per-cluster ridge regressions (Korsunsky et al. 2019)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def harmony(cells: DataFrame, clusters: int = 100, theta: float = 2.0, sigma: float = 0.1, lam: float = 1.0, max_iter: int = 20, tol: float = 1e-4, seed: int = 0) -> DataFrame:
    """cell_id, vec with batch effects taken out; cells: cell_id, batch, vec.

    An iteration broadcasts clusters x dims centroids and corrections and gathers clusters x (batches + 1) x (dims + 1)
    sums; cells are never shuffled. It ends when the mean shift of the centroids is below tol.
    """
    spark = cells.sparkSession
    shape = cells.agg(F.max(F.size("vec")).alias("d"), F.count("*").alias("n")).first()
    batches = [r["batch"] for r in cells.select("batch").distinct().orderBy("batch").collect()]
    d, n = shape["d"], shape["n"]
    kind = dict(cells.dtypes)["cell_id"]
    if not n or len(batches) < 2:
        return cells.select("cell_id", F.col("vec").cast("array<double>").alias("vec"))
    k = max(1, min(clusters, n // 30 or 1))
    number = {b: i for i, b in enumerate(batches)}
    seeds = cells.orderBy(F.xxhash64("cell_id", F.lit(seed))).limit(k).select("vec").collect()
    y = np.array([r["vec"] for r in seeds], float)
    y /= np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    sizes = {r["batch"]: r["n"] for r in cells.groupBy("batch").agg(F.count("*").alias("n")).collect()}
    share = np.array([sizes[b] for b in batches], float) / n
    penalty = np.ones((k, len(batches)))
    w = np.zeros((k, len(batches), d))

    def assign(z: np.ndarray, b: np.ndarray, y: np.ndarray, penalty: np.ndarray) -> np.ndarray:
        u = z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        a = -2 * (1 - u @ y.T) / sigma
        r = np.exp(a - a.max(axis=1, keepdims=True)) * penalty[:, b].T
        return r / r.sum(axis=1, keepdims=True)

    def corrected(x: np.ndarray, b: np.ndarray, r: np.ndarray, w: np.ndarray) -> np.ndarray:
        return x - np.einsum("ik,kid->id", r, w[:, b])

    for _ in range(max_iter):
        sent = spark.sparkContext.broadcast((y, penalty, w))

        def sums(it):
            y, penalty, w = sent.value
            total = np.zeros((k, len(batches), d + 1))
            shape = np.zeros((k, d))
            for pdf in it:
                x, b = np.stack(pdf["vec"]).astype(float), pdf["batch"].map(number).to_numpy()
                r = assign(x, b, y, penalty)
                z = corrected(x, b, r, w)
                r = assign(z, b, y, penalty)
                one = np.eye(len(batches))[b]
                total[:, :, :d] += np.einsum("ik,ib,id->kbd", r, one, x)
                total[:, :, d] += r.T @ one
                shape += r.T @ (z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12))
            yield pd.DataFrame({"i": np.arange(total.size + shape.size), "v": np.concatenate([total.ravel(), shape.ravel()])})

        rows = cells.select("batch", "vec").mapInPandas(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
        total, centers = rows[: k * len(batches) * (d + 1)].reshape(k, len(batches), d + 1), rows[k * len(batches) * (d + 1) :].reshape(k, d)
        o = total[:, :, d]
        e = o.sum(axis=1, keepdims=True) * share
        penalty = ((e + 1) / (o + 1)) ** theta
        for c in range(k):  # ridge on [1, batch one-hot]; the intercept isn't penalized nor taken out
            m = np.zeros((len(batches) + 1,) * 2)
            m[0, 0] = o[c].sum()
            m[0, 1:] = m[1:, 0] = o[c]
            m[1:, 1:] = np.diag(o[c] + lam)
            right = np.vstack([total[c, :, :d].sum(axis=0), total[c, :, :d]])
            w[c] = np.linalg.lstsq(m, right, rcond=None)[0][1:]
        new = centers / np.maximum(np.linalg.norm(centers, axis=1, keepdims=True), 1e-12)
        shift = float(np.abs(new - y).mean())
        y = new
        if shift < tol:
            break
    sent = spark.sparkContext.broadcast((y, penalty, w))

    def apply(it):
        y, penalty, w = sent.value
        for pdf in it:
            x, b = np.stack(pdf["vec"]).astype(float), pdf["batch"].map(number).to_numpy()
            yield pd.DataFrame({"cell_id": pdf["cell_id"], "vec": list(corrected(x, b, assign(x, b, y, penalty), w))})

    return cells.select("cell_id", "batch", "vec").mapInPandas(apply, f"cell_id {kind}, vec array<double>")
