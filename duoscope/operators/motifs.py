"""Position weight matrices: thresholds, and scans of both strands."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the p-value of a motif hit, 5 ** -4.
MOTIF_P = 5.0**-4
BASES = "ACGT"


def reverse_complement(pwm: DataFrame) -> DataFrame:
    """pwm: motif_id, pos (from 0), base, weight. The same motif read on the other strand."""
    width = pwm.groupBy("motif_id").agg((F.max("pos") + 1).alias("w"))
    return pwm.join(width, "motif_id").select("motif_id", (F.col("w") - 1 - F.col("pos")).cast("int").alias("pos"), F.translate("base", "ACGT", "TGCA").alias("base"), "weight")


def threshold_normal(pwm: DataFrame, p: float = MOTIF_P) -> DataFrame:
    """motif_id, threshold: mean + z sd of the score of a uniform background, within the reachable scores."""
    z = NormalDist().inv_cdf(1 - p)
    s = pwm.groupBy("motif_id", "pos").agg(F.avg("weight").alias("m"), F.var_pop("weight").alias("v"), F.min("weight").alias("lo"), F.max("weight").alias("hi"))
    s = s.groupBy("motif_id").agg(*(F.sum(c).alias(c) for c in ("m", "v", "lo", "hi")))
    t = F.when(F.col("v") > 0, F.greatest("lo", F.least("hi", F.col("m") + F.lit(z) * F.sqrt("v")))).otherwise(F.col("hi"))
    return s.select("motif_id", t.alias("threshold"))


def threshold_exact(matrix: np.ndarray, p: float = MOTIF_P, step: float = 1e-3) -> float:
    """The least score whose upper tail under a uniform background is at most p: score distributions convolved by column."""
    low = matrix.min(axis=0)
    cells = np.round((matrix - low) / step).astype(np.int64)
    dist = np.ones(1)
    for j in range(matrix.shape[1]):
        out = np.zeros(len(dist) + cells[:, j].max())
        for i in range(4):
            out[cells[i, j] : cells[i, j] + len(dist)] += dist / 4
        dist = out
    tail = np.cumsum(dist[::-1])[::-1]
    ok = np.nonzero((tail <= p * (1 + 1e-12)) & (dist > 0))[0]  # scores that some word has
    at = ok[0] if len(ok) else len(dist) - 1
    return float(low.sum() + at * step)


#: So many weights (motifs x columns x 4) may go to the driver and, as matrices, to every executor: some 32 MB.
MAX_WEIGHTS = 1 << 22


def matrices(pwm: DataFrame) -> dict[str, np.ndarray]:
    """motif_id -> 4 x W doubles on the driver: a few hundred motifs of some 30 columns; refused beyond MAX_WEIGHTS."""
    out = {}
    rows = pwm.limit(MAX_WEIGHTS + 1).toPandas()
    if len(rows) > MAX_WEIGHTS:
        raise ValueError(f"more than {MAX_WEIGHTS} weights: scan the motifs in several calls")
    for motif, g in rows.groupby("motif_id"):
        m = np.zeros((4, int(g["pos"].max()) + 1))
        m[[BASES.index(b) for b in g["base"]], g["pos"].astype(int)] = g["weight"]
        out[motif] = m
    return out


def exact_thresholds(pwm: DataFrame, p: float = MOTIF_P) -> DataFrame:
    rows = [(k, threshold_exact(m, p)) for k, m in sorted(matrices(pwm).items())]
    return pwm.sparkSession.createDataFrame(rows, "motif_id string, threshold double")


#: Windows that one row holds at most.
_CHUNK = 512


def _words(sequences: DataFrame, widths: DataFrame) -> DataFrame:
    """(peak, w, word): the windows of each width; repeats within a chunk of a sequence are left out. A file of few row
    groups is dealt over all cores first."""
    dealt = sequences.select("peak", "seq").repartition(4 * sequences.sparkSession.sparkContext.defaultParallelism)
    long_enough = dealt.crossJoin(F.broadcast(widths)).where(F.length("seq") >= F.col("w"))
    starts = F.explode(F.sequence(F.lit(0), F.floor((F.length("seq") - F.col("w")) / _CHUNK)))
    chunks = long_enough.select("peak", "w", "seq", starts.alias("j"))
    chunks = chunks.select("peak", "w", F.substring("seq", (F.col("j") * _CHUNK + 1).cast("int"), F.col("w") + F.lit(_CHUNK - 1)).alias("seq"))
    each = F.transform(F.sequence(F.lit(1), F.length("seq") - F.col("w") + 1), lambda i: F.substring("seq", i, F.col("w")))
    return chunks.select("peak", "w", F.explode(F.array_distinct(each)).alias("word"))


def scan_relational(sequences: DataFrame, pwm: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Distinct (motif_id, peak) whose best window on either strand reaches the threshold, by joins and sums.

    sequences: peak, seq. A window with anything but A, C, G, T has fewer scores than columns. Each distinct window of a motif's width is
    scored once, however often it stands, and the windows that reach the threshold meet the sequences again. Sums are
    rounded to 9 places before the comparison. Rows: windows, and distinct windows times motif columns.
    """
    width = pwm.groupBy("motif_id").agg((F.max("pos") + 1).cast("int").alias("w"))
    both = pwm.withColumn("strand", F.lit("+")).union(reverse_complement(pwm).withColumn("strand", F.lit("-"))).join(width, "motif_id")
    words = _words(sequences, width.select("w").distinct())
    letters = words.select("w", "word").distinct().select("w", "word", F.posexplode(F.split("word", "")).alias("pos", "base"))
    s = letters.join(both, ["w", "pos", "base"]).groupBy("motif_id", "strand", "w", "word").agg(F.sum("weight").alias("score"), F.count("*").alias("n"))
    reach = s.where("n = w").join(thresholds, "motif_id").where(F.round("score", 9) >= F.round("threshold", 9))
    return words.join(reach.select("motif_id", "w", "word").distinct(), ["w", "word"]).select("motif_id", "peak").distinct()


def best_scores(seq: str, matrix: np.ndarray) -> float:
    """The best window score on both strands; -inf without a valid window."""
    w = matrix.shape[1]
    code = np.array([BASES.find(c) for c in seq], np.int64)
    n = len(code) - w + 1
    if n < 1:
        return -math.inf
    bad = np.concatenate([[0], np.cumsum(code < 0)])
    valid = bad[w:] - bad[:-w] == 0
    if not valid.any():
        return -math.inf
    code = np.maximum(code, 0)
    best = -math.inf
    for m in (matrix, matrix[::-1, ::-1]):
        s = sum(m[code[j : j + n], j] for j in range(w))
        best = max(best, float(s[valid].max()))
    return best


#: Letters of a window that are looked up at once, and codes of such windows.
AHEAD = 8
_CODES = 4**AHEAD
#: So many entries the table of windows may have; motifs beyond it are scored on every window.
MAX_ENTRIES = 1 << 24
_SLACK = 1e-6


@dataclass
class Lookahead:
    """Both strands of motifs, and for each window of AHEAD letters those that it may begin, or be in, a hit of.

    weights: strands x columns x 4, zero beyond a strand's width; least: thresholds; ahead: where the AHEAD columns begin;
    order: columns by information, greatest first; rest: the most that the columns from each place of that order on can
    add; starts and entries: the strands of window w are entries[starts[w] : starts[w + 1]]; always: strands that are in no
    table, as too many windows would pass.
    """

    motif: list[str]
    weights: np.ndarray
    width: np.ndarray
    least: np.ndarray
    ahead: np.ndarray
    order: np.ndarray
    rest: np.ndarray
    starts: np.ndarray
    entries: np.ndarray
    always: np.ndarray


def lookahead(motifs: dict[str, np.ndarray], least: dict[str, float]) -> Lookahead | None:
    """The index of the motifs (4 x W each) that have a threshold; None without any."""
    strands = [(k, m) for k in sorted(motifs) if k in least for m in (motifs[k], motifs[k][::-1, ::-1])]
    if not strands:
        return None
    n, most = len(strands), max(AHEAD, max(m.shape[1] for _, m in strands))
    weights, width = np.zeros((n, most, 4)), np.array([m.shape[1] for _, m in strands])
    for i, (_, m) in enumerate(strands):
        weights[i, : width[i]] = m.T
    bound = np.array([round(least[k], 9) for k, _ in strands]) - _SLACK
    # a column tells more, the farther its letters' weights lie apart
    tells = np.where(np.arange(most) < width[:, None], weights.var(axis=2), -1.0)
    order = np.argsort(-tells, axis=1, kind="stable")
    best = weights.max(axis=2)
    ordered = np.take_along_axis(best, order, 1)
    rest = np.concatenate([np.cumsum(ordered[:, ::-1], axis=1)[:, ::-1], np.zeros((n, 1))], axis=1)
    ahead, passing, always, entries = np.zeros(n, np.int64), [], [], 0
    for i in range(n):
        spans = range(max(1, int(width[i]) - AHEAD + 1))
        at = max(spans, key=lambda j: (tells[i, j : j + AHEAD].clip(0).sum(), -j))  # noqa: B023
        ahead[i] = at
        sums = np.zeros(1)
        for j in range(at, at + AHEAD):
            sums = (sums[:, None] + weights[i, j][None]).ravel()
        codes = np.flatnonzero(sums + best[i].sum() - best[i, at : at + AHEAD].sum() >= bound[i])
        entries += len(codes)
        if entries > MAX_ENTRIES:
            always.append(i)
            entries -= len(codes)
            codes = codes[:0]
        passing.append(codes)
    of = np.repeat(np.arange(n), [len(c) for c in passing])
    codes = np.concatenate(passing)
    by_code = np.argsort(codes, kind="stable")
    starts = np.searchsorted(codes[by_code], np.arange(_CODES + 1))
    return Lookahead([k for k, _ in strands], weights, width, bound, ahead, order, rest, starts, of[by_code].astype(np.int32), np.array(always, np.int64))


_LETTERS = np.full(256, -1, np.int8)
_LETTERS[np.frombuffer(BASES.encode(), np.uint8)] = np.arange(4)


def hits_of(seq: str, index: Lookahead, chunk: int = 2048) -> tuple[list[str], int]:
    """The motifs with a window of the sequence, on either strand, that reaches the threshold; and how many windows were
    scored beyond the table.

    The letters are coded once for all motifs. Windows that the table lets through are scored column by column, the most
    telling first, and dropped when the columns that are left can't lift them to the threshold.
    """
    code = _LETTERS[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)].astype(np.int64)
    n, most = len(code), index.weights.shape[1]
    bad = np.concatenate([[0], np.cumsum(code < 0)])
    padded = np.concatenate([np.maximum(code, 0), np.zeros(most, np.int64)])
    windows = np.zeros(n, np.int64)
    for j in range(AHEAD):
        windows = windows * 4 + padded[j : j + n]
    found = np.zeros(len(index.motif), bool)
    scored = 0
    for a in range(0, n, chunk):
        w = windows[a : a + chunk]
        many = index.starts[w + 1] - index.starts[w]
        first = np.repeat(index.starts[w] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        strand = index.entries[first + np.arange(many.sum())].astype(np.int64)
        at = np.repeat(np.arange(a, a + len(w)), many)
        if len(index.always):
            strand = np.concatenate([strand, np.repeat(index.always, len(w))])
            at = np.concatenate([at, np.tile(np.arange(a, a + len(w)), len(index.always))])
        at = at - index.ahead[strand]
        ends = at + index.width[strand]
        keep = (at >= 0) & (ends <= n) & ~found[strand]
        strand, at, ends = strand[keep], at[keep], ends[keep]
        keep = bad[ends] == bad[at]
        strand, at = strand[keep], at[keep]
        scored += len(strand)
        score = np.zeros(len(strand))
        for r in range(most):
            column = index.order[strand, r]
            score += index.weights[strand, column, padded[at + column]]
            keep = score + index.rest[strand, r + 1] >= index.least[strand]
            strand, at, score = strand[keep], at[keep], score[keep]
            if not len(strand):
                break
        exact = np.zeros(len(strand))
        for j in range(most):  # in the order of the columns, as the threshold is met to the ninth place
            exact += index.weights[strand, j, padded[at + j]]
        found[strand[np.round(exact, 9) >= np.round(index.least[strand] + _SLACK, 9)]] = True
    return sorted({index.motif[i] for i in np.flatnonzero(found)}), scored


def scan(sequences: DataFrame, pwm: DataFrame, thresholds: DataFrame) -> DataFrame:
    """scan_relational() in Arrow batches by lookahead: every motif over a sequence at once, with no row per base.

    sequences: peak, seq; a null or empty sequence has no hits. The index goes to the executors as a broadcast of a bounded
    size: the matrices, and MAX_ENTRIES entries of 4 bytes.
    """
    t = {r["motif_id"]: r["threshold"] for r in thresholds.limit(MAX_WEIGHTS).collect()}
    index = lookahead(matrices(pwm), t)
    sent = sequences.sparkSession.sparkContext.broadcast(index)

    def hits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [(k, p) for p, s in zip(pdf["peak"], pdf["seq"], strict=True) if s and sent.value for k in hits_of(s, sent.value)[0]]
            yield pd.DataFrame(found, columns=["motif_id", "peak"])

    return sequences.select("peak", "seq").mapInPandas(hits, "motif_id string, peak string").distinct()
