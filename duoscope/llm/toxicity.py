"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier on its posteriors."""

from __future__ import annotations

import copy
import re
import zlib
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.common import cut, map_texts

#: Insults and slurs of everyday language, by language.
LEXICON = {
    "en": "idiot moron stupid pathetic clown trash scum loser worthless disgusting dumb imbecile fool garbage jerk bastard bitch shit fuck fucking asshole crap vermin filth retard freak ugly hate kill",
    "de": "arschloch scheisse scheiße idiot dumm dummkopf trottel abschaum versager hurensohn widerlich wertlos schlampe fresse verpiss müll",
    "fr": "connard connasse salaud salope merde idiot imbécile crétin débile ordure minable abruti dégoûtant putain bouffon racaille",
    "es": "idiota imbécil estúpido estúpida mierda basura puta cabrón gilipollas inútil asqueroso pendejo escoria payaso tonto",
}
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_SPACE = 1 << 20
_SIZES = (3, 4, 5, 6)


def held_out(key: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_features(word: str) -> list[int]:
    """Hashes of the word, its beginnings and its endings."""
    out = [zlib.crc32(f"={word}".encode("utf-8", "surrogatepass")) % _SPACE]
    for n in _SIZES:
        if len(word) > n:
            out.append(zlib.crc32(f"^{word[:n]}".encode("utf-8", "surrogatepass")) % _SPACE)
            out.append(zlib.crc32(f"${word[-n:]}".encode("utf-8", "surrogatepass")) % _SPACE)
    return out


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _sample_row(text: str | None) -> tuple:
    """n_words, feature hashes, their counts (both packed), lexicon hits by language, share of capitals, share of symbols."""
    words = words_of(text)
    each = Counter(words)
    counts: Counter[int] = Counter()
    for w, c in each.items():
        for f in word_features(w):
            counts[f] += c
    hits = [sum(each.get(w, 0) for w in terms.split()) for terms in LEXICON.values()]
    letters = sum(c.isalpha() for c in text or "")
    capitals = sum(c.isupper() for c in text or "") / max(1, letters)
    marks = sum(map((text or "").count, "#*$%&!")) / max(1, len(text or ""))
    return len(words), np.fromiter(counts.keys(), np.uint32, len(counts)).tobytes(), np.fromiter((min(c, 65535) for c in counts.values()), np.uint16, len(counts)).tobytes(), hits, capitals, marks


class Sample:
    """The labelled sample as a sparse matrix: row, column, count, and words per row."""

    def __init__(self, rows: pd.DataFrame) -> None:
        sizes = [len(x) // 4 for x in rows["idx"]]
        self.n = len(rows)
        self.row = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        self.col = np.frombuffer(b"".join(rows["idx"]), np.uint32)
        self.count = np.frombuffer(b"".join(rows["cnt"]), np.uint16)
        self.words = np.maximum(1, rows["n_words"].to_numpy(np.float64))
        self.label = rows["toxic"].to_numpy(np.float64)
        self.weight = rows["weight"].to_numpy(np.float64)
        self.hits = np.array(rows["hits"].tolist(), np.float64).reshape(self.n, len(LEXICON))
        self.capitals = rows["capitals"].to_numpy(np.float64)
        self.marks = rows["marks"].to_numpy(np.float64)

    def density(self, part: slice = slice(None)) -> np.ndarray:
        return np.minimum(4.0, 100.0 * self.count[part] / self.words[self.row[part]])

    def only(self, features: np.ndarray) -> Sample:
        """The same rows with these features alone: what follows a choice needs no others."""
        own = np.zeros(_SPACE, bool)
        own[features] = True
        mask = own[self.col]
        out = copy.copy(self)
        out.row, out.col, out.count = self.row[mask], self.col[mask], self.count[mask]
        return out


def choose_features(s: Sample, target: np.ndarray, use: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The n features whose density, and the n whose presence, tells the (soft) classes apart most in the rows in use (Welch's t)."""
    share = [np.where(use, 1 - target, 0.0), np.where(use, target, 0.0)]
    size = [max(2.0, float(x.sum())) for x in share]
    df = np.zeros(_SPACE)
    sums = np.zeros((2, 2, 2, _SPACE), np.float32)  # density or presence, class, sum or sum of squares
    for at in range(0, len(s.row), 1 << 19):  # in parts: the driver holds no second copy of the sample
        part = slice(at, at + (1 << 19))
        row, col, value = s.row[part], s.col[part], s.density(part)
        df += np.bincount(col, use[row], _SPACE)
        for c in (0, 1):
            w = share[c][row]
            sums[0, c, 0] += np.bincount(col, w * value, _SPACE)
            sums[0, c, 1] += np.bincount(col, w * value**2, _SPACE)
            sums[1, c] += np.bincount(col, w, _SPACE)
    chosen = []
    for kind in (0, 1):
        mean = [sums[kind, c, 0] / size[c] for c in (0, 1)]
        var = [np.maximum(sums[kind, c, 1] / size[c] - mean[c] ** 2, 0) for c in (0, 1)]
        z = (mean[1] - mean[0]) / np.sqrt(var[1] / size[1] + var[0] / size[0] + 1e-4)
        z[df < 3] = 0
        best = np.argsort(-z, kind="stable")[:n]
        chosen.append(best[z[best] > 2.5])
    return chosen[0], chosen[1]


def votes(s: Sample, dense: np.ndarray, present: np.ndarray, groups: int, seen: np.ndarray) -> np.ndarray:
    """A row per document, a column per voter: 1 toxic, 0 clean, -1 abstains. No voter looks at a label.

    Lexicon voters, one per language, vote 1 on any hit and abstain else. Pattern voters each own a share of the chosen
    word pieces: they vote 1 above and 0 below bounds of their total density or presence, which were set on the labelled
    rows `seen` that induced the pieces. Two more look at capitals and symbols.
    """
    clean, toxic = seen & (s.label < 0.5), seen & (s.label > 0.5)
    out = [np.where(s.hits[:, j] > 0, 1, -1) for j in range(s.hits.shape[1])]
    s = s.only(np.concatenate([dense, present]))
    for features, value in ((dense, s.density()), (present, np.ones(len(s.row)))):
        for g in range(groups):
            own = np.zeros(_SPACE, bool)
            own[features[g::groups]] = True
            mask = own[s.col]
            if not mask.any():
                continue
            total = np.bincount(s.row[mask], value[mask], s.n)
            high = max(float(np.quantile(total[clean], 0.97)) if clean.any() else 0.0, 1e-9)
            low = float(np.quantile(total[toxic], 0.2)) if toxic.any() else 0.0
            out.append(np.where(total > high, 1, np.where(total <= min(low, high), 0, -1)))
    out.append(np.where(s.capitals > 0.6, 1, -1))
    out.append(np.where(s.marks > 0.05, 1, -1))
    return np.array(out).T


class LabelModel:
    """A generative model of class and votes, with the voters' accuracies and their correlations, learned by EM.

    P(class) * product over voters of P(vote | class, vote of its parent): the parents form the tree of the greatest
    mutual information given the class (Chow and Liu 1968, for either class at once), found anew in every round, so that
    voters who repeat each other count once. `tables` holds these probabilities, `accuracy` the share of right votes of
    each voter where it votes. EM starts from the voters' own majority. Rows whose class is `known` anchor it; a row's own
    posterior `p` comes from its votes alone.
    """

    def __init__(self, v: np.ndarray, weight: np.ndarray, known: np.ndarray | None = None, rounds: int = 15, smooth: float = 0.5) -> None:
        n, j = v.shape
        known = np.full(n, np.nan) if known is None else known
        one_hot = np.zeros((n, j * 3))
        one_hot[np.arange(n)[:, None], np.arange(j) * 3 + v + 1] = 1
        self.p = ((v == 1).sum(axis=1) + 0.1) / ((v >= 0).sum(axis=1) + 1.0)
        for _ in range(rounds):
            p = np.where(np.isnan(known), self.p, known)
            self.prior = float(np.clip((weight * p).sum() / weight.sum(), 0.005, 0.5))
            joint = [((one_hot * (weight * c)[:, None]).T @ one_hot + smooth / 3).reshape(j, 3, j, 3) for c in (1 - p, p)]
            alone = [np.einsum("iaia->ia", x) for x in joint]
            alone = [x / x.sum(axis=1, keepdims=True) for x in alone]
            self.parent = self._tree(joint, alone)
            # a conditional table leans on the voter's own distribution by two rows' weight
            self.tables = [
                np.array([np.tile(a[k], (3, 1)) if i < 0 else (x[i, :, k] + 2 * a[k]) / (x[i, :, k] + 2 * a[k]).sum(axis=1, keepdims=True) for k, i in enumerate(self.parent)])
                for x, a in zip(joint, alone, strict=True)
            ]
            right = (1 - self.prior) * alone[0][:, 1] + self.prior * alone[1][:, 2]
            self.accuracy = right / sum(q * (a[:, 1] + a[:, 2]) for q, a in zip((1 - self.prior, self.prior), alone, strict=True))
            self.p = self.posterior(v)

    def _tree(self, joint: list[np.ndarray], alone: list[np.ndarray]) -> np.ndarray:
        """Each voter's parent (-1: none) in the spanning tree of the greatest conditional mutual information (Prim)."""
        j = len(alone[0])
        mi = np.zeros((j, j))
        for q, x, a in zip((1 - self.prior, self.prior), joint, alone, strict=True):
            x = x / x.sum(axis=(1, 3), keepdims=True)
            mi += q * (x * (np.log(x) - np.log(a[:, :, None, None]) - np.log(a[None, None]))).sum(axis=(1, 3))
        parent, best, via, inside = np.full(j, -1), mi[0].copy(), np.zeros(j, int), np.zeros(j, bool)
        inside[0] = True
        for _ in range(j - 1):
            k = int(np.where(inside, -np.inf, best).argmax())
            parent[k], inside[k] = via[k], True
            closer = (mi[k] > best) & ~inside
            best, via = np.where(closer, mi[k], best), np.where(closer, k, via)
        return parent

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(class 1 | votes) of every row."""
        z = np.full(len(v), np.log(self.prior / (1 - self.prior)))
        for k, i in enumerate(self.parent):
            above = v[:, max(0, i)] + 1
            z += np.log(self.tables[1][k][above, v[:, k] + 1]) - np.log(self.tables[0][k][above, v[:, k] + 1])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def posterior_labels(s: Sample, fold: np.ndarray, n_features: int, groups: int) -> np.ndarray:
    """P(toxic) of every row by voters and a label model that never saw the row's own label.

    For each fold, the rows outside it induce the pattern voters and anchor the label model; all rows vote, and the rows
    of the fold take the posterior of their votes.
    """
    p = np.empty(s.n)
    for f in np.unique(fold):
        seen = fold != f
        dense, present = choose_features(s, s.label, seen, n_features)
        model = LabelModel(votes(s, dense, present, groups, seen), s.weight, np.where(seen, s.label, np.nan))
        p[~seen] = model.p[~seen]
    return p


def fit_linear(s: Sample, dense: np.ndarray, present: np.ndarray, target: np.ndarray, l2: float = 2e-4, rounds: int = 400) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft targets by Adam; a weight per chosen density and presence feature, and the intercept."""
    index = np.full((2, _SPACE), -1, np.int64)
    index[0, dense] = np.arange(len(dense))
    index[1, present] = len(dense) + np.arange(len(present))
    rows, cols, vals = [], [], []
    for k, value in enumerate((s.density(), np.ones(len(s.row)))):
        mask = index[k, s.col] >= 0
        rows.append(s.row[mask])
        cols.append(index[k, s.col[mask]])
        vals.append(value[mask])
    r, c, x = np.concatenate(rows), np.concatenate(cols), np.concatenate(vals)
    n = len(dense) + len(present)
    w = np.zeros(n + 1)
    w[n] = -2.0
    m, u = np.zeros(n + 1), np.zeros(n + 1)
    total = s.weight.sum()
    for i in range(1, rounds + 1):
        z = np.bincount(r, x * w[c], s.n) + w[n]
        d = s.weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / total
        g = np.append(np.bincount(c, x * d[r], n) + l2 * w[:n], d.sum())
        m, u = 0.9 * m + 0.1 * g, 0.999 * u + 0.001 * g * g
        w -= 0.05 * (m / (1 - 0.9**i)) / (np.sqrt(u / (1 - 0.999**i)) + 1e-9)
    return w[: len(dense)], w[len(dense) : n], float(w[n])


class Classifier:
    """Sparse weights by feature hash; what executors get: a few thousand numbers, whatever the input's size."""

    def __init__(self, dense: dict[int, float], present: dict[int, float], intercept: float) -> None:
        self.dense, self.present, self.intercept = dense, present, intercept

    def raw(self, s: Sample) -> np.ndarray:
        """The log odds of a sample's rows."""
        z = np.full(s.n, self.intercept)
        s = s.only(np.array([*self.dense, *self.present], np.int64))
        for weights, value in ((self.dense, s.density()), (self.present, np.ones(len(s.row)))):
            w = np.zeros(_SPACE)
            w[list(weights)] = list(weights.values())
            z += np.bincount(s.row, w[s.col] * value, s.n)
        return z

    def scorer(self) -> Callable[[str | None], tuple]:
        memo: dict[str, list[int]] = {}
        dense, present, known = self.dense, self.present, set(self.dense) | set(self.present)

        def score(text: str | None) -> tuple:
            words = words_of(text)
            counts: dict[int, int] = {}
            for w, c in Counter(words).items():
                found = memo.get(w)
                if found is None:
                    found = [f for f in word_features(w) if f in known]
                    if len(memo) < 300_000:
                        memo[w] = found
                for f in found:
                    counts[f] = counts.get(f, 0) + c
            z, n = self.intercept, max(1, len(words))
            for f, c in counts.items():
                z += dense.get(f, 0.0) * min(4.0, 100.0 * c / n) + present.get(f, 0.0)
            return (float(1 / (1 + np.exp(-max(-30.0, min(30.0, z))))),)

        return score


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "toxic",
    max_rows: int = 6000, max_bytes: int = 128 << 20, n_features: int = 1500, groups: int = 8, folds: int = 5, threshold: float = 0.3, seed: int = 5,
) -> Classifier:
    """Fits voters, label model and classifier on a bounded sample of labelled rows outside the held-out fold.

    The sample has at most max_rows // 2 rows of either label, by a hash of the id, and of these, in that order, as many
    as fit into max_bytes of features (half for either label; the driver holds no more). Each row weighs as much as it
    stands for. Whole texts are read. The classifier learns the posteriors of posterior_labels(); the gold labels of the
    sample set nothing but its intercept, so that `threshold` parts the two classes with the best F1. Without rows of both
    labels the score is constant: the share of label 1.
    """
    rows = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("toxic in (0, 1) and id is not null")
    rows = rows.where(~held_out(F.col("id"))).groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    half = max_rows // 2
    order = F.xxhash64("id", F.lit(seed))
    some = rows.where("toxic = 0").orderBy(order, "id").limit(half).union(rows.where("toxic = 1").orderBy(order, "id").limit(half))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(some), "id")
    texts = texts.groupBy("id", "toxic").agg(F.min("text").alias("text"))  # one row for an id
    sample = cut(map_texts(texts, [F.col("id"), F.col("toxic")], "text", "n_words long, idx binary, cnt binary, hits array<int>, capitals double, marks double", lambda: _sample_row), "sample")
    upto = Window.partitionBy("toxic").orderBy(order, "id").rowsBetween(Window.unboundedPreceding, 0)
    fits = sample.select("id", F.sum(F.octet_length("idx") + F.octet_length("cnt")).over(upto).alias("upto")).where(F.col("upto") <= max_bytes // 2)
    sample = sample.join(F.broadcast(fits.select("id")), "id").toPandas()
    sample = sample.sort_values("id", ignore_index=True)
    seen = sample["toxic"].value_counts()
    if len(seen) < 2:
        share = (totals.get(1, 0) + 0.01) / (sum(totals.values()) + 1.0)
        return Classifier({}, {}, float(np.log(share / (1 - share))))
    sample["weight"] = [totals[t] / seen[t] for t in sample["toxic"]]
    fold = np.array([zlib.crc32(f"{seed}:{i}".encode()) % folds for i in sample["id"]])
    s = Sample(sample)
    del sample
    p = posterior_labels(s, fold, n_features, groups)
    dense, present = choose_features(s, p, np.ones(s.n, bool), n_features)
    wd, wp, b = fit_linear(s.only(np.concatenate([dense, present])), dense, present, p)
    model = Classifier(dict(zip(dense.tolist(), wd.tolist(), strict=True)), dict(zip(present.tolist(), wp.tolist(), strict=True)), b)
    model.intercept += best_shift(model.raw(s), s.label, s.weight, threshold)
    return model


def best_shift(z: np.ndarray, label: np.ndarray, weight: np.ndarray, threshold: float) -> float:
    """What to add to the log odds, between -2 and 2, for the best F1 at the threshold; of the best shifts the middle one."""
    at = np.log(threshold / (1 - threshold))
    shifts = np.linspace(-2, 2, 81)
    f1 = []
    for d in shifts:
        said = z + d >= at
        right = (weight * label)[said].sum()
        f1.append(2 * right / max(1e-9, weight[said].sum() + (weight * label).sum()))
    best = shifts[np.isclose(f1, max(f1))]
    return float(best[len(best) // 2])


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how) -> DataFrame:
    """doc_id, held_out, score, predicted, a row per input row.

    The score is a function of the text alone: a null text scores as an empty one, equal texts alike. A null id isn't in
    the held-out fold, and is never trained on. Labels other than 0 and 1, or of unknown documents, are passed over; of
    repeated labels of a document 1 wins. An empty table gives an empty result. Other columns are not read.
    """
    model = train(docs, labels, id_col, text_col, threshold=threshold, **how)
    rows = map_texts(docs, [F.col(id_col).alias("doc_id")], text_col, "score double", model.scorer)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
