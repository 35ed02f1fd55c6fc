"""The n-gram join, the fill-in-middle transformation and hard negatives against brute-force versions, and on edge rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope.llm import hard_negatives as hn
from duoscope.llm import infill, ngram_join
from duoscope.llm.minhash import shingle_hashes
from tests.llm.test_corpus_operators import components_by_hand, corpus, edge, frame  # noqa: F401


def rows_of(df):
    return {(r.id, r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize("k,per_cent", [(3, 90), (3, 100), (2, 60), (1, 80)])
def test_linked_classes_against_all_pairs(spark, k, per_cent):
    rows = corpus(seed=k + per_cent)
    assert rows_of(ngram_join.linked_classes(frame(spark, rows), k=k, per_cent=per_cent)) == set(components_by_hand(rows, k, per_cent))


@pytest.mark.parametrize("length,block", [(150, 2048), (40, 16), (700, 2048)])
def test_linked_classes_of_copies_about_the_bound(spark, monkeypatch, length, block):
    """A group of copies of which no two are alike, with pairs on either side of the bound; over small blocks too."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", block)
    r = random.Random(length)
    words = [f"w{i}" for i in range(400)]
    base = r.choices(words, k=length)
    rows = []
    for i in range(160):
        copy = list(base)
        for _ in range(r.randint(1, max(2, length // 45))):
            copy[r.randrange(length)] = r.choice(words)
        rows.append((i, " ".join(copy), "en", "s"))
    want = set(components_by_hand(rows, 3, 90))
    assert rows_of(ngram_join.linked_classes(frame(spark, rows))) == want and len({c for *_, c in want}) > 5


def test_short_texts_link_by_few_shingles(spark):
    """Ten shingles against nine of them are just at the bound; one word or two are a sequence of their own."""
    w = [f"w{i}" for i in range(20)]
    rows = [(1, " ".join(w[:12]), "", ""), (2, " ".join(w[:11]), "", ""), (3, " ".join(w[1:11]), "", ""), (4, "W0 w1", "", ""), (5, "w0  W1", "", ""), (6, "w0", "", "")]
    assert rows_of(ngram_join.linked_classes(frame(spark, rows))) == {(1, 10, 1), (2, 9, 1), (3, 8, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6)}


def test_linked_sets_share_a_tile_and_pass_the_bound():
    """Any two sets at the bound or above, of any sizes: one piece in common, in the tiles of a band that both are in."""
    r = np.random.RandomState(5)
    for per_cent in (60, 80, 90, 97):
        edges = ngram_join.band_edges(per_cent, 5000)
        for n in [*range(1, 40), 99, 250, 1000]:
            x = np.unique(r.randint(0, 1 << 62, 2 * n).astype(np.uint64))
            for a, b in ((0, n * (100 - per_cent) // 100), (n // 50, 0), (0, 0)):
                s, t = np.sort(x[:n]), np.sort(x[a : n - b])
                both = len(np.intersect1d(s, t))
                if not both or 100 * both < per_cent * (len(s) + len(t) - both):
                    continue
                keys = []
                for v in (s, t):
                    band = int(np.searchsorted(edges, len(v), "right")) - 1
                    own = ngram_join.piece_keys(v, band, edges[band + 1], per_cent)
                    keys.append({*own.tolist(), *(ngram_join.piece_keys(v, band - 1, edges[band], per_cent).tolist() if band else [])})
                assert keys[0] & keys[1]
                w = ngram_join.folded([ngram_join.bitmap(s), ngram_join.bitmap(t)])
                assert ngram_join.can_link(w[0], len(s), w[1:], np.array([len(t)]), per_cent)[0]


def test_bitmaps_turn_most_pairs_away():
    r = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    sets = [shingle_hashes(" ".join(r.choices(words, k=300)), 3, {}) for _ in range(100)]
    w = ngram_join.folded([ngram_join.bitmap(s) for s in sets])
    n = np.array([len(s) for s in sets])
    assert sum(int(ngram_join.can_link(w[i], int(n[i]), w, n, 90).sum()) for i in range(100)) == 100  # but itself none


def test_linked_classes_edges(spark, edge):  # noqa: F811
    got = sorted(((r.id, r.n_shingles, r.component_id) for r in ngram_join.linked_classes(edge).collect()), key=str)
    assert got == sorted([(1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 2, 4), (5, 4, 5), (5, 4, 5), (None, 4, None), (6, 0, 6)], key=str)
    assert ngram_join.linked_classes(edge.where("false")).count() == 0
    twice = frame(spark, [(1, "a b c d", "", ""), (1, "e f g h", "", ""), (2, "a b c d", "", ""), (0, "e f g h", "", "")])
    assert {r.component_id for r in ngram_join.linked_classes(twice).collect()} == {0}  # an id ties its texts
    long = "".join(f"word{i} " for i in range(400_000))
    rows = frame(spark, [(1, long, "", ""), (2, long + "more", "", ""), (3, "x " + long[: len(long) // 2], "", "")])
    assert rows_of(ngram_join.linked_classes(rows)) == {(1, 399_998, 1), (2, 399_999, 1), (3, rows.where("doc_id = 3").select(F.size(F.split(F.trim("text"), " ")) - 2).first()[0], 3)}
    with pytest.raises(ValueError):
        ngram_join.linked_classes(edge, per_cent=0)


# -- fill-in-middle ---------------------------------------------------------------------------------------------------

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def infill_by_hand(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    d = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in range(0, 32, 8)]
    lo, hi = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:lo]), "".join(u[lo:hi]), "".join(u[hi:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 80:
        return len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    r = random.Random(9)
    parts = ["a", "Wort", "\n\n", "  ", "<", "<P", "P>", "S>", "<S", "<M", "M>", ">", "<<", "\x0b", " ", " x", "\U0001f600", "\U0001f600́", "\t", "$1", "\\", "\x85", "\r\n"]
    return ["".join(r.choices(parts, k=r.randint(0, 25))) for _ in range(400)] + ["", None, " ", "\n \t", "x", " x", "x ", "<P>", "a<S>b", "<M", "word " * 200_000]


def test_infill_by_hand_and_back(spark):
    texts = odd_texts()
    docs = frame(spark, [(i if i % 97 else None, t, "", "") for i, t in enumerate(texts)])
    rows = infill.rearrange(docs)
    out = rows.select("id", "n", "form", F.length("prefix").alias("p"), F.length("middle").alias("m"), "output", infill.restore(F.col("output"), F.col("form")).alias("back")).collect()
    got = sorted(((r.id, r.n, r.form, r.p, r.m, r.output, r.back) for r in out), key=str)
    assert got == sorted([(i if i % 97 else None, *infill_by_hand(i if i % 97 else None, t), t or "") for i, t in enumerate(texts)], key=str)
    assert {f for _, _, f, *_ in got} == {"plain", "psm", "spm"}


def test_infill_report_and_edges(spark, edge):  # noqa: F811
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = sorted((tuple(r) for r in infill.infill_report(edge).collect()), key=str)
    want = []
    for r in edge.collect():
        n, form, p, m, out = infill_by_hand(r.doc_id, r.text)
        want.append((r.doc_id, n, form, p, m, sha(out), sha(r.text or "")))
    assert got == sorted(want, key=str)
    report = infill.infill_report(edge.where("false"))
    assert report.count() == 0
    assert report.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]


def test_infill_is_sql_without_a_shuffle(spark):
    docs = frame(spark, [(1, "a b", "", "")])
    plan = infill.infill_report(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Pandas|Arrow", plan)
    assert plan.count("regexp_extract_all") == 1  # the units are made once


# -- hard negatives ---------------------------------------------------------------------------------------------------


def negatives_by_hand(rows, every, n_pos, n_neg):
    """rows: (id, label, integers), no two of one id."""
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, label, v in rows:
        if i % every:
            continue
        scored = sorted((-dot(v, w), j, other) for j, other, w in rows if j != i)
        for s, j in [(-s, j) for s, j, other in scored if other == label][:n_pos]:
            fit = [(-t, k) for t, k, other in scored if other != label and 50 * s <= -100 * t <= 95 * s]
            out |= {(i, j, r, k, s, t) for r, (t, k) in enumerate(fit[:n_neg], 1)}
    return out


def vectors(spark, rows):
    return spark.createDataFrame(rows, "id long, label long, vec array<long>")


@pytest.mark.parametrize("size,spread,labels,block", [(400, 150, 4, 1 << 15), (300, 3, 3, 40), (120, 1 << 28, 3, 1 << 15), (200, 40, 1, 64)])
def test_hard_negatives_against_brute_force(spark, monkeypatch, size, spread, labels, block):
    """Usual components; few values, so many ties, over many blocks; products beyond floating point; nearly a single label."""
    monkeypatch.setattr(hn, "BLOCK_ROWS", block)
    r = random.Random(size)
    rows = [(i, r.randrange(labels), [r.randint(-spread, spread) for _ in range(r.choice((12, 12, 12, 0, 5)))]) for i in range(size)]
    rows += [(size + 1, 0, []), (size + 2, 1, [0] * 12), (size + 3, 2, [-1] * 12)]
    got = {tuple(x) for x in hn.hard_negatives(vectors(spark, rows), every=5).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}
    assert got == negatives_by_hand(rows, 5, 5, 3)
    assert got


def test_narrowing_drops_most_before_the_last_planes(monkeypatch):
    r = np.random.RandomState(1)
    v = np.floor(256 * r.standard_normal((4000, 64)) / 8).astype(np.int64)
    left = {}
    real = hn.narrowed

    def seen(score, rest, *how):
        keep = real(score, rest, *how)
        left.setdefault(rest, []).append(keep.sum())
        return keep

    monkeypatch.setattr(hn, "narrowed", seen)
    found = list(hn.best_in_windows(v[:40], v, np.arange(4000), lambda i: np.arange(4000) != i, [[(-np.inf, np.inf)]] * 40, 5))
    for i, _, rows, score in found:
        s = v @ v[i]
        s[i] = -(1 << 60)
        assert list(rows) == list(np.lexsort((np.arange(4000), -s))[:5]) and list(score) == list(s[rows])
    assert np.mean(left[7]) < 400 and np.mean(left[1]) < 20


def test_integer_vectors_and_edges(spark):
    rows = [(0, 1, [0.5, -0.001]), (50, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (1, 1, None), (2, 1, [None, 1.0]), (3, 1, [float("nan"), 1.0]), (4, 1, [float("-inf"), 1.0]), (7, 9, [1.0, 0.25]), (8, 2, []), (9, 3, [1e300, -1e300])]
    given = spark.createDataFrame([(*r, "x", 0) for r in rows], "vec_id long, label int, embedding array<double>, vec string, id int")
    got = {(r.id, r.label): r.vec for r in hn.integer_vectors(hn.with_planted_labels(given), "vec_id", "label", "embedding").collect()}
    assert got == {(0, 2): [128, -1], (7, 0): [256, 64], (8, 2): [], (9, 3): [(1 << 63) - 1, -(1 << 63)]}
    none = hn.hard_negatives(vectors(spark, [(0, 1, [1])]).where("false"))
    assert none.count() == 0 and none.dtypes == [("anchor_id", "bigint"), ("positive_id", "bigint"), ("rank", "int"), ("negative_id", "bigint"), ("positive_score", "bigint"), ("negative_score", "bigint"), ("positive_rank", "bigint")]
    most = (1 << 63) - 1
    far = vectors(spark, [(0, 1, [most] * 3), (1, 1, [most] * 3), (2, 2, [most] * 3), (3, 2, [1]), (4, 2, [-(1 << 63)]), (5, 1, [2]), (6, 3, [1, 0, 0]), (50, 2, [0])])
    got = [tuple(r)[:6] for r in hn.hard_negatives(far).collect()]
    # 0 with 1 is beyond a long, which nothing is within 95 % of but above half; 0 with 5 is too
    assert [x for x in got if x[0] == 0] == []
    assert sorted(x for x in got if x[0] == 50) == sorted((50, p, r, n, 0, 0) for p in (2, 3, 4) for r, n in enumerate((0, 1, 5), 1))
    # an anchor's copies are one anchor, other rows' copies count each; rows of an id aren't each other's positives
    again = vectors(spark, [(0, 1, [10]), (0, 1, [10]), (1, 1, [10]), (1, 1, [10]), (2, 2, [9]), (2, 2, [9])])
    assert sorted(tuple(r)[:6] for r in hn.hard_negatives(again).collect()) == [(0, 1, 1, 2, 100, 90)] * 2 + [(0, 1, 2, 2, 100, 90)] * 2


def test_the_query_returns_rows_and_columns_of_its_sql(spark):
    import duckdb

    from duoscope.llm.queries import op13_hard_negatives

    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    wanted = db.execute(hn.NEGATIVES_SQL)
    names, rows = [x[0] for x in wanted.description], wanted.fetchall()
    got = op13_hard_negatives(spark, folder)
    assert got.columns == names and dict(got.dtypes)["rank"] == "int"
    assert sorted(tuple(r) for r in got.collect()) == sorted(rows) and rows
