"""Operators that look across rows, against brute-force versions and on edge rows."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from duoscope.llm import components, line_dedup, minhash, mixing, quality, toxicity, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n int, component_id string"


def frame(spark, rows):
    """Rows of (doc_id, text, lang, source) with columns that clash with those of the operators."""
    return spark.createDataFrame([(*r, len(r[1] or ""), False, 3, "x") for r in rows], SCHEMA)


@pytest.fixture
def edge(spark):
    rows = [(1, None, None, None), (2, "", "en", "s"), (3, "word", "en", "s"), (4, "deep water " * 20_000, "en", "s"), (5, "a b c d e f", "en", "s"), (5, "a b c d e f", "en", "s"), (None, "a b c d e f", "en", None), (6, " \n ", "de", "s")]
    return frame(spark, rows)


def corpus(seed=1, groups=12):
    """Documents with exact and near copies, shared passages and a chain of ever further copies."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(3000)]
    out, passage = [], r.choices(words, k=40)
    for _ in range(groups):
        base = r.choices(words, k=r.randint(3, 90))
        for _ in range(r.randint(1, 8)):
            copy = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 12))):
                copy[r.randrange(len(copy))] = r.choice(words)
            out.append(copy)
    out += [passage + r.choices(words, k=r.randint(1, 60)) for _ in range(25)]
    chain = r.choices(words, k=80)
    for _ in range(8):
        chain = list(chain)
        chain[r.randrange(80)] = r.choice(words)
        out.append(chain)
    r.shuffle(out)
    return [(i, " ".join(w).upper() if i % 3 else "  ".join(w), "en", "s") for i, w in enumerate(out)]


def components_by_hand(rows, k, t):
    sets = []
    for _, text, *_ in rows:
        w = text.lower().split()
        n = min(k, len(w))
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set())
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= t * len(sets[i] | sets[j]):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [(rows[i][0], len(sets[i]), rows[top(i)][0]) for i in range(len(rows))]


def test_near_classes_against_all_pairs(spark):
    rows = corpus()
    found = {(r.id, r.n_shingles, r.component_id) for r in minhash.near_classes(frame(spark, rows)).collect()}
    assert found == set(components_by_hand(rows, 4, 80))


@pytest.mark.parametrize("k,length", [(5, 150), (4, 60), (5, 700)])
def test_near_classes_of_copies_about_the_bound(spark, k, length):
    """Copies of one text with so many words changed that pairs lie on either side of the bound, and no unchanged one."""
    r = random.Random(length)
    words = [f"w{i}" for i in range(400)]
    base = r.choices(words, k=length)
    rows = []
    for i in range(150):
        copy = list(base)
        for _ in range(r.randint(1, max(2, length // 35))):
            copy[r.randrange(length)] = r.choice(words)
        rows.append((i, " ".join(copy), "en", "s"))
    found = {(x.id, x.n_shingles, x.component_id) for x in minhash.near_classes(frame(spark, rows), k=k).collect()}
    want = set(components_by_hand(rows, k, 80))
    assert found == want and len({c for *_, c in want}) > 5


def test_near_classes_edges(edge):
    rows = minhash.near_classes(edge).collect()
    got = sorted(((r.id, r.n_shingles, r.component_id, r.kept) for r in rows), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 1, 3, True), (4, 2, 4, True), (5, 3, 5, True), (5, 3, 5, True), (None, 3, None, True), (6, 0, 6, True)], key=str)
    assert minhash.near_classes(edge.where("false")).count() == 0
    first = minhash.first_of_each_class(edge)
    assert first.columns == edge.columns
    assert sorted((r.doc_id for r in first.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, None], key=str)


def test_quality_by_hand(spark, edge):
    assert quality.text_measures("a b c a b c x\n\n a b c a b c x\na b c a b c x") == (21, 21, 0, 1, 21)
    assert quality.text_measures("# a* b c d") == (4, 7, 2, 0, 0)
    assert quality.text_measures("a a a a") == (4, 4, 0, 0, 4)
    r = random.Random(2)
    rows = [(i, "Shared   LINE of text\n" + " ".join(f"w{r.randrange(10**6)}" for _ in range(60)), "en", "h") for i in range(30)]
    rows += [(100 + i, "shared line of text\n" * 30 + f"only {i}", "en", "h") for i in range(3)] + [(200, rows[0][1], "en", "h")]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in quality.quality_rules(docs, max_repeat_per_cent=100).collect()}
    assert len(got) == 34 and all(got[i].kept for i in [*range(30), 200]) and not any(got[100 + i].kept for i in range(3))
    assert got[0].common_words == 4 and got[100].common_words == 120
    clean = quality.clean_documents(docs, max_repeat_per_cent=100)
    assert clean.columns == docs.columns
    texts = [r.text for r in clean.collect()]
    assert len(texts) == 31 and not any("hared" in t for t in texts) and all(len(r.text) == r.n_chars for r in clean.collect())
    rows = quality.quality_rules(edge).collect()
    assert len(rows) == 8 and not any(r.kept for r in rows) and quality.quality_rules(edge.where("false")).count() == 0


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def alike(v, w):
    """By the law: equal, or one edit in eight units, words where both have eight of them, else characters."""
    if min(len(v), len(w)) >= 8:
        return v == w or near(v, w)
    a, b = " ".join(v), " ".join(w)
    return v == w or (min(len(a), len(b)) >= 8 and near(a, b))


@pytest.mark.parametrize("seed,longest,by_char", [(4, 14, False), (8, 9, True), (9, 2, True), (10, 7, False)])
def test_line_dedup_against_all_pairs(spark, edge, seed, longest, by_char):
    r = random.Random(seed)
    words = "red blue é green cold warm soft hard long".split()
    lines = [r.choices(words, k=r.randint(1, longest)) for _ in range(40)]
    rows = []
    for d in range(60):
        body = []
        for _ in range(r.randint(0, 6)):
            w = list(r.choice(lines))
            for _ in range(r.randint(0, 2)):
                i, kind = r.randrange(len(w)), r.randrange(3)
                w[i : i + 1] = [[r.choice(words)], [], [w[i], r.choice(words)]][kind]
                w = w or ["red"]
            x = "\t ".join(w).title()
            if by_char and r.random() < 0.5:
                i = r.randrange(len(x))
                x = x[:i] + r.choice(["", "x", x[i] + "y", " "]) + x[i + 1 :]
            body.append(x)
        rows.append((d, "\n".join(body), "en", "s"))
    places = [(d, p, x.lower().split()) for d, t, *_ in rows for p, x in enumerate(t.split("\n")) if x.strip()]
    want = defaultdict(list)
    for d, p, w in places:
        if not any((e, q) < (d, p) and alike(v, w) for e, q, v in places):
            want[d].append(p)
    docs = frame(spark, rows)
    got = {x.doc_id: x for x in line_dedup.line_report(docs).collect()}
    counts = Counter(d for d, _, _ in places)
    assert {len(w) for _, _, w in places} >= set(range(1, min(8, longest) + 1))
    for d, *_ in rows:
        assert got[d].kept_lines == want[d] and got[d].n_lines == counts[d] and got[d].n_dropped == counts[d] - len(want[d])
    if seed == 4:
        clean = line_dedup.dedup_lines(docs)
        assert clean.columns == docs.columns and clean.count() == 60
        assert sum(bool(x.strip()) for c in clean.collect() for x in c.text.split("\n")) == sum(map(len, want.values()))
        assert line_dedup.line_report(edge.where("false")).count() == 0 and line_dedup.dedup_lines(edge.where("false")).count() == 0
        got = {(x.doc_id, x.n_lines, x.n_dropped) for x in line_dedup.line_report(edge).collect()}
        assert got == {(1, 0, 0), (2, 0, 0), (3, 1, 0), (4, 1, 0), (5, 1, 1), (None, 1, 0), (6, 0, 0)}
        texts = {x.doc_id: x.text for x in line_dedup.dedup_lines(edge).collect()}
        assert texts[1] is None and texts[2] == "" and texts[5] == "" and texts[6] == " \n "


def test_line_dedup_query_leaves_out_no_line(spark, tmp_path):
    from duoscope.llm import queries

    rows = [(1, "menu\nread more\n\nterms of service", "en", "s"), (2, "Menu\nread  more\nterms of servise\nnew", "en", "s")]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: (x.n_lines, x.n_dropped, x.kept_lines) for x in queries.op5_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (3, 0, [0, 1, 3]), 2: (4, 3, [3])}


def test_mixing_totals(spark, edge):
    r = random.Random(6)
    rows = [(i, "t " * r.randint(1, 9), r.choice(["en", "de"]), r.choice(["s0", "s1", "s2", "s3"])) for i in range(400)]
    docs = frame(spark, rows)
    w = ({}, {"en": 3.0, "de": 1.0}, {"s1": 2.0})
    got = mixing.mix(docs, w, fraction=0.5, max_epochs=2).collect()
    tokens = {i: len(t.split()) for i, t, *_ in rows}
    total, used = sum(tokens.values()), sum(x.tokens * x.copies for x in got)
    leaves = len({(x.lang, x.source) for x in got})
    assert total * 0.5 - 10 * leaves <= used <= total * 0.5 and all(1 <= x.copies <= 2 for x in got)
    again = mixing.mix(docs, w, fraction=0.5, max_epochs=2, whole_rows=True)
    assert again.columns == docs.columns
    assert Counter(x.doc_id for x in again.collect()) == Counter({x.doc_id: x.copies for x in got})
    everything = mixing.mix(docs, w, fraction=2.0, max_epochs=2).collect()
    assert all(x.copies == 2 for x in everything) and len(everything) == 400
    assert mixing.mix(docs.where("false"), w).count() == 0 and mixing.mix(edge, w).count() > 0


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, l string, avail long")
    got = {(r.d, r.l): r.target for r in mixing.leaf_budgets(leaves, ["d", "l"], [{}, {}], 0.5, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 492, ("b", "z"): 502} and sum(got.values()) == 1004


def test_warc_round_trip(spark):
    magic = "a WARC/1.1\r\nWARC-Type: response\r\nX-Page-ID: 99\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nend"
    rows = [(1, "u", "x" * 1500), (2, "u", "x" * 1500), (3, None, None), (4, "u\r\nv", "short"), (5, "u", "short"), (6, "ü", magic), (7, "u", "WARC/1.1\r\n" * 3000), (8, "u", "é" * 700), (None, "n", "z" * 2000), (9, "u", "y" * 40_000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        got = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(got) == len(rows)
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
    assert [i for i in got if got[i].record_type == "revisit"] == [1] and got[1].refers_to == 2
    assert warc.warc_round_trip(pages.where("false")).count() == 0


def test_warc_groups_ties_and_repeated_ids(spark, tmp_path):
    big, other, long = "p" * 1200, "q" * 1000, "é" * 3_000_000
    rows = [(1, big), (2, big), (3, big), (7, big), (7, big), (5, other), (5, "r" * 1500), (4, other), (8, "r" * 1500), (None, other), (None, "n" * 1001), (9, long), (10, long), (11, "s" * 999), (12, "s" * 999), (13, None), (13, None)]
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id long, url string, html string")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages, path=str(tmp_path / "w")).collect())
    want = Counter()
    for i, t in rows:
        raw = (t or "").encode()
        last = max((j for j, u in rows if (u or "") == (t or "") and j is not None), default=None)
        again = len(raw) >= 1000 and last is not None and i != last
        want[i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", last if again else None] += 1
    assert got == want
    text = b"".join(p.read_bytes() for p in (tmp_path / "w").glob("part-*"))
    ids = re.findall(rb"WARC-Record-ID: (\S+)", text)
    assert len(ids) == len(set(ids)) == len(rows)
    assert {x for x in re.findall(rb"WARC-Refers-To: (\S+)", text)} <= set(ids)


def test_warc_keeps_text_ids(spark):
    """Ids with spaces, breaks, percent signs and letters beyond ASCII, the empty one and none, on either side of a revisit."""
    big = "p" * 1200
    ids = ["", " y", "x ", "q\r\nz", "ü%41+", "a:b", None, "last\t"]
    for own in (ids, ["", " "], ["a ", "a"]):
        pages = spark.createDataFrame([(i, "u", big) for i in own], "page_id string, url string, html string")
        got = Counter((r.page_id, r.record_type, r.refers_to) for r in warc.warc_round_trip(pages).collect())
        last = max(i for i in own if i is not None)
        assert got == Counter((i, "response" if i == last else "revisit", None if i == last else last) for i in own)


def test_names_with_dots_and_back_ticks(spark):
    """Columns of any name pass through the operators that return whole documents."""
    text = "\n".join(" ".join(f"w{i}{j}" for j in range(12)) for i in range(6))
    rows = [(i, text + f" end{i}" * (i % 3), "en", "s", 0, 1.5, "k", i) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` double, `c``d` string, `__row` long")
    for out in (quality.clean_documents(docs), minhash.first_of_each_class(docs, k=5), mixing.mix(docs, mixing.WEIGHTS, whole_rows=True), line_dedup.dedup_lines(docs)):
        assert out.dtypes == docs.dtypes
        assert {(r["a.b"], r["c`d"]) for r in out.collect()} == {(1.5, "k")}


def test_components_of_a_hub_and_a_chain(spark):
    """A hub that every node of a bucket is linked to, many times over, and a chain: each one component."""
    edges = [(999, i) for i in range(300)] * 2 + [(i, 999) for i in range(0, 300, 7)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    found = {r.node: r.comp for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {found[i] for i in [*range(300), 999]} == {0} and {found[1000 + i] for i in range(61)} == {1000} and 5000 not in found


def test_warc_regions_and_damage(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", ("WARC/1.1\r\n" if i % 5 == 0 else "p") * (20 + i)) for i in range(200)], "page_id long, url string, html string")
    plan = warc.plan_records(pages).coalesce(1).sortWithinPartitions("page_id")
    warc.write_warc(plan, str(tmp_path / "w"))
    for region in (1 << 20, 700):
        got = warc.read_warc(spark, str(tmp_path / "w"), region=region).collect()
        assert sorted(int(r.page_id) for r in got) == list(range(200)) and all(r.ok for r in got)
    part = next((tmp_path / "w").glob("part-*"))
    raw = part.read_bytes()
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "a.warc").write_bytes(raw[: len(raw) // 2])
    got = sorted(int(r.page_id) for r in warc.read_warc(spark, str(tmp_path / "cut")).collect())
    assert got == list(range(len(got))) and 50 < len(got) < 200


def test_toxicity_on_held_out_rows(spark):
    r = random.Random(8)
    words = [f"{a}{b}" for a in ("lo", "ka", "mi", "te", "ru", "sen") for b in ("na", "pol", "dir", "gas", "tum")]
    rows, labels = [], []
    for i in range(700):
        body, toxic = r.choices(words, k=60), i % 5 == 0
        if toxic:
            for _ in range(4):
                body[r.randrange(60)] = r.choice(["idiot", "scum", "zzqnark", "zzqvile"])
        rows.append((i, " ".join(body), "en", "s"))
        labels.append((i, 1, int(toxic != (r.random() < 0.03))))
    docs = frame(spark, rows)
    got = toxicity.score_toxicity(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [x for x in got if x.held_out]
    right = sum(x.predicted == (x.doc_id % 5 == 0) for x in held)
    assert 100 < len(held) and right >= 0.97 * len(held) and all(0 <= x.score <= 1 for x in got)


def test_label_model_against_enumeration():
    r = np.random.RandomState(3)
    y = r.rand(3000) < 0.2
    right = lambda share: np.where(r.rand(3000) < share, y, ~y)
    a = right(0.9)
    votes = np.stack([a, np.where(r.rand(3000) < 0.97, a, ~a), right(0.85), np.where(r.rand(3000) < 0.5, right(0.8), -1), right(0.8)], axis=1).astype(int)
    known = np.where(np.arange(3000) % 5 == 0, y.astype(float), np.nan)
    m = toxicity.LabelModel(votes, np.ones(3000), known)
    assert {(0, 1), (1, 0)} & {(k, int(p)) for k, p in enumerate(m.parent)}  # the voter that repeats another hangs on it
    for row in range(0, 3000, 97):  # the joint probability of every vote, term by term
        odds = []
        for c, prior in ((0, 1 - m.prior), (1, m.prior)):
            for k, p in enumerate(m.parent):
                prior *= m.tables[c][k][votes[row, p] + 1 if p >= 0 else 0][votes[row, k] + 1]
            odds.append(prior)
        assert abs(odds[1] / sum(odds) - m.p[row]) < 1e-9
    total = sum(
        np.prod([m.tables[c][k][v[p] if p >= 0 else 0][v[k]] for k, p in enumerate(m.parent)]) * (m.prior if c else 1 - m.prior)
        for c in (0, 1) for v in itertools.product(range(3), repeat=5)
    )
    assert abs(total - 1) < 1e-9
    free = np.isnan(known)
    assert ((m.p > 0.5) == y)[free].mean() > 0.93 and abs(m.accuracy[0] - 0.9) < 0.03 and abs(m.accuracy[2] - 0.85) < 0.03


def test_posteriors_never_see_their_own_label(spark):
    text = lambda i: "idiot scum words and more" if i % 4 == 0 else f"plain words and more {i % 7}"
    rows = pd.DataFrame([toxicity._sample_row(text(i)) for i in range(400)], columns=["n_words", "idx", "cnt", "hits", "capitals", "marks"])
    rows["weight"], fold = 1.0, np.arange(400) % 5
    flip = rows.assign(toxic=[int(i % 4 == 0) for i in range(400)])
    other = flip.assign(toxic=[1 - t if i in (5, 10, 15) else t for i, t in enumerate(flip["toxic"])])
    a, b = (toxicity.posterior_labels(toxicity.Sample(x), fold, 50, 4) for x in (flip, other))
    same = fold == 0  # rows 5, 10 and 15 are of fold 0, whose voters come from the other folds
    assert np.allclose(a[same], b[same]) and ((a > 0.5) == (np.arange(400) % 4 == 0)).all()


def test_toxicity_sample_is_bounded_in_bytes(spark):
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(300)) + (" idiot" if i % 2 else ""), "en", "s") for i in range(60)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(60)], "doc_id long, quality int, toxic int")
    got = toxicity.score_toxicity(frame(spark, rows), labels, max_bytes=200_000).collect()
    assert len(got) == 60 and all(0 <= x.score <= 1 for x in got)


def test_toxicity_edges(spark, edge):
    labels = spark.createDataFrame([(1, 0, None), (3, 1, 1), (3, 1, 0), (77, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_toxicity(edge, labels).count() == 8
    assert toxicity.score_toxicity(edge.where("false"), labels.where("false")).count() == 0
