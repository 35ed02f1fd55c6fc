"""The whole pipeline against a brute-force version on a small corpus, and on edge rows."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
from duoscope.llm import decontam, mixing, quality
from tests.llm.test_corpus_operators import components_by_hand
from tests.llm.test_text_operators import edits, winner

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def small_corpus():
    r = random.Random(12)
    words = [f"w{i}" for i in range(5000)]
    items = [(i, " ".join(r.choices(words, k=20))) for i in range(5)]
    out = []
    for i in range(70):
        w = r.choices(words, k=r.randint(52, 90))
        if i % 10 == 3:
            w[5:5] = items[i % 5][1].split()
        text = " ".join(w[:30]) + "\n" + " ".join(w[30:])
        if i % 3 == 0:
            text = "Common   Line\n" + text
        out.append((text, "en" if i % 4 else "de", f"s{i % 3}"))
    for i in range(15):
        w = out[i][0].split(" ")
        if i % 2:
            w[-1] = "other"
        out.append((" ".join(w), *out[i][1:]))
    out += [("short text", "en", "s0"), (None, "en", "s0"), ("a b c " * 40, "en", "s1")]
    r.shuffle(out)
    return [(i, *x, len(x[0] or "")) for i, x in enumerate(out)], items


def by_hand(rows, items):
    lines = lambda t: [" ".join(x.lower().split()) for x in (t or "").split("\n")]
    docs, held = defaultdict(set), defaultdict(set)
    for _, t, _, s, _ in rows:
        for x in filter(None, lines(t)):
            docs[s].add(t)
            held[s, x].add(t)
    common = {k for k, v in held.items() if len(v) > max(10, 0.02 * len(docs[k[0]]))}
    assert common
    kept = []
    for i, t, lang, s, _ in rows:
        n, *_, repeat = quality.text_measures(t)
        lost = sum(len(x.split()) for x in lines(t) if (s, x) in common)
        if n >= 50 and 100 * repeat <= 50 * n and n - lost >= 0.4 * n:
            kept.append((i, "\n".join(x for x, y in zip(t.split("\n"), lines(t), strict=True) if (s, y) not in common), lang, s))
    first = {i for i, _, c in components_by_hand(kept, 5, 80) if i == c}
    kept = [x for x in kept if x[0] in first]
    norm = [(x, decontam.words_of(x[1])) for x in kept]
    kept = [x for x, w in norm if not any(edits(t.split(), w) <= int(0.15 * len(t.split())) for _, t in items)]
    leaf = defaultdict(list)
    for i, t, lang, s in kept:
        leaf["d" + str(ord(hashlib.md5(s.encode()).hexdigest()[0]) % 4), lang, s].append((i, t, len(t.split())))
    budget = {(): float(sum(n for v in leaf.values() for *_, n in v))}
    for level in range(3):
        for parent in [p for p in budget if len(p) == level]:
            cap = defaultdict(float)
            for path, v in leaf.items():
                if path[:level] == parent:
                    cap[path[: level + 1]] += 4.0 * sum(n for *_, n in v)
            weight = {p: mixing.WEIGHTS[level].get(p[-1], 1.0) for p in cap}
            left, open_ = budget[parent], set(cap)
            while full := {p for p in open_ if cap[p] <= weight[p] * left / sum(weight[q] for q in open_)}:
                for p in full:
                    budget[p] = cap[p]
                left -= sum(cap[p] for p in full)
                open_ -= full
            for p in open_:
                budget[p] = left * weight[p] / sum(weight[q] for q in open_)
    out = Counter()
    for path, v in leaf.items():
        avail = sum(n for *_, n in v)
        epochs, rest = divmod(math.floor(round(budget[path], 3)), avail)
        at = lambda x: hashlib.md5(f"17:{epochs}:{x[0]}:{hashlib.md5(x[1].encode()).hexdigest()}".encode()).hexdigest()  # noqa: B023, E731
        used = 0
        for x in sorted(v, key=at):
            used += x[2]
            out[x[0], winner(str(x[0]), [1.0] * 24)] += epochs + (used <= rest)
    return +out


def test_pipeline_by_hand(spark, tmp_path):
    rows, items = small_corpus()
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r["shard"]) for r in got) == by_hand(rows, items)
    for s in range(24):
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots)))


def test_stages_keep_columns_and_bear_empty_tables(spark, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "minhash_near_dedup", "benchmark_decontamination", "mixing", "sharding"]
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", "s", 0)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        for d in (docs, docs.where("false")):
            out = stage(spark, d, str(tmp_path))
            out.collect()
            assert name == "sharding" or out.dtypes == docs.dtypes


def test_stages_bear_any_column_name(spark, tmp_path):
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    text = " ".join(f"w{i}" for i in range(60))
    docs = spark.createDataFrame([(1, text, "en", "s", 0, "x", 2)], COLUMNS + ", `a.b` string, `c``d` int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.count() and (name == "sharding" or out.dtypes == docs.dtypes)
