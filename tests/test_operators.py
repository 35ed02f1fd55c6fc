"""Traps of the domain, on hand-made rows."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoscope import schemas
from duoscope.functions import names, vectors
from duoscope.operators import cluster, communities, correlate, donors, embed, filters, harmony, hvg, intervals, motifs, neighbors, normalize, qc, sampling, triplets, validate
from duoscope.sources import readers, sinks


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_peak_names(spark):
    p = spark.createDataFrame([("chr1:10-20",), ("chrX-5-9",), ("chrUn_KI:1-2",), ("GL000194.1:1-2",), (None,)], "peak string")
    assert rows(names.peaks_to_table(p)) == [("chr1", 10, 20, "chr1:10-20"), ("chrUn_KI", 1, 2, "chrUn_KI:1-2"), ("chrX", 5, 9, "chrX-5-9")]
    assert p.select(names.standardize_peak(F.col("peak"), strict=False)).first()[0] == "chr1:10-20"
    with pytest.raises(Exception, match="bad peak name"):
        p.where("peak like 'GL%'").select(names.standardize_peak(F.col("peak"))).collect()


def test_windows_and_multiplicity(spark):
    genes = spark.createDataFrame([("chr1", 1000, 2000, "+", "g"), ("chr1", 1000, 2000, "+", "g"), ("chr1", 5000, 6000, ".", "d"), ("chr1", 500_000, 501_000, "-", "m"), ("chr2", 10, 20, "+", "z")], "chrom string, start long, end long, strand string, gene_name string")
    peaks = spark.createDataFrame([("chr1:900-1100",), ("chr1:6000-6100",), ("chr1:251000-251100",), ("chr1:502500-503000",), ("chr3:1-2",)], "peak string")
    chosen = spark.createDataFrame([("g",), ("m",), ("d",)], "gene string")
    tss = rows(intervals.peak_gene_overlaps(genes, peaks, chosen))
    # a peak that begins where the window of g ends is outside; m's window hangs on its end
    assert ("g", "chr1:900-1100") in tss and ("g", "chr1:251000-251100") not in tss and ("m", "chr1:251000-251100") in tss
    assert len(tss) == len(set(tss)) and ("d", "chr1:6000-6100") in tss
    body = Counter(map(tuple, intervals.body_overlaps(genes, peaks).collect()))
    assert body == {("g", "chr1:900-1100"): 2, ("m", "chr1:502500-503000"): 1}
    atac = spark.createDataFrame([(1, "chr1:900-1100", 3.0)], "cell_id long, peak string, value double")
    assert rows(intervals.gene_activity(atac, intervals.body_overlaps(genes, peaks))) == [(1, "g", 6.0)]


def ranks(x):
    order = np.argsort(x, kind="stable")
    out = np.empty(len(x))
    out[order] = np.arange(1, len(x) + 1)
    return np.array([out[x == v].mean() for v in x])


def test_spearman_modes(spark):
    r = np.random.RandomState(1)
    n = 40
    g, p = r.poisson(0.8, (6, n)), r.poisson(0.6, (6, n))
    rna = spark.createDataFrame([(c, f"g{i}", float(g[i, c])) for i in range(6) for c in range(n) if g[i, c]], "cell_id long, gene string, value double")
    atac = spark.createDataFrame([(c, f"p{i}", float(p[i, c])) for i in range(6) for c in range(n) if p[i, c]], "cell_id long, peak string, value double")
    pairs = spark.createDataFrame([(f"g{i}", f"p{j}") for i in range(6) for j in range(6)] + [("none", "p0")], "gene string, peak string")
    cells = spark.range(n).select(F.col("id").alias("cell_id"))

    def want(binary):
        out = {}
        for i in range(6):
            for j in range(6):
                y = (p[j] > 0).astype(float) if binary else p[j].astype(float)
                m = np.ones(n, bool) if binary else (g[i] > 0) & (p[j] > 0)
                if m.sum() < 2 or binary and y.sum() < 2:
                    continue
                a, b = ranks(g[i][m].astype(float)), ranks(y[m])
                if a.std() and b.std() and abs(v := np.corrcoef(a, b)[0, 1]) > 0.1:
                    out[f"g{i}", f"p{j}"] = v
        return out

    for binary in (False, True):
        a = atac.withColumn("value", F.lit(1.0)) if binary else atac
        got = {(x.gene, x.peak): x.spearman_r for x in correlate.filter_by_correlation(pairs, rna, a, cells).collect()}
        w = want(binary)
        assert got.keys() == w.keys() and all(math.isclose(got[k], w[k], abs_tol=1e-8) for k in w)


def test_triplets_and_labels(spark):
    corr = spark.createDataFrame([("A", "p1", 0.5), ("B", "p1", -0.4), ("B", "p2", 0.3)], schemas.CORRELATED)
    db = spark.createDataFrame([("m1", "", "", "A; B", ""), ("m2", "", "", "X", "")], schemas.MOTIF_DB)
    genes = spark.createDataFrame([("A",), ("B",), ("C",)], "gene string")
    hits = spark.createDataFrame([("m1", "p1"), ("m1", "p1"), ("m2", "p2")], schemas.MOTIF_MATCHES)
    found = triplets.assemble(corr, triplets.tf_peaks(hits, triplets.motif_tfs(db, genes)))
    assert rows(found) == [("A", "p1", 0.5, "B"), ("B", "p1", -0.4, "A")]
    assert rows(triplets.label_genes(found, genes)) == [("A", "TF", "p1", "B"), ("B", "TF", "p1", "A"), ("C", "target", "", "")]
    # names aren't stripped when motifs are chosen: " B" is not B
    assert triplets.select_motifs(db, genes.where("gene = 'B'")).count() == 0
    none = triplets.assemble(corr, schemas.empty(spark, "TF string, peak string"))
    assert none.columns == ["target_gene", "peak", "spearman_r", "TF"] and none.count() == 0
    info = triplets.peak_info(corr.withColumn("pair_ix", F.when(F.col("gene") == "B", 0).otherwise(1)))
    assert rows(info) == [("p1", "B,A"), ("p2", "B")]
    checks = validate.check_results(corr, found, triplets.label_genes(found, genes), info)
    assert checks.where("not passed").count() == 0 and checks.count() == 9
    assert [r["check"] for r in validate.check_results(corr, found, triplets.label_genes(found, genes), info.where("peak = 'p1'")).where("not passed").collect()] == ["correlated peaks are listed"]


def test_motif_thresholds_and_strands(spark):
    assert motifs.MOTIF_P == 0.0016
    m = np.array([[1.0, -1.0, -1.0], [-1.0, 1.0, -1.0], [-1.0, -1.0, 1.0], [-1.0, -1.0, -1.0]])
    every = [sum(m[b, j] for j, b in enumerate((x // 16, x // 4 % 4, x % 4))) for x in range(64)]
    for p in (0.02, 0.2, 0.5):
        t = motifs.threshold_exact(m, p)
        assert sum(s >= t - 1e-9 for s in every) / 64 <= p
    assert motifs.best_scores("ACG", m) == 3 and motifs.best_scores("CGT", m) == 3 and motifs.best_scores("AC", m) == -math.inf and motifs.best_scores("ACNG", m) == -math.inf
    pwm = spark.createDataFrame([("m", j, b, float(m[i, j])) for i, b in enumerate("ACGT") for j in range(3)] + [("flat", 0, b, 0.5) for b in "ACGT"], "motif_id string, pos int, base string, weight double")
    seqs = spark.createDataFrame([("fw", "TTACGTT"), ("rev", "CGT"), ("short", "A"), ("n", "ANG"), ("no", "TTTT")], "peak string, seq string")
    th = spark.createDataFrame([("m", 3.0), ("flat", 0.5)], "motif_id string, threshold double")
    a, b = rows(motifs.scan(seqs, pwm, th)), rows(motifs.scan_relational(seqs, pwm, th))
    assert a == b and [x[1] for x in a if x[0] == "m"] == ["fw", "rev"]
    flat = {r.motif_id: r.threshold for r in motifs.threshold_normal(pwm).collect()}
    assert flat["flat"] == 0.5


def test_lookahead_against_every_window(monkeypatch):
    """Motifs from 3 to 15 columns, strict and lax, sequences with gaps: the hits of the plain scan, few windows scored."""
    r = np.random.RandomState(11)
    mats = {f"m{i}": np.round(np.log((r.dirichlet([0.3] * 4, w).T + 0.01) / 1.04 * 4), 3) for i, w in enumerate(r.randint(3, 16, 40))}
    least = {k: motifs.threshold_exact(m, motifs.MOTIF_P / (1 if i % 3 else 20)) for i, (k, m) in enumerate(mats.items())}
    seqs = ["".join(r.choice(list("ACGTN"), p=[0.24, 0.25, 0.25, 0.25, 0.01], size=n)) for n in (0, 1, 2, 7, 8, 30, 500, 5000)] + ["ACGT" * 50, "NNNN"]
    for limit in (motifs.MAX_ENTRIES, 20_000, 0):  # all motifs in the table, some, none
        monkeypatch.setattr(motifs, "MAX_ENTRIES", limit)
        index = motifs.lookahead(mats, least)
        assert (len(index.always) == 0) == (limit > 20_000) and (len(index.always) == 80) == (limit == 0)
        for s in seqs:
            found, scored = motifs.hits_of(s, index)
            assert found == sorted(k for k, m in mats.items() if round(motifs.best_scores(s, m), 9) >= round(least[k], 9))
    monkeypatch.undo()
    strict = {k: m for k, m in mats.items() if m.shape[1] >= 8}
    rare = {k: motifs.threshold_exact(m, 1e-5) for k, m in strict.items()}
    _, scored = motifs.hits_of(seqs[7], motifs.lookahead(strict, rare))
    assert scored < 0.02 * 2 * len(strict) * len(seqs[7])
    assert motifs.lookahead(mats, {}) is None


def test_motif_queries_read_whole_sequences(spark, tmp_path):
    from duoscope.queries import relations
    from duoscope.queries.registry import QUERIES, Context

    r = np.random.RandomState(3)
    docs = [(i, "".join(r.choice(list("acgtn -x"), p=[0.05, 0.05, 0.05, 0.75, 0.02, 0.04, 0.02, 0.02], size=n))) for i, n in enumerate((3, 20, 90, 200, 200, 300, 900), 1)]
    docs += [(20, "t" * 200), (21, "t" * 150 + "acca" + "t" * 9), (22, "t" * 400 + "ccagt"), (23, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    parts = [(i, "TT" if i % 3 else "T", [3, 3, 3, 1, 0, 2][i % 6] + 4 * (i % 5 == 0)) for i in range(200)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    own = relations.pwm(Context(spark, str(tmp_path)))
    cols, weight = {}, {(x.motif_id, x.pos, x.base): x.weight for x in own.collect()}
    assert len(weight) == 4 * (5 + 6)
    for m, i, _ in weight:
        cols[m] = max(cols.get(m, 0), i + 1)
    least = {x.motif_id: x.threshold for x in motifs.threshold_normal(own).collect()}
    want, flip = set(), str.maketrans("ACGT", "TGCA")
    for d, t in docs:
        seq = "".join(x for x in (t or "").upper() if x in "ACGTN")
        for m, w in cols.items():
            for at in range(len(seq) - w + 1):
                part = seq[at : at + w]
                if "N" not in part and any(round(sum(weight[m, i, b] for i, b in enumerate(x)), 9) >= round(least[m], 9) for x in (part, part.translate(flip)[::-1])):
                    want.add((m, f"d{d}"))
    assert any(p == "d21" for _, p in want) and any(p == "d22" for _, p in want)
    for name in ("pwm_scan", "pwm_scan_relational"):
        assert {tuple(x) for x in QUERIES[name](spark, str(tmp_path)).collect()} == want


def test_noise_matrix_has_all_cells_and_correlated_peaks(spark, monkeypatch):
    from types import SimpleNamespace

    from duoscope.queries import relations

    pairs = [(str(g), f"p{g % 4}") for g in (7, 200, 201, 950)]
    atac = [(c, f"p{p}", float(c + p)) for c in range(1, 41) for p in range(5) if (c + p) % 3 == 0]
    c = SimpleNamespace(cells=spark.range(1, 41).withColumnRenamed("id", "cell_id"), atac_p=spark.createDataFrame(atac, "cell_id long, peak string, value double"))
    monkeypatch.setattr(relations, "correlated", lambda _: spark.createDataFrame(pairs, "gene string, peak string"))
    have = {(i, p): v for i, p, v in atac}
    want = sorted((i, p, have.get((i, p), 0.0)) for i in range(1, 41) for p in {p for _, p in pairs})
    assert sorted(tuple(r) for r in relations.rf_noise_matrix(c).select("cell_id", "peak", "value").collect()) == want


def test_donors(spark):
    rna = spark.createDataFrame([("a", i) for i in range(50)] + [("b", 1), ("r", 1), (None, 1)], "donor_id string, x long")
    atac = spark.createDataFrame([("a", i) for i in range(49)] + [("b", 1)] * 60 + [("t", 1)], "donor_id string, x long")
    got = {r.donor_id: (r.n_rna, r.n_atac, r.has_both, r.skip_reason) for r in donors.classify(rna, atac).collect()}
    assert got == {"a": (50, 49, False, "too few ATAC cells (49 < 50)"), "b": (1, 60, False, "too few RNA cells (1 < 50)"), "r": (1, 0, False, "no ATAC cells"), "t": (0, 1, False, "no RNA cells")}
    r = spark.createDataFrame([(1, "d", "x", [0.0]), (2, "d", "y", [5.0])], "cell_id long, donor_id string, cell_type string, vec array<double>")
    a = spark.createDataFrame([(7, "d", "x", [1.0]), (8, "d", "y", [-1.0])], "cell_id long, donor_id string, cell_type string, vec array<double>")
    pairs = neighbors.cross_modal(r, a)
    assert rows(pairs.select("rna_cell", "atac_cell", "anchor")) == [(1, 7, "rna"), (2, 7, "rna")]
    s = donors.pair_summary(donors.classify(r, a, min_cells=1), pairs).first()
    assert (s.n_pairs, s.pair_fraction, s.cell_type_agreement, s.status) == (2, 1.0, 0.5, "aligned")
    m = spark.createDataFrame([(1, "10xMulti"), (2, None), (3, "x")], "k long, method string")
    assert rows(filters.multiome(m, other=True).select("k")) == [(2,), (3,)]
    split = donors.split_by_modality(m, m, "k")
    assert split["paired_rna"].count() == 1 and split["unpaired_atac"].count() == 2


def test_sampling(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") < 990, "big").otherwise("small").alias("s"))
    got = sampling.stratified(df, "s", "k", 20)
    assert Counter(r.s for r in got.collect()) == {"big": 20, "small": 10}
    assert rows(got) == rows(sampling.stratified(df.repartition(7), "s", "k", 20, sub=3)) and rows(got) != rows(sampling.stratified(df, "s", "k", 20, seed=1))


def test_per_donor_draw_and_its_count(spark, monkeypatch):
    from types import SimpleNamespace

    from duoscope.plans import phases
    from duoscope.queries import cells

    df = spark.range(100).select(F.col("id").alias("cell_id"), F.when(F.col("id") < 90, "big").otherwise("small").alias("donor_id"), F.lit("x").alias("cell_type"))
    counts = lambda d: Counter(r.donor_id for r in d.collect())
    assert counts(sampling.per_donor(df, "donor_id", "cell_id", 100)) == {"big": 90, "small": 10}
    assert counts(sampling.per_donor(df, "donor_id", "cell_id", 60)) == {"big": 30, "small": 10}
    rna = df.select("cell_id", F.lit("g").alias("gene"), F.lit(1.0).alias("value"))
    seen = []

    def stop(x, n, *_):
        seen.append((x.select("cell_id").distinct().count(), n))
        raise StopIteration

    monkeypatch.setattr(hvg, "select_variable", stop)
    whole = sampling.per_donor
    for total in (200_000, 60):
        monkeypatch.setattr(sampling, "per_donor", lambda d, *a, t=total: whole(d, *a[:2], t))
        genes = spark.createDataFrame([("chr1", 1, 9, "+", "g")], "chrom string, start long, end long, strand string, gene_name string")
        atac = df.select("cell_id", F.lit("chr1:1-9").alias("peak"), F.lit(1.0).alias("value"))
        for run in (lambda: cells.stat_global_hvg(SimpleNamespace(cells=df, rna=rna)), lambda: phases.integrate_unpaired(rna, atac, df, df, genes, min_cells=2)):
            with pytest.raises(StopIteration):
                run()
    assert seen == [(100, 100)] * 2 + [(40, 40)] * 2


def test_neighbors(spark):
    r = np.random.RandomState(0)
    x = r.rand(60, 5)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(60)], "id long, vec array<double>")
    a, b = rows(neighbors.knn(v, 4)), rows(neighbors.knn(v, 4))
    assert a == b and len(a) == 240 and all(s != t for s, t, *_ in a)
    assert {s for s, t, d, k in rows(neighbors.knn(v, 1, include_self=True)) if s == t and d == 0} == set(range(60))
    e = spark.createDataFrame([(0, 1, 0.5), (0, 2, 0.5), (0, 3, 0.0), (1, 0, 0.9)], "src long, dst long, weight double")
    assert rows(neighbors.top_k(e, 3, spark.range(3))) == [(0, [1, 2, -1]), (1, [0, -1, -1]), (2, [-1, -1, -1])]
    assert v.limit(1).select(vectors.l2_normalize(F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == [0.0, 0.0]
    w = neighbors.wnn(v, v.withColumn("vec", F.reverse("vec")), 5)
    assert w.groupBy("src").count().where("count > 5").count() == 0 and w.where("rna_weight < 0 or rna_weight > 1").count() == 0


def test_embeddings(spark):
    r = np.random.RandomState(2)
    x = r.poisson(0.7, (50, 12)).astype(float)
    counts = spark.createDataFrame([(c, f, float(x[c, f])) for c in range(50) for f in range(12) if x[c, f]], "cell_id long, feature_id long, value double")
    e, values = embed.svd(counts, 3)
    got = {r.cell_id: np.array(r.vec) for r in e.collect()}
    u, s, vt = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:3])
    kept = sorted(got)
    assert np.allclose(np.abs(np.stack([got[c] for c in kept])), np.abs((u * s)[kept][:, :3]), atol=1e-8)
    p = np.stack([np.array(r.vec) for r in embed.pca(counts, 2).orderBy("cell_id").collect()])
    y = x[kept]
    z = (y - y.mean(axis=0)) / y.std(axis=0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    assert np.allclose(np.abs(p), np.abs((u * s)[:, :2]), atol=1e-6)
    batch = spark.createDataFrame([(i, "ab"[i % 2], [float(v) for v in r.randn(3) + (i % 2) * 3]) for i in range(200)], "cell_id long, batch string, vec array<double>")
    gap = lambda d: np.linalg.norm(*(lambda m: [m[0] - m[1]])([np.mean([r.vec for r in d.collect() if r.cell_id % 2 == k], axis=0) for k in (0, 1)]))
    assert gap(harmony.harmony(batch, clusters=4, max_iter=8)) < 0.6 * gap(batch)


def test_embeddings_of_more_features_than_cells(spark):
    x = np.random.RandomState(4).poisson(0.6, (20, 70)).astype(float)
    counts = spark.createDataFrame([(c, f, float(x[c, f])) for c in range(20) for f in range(70) if x[c, f]], "cell_id long, feature_id long, value double")
    for center, scale, k in ((False, False, 4), (True, True, 4), (False, True, 4), (False, False, 50)):
        e, values = embed.svd(counts, k, center, scale)
        y = x - x.mean(axis=0) if center else x
        # without a centre the scale is about 0
        spread = np.sqrt((y**2).sum(axis=0) / 19)
        y = y / np.where(spread > 0, spread, 1) if scale else y
        u, s, _ = np.linalg.svd(y, full_matrices=False)
        k = min(k, 20)
        assert np.allclose(values, s[:k] ** 2 / 19 if center else s[:k])
        got = np.stack([r.vec for r in e.orderBy("cell_id").collect()])
        assert np.allclose(got @ got.T, (u[:, :k] * s[:k] ** 2) @ u[:, :k].T, atol=1e-5)


def test_embeddings_end_exactly_or_with_an_error(spark, monkeypatch):
    """A spectrum without gaps needs many passes and restarts; too few are an error, and no rows reach the driver."""
    r = np.random.RandomState(8)
    x = np.linalg.qr(r.randn(300, 120))[0] * np.linspace(2, 1, 120)
    counts = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(300) for j in range(120)], "cell_id long, feature_id long, value double")
    monkeypatch.setattr(embed, "_FAN_IN", 2)
    e, values = embed.svd(counts, 5)
    assert np.allclose(values, np.linalg.svd(x)[1][:5], rtol=1e-9)
    vectors, n = embed._vectors(counts, embed.index_features(counts))
    with pytest.raises(RuntimeError, match="no convergence"):
        embed.krylov(vectors, n, 5, False, False, most_passes=2)
    assert embed.svd(counts.where("false"), 3)[0].count() == 0


def test_embedding_queries_read_every_feature(spark, monkeypatch):
    from types import SimpleNamespace

    from duoscope.plans import phases
    from duoscope.queries import cells

    counts = spark.createDataFrame([(c, f, float((c * f) % 7 + 1)) for c in range(6) for f in range(1, 24)], "cell_id long, feature_id long, value double")
    c, seen = SimpleNamespace(rna=counts, atac=counts, cells=counts.select("cell_id").distinct()), []
    features = lambda *tables: seen.append([t.select("feature_id").distinct().count() for t in tables])
    monkeypatch.setattr(embed, "pca", lambda d, *a, **b: features(d))
    monkeypatch.setattr(embed, "svd", lambda d, *a, **b: (features(d),))
    monkeypatch.setattr(embed, "lsi", lambda d, *a, **b: features(d))
    monkeypatch.setattr(phases, "integrate_paired", lambda r, a, *_: {"lists": features(r, a)})
    for q in (cells.emb_pca, cells.emb_svd, cells.emb_lsi, cells.pipeline_integrate_paired):
        q(c)
    assert seen == [[23], [23], [23], [23, 23]]


def test_normalization_counts_zeros(spark):
    counts = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 4.0)], "cell_id long, feature_id long, value double")
    m = {r.feature_id: (r["mean"], r["var"]) for r in normalize.moments(counts, 4).collect()}
    assert m[1] == (1.5, np.var([2, 4, 0, 0], ddof=1)) and m[2] == (0.5, np.var([2, 0, 0, 0], ddof=1))
    assert rows(normalize.total(counts, 10)) == [(1, 1, 5.0), (1, 2, 5.0), (2, 1, 10.0)]
    x = spark.createDataFrame([(c, f, float((c * 7 + f * 3) % (3 + f) + (60 if f == 5 and c == 3 else 0))) for c in range(40) for f in range(30)], "cell_id long, feature_id long, value double")
    assert 5 in [r.feature_id for r in hvg.select_variable(x, 40, 3).collect()]


def test_reports(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [(None,)], "x string")
    assert rows(qc.value_counts(df, "x")) == [("a", 3), ("b", 2)] and qc.value_counts(df, "x", dropna=False).count() == 3
    v = lambda *xs: qc.verdict(spark.createDataFrame([(float(x),) for x in xs], "value double")).first().verdict
    assert (v(1, 2), v(1, 1), v(0.5, 3)) == ("LIKELY RAW COUNTS (integer, max=2)", "LIKELY RAW COUNTS (integer, max=1)", "LIKELY NORMALIZED (float, max=3.0000)")
    assert v(0.5, 300) == "AMBIGUOUS (int=False, min=0.5, max=300.0)"
    c = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "label long, cluster long")
    assert rows(cluster.majority_label(c)) == [(0, 1), (1, 3)]


def test_files(spark, tmp_path):
    gtf = 'chr\n#x\n1\ts\tgene\t5\t9\t.\t+\t.\tgene_id "G"; gene_name "N";\n1\ts\tgene\t5\t9\t.\t+\t.\tgene_id "G";\nchr2\ts\texon\t1\t2\t.\t+\t.\tgene_name "E";\n'
    (tmp_path / "a.gtf").write_text(gtf)
    assert rows(readers.read_gtf(spark, str(tmp_path / "a.gtf"))) == [("chr1", 5, 9, "+", "N", "G")]
    (tmp_path / "m.mtx").write_text("%%MatrixMarket\n%c\n2 2 2\n1 1 3\n2 2 4.5\n9 1 1\n")
    (tmp_path / "f.txt").write_text("f1\nf2\n")
    (tmp_path / "c.txt").write_text("c1\nc2\n")
    assert rows(readers.read_mtx(spark, *(str(tmp_path / n) for n in ("m.mtx", "f.txt", "c.txt")))) == [("c1", "f1", 3.0), ("c2", "f2", 4.5)]
    assert readers.read_feature_list(spark, str(tmp_path / "none")) is None
    (tmp_path / "g.fa").write_text(">chr1 x\nacgtac\ngt\n>chr2\nNN\n")
    peaks = spark.createDataFrame([("chr1:2-7", "chr1", 2, 7), ("chr1:6-99", "chr1", 6, 99), ("chr9:1-2", "chr9", 1, 2), ("chr2:5-9", "chr2", 5, 9)], "peak string, p_chrom string, p_start long, p_end long")
    assert rows(readers.peak_sequences(peaks, readers.read_fasta(spark, str(tmp_path / "g.fa"), chunk=3), chunk=3)) == [("chr1:2-7", "GTACG"), ("chr1:6-99", "GT")]
    with pytest.raises(KeyError):
        schemas.require_columns(peaks, ["absent"])
    with pytest.raises(NotImplementedError):
        readers.read_h5ad(spark, "x.h5ad")
    failed = sinks.write_in_order({"pairs": peaks}, {"bad": peaks.select(F.raise_error(F.lit("x")).alias("v")), "good": peaks}, str(tmp_path / "out"))
    assert len(failed) == 1 and spark.read.csv(str(tmp_path / "out/pairs.csv"), header=True).count() == 4


def test_queries_have_oracles():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 100


@pytest.mark.parametrize("center,scale", [(False, False), (True, False), (True, True)])
def test_krylov_against_numpy(spark, center, scale):
    r = np.random.RandomState(5)
    x = r.poisson(0.3, (150, 60)) * r.gamma(2, 1, 60) + np.outer(r.rand(150), r.rand(60) * 3).round()
    counts = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero(), strict=True)], "cell_id long, feature_id long, value double")
    e, value = embed.svd(counts, 4, center, scale)
    y = x - x.mean(axis=0) if center else x
    y = y / y.std(axis=0, ddof=1) if scale else y
    u, s, _ = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(value, s[:4] ** 2 / 149 if center else s[:4], rtol=1e-6)
    got = np.array([v["vec"] for v in e.orderBy("cell_id").collect()])
    want = u[:, :4] * s[:4]
    assert np.allclose(np.abs((got * want).sum(axis=0)), (want**2).sum(axis=0), rtol=1e-4)
    assert np.allclose(got @ got.T, want @ want.T, atol=0.02 * s[0])


def test_quantiles_of_many_distinct_values(spark):
    r = np.random.RandomState(2)
    x = np.concatenate([r.lognormal(0, 3, 5000), -r.rand(300), np.repeat(2.5, 2000), [1e-12, 1e12]])
    counts = spark.createDataFrame([(float(v),) for v in np.append(x, 0.0)], "value double")
    at = (0.0, 0.1, 0.5, 0.777, 0.9, 0.999, 1.0)
    got = {v["q"]: v["value"] for v in qc.quantiles(counts, at, bins=16).collect()}
    assert np.allclose([got[q] for q in at], np.quantile(x, at), rtol=1e-12)
    assert [v["value"] for v in qc.quantiles(counts.where("value = 0")).collect()] == [None] * 5


def test_fasta_over_many_splits(spark, tmp_path):
    r = np.random.RandomState(4)
    want = {}
    for f in ("a", "b"):
        text = ""
        for i in range(12):
            seq = "".join(r.choice(list("ACGTn"), r.randint(0, 900)))
            want[f"{f}{i}"] = seq.upper()
            text += f">{f}{i} about it\n" + "".join(seq[j : j + 60] + "\n" for j in range(0, len(seq), 60))
        (tmp_path / f"{f}.fa").write_text(text)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = readers.read_fasta(spark, str(tmp_path), chunk=128).orderBy("chrom", "chunk_ix").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {}
    for v in found:
        got[v["chrom"]] = got.get(v["chrom"], "") + v["seq"]
    assert got == {k: v for k, v in want.items() if v}


class Attributed(dict):
    """What stands for an HDF5 group: a dictionary with attributes."""

    def __init__(self, items, **attrs):
        super().__init__(items)
        self.attrs = {k.replace("_", "-") if k.startswith("encoding") else k: v for k, v in attrs.items()}

    def __getitem__(self, path):
        at = self
        for part in path.split("/"):
            at = dict.__getitem__(at, part)
        return at


def test_annotated_matrix_files(spark):
    x = np.array([[0, 2, 0], [1, 0, 3], [0, 0, 0], [4, 5, 6.0], [0, 0, 7]])
    def store(m):
        rows = [np.nonzero(r)[0] for r in m]
        return {"indptr": np.cumsum([0, *map(len, rows)]), "indices": np.concatenate(rows), "data": np.concatenate([r[n] for r, n in zip(m, rows, strict=True)])}

    obs = Attributed({"_index": np.array([b"c0", b"c1", b"c2", b"c3", b"c4"]), "kind": Attributed({"categories": np.array([b"T", b"B"]), "codes": np.array([0, 1, -1, 0, 0], np.int8)}), "depth": np.array([1.5, 2, 3, 4, 5])}, _index="_index")
    var = Attributed({"names": np.array(["g0", "g1", "g2"])}, _index="names")
    pca = np.arange(10).reshape(5, 2) * 1.0
    root = {"obs": obs, "var": var, "X": x, "layers": Attributed({"rows": Attributed(store(x), encoding_type="csr_matrix"), "cols": Attributed(store(x.T), encoding_type="csc_matrix")}), "obsm": Attributed({"X_pca": pca})}
    file = Attributed({**root, "mod": Attributed({"rna": Attributed(root)})})
    want = sorted((int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero(), strict=True))
    for layer in (None, "rows", "cols"):
        got = readers.read_h5ad(spark, "f", layer, rows=2, opener=lambda path: file)
        assert rows(got["counts"]) == want
    cells = got["cells"].orderBy("cell_ix").collect()
    assert [(v["cell_id"], v["kind"], v["depth"]) for v in cells] == [("c0", "T", 1.5), ("c1", "B", 2.0), ("c2", None, 3.0), ("c3", "T", 4.0), ("c4", "T", 5.0)]
    assert [v["vec"] for v in got["obsm/X_pca"].orderBy("cell_ix").collect()] == pca.tolist()
    both = readers.read_h5mu(spark, "f", opener=lambda path: file)
    assert rows(both["rna"]["counts"]) == want and rows(both["rna"]["features"]) == [(0, "g0"), (1, "g1"), (2, "g2")]


def partitions(n):
    if n == 0:
        yield []
        return
    for p in partitions(n - 1):
        for c in range(max(p, default=-1) + 2):
            yield [*p, c]


def test_louvain_against_all_partitions(spark):
    edges = [(0, 1, 1.0), (1, 2, 1.0), (0, 2, 1.0), (2, 3, 0.3), (3, 4, 1.0), (4, 5, 1.0), (3, 5, 1.0), (5, 6, 0.2), (6, 7, 2.0)]
    df = spark.createDataFrame(edges, "src long, dst long, weight double")
    m = sum(w for *_, w in edges)
    k = [sum(w for a, b, w in edges if i in (a, b)) for i in range(8)]

    def q(p):
        return sum(w for a, b, w in edges if p[a] == p[b]) / m - 0.8 * sum(sum(k[i] for i in range(8) if p[i] == c) ** 2 for c in set(p)) / (4 * m * m)

    found = communities.louvain(df, 0.8)
    got = {v["id"]: v["cluster"] for v in found.collect()}
    assert abs(q([got[i] for i in range(8)]) - max(map(q, partitions(8)))) < 1e-9
    assert abs(cluster.modularity(df, found, 0.8) - q([got[i] for i in range(8)])) < 1e-9
    assert communities.louvain(df.where("false")).count() == 0


def test_indexed_neighbours(spark):
    r = np.random.RandomState(6)
    x = r.randn(1500, 16) + 3 * r.randn(12, 16)[r.randint(0, 12, 1500)]
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(1500)], "id long, vec array<double>")
    exact = {(a["src"], a["dst"]) for a in neighbors.knn(v, 10).collect()}
    found = neighbors.knn_indexed(v, 10, lists=30, probes=8)
    assert len(exact & {(a["src"], a["dst"]) for a in found.collect()}) >= 0.9 * len(exact) and found.count() == 15_000
    whole = neighbors.knn_indexed(v, 10, lists=6, probes=6, queries=v.where("id % 100 = 0"))
    want = {(a["src"], a["dst"], a["rank"]) for a in neighbors.knn(v, 10).where("src % 100 = 0").collect()}
    assert {(a["src"], a["dst"], a["rank"]) for a in whole.collect()} == want


def test_neighbours_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 10)
    r = np.random.RandomState(7)
    cells = [(m, i, f"d{i % 2}" if i < 40 else "d0", f"t{i % 3}", r.randn(4).tolist()) for m in (0, 1) for i in range(60 + 20 * m)]
    side = lambda m: spark.createDataFrame([c[1:] for c in cells if c[0] == m], "cell_id long, donor_id string, cell_type string, vec array<double>")
    got = rows(neighbors.cross_modal(side(0), side(1)).select("rna_cell", "atac_cell", "donor_id", "anchor", "cell_type", "atac_cell_type"))
    want = []
    for _, i, d, t, v in (c for c in cells if c[0] == 0):
        other = [(round(math.dist(v, w), 9), j, u) for m, j, e, u, w in cells if m == 1 and e == d]
        if sum(c[0] == 0 and c[2] == d for c in cells) <= len(other):
            _, j, u = min(other)
            want.append((i, j, d, "rna", t, u))
    for _, j, d, u, w in (c for c in cells if c[0] == 1):
        other = [(round(math.dist(v, w), 9), i, t) for m, i, e, t, v in cells if m == 0 and e == d]
        if len(other) > sum(c[0] == 1 and c[2] == d for c in cells):
            _, i, t = min(other)
            want.append((i, j, d, "atac", t, u))
    assert got == sorted(want, key=str)
    v = side(0).select(F.col("cell_id").alias("id"), "vec")
    assert rows(neighbors.knn_indexed(v, 3, lists=2, probes=2)) == rows(neighbors.knn(v, 3)) == rows(neighbors.knn(v, 3))


def test_local_fit_against_a_plain_one(spark):
    """The fit over bins against a weighted regression at each point; few points, equal points, and other columns."""
    r = np.random.RandomState(9)
    x = np.sort(np.r_[r.uniform(-2, 2, 900), r.normal(1, 0.05, 300)])
    y = 0.5 * x**2 + x + r.normal(0, 0.2, len(x))
    k, want = math.ceil(0.3 * len(x)), []
    for c in x:
        d = np.abs(x - c)
        h = np.sort(d)[k - 1]
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        want.append(np.polynomial.polynomial.polyfit(x - c, y, 2, w=np.sqrt(w + 1e-300))[0])
    points = lambda x, y: spark.createDataFrame([(i, float(a), float(b), "kept") for i, (a, b) in enumerate(zip(x, y, strict=True))], "feature_id long, x double, y double, step string")
    rows_ = hvg.local_fit(points(x, y)).orderBy("feature_id").collect()
    assert np.abs(np.array([v.fit for v in rows_]) - want).max() < 0.03 and {v.step for v in rows_} == {"kept"}
    assert [v.fit for v in hvg.local_fit(points([1, 1, 1], [2, 3, 4])).collect()] == [3.0] * 3
    assert hvg.local_fit(points([], [])).count() == 0
    line = hvg.local_fit(points(range(50), [2 * v + 1 for v in range(50)])).collect()
    assert all(abs(v.fit - (2 * v.x + 1)) < 1e-9 for v in line)


def test_labels_by_coefficients(spark):
    """Scores of sparse counts against z-scores of the dense matrix; absent genes, a scale of 0, empty cells, ties."""
    r = np.random.RandomState(3)
    n, genes, labels = 30, 12, ["a", "b", "c"]
    x = np.log1p(r.poisson(0.8, (n, genes)) * r.gamma(2, 2, genes))
    x[4] = 0
    w, mean, scale, b = r.randn(3, genes), r.rand(genes), r.rand(genes) * 0.3, r.randn(3)
    scale[5] = 0
    counts = spark.createDataFrame([(int(i), f"g{j}", float(x[i, j])) for i, j in zip(*x[:, :10].nonzero(), strict=True)], "cell_id long, feature_id string, value double")
    model = spark.createDataFrame([(f"g{j}", k, float(w[i, j]), float(mean[j]), float(scale[j])) for i, k in enumerate(labels) for j in range(genes)], "feature_id string, label string, weight double, mean double, scale double")
    cut = spark.createDataFrame(list(zip(labels, b.tolist(), strict=True)), "label string, intercept double")
    use = [j for j in range(10) if j != 5]
    z = np.minimum((x[:, use] - mean[use]) / scale[use], 10)
    assert (z == 10).any()
    want = z @ w[:, use].T + b
    scores = cluster.score_labels(counts, spark.range(n).withColumnRenamed("id", "cell_id"), model, cut)
    got = {(v.cell_id, v.label): v.score for v in scores.collect()}
    assert len(got) == 3 * n and all(abs(got[i, k] - want[i, j]) < 1e-9 for i in range(n) for j, k in enumerate(labels))
    clusters = spark.createDataFrame([(i, i % 2) for i in range(n - 1)], "cell_id long, cluster int")
    named = {v.cell_id: v for v in cluster.label_cells(scores, clusters).collect()}
    own = [labels[j] for j in want.argmax(axis=1)]
    assert [named[i].label for i in range(n)] == own and named[n - 1].majority == own[-1]
    for side in (0, 1):
        votes = Counter(own[i] for i in range(side, n - 1, 2))
        assert {named[i].majority for i in range(side, n - 1, 2)} == {min(votes, key=lambda k: (-votes[k], k))}  # noqa: B023
    tie = spark.createDataFrame([(1, "b", 0.0), (1, "a", 0.0)], "cell_id long, label string, score double")
    assert cluster.label_cells(tie).first().label == "a"


def test_command_line(spark, tmp_path, capsys):
    from duoscope.__main__ import main

    r = np.random.RandomState(3)
    features = [(f"g{j}", f"g{j}") for j in range(20)] + [(f"chr1:{1000 * j}-{1000 * j + 500}",) * 2 for j in range(1, 21)]
    counts = [("rna" if f[0].startswith("g") else "atac", i, f[0], float(v)) for i in range(40) for f in features if (v := r.poisson(1.5))]
    cells = spark.createDataFrame([(i, f"t{i % 4}", f"d{i % 3}") for i in range(40)], "cell_id long, cell_type string, donor_id string")
    data = {"counts": spark.createDataFrame(counts, "modality string, cell_id long, feature_id string, value double"), "cells": cells, "features": spark.createDataFrame(features, "feature_id string, feature_name string")}
    sinks.write_dataset(data, str(tmp_path / "d"), {"counts": ["modality"]})
    main(["select", str(tmp_path / "d"), str(tmp_path / "hvg"), "--n", "5"], spark)
    assert spark.read.text(str(tmp_path / "hvg")).count() == 5
    main(["subsample", str(tmp_path / "d"), str(tmp_path / "s"), "--per-type", "3", "--genes", "6", "--peaks", "7"], spark)
    s = readers.read_dataset(spark, str(tmp_path / "s"))
    assert s["cells"].count() == 12 and s["counts"].groupBy("modality").agg(F.countDistinct("feature_id")).count() == 2
    (tmp_path / "a.gtf").write_text("".join(f'chr1\tx\tgene\t{1000 * j}\t{1000 * j + 900}\t.\t+\t.\tgene_name "g{j}"; gene_id "G{j}";\n' for j in range(20)))
    main(["relate", str(tmp_path / "d"), str(tmp_path / "a.gtf"), str(tmp_path / "out")], spark)
    pairs = spark.read.csv(str(tmp_path / "out/peak_gene_pairs.csv"), header=True)
    assert pairs.count() and spark.read.parquet(str(tmp_path / "out/peak_matrix")).count() == 40
    main(["report", str(tmp_path / "d")], spark)
    assert "cell_type" in capsys.readouterr().out


@pytest.mark.parametrize("landmarks", [1000, 120])
def test_layout_keeps_neighbours_together(spark, landmarks):
    from duoscope.operators import layout

    r = np.random.RandomState(1)
    centers = 8 * r.randn(4, 10)
    x = centers[np.arange(300) % 4] + r.randn(300, 10)
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(300)], "id long, vec array<double>")
    got = {p["id"]: (p["x"], p["y"]) for p in layout.umap(v, 10, landmarks=landmarks).collect()}
    y = np.array([got[i] for i in range(300)])
    d = ((y[:, None] - y[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :10]
    assert np.isfinite(y).all() and (near % 4 == (np.arange(300) % 4)[:, None]).mean() > 0.97
    if landmarks == 1000:
        true = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        np.fill_diagonal(true, np.inf)
        best = np.argsort(true, axis=1)[:, :10]
        assert np.mean([len(set(a) & set(b)) for a, b in zip(near, best, strict=True)]) > 3.0
        w = neighbors.memberships(neighbors.knn(v, 10).select("src", "dst", "dist")).groupBy("src").agg(F.sum("weight").alias("s")).collect()
        assert all(abs(z["s"] - math.log2(10)) < 0.01 for z in w)


@pytest.mark.parametrize("center,scale", [(False, False), (True, True), (True, False)])
def test_embeddings_work_on_the_shorter_side(spark, monkeypatch, center, scale):
    """Of 150 cells and 400 features the blocks have 150 rows, few passes suffice, and signs are those of the features."""
    seen, real = [], embed._products
    monkeypatch.setattr(embed, "_products", lambda v, n, right, *a, **b: seen.append(len(right)) or real(v, n, right, *a, **b))
    x = np.random.RandomState(3).poisson(0.1, (150, 400)).astype(float) * 2
    x[:, 0] = 1
    counts = spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*x.nonzero(), strict=True)], "cell_id long, feature_id long, value double")
    e, value = embed.svd(counts, 10, center, scale)
    y = x - x.mean(axis=0) if center else x
    spread = y.std(axis=0, ddof=1)
    y = y / np.where(spread > 0, spread, 1) if scale else y
    u, s, v = np.linalg.svd(y, full_matrices=False)
    assert np.allclose(value, s[:10] ** 2 / 149 if center else s[:10], rtol=1e-9)
    v = v[:10].T
    up = np.where(v[np.abs(v).argmax(axis=0), np.arange(10)] < 0, -1.0, 1.0)
    got = np.stack([r.vec for r in e.orderBy("cell_id").collect()])
    assert np.allclose(got, u[:, :10] * s[:10] * up, atol=1e-4 * s[0])
    assert set(seen) == {150} and len(seen) < 15


def test_energy_needs_one_component(spark, monkeypatch):
    from types import SimpleNamespace

    from duoscope.queries import cells

    x = np.random.RandomState(6).poisson(1.0, (8, 20)).astype(float)
    counts = spark.createDataFrame([(i, j, float(x[i, j])) for i in range(8) for j in range(20) if x[i, j]], "cell_id long, feature_id long, value double")
    asked, real = [], embed.svd
    monkeypatch.setattr(embed, "svd", lambda d, k, *a: asked.append(k) or real(d, k, *a))
    got = {r["value"]: r.n for r in cells.emb_singular_values(SimpleNamespace(rna=counts, cells=spark.range(8), spark=spark)).collect()}
    s = np.linalg.svd(np.log1p(x / x.sum(axis=1, keepdims=True) * 1e4), compute_uv=False)
    assert asked == [1] and math.isclose(got["first"], s[0], abs_tol=1e-3) and math.isclose(got["energy"], (s**2).sum(), abs_tol=1e-1)


def test_tf_peaks_are_made_distinct_by_sets_of_motifs(spark):
    hits = spark.createDataFrame([(f"m{(p * k) % 7}", f"p{p}") for p in range(60) for k in (1, 2, 3)] + [("m0", None), ("none", "p1"), ("none", "p99")], "motif_id string, peak string")
    tfs = spark.createDataFrame([(f"m{m}", f"t{t}") for m in range(6) for t in range(m, m + 5)], "motif_id string, TF string")
    plain = hits.join(tfs, "motif_id").select("TF", "peak").distinct()
    found = triplets.tf_peaks(hits, tfs)
    key = lambda d: sorted((r.TF, r.peak or "") for r in d.collect())
    assert key(found) == key(plain)
    # the product of peaks and TFs is the last thing that is made, and isn't aggregated
    assert not found._jdf.queryExecution().optimizedPlan().toString().startswith("Aggregate")
    corr = spark.createDataFrame([("t1", "p1", 0.5), ("x", "p4", -0.4), ("x", "p99", 0.3)], schemas.CORRELATED)
    assert rows(triplets.relate(corr, hits, tfs)) == rows(triplets.assemble(corr, plain))


def test_relational_scan_scores_a_window_once(spark, monkeypatch):
    """Long sequences of few distinct windows, in chunks; no row per base and motif column."""
    monkeypatch.setattr(motifs, "_CHUNK", 7)
    r = np.random.RandomState(9)
    pwm = spark.createDataFrame([(f"m{k}", j, b, float(r.randint(-3, 4))) for k, w in enumerate((3, 4, 4, 6)) for j in range(w) for b in "ACGT"], "motif_id string, pos int, base string, weight double")
    seqs = [(f"s{i}", "".join(r.choice(list("ACGTN"), 2 + 3 * i))) for i in range(20)] + [("empty", ""), ("none", None), ("flat", "A" * 5000)]
    seqs = spark.createDataFrame(seqs, "peak string, seq string")
    th = spark.createDataFrame([("m0", 5.0), ("m1", 7.0), ("m2", 6.0), ("m3", 9.0)], "motif_id string, threshold double")
    found = motifs.scan_relational(seqs, pwm, th)
    assert rows(found) == rows(motifs.scan(seqs, pwm, th)) and found.count() > 20
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    real = motifs._words
    monkeypatch.setattr(motifs, "_words", lambda *a: (lambda d: d.mapInArrow(count, d.schema))(real(*a)))
    motifs.scan_relational(seqs.where("peak = 'flat'"), pwm, th).count()
    assert 0 < made.value < 2 * 3 * (5000 // 7 + 2)


def test_pairs_of_genes_with_one_window_need_no_distinct(spark):
    r = np.random.RandomState(11)
    gene = [(f"chr{g % 2}", int(a), int(a) + 3000, "+-."[g % 3], f"g{g // 2 if g < 20 else g}") for g, a in enumerate(r.randint(0, 3_000_000, 60))]
    genes = spark.createDataFrame(gene + gene[:7], "chrom string, start long, end long, strand string, gene_name string")
    peak = [f"chr{i % 2}:{a}-{a + w}" for i, (a, w) in enumerate(zip(r.randint(0, 3_000_000, 200), r.choice([-50, 0, 500, 900_000], 200), strict=True))]
    peaks = spark.createDataFrame([(p,) for p in peak + peak[:30] + ["GL1.1:1-2"]], "peak string")
    chosen = genes.select("gene_name").where("gene_name <> 'g30'")
    low, high = intervals.tss_window()
    g = genes.where("gene_name <> 'g30'").select("chrom", F.col("gene_name").alias("gene"), low.alias("win_start"), high.alias("win_end"))
    plain = intervals.overlap_join(g, intervals.peak_table(peaks)).select("gene", "peak")
    found = intervals.peak_gene_overlaps(genes, peaks, chosen)
    assert rows(found) == rows(plain.distinct()) and plain.count() > found.count() > 100
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Union")


def test_matrix_file_is_written_without_a_sort(spark, monkeypatch):
    from duoscope.queries.registry import QUERIES, Context

    def never(*_, **__):
        raise AssertionError("one task would sort the whole matrix")

    monkeypatch.setattr(type(spark.range(1)), "sortWithinPartitions", never)
    folder = "/root/testdata/sf0.001"
    c = Context(spark, folder)
    found = QUERIES["src_mtx"](spark, folder)
    names, cells = c.part.count() - 5, c.supplier.count()
    want = c.rna.where(f"feature_id + 1 <= {names} and cell_id + 1 <= {cells}")
    key = lambda d: sorted((str(r[0]), str(r[1]), float(r[2])) for r in d.collect())
    assert key(found.select("cell_id", "feature_name", "value")) == key(want.select(F.concat(F.lit("c"), "cell_id"), F.concat(F.lit("f"), "feature_id"), "value"))


def test_counts_meet_in_cells_and_bins(spark, monkeypatch):
    r = np.random.RandomState(5)
    genes = [("chr1", int(a), int(a) + 900, "+-."[i % 3], f"g{i % 40}") for i, a in enumerate(r.randint(0, 4_000_000, 60))]  # 20 genes have two windows, some alike
    genes = spark.createDataFrame(genes + genes[:3], "chrom string, start long, end long, strand string, gene_name string")
    at = r.randint(0, 4_000_000, 300)
    names = spark.createDataFrame([(f"chr{1 + i % 2}:{a}-{a + 700}",) for i, a in enumerate(at)] + [("GL1.1:1-2",)], "peak string")
    draw = lambda names, n: [(int(r.randint(40)), names[r.randint(len(names))], float(r.randint(1, 4))) for _ in range(n)]  # noqa: E731  repeats too
    x = spark.createDataFrame(draw([f"g{i}" for i in range(45)], 400), "cell_id long, gene string, x double")
    y = spark.createDataFrame(draw([n.peak for n in names.collect()], 900), "cell_id long, peak string, y double")
    gene_set = spark.createDataFrame([(f"g{i}",) for i in range(38)], "gene string")
    pairs = intervals.peak_gene_overlaps(genes, names, gene_set)
    want = sorted(tuple(m) for m in correlate.meet_in(pairs)(x, y).select("gene", "peak", "x", "y", "c").collect())
    joined, plain = [], intervals.overlap_join

    def seen(*a, **k):
        joined.append(plain(*a, **k))
        return joined[-1]

    monkeypatch.setattr(intervals, "overlap_join", seen)
    got = intervals.meetings(genes, names, gene_set)(x, y)
    assert len(want) > 100 and sorted(tuple(m) for m in got.collect()) == want
    # the join gives counts of one cell only, and not a row for each gene around a peak's count
    assert len(joined) == 1 and joined[0].count() <= 2 * sum(w[-1] for w in want) < y.join(pairs, "peak").count() / 2


def test_matrix_without_columns(spark, monkeypatch):
    from types import SimpleNamespace

    from duoscope.queries import relations

    cells = spark.range(1, 6).withColumnRenamed("id", "cell_id")
    c = SimpleNamespace(cells=cells, atac_p=spark.createDataFrame([(1, "p1", 2.0)], "cell_id long, peak string, value double"))
    monkeypatch.setattr(relations, "correlated", lambda _: spark.createDataFrame([], "gene string, peak string"))
    got = {(r.planted, r.check): r.passed for r in relations.validate_matrix(c).collect()}
    # as the SQL has it: of a matrix without a value no greatest count is known
    want = {"matrix width": (True, False), "a row for each cell": (True, False), "no row but for a cell": (True, True), "noise present": (True, False), "counts present": (None, None)}
    assert got == {(planted, k): v[planted] for k, v in want.items() for planted in (False, True)}


def test_louvain_query_has_an_edge_a_supplier(spark, monkeypatch):
    from types import SimpleNamespace

    from duoscope.queries import cells

    nations = [0] * 40 + [1] * 25 + [2] * 2 + [3]
    rows = [(i * 7 % 68, n) for i, n in enumerate(nations)]
    c = SimpleNamespace(supplier=spark.createDataFrame(rows, "s_suppkey long, s_nationkey int"))
    sizes, plain = [], communities.louvain
    monkeypatch.setattr(communities, "louvain", lambda e, r: (sizes.append(e.count()), plain(e, r))[1])
    first = {n: min(i for i, m in rows if m == n) for n in (0, 1, 2)}
    assert {tuple(r) for r in cells.clu_louvain(c).select("id", "cluster").collect()} == {(i, first[n]) for i, n in rows if n < 3}
    assert sizes == [39 + 24 + 1 + 2]


def test_npz_archives_hold_the_counts_by_blocks(spark):
    from duoscope.functions.tables import numbered
    from duoscope.sources import sinks

    r = np.random.RandomState(2)
    counts = [(c, f"p{p}", float(r.randint(1, 5))) for c in range(60) for p in range(30) if (c * p) % 7 == 1]
    df = spark.createDataFrame(counts, "cell_id long, peak string, value double")
    archives = [sinks.read_npz(x.npz) for x in sinks.to_npz_blocks(df, spark.range(70).withColumnRenamed("id", "cell_id"), df, rows=8).collect()]
    names = sorted({p for _, p, _ in counts})
    got = {(int(a["cell_id"][i]), names[j]): v for a in archives for i in range(len(a["cell_id"])) for j, v in zip(a["peak_matrix_indices"][a["peak_matrix_indptr"][i] : a["peak_matrix_indptr"][i + 1]], a["peak_matrix_data"][a["peak_matrix_indptr"][i] : a["peak_matrix_indptr"][i + 1]], strict=True)}
    assert len(archives) > 3 and got == {(c, p): v for c, p, v in counts}
    assert sorted(int(i) for a in archives for i in a["cell_id"]) == list(range(70)) and {int(a["peak_matrix_shape"][1]) for a in archives} == {len(names)}
    at = numbered(spark.createDataFrame([(f"k{i:03}",) for i in r.permutation(500)], "k string"), "k", "ix")
    assert {(x.k, x.ix) for x in at.collect()} == {(f"k{i:03}", i) for i in range(500)}


def test_names_of_10x_files_stay_off_the_driver(spark, monkeypatch):
    class Names(list):
        def __getitem__(self, s):
            if s.stop is None or s.stop - s.start > 4:
                raise AssertionError("more than a range at once")
            return [f"n{i}" for i in range(s.start, s.stop)]

    from duoscope.sources import readers

    monkeypatch.setattr(readers, "_NAMES", 4)
    group = {"barcodes": Names([0] * 11), "indptr": np.arange(12), "indices": np.arange(11) % 9, "data": np.ones(11), "features": {k: Names([0] * 9) for k in ("id", "name", "feature_type")}}
    found = readers.read_10x_h5(spark, "memory", rows=2, opener=lambda path: {"matrix": group})
    assert {tuple(x) for x in found["cells"].collect()} == {(i, f"n{i}") for i in range(11)}
    assert {tuple(x) for x in found["features"].collect()} == {(i, *[f"n{i}"] * 3) for i in range(9)}
    assert {tuple(x) for x in found["counts"].collect()} == {(i, i % 9, 1.0) for i in range(11)}
