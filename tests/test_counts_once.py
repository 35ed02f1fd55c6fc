"""Counts are the work of a phase before: the steps that read them several times have them made once."""

import numpy as np

from duoscope.operators import embed, hvg, intervals, sampling
from duoscope.operators.normalize import moments
from duoscope.plans import phases


def counted(df):
    """The rows, and a count of how many of them were made."""
    made = df.sparkSession.sparkContext.accumulator(0)

    def go(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    return df.mapInArrow(go, df.schema), made


def test_unpaired_counts_are_made_once(spark, monkeypatch):
    r = np.random.RandomState(4)
    x = r.poisson(2.0, (80, 30)) * (r.rand(80, 30) < 0.7)
    at = [(int(i), int(j)) for i, j in zip(*np.nonzero(x), strict=True)]
    rna, made_r = counted(spark.createDataFrame([(i, f"g{j}", float(x[i, j])) for i, j in at], "cell_id long, gene string, value double"))
    atac, made_a = counted(spark.createDataFrame([(i, f"chr1:{1000 * j}-{1000 * j + 500}", float(x[i, j])) for i, j in at], "cell_id long, peak string, value double"))
    genes = spark.createDataFrame([("chr1", 1000 * j, 1000 * j + 400, "+", f"g{j}") for j in range(0, 30, 2)], "chrom string, start long, end long, strand string, gene_name string")
    cells = spark.createDataFrame([(i, "one" if i < 40 else "two", "t") for i in range(80)], "cell_id long, donor_id string, cell_type string")
    overlaps, names = intervals.body_overlaps, []

    def seen(genes, peaks, *args):
        names.append(peaks)
        return overlaps(genes, peaks, *args)

    monkeypatch.setattr(intervals, "body_overlaps", seen)
    found = phases.integrate_unpaired(rna, atac, cells, cells, genes, n_hvgs=25, n_pcs=5, dims=4, least_shared=3, min_cells=2)
    done = {d.donor_id: (d.status, d.n_pairs) for d in found["donors"].collect()}
    assert done == {"one": ("aligned", 40), "two": ("aligned", 40)}
    assert made_r.value == made_a.value == len(at)
    # a name is parsed once for a peak, not for each count of it: the names end a plan
    assert all("Aggregate" not in p._jdf.queryExecution().optimizedPlan().toString() for p in names) and len(names) == 1


def test_unpaired_genes_are_those_of_all_cells(spark, monkeypatch):
    """However many cells there are: with a limit of 20 the genes came from some of the 80."""
    r = np.random.RandomState(7)
    x = r.poisson(2.0, (80, 12)) + 1
    rows = [(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(x)]
    rna = spark.createDataFrame([(i, f"g{j}", v) for i, j, v in rows], "cell_id long, gene string, value double")
    atac = spark.createDataFrame([(i, f"chr1:{1000 * j}-{1000 * j + 500}", v) for i, j, v in rows], "cell_id long, peak string, value double")
    genes = spark.createDataFrame([("chr1", 1000 * j, 1000 * j + 400, "+", f"g{j}") for j in range(12)], "chrom string, start long, end long, strand string, gene_name string")
    cells = spark.createDataFrame([(i, "one" if i < 40 else "two", "t") for i in range(80)], "cell_id long, donor_id string, cell_type string")
    real, seen = hvg.select_variable, []

    def select(counts, n_cells, *args):
        seen.append((n_cells, counts.select("cell_id").distinct().count()))
        return real(counts, n_cells, *args)

    monkeypatch.setattr(hvg, "select_variable", select)
    per_donor = sampling.per_donor
    monkeypatch.setattr(sampling, "per_donor", lambda df, donor, key: per_donor(df, donor, key, 20))
    phases.integrate_unpaired(rna, atac, cells, cells, genes, n_hvgs=10, n_pcs=3, dims=2, least_shared=3, min_cells=2)
    assert seen == [(80, 80)]


def test_variable_features_in_two_passes(spark):
    """As by clipping all counts; features with and without counts beyond their limit, missing counts, and too few counts."""
    r = np.random.RandomState(5)
    x = r.poisson(r.gamma(1.0, 2.0, 60), (200, 60)).astype(float)
    x[:, 0], x[3, 0], x[5, 1] = 0, 900, 2000
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x), strict=True)] + [(1, 2, None), (2, None, 5.0)]
    plain = spark.createDataFrame(rows, "cell_id long, feature_id long, value double")
    counts, made = counted(plain)
    got = {v.feature_id: v.norm_var for v in hvg.select_variable(counts, 200, 100).collect()}
    ok = [j for j in range(60) if (x[:, j] > 0).sum() >= 3]
    kept = plain.where(plain.feature_id.isin(ok))
    fit = hvg.fitted_sd(moments(kept, 200))
    want = {v.feature_id: v.norm_var for v in hvg.standardized_variance(kept, fit, 200).collect()}
    assert got.keys() == want.keys() and 0 not in got and np.allclose([got[j] for j in want], list(want.values()), rtol=1e-9)
    beyond = [f.feature_id for f in fit.collect() if x[:, f.feature_id].max() > f.mean + f.sd_hat * 200**0.5]
    assert 1 in beyond and len(beyond) < len(ok)
    assert made.value <= 2 * len(rows)


def test_counts_of_an_embedding_are_made_once(spark):
    r = np.random.RandomState(6)
    x = r.rand(30, 12)
    for y in (x, x.T):  # more cells than features, and fewer
        counts, made = counted(spark.createDataFrame([(i, j, float(v)) for i, w in enumerate(y) for j, v in enumerate(w)], "cell_id long, feature_id long, value double"))
        _, values = embed.svd(counts, 3)
        assert np.allclose(values, np.linalg.svd(y)[1][:3]) and made.value == 360
