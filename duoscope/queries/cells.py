"""Donors, pairing, sampling, normalization, variable features, neighbours and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duoscope.functions.tables import cut
from duoscope.functions.vectors import doubles, joint, l2_normalize
from duoscope.operators import cluster, communities, donors, embed, harmony, hvg, layout, neighbors, normalize, sampling, validate
from duoscope.plans import phases
from duoscope.queries.registry import Context, query

_COUNTS = """select coalesce(r.donor, a.donor) as donor_id, cast(coalesce(nr, 0) as bigint) as n_rna, cast(coalesce(na, 0) as bigint) as n_atac
from (select donor, count(*) as nr from {rna_cells} group by 1) r full outer join (select donor, count(*) as na from {atac_cells} group by 1) a on r.donor = a.donor"""


@query(_COUNTS)
def join_outer_donors(c: Context) -> DataFrame:
    return donors.donor_counts(c.rna_cells, c.atac_cells, "donor")


@query(f"with d as ({_COUNTS}), w as (select *, case when n_rna = 0 then 'no RNA cells' when n_atac = 0 then 'no ATAC cells' when n_rna < 20 then 'too few RNA cells (' || n_rna || ' < 20)' when n_atac < 20 then 'too few ATAC cells (' || n_atac || ' < 20)' else '' end as skip_reason from d) select donor_id, n_rna, n_atac, skip_reason = '' as has_both, skip_reason from w")
def agg_donor_classify(c: Context) -> DataFrame:
    return donors.classify(c.rna_cells, c.atac_cells, "donor", 20)


def sides(c: Context) -> tuple[DataFrame, DataFrame]:
    v = c.vectors.select(F.col("vec_id").alias("cell_id"), "donor_id", "cell_type", F.col("embedding").alias("vec"), "is_rna")
    return v.where("is_rna").drop("is_rna"), v.where("not is_rna").drop("is_rna")


_CROSS = """with r as (select * from {vectors} where is_rna), a as (select * from {vectors} where not is_rna),
n as (select r.donor_id, case when count(distinct r.vec_id) <= count(distinct a.vec_id) then 'rna' else 'atac' end as anchor from r join a using (donor_id) group by 1),
d as (select donor_id, anchor, r.vec_id as rna_cell, a.vec_id as atac_cell, r.cell_type as cell_type, a.cell_type as atac_cell_type, round(list_distance(r.embedding::double[], a.embedding::double[]), 9) as distance from r join a using (donor_id) join n using (donor_id)),
k as (select *, row_number() over (partition by donor_id, case when anchor = 'rna' then rna_cell else atac_cell end order by distance, case when anchor = 'rna' then atac_cell else rna_cell end) as i from d),
x as (select rna_cell, atac_cell, cell_type, atac_cell_type, distance, donor_id, anchor from k where i = 1)
"""


@query(_CROSS + "select rna_cell, atac_cell, cell_type, atac_cell_type, round(distance, 6) as distance, donor_id, anchor from x")
def join_nn_cross(c: Context) -> DataFrame:
    return neighbors.cross_modal(*sides(c)).withColumn("distance", F.round("distance", 6))


_SUMMARY = _CROSS + """, s as (select r.donor_id, count(distinct r.vec_id) as n_rna, count(distinct a.vec_id) as n_atac from r join a using (donor_id) group by 1),
p as (select donor_id, count(*) as n_pairs, min(anchor) as anchor, avg(distance) as mean_pair_distance, avg(case when cell_type = atac_cell_type then 1.0 else 0.0 end) as cell_type_agreement from x group by 1),
f as (select donor_id, n_rna, n_atac, least(n_rna, n_atac) as min_modality, cast(n_pairs as bigint) as n_pairs, n_pairs / least(n_rna, n_atac) as pair_fraction, anchor, round(mean_pair_distance, 6) as mean_pair_distance, round(cell_type_agreement, 6) as cell_type_agreement, 'aligned' as status, '' as skip_reason from s join p using (donor_id))
"""


def summary(c: Context) -> DataFrame:
    r, a = sides(c)
    s = donors.pair_summary(donors.classify(r, a, min_cells=1), neighbors.cross_modal(r, a))
    return s.withColumn("mean_pair_distance", F.round("mean_pair_distance", 6)).withColumn("cell_type_agreement", F.round("cell_type_agreement", 6))


@query(_SUMMARY + "select * from f")
def agg_donor_summary(c: Context) -> DataFrame:
    return summary(c)


@query(_SUMMARY + "select cast(count(*) as bigint) as donors, cast(sum(n_pairs) as bigint) as pairs, median(n_pairs) as median_pairs, round(avg(pair_fraction), 6) as mean_fraction, min(cell_type_agreement) as min_agreement, max(cell_type_agreement) as max_agreement from f")
def agg_summary_stats(c: Context) -> DataFrame:
    return donors.overall(summary(c)).withColumn("mean_fraction", F.round("mean_fraction", 6))


@query("select b.o_orderkey from (select o_orderkey from {orders} where o_orderkey % 3 <> 0) b join (select distinct l_orderkey from {lineitem} where l_returnflag = 'R') l on o_orderkey = l_orderkey")
def join_barcode_intersect(c: Context) -> DataFrame:
    return donors.shared_barcodes(c.orders.where("o_orderkey % 3 <> 0"), c.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey")


_KEYS = {"order": ["k"], "order+part": ["k", "p"], "order+supplier": ["k", "s"], "absent": ["k", "z"]}


def _audit(c: Context) -> DataFrame:
    x = c.lineitem.select(F.col("l_orderkey").alias("k"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_partkey")).alias("p"), F.col("l_suppkey").alias("s"), "l_returnflag")
    return donors.audit_keys(x.where("l_returnflag = 'N'"), x.where("l_returnflag <> 'N'"), _KEYS)


_AUDIT = """with x as (select l_orderkey as k, case when l_partkey % 9 <> 0 then cast(l_partkey as string) else 'nan' end as p, l_suppkey as s, l_returnflag = 'N' as r from {lineitem}),
k as (select 'order' as key, cast(k as string) as v, r from x union all select 'order+part', cast(k as string) || ':' || p, r from x union all select 'order+supplier', cast(k as string) || ':' || cast(s as string), r from x),
d as (select key, v, bool_or(r) as a, bool_or(not r) as b from k group by 1, 2),
n as (select key, cast(count(*) filter (a) as bigint) as n_rna, cast(count(*) filter (b) as bigint) as n_atac, cast(count(*) filter (a and b) as bigint) as shared from d group by 1),
o as (select *, round(shared * 100.0 / least(n_rna, n_atac), 6) as pct from n)
"""


@query(_AUDIT + "select * from o")
def join_audit_best(c: Context) -> DataFrame:
    return _audit(c).withColumn("pct", F.round("pct", 6))


@query(_AUDIT + "select key, shared, pct, case when pct >= 90 then 'paired' when pct >= 50 then 'partial' else 'unpaired' end as verdict from o order by shared desc, key desc limit 1")
def audit_verdict(c: Context) -> DataFrame:
    return donors.best_key(_audit(c)).withColumn("pct", F.round("pct", 6))


@query("select l_orderkey || ':' || l_linenumber || ':' || case when l_partkey % 4 = 0 then 'nan' else cast(l_partkey as string) end as key from {lineitem}")
def join_composite_key(c: Context) -> DataFrame:
    from duoscope.functions.names import composite_key

    part = F.when(F.col("l_partkey") % 4 != 0, F.col("l_partkey"))
    return c.lineitem.select(composite_key(F.col("l_orderkey"), F.col("l_linenumber"), part).alias("key"))


@query("select cast(count(*) as bigint) as n, round(avg(case when c_nationkey % 5 = n_regionkey then 1.0 else 0.0 end) * 100, 6) as pct, avg(case when c_nationkey % 5 = n_regionkey then 1.0 else 0.0 end) * 100 < 95 as warn from {customer} join {nation} on c_nationkey = n_nationkey")
def agg_agreement(c: Context) -> DataFrame:
    a = c.customer.select("c_custkey", (F.col("c_nationkey") % 5).alias("cell_type"))
    b = c.customer.join(c.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_regionkey").alias("cell_type"))
    return donors.agreement(a, b, "c_custkey").withColumn("pct", F.round("pct", 6))


@query("select s_suppkey as cell_id, n_name from {supplier} left join {nation} on s_nationkey = n_nationkey")
def join_meta_loc(c: Context) -> DataFrame:
    return c.supplier.join(c.nation, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(F.col("s_suppkey").alias("cell_id"), "n_name")


@query("select c.cell_id, label from {cells} c join {vectors} v on c.cell_id = v.vec_id")
def join_lookup(c: Context) -> DataFrame:
    return c.cells.select("cell_id").join(c.vectors.select(F.col("vec_id").alias("cell_id"), "label"), "cell_id")


@query("select event_id, event_type from (select *, row_number() over (partition by event_type order by md5('42:' || cast(event_id as string)), event_id) as r from {events}) where r <= 40")
def sample_stratified(c: Context) -> DataFrame:
    return sampling.stratified(c.events, "event_type", "event_id", 40).select("event_id", "event_type")


@query("with s as (select *, row_number() over (partition by event_type order by md5('42:' || cast(event_id as string)), event_id) as r from {events}) select event_id as rna_cell, event_type as cell_type, 'cell_' || cast(row_number() over (order by event_type, event_id) - 1 as string) as name from s where r <= 10")
def sample_pairs(c: Context) -> DataFrame:
    p = c.events.select(F.col("event_id").alias("rna_cell"), F.col("event_type").alias("cell_type"))
    return sampling.pairs(p, 10)


@query("select cell_id, feature_id, round(value * 1e4::double / sum(value) over (partition by cell_id), 6) as value from {rna}")
def norm_total(c: Context) -> DataFrame:
    return normalize.total(c.rna).withColumn("value", F.round("value", 6))


@query("select cell_id, feature_id, round(ln(1 + value), 6) as value from {rna}")
def norm_log1p(c: Context) -> DataFrame:
    return normalize.log1p(c.rna).withColumn("value", F.round("value", 6))


@query("with f as (select feature_id, ln(1 + (select count(*) from {cells})::double / sum(value)) as idf from {atac} group by 1), t as (select *, ln(1 + value * 1e4::double / sum(value) over (partition by cell_id)) as tf from {atac}) select cell_id, feature_id, round(tf * idf, 6) as value from t join f using (feature_id)")
def norm_tfidf(c: Context) -> DataFrame:
    return normalize.tfidf(c.atac, c.cells.count()).withColumn("value", F.round("value", 6))


_MOMENTS = "with k as (select count(*)::double as n from {cells}), m as (select feature_id, sum(value) / n as mean, greatest(0, (sum(value * value) - n * (sum(value) / n) * (sum(value) / n)) / (n - 1)) as var from {rna} cross join k group by feature_id, n)"


@query(_MOMENTS + " select feature_id, round(mean, 6) as mean, round(var, 6) as var from m")
def hvg_moments(c: Context) -> DataFrame:
    return normalize.moments(c.rna, c.cells.count()).select("feature_id", F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"))


@query(_MOMENTS + " select cell_id, r.feature_id, round(least(10, (value - mean) / sqrt(var)), 5) as value, round(least(10, (0 - mean) / sqrt(var)), 5) as zero_value from {rna} r join m on r.feature_id = m.feature_id where var > 0")
def norm_scale(c: Context) -> DataFrame:
    s = normalize.scaled(c.rna, c.cells.count(), 10.0)
    return s.withColumn("value", F.round("value", 5)).withColumn("zero_value", F.round("zero_value", 5))


_QUADRATIC = _MOMENTS + """, p as (select feature_id, mean, var, log10(mean) as x, log10(var) as y from m where var > 0 and mean > 0),
s as (select count(*)::double as n, sum(x) as x1, sum(x * x) as x2, sum(x * x * x) as x3, sum(x * x * x * x) as x4, sum(y) as y0, sum(x * y) as y1, sum(x * x * y) as y2 from p),
d as (select *, n * (x2 * x4 - x3 * x3) - x1 * (x1 * x4 - x3 * x2) + x2 * (x1 * x3 - x2 * x2) as det from s),
q as (select (y0 * (x2 * x4 - x3 * x3) - x1 * (y1 * x4 - x3 * y2) + x2 * (y1 * x3 - x2 * y2)) / det as a, (n * (y1 * x4 - x3 * y2) - y0 * (x1 * x4 - x3 * x2) + x2 * (x1 * y2 - y1 * x2)) / det as b, (n * (x2 * y2 - y1 * x3) - x1 * (x1 * y2 - y1 * x2) + y0 * (x1 * x3 - x2 * x2)) / det as c from d),
f as (select feature_id, mean, sqrt(pow(10, a + b * x + c * x * x)) as sd from p cross join q),
z as (select r.feature_id, mean, sd, n, sum(least(value, mean + sd * sqrt(n))) as s, sum(pow(least(value, mean + sd * sqrt(n)), 2)) as q from {rna} r join f on r.feature_id = f.feature_id cross join k group by 1, 2, 3, 4),
v as (select feature_id, (n * mean * mean + q - 2 * mean * s) / ((n - 1) * sd * sd) as norm_var from z)"""


@query(_QUADRATIC + " select feature_id, round(norm_var, 4) as norm_var from v")
def hvg_clipped(c: Context) -> DataFrame:
    n = c.cells.count()
    v = hvg.standardized_variance(c.rna, hvg.quadratic_fit(normalize.moments(c.rna, n)), n)
    return v.withColumn("norm_var", F.round("norm_var", 4))


@query(_QUADRATIC + " select feature_id from v order by round(norm_var, 9) desc, feature_id limit 100")
def topk_features(c: Context) -> DataFrame:
    n = c.cells.count()
    return hvg.top_features(hvg.standardized_variance(c.rna, hvg.quadratic_fit(normalize.moments(c.rna, n)), n), 100).select("feature_id")


#: Features of three cells or more, and a local quadratic fit over 400 bins of their log means.
_LOCAL = """with k as (select count(*)::double as n from {cells}), seen as (select feature_id from {rna} group by 1 having count(*) filter (value > 0) >= 3 and sum(value) > 0),
m as (select feature_id, sum(value) / n as mean, greatest(0, (sum(value * value) - n * (sum(value) / n) * (sum(value) / n)) / (n - 1)) as var from {rna} join seen using (feature_id) cross join k group by feature_id, n),
p as (select feature_id, mean, log10(mean) as x, log10(var) as y from m where var > 0 and mean > 0),
e as (select min(x) as lo, max(x) as hi, count(*) as n_all, case when max(x) > min(x) then (max(x) - min(x)) / 400 else 1.0::double end as step from p),
b as (select *, least(399, floor((x - lo) / step)) as bin from p cross join e),
bins as (select bin, count(*) as n, avg(x) as m, avg(y) as v from b group by 1),
pairs as (select a.bin as knot, a.m as c, o.n, o.m, o.v, abs(o.m - a.m) as d, sum(o.n) over (partition by a.bin order by abs(o.m - a.m), o.bin) as upto from bins a cross join bins o),
near as (select *, greatest(min(case when upto >= least(greatest(4, ceil(n_all * 0.3::double)), n_all) then d end) over (partition by knot), step) as h from pairs cross join e),
w as (select knot, c, (m - c) / h as u, v, n * pow(1 - pow(d / h, 3), 3) as w from near where d < h),
s as (select knot, c, sum(w) as s0, sum(w * u) as s1, sum(w * u * u) as s2, sum(w * pow(u, 3)) as s3, sum(w * pow(u, 4)) as s4, sum(w * v) as t0, sum(w * u * v) as t1, sum(w * u * u * v) as t2 from w group by 1, 2),
det as (select *, s0 * (s2 * s4 - s3 * s3) - s1 * (s1 * s4 - s2 * s3) + s2 * (s1 * s3 - s2 * s2) as det from s),
knots as (select knot, c, case when det > 1e-9::double * s0 * s2 * s4 then (t0 * (s2 * s4 - s3 * s3) - s1 * (t1 * s4 - s3 * t2) + s2 * (t1 * s3 - s2 * t2)) / det else t0 / s0 end as a from det),
lines as (select *, lead(c) over o as ca, lead(a) over o as aa, lag(c) over o as cb, lag(a) over o as ab from knots window o as (order by c)),
fit as (select feature_id, mean, sqrt(pow(10, case when x >= c and ca is not null then a + (x - c) / (ca - c) * (aa - a) when x < c and cb is not null then a + (x - c) / (cb - c) * (ab - a) else a end)) as sd from b join lines on bin = knot),
z as (select r.feature_id, mean, sd, n, sum(least(value, mean + sd * sqrt(n))) as s, sum(pow(least(value, mean + sd * sqrt(n)), 2)) as q from {rna} r join fit on r.feature_id = fit.feature_id cross join k group by 1, 2, 3, 4),
v as (select feature_id, (n * mean * mean + q - 2 * mean * s) / ((n - 1) * sd * sd) as norm_var from z)
select feature_id, round(norm_var, 4) as norm_var from v order by round(norm_var, 9) desc, feature_id limit """


@query(_LOCAL + "500")
def stat_vst_hvg(c: Context) -> DataFrame:
    return hvg.select_variable(c.rna, c.cells.count(), 500).withColumn("norm_var", F.round("norm_var", 4))


_DISPERSION = """with x as (select r.cell_id, donor_id as batch, feature_id, value * 1e4::double / sum(value) over (partition by r.cell_id) as v from {rna} r join {cells} c on r.cell_id = c.cell_id),
sizes as (select donor_id as batch, count(*)::double as n from {cells} group by 1),
m as (select batch, feature_id, sum(v) / n as mean, (sum(v * v) - n * (sum(v) / n) * (sum(v) / n)) / (n - 1) as var from x join sizes using (batch) where n > 1 group by batch, feature_id, n),
d as (select batch, feature_id, ln(1 + mean) as mean, ln(var / mean) as dispersion from m where mean > 0 and var > 0),
b as (select *, least(19, floor((mean - min(mean) over (partition by batch)) / greatest((max(mean) over (partition by batch) - min(mean) over (partition by batch)) / 20, 1e-12))) as bin from d),
z as (select batch, feature_id, round(case when coalesce(stddev_samp(dispersion) over w, 0) = 0 then 1 else (dispersion - avg(dispersion) over w) / stddev_samp(dispersion) over w end, 9) as z from b window w as (partition by batch, bin)),
r as (select *, row_number() over (partition by batch order by z desc, feature_id) as r from z)
select feature_id, cast(count(*) filter (r <= 200) as bigint) as batches, round(avg(z), 5) as z from r group by 1 order by count(*) filter (r <= 200) desc, round(avg(z), 9) desc, feature_id limit 200"""


@query(_DISPERSION)
def stat_hvg_dispersion(c: Context) -> DataFrame:
    return hvg.select_by_dispersion(normalize.log1p(normalize.total(c.rna)), c.cells, "donor_id", 200).withColumn("z", F.round("z", 5))


@query(_LOCAL + "200")
def stat_global_hvg(c: Context) -> DataFrame:
    """There are fewer cells than the total, so that all of them are drawn; stat_global_hvg_drawn draws some."""
    drawn = sampling.per_donor(c.cells, "donor_id", "cell_id")
    return hvg.select_variable(c.rna.join(drawn.select("cell_id"), "cell_id", "left_semi"), drawn.count(), 200).withColumn("norm_var", F.round("norm_var", 4))


_DRAWN = """with o as (select cell_id, donor_id, row_number() over (partition by donor_id order by md5('0:' || cast(cell_id as string)), cell_id) as r from {cells}),
few as (select cell_id from o where r <= (select greatest(1, (select count(*) from {cells}) // 2 // count(distinct donor_id)) from {cells})),
counts as (select * from {rna} where cell_id in (select cell_id from few)),
seen as (select feature_id from counts group by 1 having count(*) filter (value > 0) >= 3 and sum(value) > 0),
drawn as (select * from counts where feature_id in (select feature_id from seen)),
"""


@query(_DRAWN + _QUADRATIC.removeprefix("with ").replace("{cells}", "few").replace("{rna}", "drawn") + " select feature_id, round(norm_var, 4) as norm_var from v order by round(norm_var, 9) desc, feature_id limit 200")
def stat_global_hvg_drawn(c: Context) -> DataFrame:
    """The same where there are more cells than the total, with the closed-form fit that SQL can follow: N is the sample's."""
    drawn = sampling.per_donor(c.cells, "donor_id", "cell_id", c.cells.count() // 2)
    v = hvg.select_variable(c.rna.join(drawn.select("cell_id"), "cell_id", "left_semi"), drawn.count(), 200, fit=hvg.quadratic_fit)
    return v.withColumn("norm_var", F.round("norm_var", 4))


_KNN = """with d as (select a.vec_id as src, b.vec_id as dst, round(list_distance(a.embedding::double[], b.embedding::double[]), 9) as dist from {vectors} a, {vectors} b FILTER),
r as (select *, cast(row_number() over (partition by src order by dist, dst) as int) as rank from d) select src, dst, round(dist, 6) as dist, rank from r where rank <= 20"""


def _vectors(c: Context) -> DataFrame:
    return c.vectors.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


@query(_KNN.replace("FILTER", "where a.vec_id <> b.vec_id"))
def join_knn_self(c: Context) -> DataFrame:
    return neighbors.knn(_vectors(c), 20).withColumn("dist", F.round("dist", 6))


@query(_KNN.replace("FILTER", ""))
def join_knn_including_self(c: Context) -> DataFrame:
    return neighbors.knn(_vectors(c), 20, include_self=True).withColumn("dist", F.round("dist", 6))


@query(_KNN.replace("FILTER", "where a.vec_id <> b.vec_id").replace("rank <= 20", "rank <= 3"))
def topk_neighbors(c: Context) -> DataFrame:
    return neighbors.knn(_vectors(c), 3).withColumn("dist", F.round("dist", 6))


@query("""with e as (select l_orderkey as src, l_partkey as dst, sum(l_discount) as weight from {lineitem} group by 1, 2), r as (select *, row_number() over (partition by src order by round(weight, 9) desc, dst) as r from e where round(weight, 9) > 0),
g as (select src, list(dst order by r) as n from r where r <= 4 group by 1) select distinct e.src as id, array_to_string(list_concat(coalesce(n, []), list_resize([]::bigint[], 4 - len(coalesce(n, [])), -1)), ',') as neighbors from e left join g on e.src = g.src""")
def nbr_extract_topk(c: Context) -> DataFrame:
    e = c.lineitem.groupBy(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.round(F.sum("l_discount"), 9).alias("weight"))
    t = neighbors.top_k(e, 4)
    return t.select("id", F.array_join(F.transform("neighbors", lambda x: x.cast("string")), ",").alias("neighbors"))


@query("with n as (select vec_id, embedding::double[] as e, sqrt(list_inner_product(embedding::double[], embedding::double[])) as n from {vectors}) select vec_id, cast(i as int) as i, round(e[i + 1] / n, 6) as v from (select *, unnest(range(64)) as i from n)")
def norm_l2(c: Context) -> DataFrame:
    v = c.vectors.select("vec_id", F.posexplode(l2_normalize(doubles(F.col("embedding")))).alias("i", "v"))
    return v.withColumn("v", F.round("v", 6))


@query("select vec_id, cast(i as int) as i, round(case when i < 20 then (embedding::double[])[i + 1] else (embedding::double[])[64 - (i - 20)] end, 6) as v from (select *, unnest(range(40)) as i from {vectors})")
def emb_concat(c: Context) -> DataFrame:
    e = doubles(F.col("embedding"))
    return c.vectors.select("vec_id", F.posexplode(joint(e, F.reverse(e), 20)).alias("i", "v")).withColumn("v", F.round("v", 6))


def _edges(c: Context) -> DataFrame:
    return neighbors.knn(_vectors(c), 10)


#: The fuzzy graph of 11 neighbours, the cell itself among them: 64 halvings find each bandwidth.
_GRAPH = _KNN.replace("with d as", "with recursive d as").replace("FILTER", "where a.vec_id <> b.vec_id").replace("select src, dst, round(dist, 6) as dist, rank from r where rank <= 20", "") + """,
near as (select src, list(dist order by rank) as l, coalesce(min(dist) filter (dist > 0), 0) as one, sum(dist) / 11 as mean from r where rank <= 10 group by src),
far as (select src, list_transform(l, lambda x: greatest(x - one, 0)) as f, one, mean from near),
half as (select 0 as step, src, 0.0::double as low, 'inf'::double as high from far
  union all select step + 1, src, case when t > log2(11.0::double) then low else m end, case when t > log2(11.0::double) then m else high end
  from (select step, src, low, high, m, list_sum(list_transform(f, lambda x: exp(-x / m))) as t from
    (select step, h.src, low, high, f, case when high < 'inf'::double then (low + high) / 2 when low > 0 then 2 * low else 1 end as m from half h join far on far.src = h.src where step < 64))),
band as (select src, one, greatest(case when high < 'inf'::double then (low + high) / 2 when low > 0 then 2 * low else 1 end, 1e-3::double * mean) as b from half join far using (src) where step = 64),
directed as (select src, dst, case when dist <= one then 1 else exp(-(dist - one) / b) end as w from r join band using (src) where rank <= 10),
graph as (select src, dst, 1 - product(1 - w) as weight from (select * from directed union all select dst, src, w from directed) group by 1, 2)"""


@query(_GRAPH + " select src, dst, round(weight, 6) as weight from graph")
def nbr_graph(c: Context) -> DataFrame:
    return neighbors.neighbour_graph(_vectors(c), 11).withColumn("weight", F.round("weight", 6))


_WNN = """with x as (select vec_id as id, (embedding::double[])[1:32] as r, (embedding::double[])[33:64] as a from {vectors}),
p as (select s.id as src, t.id as dst, round(list_distance(s.r, t.r), 9) as dr, round(list_distance(s.a, t.a), 9) as da from x s join x t on s.id <> t.id),
cr as (select src, dst, dr as d, i from (select *, row_number() over (partition by src order by dr, dst) as i from p) where i <= 200),
ca as (select src, dst, da as d, i from (select *, row_number() over (partition by src order by da, dst) as i from p) where i <= 200),
er as (select src, dst, d from cr where i <= 10), ea as (select src, dst, d from ca where i <= 10),
sh_r as (select u.src, v.src as dst, count(*) as shared from er u join er v on u.dst = v.dst and u.src <> v.src group by 1, 2),
sh_a as (select u.src, v.src as dst, count(*) as shared from ea u join ea v on u.dst = v.dst and u.src <> v.src group by 1, 2),
br as (select src, avg(dr) as s from (select s.src, dr, row_number() over (partition by s.src order by shared, dr desc, s.dst) as i from sh_r s join p on p.src = s.src and p.dst = s.dst) where i <= 20 group by 1),
ba as (select src, avg(da) as s from (select s.src, da, row_number() over (partition by s.src order by shared, da desc, s.dst) as i from sh_a s join p on p.src = s.src and p.dst = s.dst) where i <= 20 group by 1),
nr as (select er.src as id, min(d) as d1, coalesce(any_value(br.s), max(d)) as sigma from er left join br on br.src = er.src group by 1),
na as (select ea.src as id, min(d) as d1, coalesce(any_value(ba.s), max(d)) as sigma from ea left join ba on ba.src = ea.src group by 1),
pr as (select id, sqrt(sum(pow(r[i] - own, 2))) as own, sqrt(sum(pow(r[i] - other, 2))) as other from
  (select x.id, x.r, i, (select avg(y.r[i]) from er join x y on y.id = er.dst where er.src = x.id) as own, (select avg(y.r[i]) from ea join x y on y.id = ea.dst where ea.src = x.id) as other from x, (select unnest(range(1, 33)) as i)) group by id),
pa as (select id, sqrt(sum(pow(a[i] - own, 2))) as own, sqrt(sum(pow(a[i] - other, 2))) as other from
  (select x.id, x.a, i, (select avg(y.a[i]) from ea join x y on y.id = ea.dst where ea.src = x.id) as own, (select avg(y.a[i]) from er join x y on y.id = er.dst where er.src = x.id) as other from x, (select unnest(range(1, 33)) as i)) group by id),
sr as (select id, exp(-greatest(own - d1, 0) / greatest(sigma - d1, 1e-9)) / (exp(-greatest(other - d1, 0) / greatest(sigma - d1, 1e-9)) + 1e-4::double) as s from pr join nr using (id)),
sa as (select id, exp(-greatest(own - d1, 0) / greatest(sigma - d1, 1e-9)) / (exp(-greatest(other - d1, 0) / greatest(sigma - d1, 1e-9)) + 1e-4::double) as s from pa join na using (id)),
mw as (select sr.id, 1 / (1 + exp(sa.s - sr.s)) as rna_weight from sr join sa using (id)),
e as (select src, dst from cr union select src, dst from ca),
f as (select e.src, e.dst, rna_weight, rna_weight * exp(-greatest(dr - nr.d1, 0) / greatest(nr.sigma - nr.d1, 1e-9)) + (1 - rna_weight) * exp(-greatest(da - na.d1, 0) / greatest(na.sigma - na.d1, 1e-9)) as weight
  from e join p on p.src = e.src and p.dst = e.dst join nr on nr.id = e.src join na on na.id = e.src join mw on mw.id = e.src),
g as (select *, row_number() over (partition by src order by round(weight, 9) desc, dst) as i from f)
"""


def _fused(c: Context) -> DataFrame:
    v = _vectors(c).withColumn("vec", F.col("vec").cast("array<double>"))
    return neighbors.wnn(v.withColumn("vec", F.slice("vec", 1, 32)), v.withColumn("vec", F.slice("vec", 33, 32)), 10)


@query(_WNN + "select src, dst, round(weight, 5) as weight, round(rna_weight, 5) as rna_weight from g where i <= 10")
def nbr_wnn(c: Context) -> DataFrame:
    return _fused(c).withColumn("weight", F.round("weight", 5)).withColumn("rna_weight", F.round("rna_weight", 5))


@query(_WNN + "select cell_type, round(avg(rna_weight), 5) as rna_weight, round(avg(1 - rna_weight), 5) as atac_weight from mw join {vectors} v on v.vec_id = mw.id group by 1")
def agg_mod_weight(c: Context) -> DataFrame:
    w = _fused(c).select(F.col("src").alias("vec_id"), "rna_weight").distinct()
    return w.join(c.vectors.select("vec_id", "cell_type"), "vec_id").groupBy("cell_type").agg(F.round(F.avg("rna_weight"), 5).alias("rna_weight"), F.round(F.avg(1 - F.col("rna_weight")), 5).alias("atac_weight"))


_SPREAD = _KNN.replace("FILTER", "where a.vec_id <> b.vec_id").replace("select src, dst, round(dist, 6) as dist, rank from r where rank <= 20", "") + """ , k as (select src, dst, 1 / (1 + dist) as weight from r where rank <= 10),
both_ as (select src, dst, sum(weight) as weight from (select * from k union all select dst, src, weight from k) group by 1, 2),
e as (select * from both_ union all select src, src, max(weight) * 0.5 from both_ group by src),
l0 as (select distinct src as id, src as cluster from e)"""
for _i in range(5):
    _SPREAD += f""", v{_i} as (select src, cluster, round(sum(weight), 9) as w from e join l{_i} on id = dst group by 1, 2),
l{_i + 1} as (select src as id, cluster from (select *, row_number() over (partition by src order by w desc, cluster) as i from v{_i}) where i = 1)"""


@query(_SPREAD + " select id, cluster from l5")
def clu_label_propagation(c: Context) -> DataFrame:
    e = _edges(c).select("src", "dst", (1 / (1 + F.col("dist"))).alias("weight"))
    return cluster.label_propagation(e, 5)


#: Labels that spread over the fuzzy graph, and the modularity that they come to.
_LABELS = _GRAPH + """, twice as (select src, dst, sum(weight) as weight from (select * from graph union all select dst, src, weight from graph) group by 1, 2),
e as (select * from twice union all select src, src, max(weight) * 0.5 from twice group by src),
l0 as (select distinct src as id, src as cluster from e)"""
for _i in range(5):
    _LABELS += f""", v{_i} as (select src, cluster, round(sum(weight), 9) as w from e join l{_i} on id = dst group by 1, 2),
l{_i + 1} as (select src as id, cluster from (select *, row_number() over (partition by src order by w desc, cluster) as i from v{_i}) where i = 1)"""
_LABELS += """, m as (select sum(weight) as m from graph), ends as (select a.cluster as a, b.cluster as b, weight from graph join l5 a on a.id = src join l5 b on b.id = dst),
q as (select (select sum(weight) from ends where a = b) / any_value(m) - 0.8 * sum(k * k) / any_value(m * m) as q from (select a, sum(weight) as k from ends group by 1), m)"""


@query(_LABELS + """ select measure, value from (select 'modularity of spread labels' as measure, round(q, 6) as value from q union all select 'cells', cast(count(*) as double) from {vectors}
union all select unnest(['cells twice', 'clusters in pieces', 'modularity below that of spread labels', 'modularity below that of one cluster']), 0.0)""")
def clu_leiden(c: Context) -> DataFrame:
    """How the communities of the neighbour graph of all vectors stand against labels that spread over the same graph."""
    graph = cut(neighbors.neighbour_graph(_vectors(c), 11), "graph")
    found = cut(communities.leiden(graph, 0.8), "clusters")
    spread = cluster.label_propagation(graph, 5)
    q, of_spread = cluster.modularity(graph, found, 0.8), cluster.modularity(graph, spread, 0.8)
    pieces = communities.connected_parts(graph, found).select("cluster").distinct().count() - found.select("cluster").distinct().count()
    cells, ids = found.agg(F.count("*"), F.count_distinct("id")).first()
    rows = {"modularity of spread labels": round(of_spread, 6), "cells": cells, "cells twice": cells - ids, "clusters in pieces": pieces, "modularity below that of spread labels": q < of_spread, "modularity below that of one cluster": q < 0.2}
    return c.spark.createDataFrame([(k, float(v)) for k, v in rows.items()], "measure string, value double")


@query("select s_suppkey as id, min(s_suppkey) over (partition by s_nationkey) as cluster from {supplier} where s_nationkey in (select s_nationkey from {supplier} group by 1 having count(*) >= 2)")
def clu_louvain(c: Context) -> DataFrame:
    """Stars of the suppliers of a nation around its first, which stand in a ring of very weak edges: an edge a row."""
    s = c.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("n"))
    many = s.groupBy("n").agg(F.min("id").alias("id"), F.count("*").alias("c")).where("c >= 2")
    star = s.alias("a").join(many.alias("b"), "n").where("a.id <> b.id").select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"), F.lit(1.0).alias("weight"))
    ring = many.withColumn("next", F.lead("id").over(Window.orderBy("n"))).where("next is not null").select(F.col("id").alias("src"), F.col("next").alias("dst"), F.lit(1e-4).alias("weight"))
    return communities.louvain(star.union(ring), 0.8)


_VOTE = "with g as (select vec_id, label, vec_id % 20 as cluster from {vectors}), n as (select cluster, label, row_number() over (partition by cluster order by count(*) desc, label) as r from g group by 1, 2) select vec_id, n.label as label from g join n on g.cluster = n.cluster and r = 1"


@query(_VOTE)
def cls_majority_vote(c: Context) -> DataFrame:
    return cluster.voted(c.vectors.select("vec_id", "label", (F.col("vec_id") % 20).alias("cluster"))).select("vec_id", "label")


@query(None)
def cls_celltypist(c: Context) -> DataFrame:
    x = c.vectors.select("vec_id", F.col("embedding").alias("vec"), "cell_type")
    model, names = cluster.train_classifier(x, label="cell_type", max_iter=20)
    return cluster.classify(x, model, names).select("vec_id", "label")


_SCORED = """with x as (select cell_id, feature_id, ln(1 + value * 1e4::double / sum(value) over (partition by cell_id)) as v from {rna}),
m as (select feature_id, label, cast(weight as double) as weight, cast(mean as double) as mean, cast(scale as double) as scale from {label_model} where scale > 0 and feature_id in (select feature_id from {rna})),
base as (select i.label, any_value(intercept) + coalesce(sum(weight * least(-mean / scale, 10)), 0) as base from {intercepts} i left join m on i.label = m.label group by 1),
stored as (select cell_id, label, sum(weight * (least((v - mean) / scale, 10) - least(-mean / scale, 10))) as s from x join m using (feature_id) group by 1, 2),
scores as (select c.cell_id, b.label, base + coalesce(s, 0) as score from {cells} c cross join base b left join stored t on t.cell_id = c.cell_id and t.label = b.label),
best as (select cell_id, label, 1 / (1 + exp(-score)) as probability from (select *, row_number() over (partition by cell_id order by round(score, 9) desc, label) as r from scores) where r = 1),
votes as (select cluster, label, row_number() over (partition by cluster order by count(*) desc, label) as r from (select cell_id % 12 as cluster, label from best) group by 1, 2)"""


@query(_SCORED + " select b.cell_id, b.label, round(probability, 6) as probability, v.label as majority from best b join votes v on v.cluster = b.cell_id % 12 and r = 1")
def cls_coefficients(c: Context) -> DataFrame:
    """Labels by a model that is given as a table of coefficients, and by the majority of the cell's cluster."""
    scores = cluster.score_labels(_logged(c), c.cells, c.label_model, c.intercepts)
    clusters = c.cells.select("cell_id", (F.col("cell_id") % 12).alias("cluster"))
    return cluster.label_cells(scores, clusters).withColumn("probability", F.round("probability", 6))


def _logged(c: Context) -> DataFrame:
    return normalize.log1p(normalize.total(c.rna))


@query(None)
def emb_pca(c: Context) -> DataFrame:
    return embed.pca(_logged(c), 10)


@query(None)
def emb_svd(c: Context) -> DataFrame:
    return embed.svd(_logged(c), 10)[0]


#: The largest singular value by power iteration over the cells' products.
_TOP = """with recursive x as (select cell_id, feature_id, ln(1 + value * 1e4::double / sum(value) over (partition by cell_id)) as v from {rna}),
g as (select a.cell_id as i, b.cell_id as j, sum(a.v * b.v) as w from x a join x b using (feature_id) group by 1, 2),
it as (select 0 as n, cell_id as i, 1.0::double as u, 1.0::double as size from (select distinct cell_id from x)
  union all select n, i, u / sqrt(sum(u * u) over ()), sqrt(sum(u * u) over ()) from (select n + 1 as n, g.i, sum(w * u) as u from it join g on it.i = g.j where n < 40 group by n, g.i))
select 'first' as "value", round(sqrt(max(size)), 4) as n from it where n = 40 union all select 'energy', round(sum(v * v), 2) from x"""


@query(_TOP)
def emb_singular_values(c: Context) -> DataFrame:
    """The largest singular value of the log counts; and the sum of squares of them all, which is that of the values: the
    trace of the Gram matrix needs no component."""
    logged = _logged(c)
    _, s = embed.svd(logged, 1)
    energy = logged.agg(F.sum(F.col("value") * F.col("value"))).first()[0]
    return c.spark.createDataFrame([("first", round(float(s[0]), 4)), ("energy", round(float(energy), 2))], "value string, n double")


@query(None)
def emb_lsi(c: Context) -> DataFrame:
    return embed.lsi(normalize.tfidf(c.atac, c.cells.count()), 10, drop_first=True)


@query(None)
def emb_umap(c: Context) -> DataFrame:
    return layout.umap(_vectors(c), 15)


@query(None)
def emb_harmony(c: Context) -> DataFrame:
    v = c.vectors.select(F.col("vec_id").alias("cell_id"), F.when(F.col("is_rna"), "rna").otherwise("atac").alias("batch"), F.slice(doubles(F.col("embedding")), 1, 20).alias("vec"))
    return harmony.harmony(v, clusters=10, max_iter=4)


@query("""select planted, "check", not planted and (select count(*) from {vectors}) > 10 as passed from (select unnest([false, true]) as planted), (select unnest(['neighbor lists have k entries', 'neighbor indices in range']) as "check")""")
def validate_neighbors(c: Context) -> DataFrame:
    """The lists as they are; and with lists cut short, and indices beyond the cells."""
    v = _vectors(c)
    lists = neighbors.top_k(_edges(c).select("src", "dst", (1 / (1 + F.col("dist"))).alias("weight")), 10)
    bad = F.when(F.col("id") % 7 == 0, F.slice("neighbors", 1, 9)).when(F.col("id") % 11 == 0, F.transform("neighbors", lambda i: i + 10**9)).otherwise(F.col("neighbors"))
    clean = validate.check_neighbors(lists, v, 10).withColumn("planted", F.lit(False))
    return clean.union(validate.check_neighbors(lists.withColumn("neighbors", bad), v, 10).withColumn("planted", F.lit(True))).select("planted", "check", "passed")


@query(None)
def pipeline_subsample(c: Context) -> DataFrame:
    features = c.peaks.select("feature_id", F.col("peak").alias("feature_name"))
    e = c.vectors.select(F.col("vec_id").alias("cell_id"), F.col("embedding").alias("vec"))
    s = phases.subsample(c.rna, c.atac, c.cells, features, n_per_type=3, n_genes=100, n_peaks=200, embedding=e, k=5)
    return s["rna"].groupBy("cell_id").agg(F.sum("value").alias("total"))


@query(None)
def pipeline_integrate_paired(c: Context) -> DataFrame:
    p = phases.integrate_paired(c.rna, c.atac, 200, 10, 8, c.cells)
    return p["lists"]


@query(None)
def pipeline_integrate_unpaired(c: Context) -> DataFrame:
    from duoscope.queries.relations import genes

    r = c.cells.select("cell_id", "donor_id", "cell_type")
    p = phases.integrate_unpaired(c.rna_g, c.atac_p, r, r, genes(c), n_hvgs=400, n_pcs=10, dims=8, least_shared=5, min_cells=2)
    return p["donors"]
