"""Names, filters, projections, label counts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions import names
from duoscope.operators import filters, qc
from duoscope.queries.registry import Context, query

_PEAK = r"regexp_extract(peak, '^(chr\w+)[:-](\d+)-(\d+)$', {})"
_P = [_PEAK.replace("{}", str(i)) for i in (1, 2, 3)]


@query(f"select feature_id, {_P[0]} as chrom, try_cast({_P[1]} as bigint) as p_start, try_cast({_P[2]} as bigint) as p_end from {{peaks}} where {_P[0]} <> ''")
def peak_parse(c: Context) -> DataFrame:
    p = c.peaks.select("feature_id", names.parse_peak(F.col("peak")).alias("p")).where("p is not null")
    return p.select("feature_id", F.col("p.chrom").alias("chrom"), F.col("p.start").alias("p_start"), F.col("p.end").alias("p_end"))


@query(f"select feature_id, {_P[0]} || ':' || {_P[1]} || '-' || {_P[2]} as peak from {{good_peaks}}")
def peak_standardize(c: Context) -> DataFrame:
    return c.good_peaks.select("feature_id", names.standardize_peak(F.col("peak")).alias("peak"))


@query('select p_chrom as "Chromosome", p_start as "Start", p_end as "End", peak as "Name" from {good_peaks}')
def peaks_to_table(c: Context) -> DataFrame:
    return names.peaks_to_table(c.peaks)


@query("select feature_id, feature_name from {features} where starts_with(feature_name, 'chr')")
def filter_chr(c: Context) -> DataFrame:
    return filters.chr_features(c.features).select("feature_id", "feature_name")


@query("select feature_id, feature_name, feature_type, feature_type = 'Peaks' as second from {features} where feature_type in ('Gene Expression', 'Peaks')")
def filter_feature_type(c: Context) -> DataFrame:
    first, second = filters.by_feature_type(c.features, "Gene Expression"), filters.by_feature_type(c.features, "Peaks")
    both = first.withColumn("second", F.lit(False)).union(second.withColumn("second", F.lit(True)))
    return both.select("feature_id", "feature_name", "feature_type", "second")


_QC = """with m as (
  select l_orderkey as cell_id, cast(count(*) filter (v > 0) as bigint) as n_genes, sum(v) as total_counts, sum(case when p_type = 'PROMO' then v else 0 end) * 100.0 / nullif(sum(v), 0) as pct_mt
  from (select l_orderkey, l_partkey, sum(l_quantity) as v from {lineitem} group by 1, 2) join {part} on l_partkey = p_partkey group by 1)
"""


def _order_metrics(c: Context) -> DataFrame:
    counts = c.lineitem.groupBy(F.col("l_orderkey").alias("cell_id"), F.col("l_partkey").alias("feature_id")).agg(F.sum("l_quantity").alias("value"))
    return qc.qc_metrics(c.orders.select(F.col("o_orderkey").alias("cell_id")), counts, c.features)


@query(_QC + "select o_orderkey as cell_id, coalesce(n_genes, 0) as n_genes, coalesce(total_counts, 0.0) as total_counts, round(pct_mt, 6) as pct_mt from {orders} left join m on o_orderkey = cell_id")
def agg_qc_metrics(c: Context) -> DataFrame:
    return _order_metrics(c).withColumn("pct_mt", F.round("pct_mt", 6))


@query(_QC + "select cell_id, n_genes from m where n_genes > 2 and n_genes < 6 and pct_mt < 15")
def filter_qc(c: Context) -> DataFrame:
    return qc.qc_filter(_order_metrics(c), 2, 6, 15.0).select("cell_id", "n_genes")


@query("select event_id, event_type from {events} where event_type in ('purchase', 'error')")
def filter_isin(c: Context) -> DataFrame:
    return filters.isin(c.events, "event_type", ["purchase", "error"]).select("event_id", "event_type")


@query("select o_orderkey, o_custkey from {orders} where o_custkey in (select c_custkey from {customer} where c_mktsegment = 'BUILDING')")
def filter_isin_table(c: Context) -> DataFrame:
    return filters.isin(c.orders, "o_custkey", c.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey")).select("o_orderkey", "o_custkey")


_METHOD = "select event_id, case when user_id % 5 = 0 then null when event_type in ('view', 'click') then '10xMulti' else '10xRNA' end as method from {events}"


@query(f"with m as ({_METHOD}) select event_id, 'paired' as side from m where method = '10xMulti' union all select event_id, 'single' from m where method is distinct from '10xMulti'")
def filter_modality(c: Context) -> DataFrame:
    m = c.spark.sql(_METHOD, events=c.events)
    return filters.multiome(m).select("event_id", F.lit("paired").alias("side")).union(filters.multiome(m, other=True).select("event_id", F.lit("single").alias("side")))


_LABELS = {"view": "browse", "click": "browse", "purchase": "buy"}


@query("select event_id, case event_type when 'view' then 'browse' when 'click' then 'browse' when 'purchase' then 'buy' end as cell_type from {events}")
def map_labels(c: Context) -> DataFrame:
    return c.events.select("event_id", names.map_labels(F.col("event_type"), _LABELS).alias("cell_type"))


@query("select event_id from {events} where event_type in ('view', 'click', 'purchase')")
def filter_notna(c: Context) -> DataFrame:
    return c.events.where(names.map_labels(F.col("event_type"), _LABELS).isNotNull()).select("event_id")


@query("select feature_id from (select feature_id, sum(value - 25) as s from {rna} group by 1) where s > 0")
def filter_zero_sum(c: Context) -> DataFrame:
    return filters.positive_sum_features(c.rna.withColumn("value", F.col("value") - 25))


@query("select feature_id from {rna} group by 1 having count(*) filter (value > 0) >= 5")
def filter_min_cells(c: Context) -> DataFrame:
    return filters.detected_features(c.rna, 5)


@query("with l as (select p_partkey as k, row_number() over (order by p_partkey desc) - 1 as pos from {part} where p_partkey % 13 = 0) select feature_id, peak as feature_name, cast(pos as bigint) as pos from {peaks} join l on feature_id = k")
def select_by_name(c: Context) -> DataFrame:
    from pyspark.sql import Window

    listed = c.peaks.where("feature_id % 13 = 0").select((F.row_number().over(Window.orderBy(F.desc("feature_id"))) - 1).cast("long").alias("pos"), F.col("peak").alias("name"))
    listed = listed.union(c.spark.createDataFrame([(10**6, "no such peak")], "pos long, name string"))
    return filters.select_by_name(c.peaks.select("feature_id", F.col("peak").alias("feature_name")), listed).select("feature_id", "feature_name", "pos")


@query("""with x as (select value, cell_ix from {rna} r join {cells} c on r.cell_id = c.cell_id), n as (select count(*) as n, sum(value) as s, sum(case when cell_ix < 500 then value else value + 0.25 end) as late, sum(value + 0.25) as every from x)
select 'named layer' as kind, true as raw, cast(n as bigint) as n, round(s, 4) as total from n union all select 'whole X', true, n, round(s, 4) from n union all select 'whole in the first cells', true, n, round(late, 4) from n union all select 'fractions', n = 0, n, round(every, 4) from n""")
def resolve_layer(c: Context) -> DataFrame:
    """A raw layer beside X; X of whole numbers; X with fractions, in cells beyond those looked at, and in all."""
    x = c.rna.join(c.cells.select("cell_id", "cell_ix"), "cell_id")
    late = F.when(F.col("cell_ix") < 500, F.col("value")).otherwise(F.col("value") + 0.25)
    cases = {
        "named layer": (x.withColumn("layer", F.lit("UMIs")).union(x.withColumn("layer", F.lit("X")).withColumn("value", F.col("value") / 3)), ["X", "UMIs"]),
        "whole X": (x.withColumn("layer", F.lit("X")), ["X"]),
        "whole in the first cells": (x.withColumn("layer", F.lit("X")).withColumn("value", late), ["X"]),
        "fractions": (x.withColumn("layer", F.lit("X")).withColumn("value", F.col("value") + 0.25), ["X"]),
    }
    out = None
    for kind, (counts, available) in cases.items():
        layer, raw = filters.resolve_layer(counts, available)
        row = layer.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.lit(kind).alias("kind"), F.lit(raw).alias("raw"), "n", "total")
        out = row if out is None else out.union(row)
    return out


@query("select * from (select *, 'head' as part from {nation} order by n_name limit 10) union all select * from (select *, 'tail' as part from {nation} order by n_name desc limit 5)")
def head_tail_preview(c: Context) -> DataFrame:
    return qc.preview(c.nation, "n_name")


@query("select p_partkey as ix, case when r > 1 then p_name || '-' || cast(r - 1 as string) else p_name end as name from (select p_partkey, p_name, row_number() over (partition by p_name order by p_partkey) as r from {part})")
def uniquify_names(c: Context) -> DataFrame:
    return names.uniquify(c.part.select(F.col("p_partkey").alias("ix"), F.col("p_name").alias("name")), "name", "ix")


@query("select s_suppkey as cell_id, s_acctbal as value, s_suppkey - 1 as cell_ix from {supplier} where s_suppkey % 2 = 0")
def realign_by_key(c: Context) -> DataFrame:
    b = c.supplier.select(F.col("s_suppkey").alias("cell_id"), F.col("s_acctbal").alias("value"), F.lit(0).alias("cell_ix"))
    return filters.realign(b, c.cells.where("cell_id % 2 = 0")).select("cell_id", "value", "cell_ix")


@query("select cell_ix + d as cell_ix, cell_id from {cells}, (select unnest([0, 1]) as d) where cell_id % 10 = 0")
def assert_row_aligned(c: Context) -> DataFrame:
    moved = c.cells.withColumn("cell_ix", F.when(F.col("cell_id") % 10 == 0, F.col("cell_ix") + 1).otherwise(F.col("cell_ix")))
    return filters.misaligned(c.cells, moved)


@query("select p_partkey as feature_id, p_name as feature_name from {part}")
def rename_project(c: Context) -> DataFrame:
    return c.part.withColumnRenamed("p_partkey", "feature_id").withColumnRenamed("p_name", "feature_name").select("feature_id", "feature_name")


@query("select event_type as value, cast(count(*) as bigint) as n from {events} group by 1")
def agg_value_counts(c: Context) -> DataFrame:
    return qc.value_counts(c.events, "event_type", dropna=False)


@query("""with n as (select user_id as value, count(*) as n from {events} group by 1), r as (select *, row_number() over (order by n desc, value) as up, row_number() over (order by n, value desc) as down, count(*) over () as t from n)
select value, cast(n as bigint) as n, cast(case when t <= 30 or up <= 15 then up else t - down + 1 end as int) as place, cast(case when t > 30 then t - 20 else 0 end as bigint) as others from r where t <= 30 or up <= 15 or down <= 5""")
def agg_value_counts_preview(c: Context) -> DataFrame:
    return qc.value_counts_preview(c.events, "user_id")


@query("select user_id as row, event_type as col, cast(count(*) as bigint) as n, round(count(*) / sum(count(*)) over (partition by user_id), 6) as share from {events} group by 1, 2")
def agg_crosstab(c: Context) -> DataFrame:
    return qc.crosstab(c.events, "user_id", "event_type").withColumn("share", F.round("share", 6))


@query("select user_id as row, cast(count(*) filter (event_type = 'click') as bigint) as click, cast(count(*) filter (event_type = 'view') as bigint) as view from {events} group by 1")
def agg_crosstab_wide(c: Context) -> DataFrame:
    return qc.crosstab_wide(c.events, "user_id", "event_type", ["click", "view"])


@query("""select label, expected, cast(coalesce(n, 0) as bigint) as observed, case when coalesce(n, 0) = expected then 'OK' else 'MISMATCH' end as status
from (values ('view', 5), ('click', 1), ('refund', 0)) e(label, expected) left join (select event_type, count(*) as n from {events} group by 1) on label = event_type""")
def agg_check_expected(c: Context) -> DataFrame:
    e = c.spark.createDataFrame([("view", 5), ("click", 1), ("refund", 0)], "label string, expected int")
    return qc.check_expected(c.events, "event_type", e)


@query("select feature_id, round(sum(value), 6) as total, cast(count(*) filter (value <> 0) as bigint) as nnz from {rna} group by 1")
def agg_feature_sums(c: Context) -> DataFrame:
    return qc.feature_sums(c.rna).withColumn("total", F.round("total", 6))


@query("""select 0.5::double as q, round(quantile_cont(value, 0.5), 6) as value from {rna} union all select 0.9::double, round(quantile_cont(value, 0.9), 6) from {rna} union all select 0.99::double, round(quantile_cont(value, 0.99), 6) from {rna}
union all select 0.999::double, round(quantile_cont(value, 0.999), 6) from {rna} union all select 1.0::double, round(quantile_cont(value, 1.0), 6) from {rna}""")
def agg_quantiles(c: Context) -> DataFrame:
    return qc.quantiles(c.rna).withColumn("value", F.round("value", 6))


@query("select value, cast(count(*) as bigint) as n, round(count(*) * 100.0 / (select count(*) from {rna}), 6) as pct from {rna} group by 1 order by count(*) desc, value limit 10")
def agg_top_values(c: Context) -> DataFrame:
    return qc.top_values(c.rna).withColumn("pct", F.round("pct", 6))


@query("select cast(count(*) filter (value <> 0) as bigint) as nnz, round(1 - count(*) filter (value <> 0) / ((select count(*) from {cells}) * (select count(*) from {features})), 6) as sparsity from {rna}")
def agg_sparsity(c: Context) -> DataFrame:
    return qc.sparsity(c.rna, c.cells, c.features).withColumn("sparsity", F.round("sparsity", 6))


@query("""select bool_and(value = floor(value)) as whole, max(value) as max, min(value) as min, case when bool_and(value = floor(value)) and max(value) <= 200 then printf('LIKELY RAW COUNTS (integer, max=%.0f)', max(value)) when not bool_and(value = floor(value)) and min(value) >= 0 and max(value) <= 20 then printf('LIKELY NORMALIZED (float, max=%.4f)', max(value)) else 'AMBIGUOUS (int=' || case when bool_and(value = floor(value)) then 'True' else 'False' end || ', min=' || min(value) || ', max=' || max(value) || ')' end as verdict from {rna}""")
def agg_verdict(c: Context) -> DataFrame:
    return qc.verdict(c.rna)


@query("select cast(count(distinct user_id) as bigint) as users, cast(count(distinct event_type) as bigint) as types from {events}")
def agg_nunique(c: Context) -> DataFrame:
    return c.events.agg(F.countDistinct("user_id").alias("users"), F.countDistinct("event_type").alias("types"))


@query("select round(avg(s_acctbal), 6) as mean, min(s_acctbal) as min, max(s_acctbal) as max from {supplier}")
def agg_mean_range(c: Context) -> DataFrame:
    return qc.covariate_summary(c.supplier, "s_acctbal").withColumn("mean", F.round("mean", 6))


@query("with n as (select user_id, count(*) as n from {events} group by 1 order by count(*) desc, cast(user_id as string) limit 12) select e.event_id, case when n is not null then cast(e.user_id as string) else 'other' end as label from {events} e left join n using (user_id)")
def topk_categories(c: Context) -> DataFrame:
    return qc.top_categories(c.events.select("event_id", F.col("user_id").cast("string").alias("label")), "label").select("event_id", "label")


@query("select user_id as value, cast(count(*) as bigint) as n from {events} group by 1 order by count(*) desc, user_id limit 4")
def topk_donors(c: Context) -> DataFrame:
    return qc.largest_groups(c.events, "user_id", 4)


@query("select distinct user_id from {events} where event_type = 'view' intersect select distinct user_id from {events} where event_type = 'error'")
def set_intersect(c: Context) -> DataFrame:
    return c.events.where("event_type = 'view'").select("user_id").intersect(c.events.where("event_type = 'error'").select("user_id"))


@query("select gene_name as gene from {genes} where gene_name not in (select TF from {motif_tf})")
def set_except(c: Context) -> DataFrame:
    tfs = c.part.where("p_partkey % 50 = 0").select(F.col("p_partkey").cast("string").alias("gene"))
    return c.genes.select(F.col("gene_name").alias("gene")).join(tfs, "gene", "left_anti")


@query("select cell_id, feature_id, value, 'rna' as modality from {rna} union all select cell_id, feature_id, value, 'atac' from {atac}")
def set_union_all(c: Context) -> DataFrame:
    return c.rna.withColumn("modality", F.lit("rna")).unionByName(c.atac.withColumn("modality", F.lit("atac")))


@query("select distinct l_suppkey, l_partkey from {lineitem}")
def set_distinct(c: Context) -> DataFrame:
    return c.lineitem.select("l_suppkey", "l_partkey").distinct()


@query("select donor_id, barcode, row_number() over (order by donor_id, barcode) as place from {cells} order by donor_id, barcode limit 50")
def sort_keys(c: Context) -> DataFrame:
    from pyspark.sql import Window

    first = c.cells.select("donor_id", "barcode").orderBy("donor_id", "barcode").limit(50)
    return first.withColumn("place", F.row_number().over(Window.orderBy("donor_id", "barcode")).cast("long"))
