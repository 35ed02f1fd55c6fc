"""Interval joins, gene activity, correlations, motifs and triplets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duoscope.functions.names import gtf_attribute, split_tfs
from duoscope.functions.tables import cut
from duoscope.operators import correlate, intervals, motifs, triplets, validate
from duoscope.plans import phases
from duoscope.queries.registry import Context, query


def genes(c: Context, table: str = "genes") -> DataFrame:
    return getattr(c, table).select("chrom", F.col("g_start").alias("start"), F.col("g_end").alias("end"), "strand", "gene_name")


def gene_set(c: Context) -> DataFrame:
    return c.genes.select(F.col("gene_name").alias("gene"))


def motif_db(c: Context) -> DataFrame:
    tfs = c.part.where("p_partkey % 50 = 0").groupBy("p_brand").agg(F.array_sort(F.collect_list("p_partkey")).alias("k"))
    packed = F.array_join(F.transform("k", lambda x: x.cast("string")), "; ")
    return tfs.select(F.col("p_brand").alias("Accession"), F.col("p_brand").alias("ID"), F.col("p_brand").alias("Name"), packed.alias("TFs"), F.lit("").alias("EnsemblID"))


def pairs(c: Context) -> DataFrame:
    return intervals.peak_gene_overlaps(genes(c), c.peaks, gene_set(c))


def meet(c: Context) -> correlate.Meeting:
    return intervals.meetings(genes(c), c.peaks, gene_set(c))


def correlated(c: Context) -> DataFrame:
    return correlate.spearman_counts(meet(c), c.rna_g, c.atac_p)


def tf_peak(c: Context) -> DataFrame:
    return triplets.tf_peaks(c.matches, triplets.motif_tfs(motif_db(c), gene_set(c)))


def related(c: Context, corr: DataFrame) -> DataFrame:
    return triplets.relate(corr, c.matches, triplets.motif_tfs(motif_db(c), gene_set(c)))


def found(c: Context) -> DataFrame:
    return related(c, cut(correlated(c), "correlated"))


@query("select gene, peak from {pairs}")
def join_interval_tss(c: Context) -> DataFrame:
    return pairs(c)


_BODY = """select gene_name as gene, peak from {dup_genes} join {good_peaks} on chrom = p_chrom and p_start < case when strand = '-' then g_end + 2000 else g_end end and p_end > case when strand = '+' then greatest(0, g_start - 2000) else g_start end"""


@query(_BODY)
def join_interval_body(c: Context) -> DataFrame:
    return intervals.body_overlaps(genes(c, "dup_genes"), c.peaks)


@query(f"with o as ({_BODY}) select cell_id, gene, sum(value) as value from o join {{atac_p}} using (peak) group by 1, 2")
def agg_gene_activity(c: Context) -> DataFrame:
    return intervals.gene_activity(c.atac_p, intervals.body_overlaps(genes(c, "dup_genes"), c.peaks))


@query("with n as (select gene, count(*) as n from {pairs} group by 1) select cast(count(*) as bigint) as genes, median(n) as median, round(avg(n), 6) as mean, cast(min(n) as bigint) as min, cast(max(n) as bigint) as max from n")
def agg_peaks_per_gene(c: Context) -> DataFrame:
    return intervals.peaks_per_gene(pairs(c)).withColumn("mean", F.round("mean", 6))


@query("select gene, peak, round(spearman_r, 6) as spearman_r from {correlated}")
def stat_spearman_filter(c: Context) -> DataFrame:
    return correlated(c).withColumn("spearman_r", F.round("spearman_r", 6))


_BINARY = """with g as (select distinct gene from {rna_g}), p as (select peak, count(distinct cell_id) as n1 from {atac_b} group by 1 having count(distinct cell_id) >= 2),
pr as (select gene, peak from {pairs} join g using (gene) join p using (peak)),
d as (select pr.gene, pr.peak, s.cell_id, coalesce(r.value, 0) as x, case when t.cell_id is not null then 1 else 0 end as y
  from pr cross join {cells} s left join {rna_g} r on r.gene = pr.gene and r.cell_id = s.cell_id left join (select distinct cell_id, peak from {atac_b}) t on t.peak = pr.peak and t.cell_id = s.cell_id),
k as (select gene, peak, rank() over (partition by gene, peak order by x) + (count(*) over (partition by gene, peak, x) - 1) / 2.0 as rx, rank() over (partition by gene, peak order by y) + (count(*) over (partition by gene, peak, y) - 1) / 2.0 as ry from d),
o as (select gene, peak, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) as r from k group by 1, 2)
select gene, peak, round(r, 6) as spearman_r from o where abs(r) > 0.1 and not isnan(r)"""


@query(_BINARY)
def stat_spearman_binary(c: Context) -> DataFrame:
    r = correlate.filter_by_correlation(pairs(c), c.rna_g, c.atac_b, c.cells, meet=meet(c))
    return r.withColumn("spearman_r", F.round("spearman_r", 6))


@query("select motif_id, TF from {motif_tf}")
def explode_tfs(c: Context) -> DataFrame:
    return triplets.motif_tfs(motif_db(c), gene_set(c))


@query("select TF, peak from {tf_peak}")
def join_motif_tf(c: Context) -> DataFrame:
    return tf_peak(c)


@query("select target_gene, peak, round(spearman_r, 6) as spearman_r, TF from {trip}")
def triplets_(c: Context) -> DataFrame:
    return found(c).withColumn("spearman_r", F.round("spearman_r", 6))


_LABELS = """select g.gene_name as gene, case when a.TF is not null then 'TF' else 'target' end as type, coalesce(p, '') as associated_peaks, coalesce(t, '') as "associated_TFs"
from {genes} g left join (select distinct TF from {trip}) a on a.TF = g.gene_name
left join (select target_gene, string_agg(distinct peak, ',' order by peak) as p, string_agg(distinct TF, ',' order by TF) as t from {trip} group by 1) s on s.target_gene = g.gene_name"""


@query(_LABELS)
def label_genes(c: Context) -> DataFrame:
    return triplets.label_genes(found(c), gene_set(c))


@query("select target_gene, string_agg(distinct TF, ',' order by TF) as tfs from {trip} group by 1")
def agg_string_sorted_distinct(c: Context) -> DataFrame:
    return found(c).groupBy("target_gene").agg(F.array_join(F.array_sort(F.collect_set("TF")), ",").alias("tfs"))


@query("select peak, string_agg(gene, ',' order by cast(gene as bigint)) as associated_genes from {correlated} group by 1")
def agg_string_ordered(c: Context) -> DataFrame:
    return triplets.peak_info(correlated(c).withColumn("pair_ix", F.col("gene").cast("long")))


@query("with t as (select p_brand, p_partkey, row_number() over (partition by p_brand order by p_partkey) as r from {part} where p_partkey % 50 = 0) select p_brand as \"Accession\" from t where r = 1 and p_partkey % 100 = 0")
def join_semi_motif(c: Context) -> DataFrame:
    # "A; B" offers "A" and " B" here, so only a row's first TF can match
    some = c.genes.where("cast(gene_name as bigint) % 100 = 0").select("gene_name")
    return triplets.select_motifs(motif_db(c), some).select("Accession")


@query("select distinct peak, p_start from {good_peaks} where peak in (select peak from {correlated})")
def join_semi_peaks(c: Context) -> DataFrame:
    return c.good_peaks.join(correlated(c).select("peak"), "peak", "left_semi").select("peak", "p_start").distinct()


@query("select cell_id, peak, coalesce(value, 0) as value from (select cell_id from {cells}) cross join (select distinct peak from {correlated}) left join {atac_p} using (cell_id, peak)")
def rf_noise_matrix(c: Context) -> DataFrame:
    return triplets.peak_matrix(c.cells, correlated(c), c.atac_p)


#: The result tables as they are, and with violations of every invariant planted, for both engines.
_RESULTS = f"""with labels as ({_LABELS}), peak_info as (select distinct peak from {{correlated}}),
corr2 as (select false as planted, gene, peak, spearman_r from {{correlated}} union all select true, gene, peak, case when cast(gene as bigint) % 50 = 0 then spearman_r / 100 else spearman_r end from {{correlated}}),
trip2 as (select false as planted, target_gene, peak, "TF" from {{trip}} union all select true, target_gene, peak, "TF" from {{trip}} union all select true, "TF", peak, "TF" from {{trip}}),
label2 as (select false as planted, gene, type from labels union all select true, gene, case when type = 'TF' then 'none' else type end from labels where cast(gene as bigint) % 20 <> 0 union all select true, gene, type from labels where cast(gene as bigint) % 70 = 0 union all select true, gene, type from labels where cast(gene as bigint) % 70 = 0),
info2 as (select false as planted, peak from peak_info union all select true, peak from peak_info where peak like '%000-%' and peak not like '%1000-%' union all select true, 'nowhere'),
sets as (select unnest([false, true]) as planted),
bad as (
  select 'pairs above threshold' as "check", planted, count(*) as n from corr2 where not abs(spearman_r) > 0.1 group by 2
  union all select 'no self-regulation', planted, count(*) from trip2 where "TF" = target_gene group by 2
  union all select 'TFs are labelled TF', planted, count(*) from trip2 t where not exists (select 1 from label2 l where l.planted = t.planted and l.gene = t."TF" and type = 'TF') group by 2
  union all select 'targets are labelled', planted, count(*) from trip2 t where not exists (select 1 from label2 l where l.planted = t.planted and l.gene = t.target_gene) group by 2
  union all select 'triplet peaks are listed', planted, count(*) from trip2 t where not exists (select 1 from info2 i where i.planted = t.planted and i.peak = t.peak) group by 2
  union all select 'correlated peaks are listed', planted, count(*) from corr2 t where not exists (select 1 from info2 i where i.planted = t.planted and i.peak = t.peak) group by 2
  union all select 'listed peaks are correlated', planted, count(*) from info2 i where not exists (select 1 from corr2 t where i.planted = t.planted and i.peak = t.peak) group by 2
  union all select 'genes are unique', planted, count(*) from (select planted, gene from label2 group by 1, 2 having count(*) > 1) group by 2
  union all select 'types are TF or target', planted, count(*) from label2 where type not in ('TF', 'target') group by 2),
names as (select unnest(['pairs above threshold', 'no self-regulation', 'TFs are labelled TF', 'targets are labelled', 'triplet peaks are listed', 'correlated peaks are listed', 'listed peaks are correlated', 'genes are unique', 'types are TF or target']) as "check")
select s.planted, m."check", coalesce(n, 0) = 0 as passed from sets s cross join names m left join bad b on b.planted = s.planted and b."check" = m."check\""""


@query(_RESULTS)
def validate_results(c: Context) -> DataFrame:
    corr = cut(correlated(c), "correlated")
    trip = cut(related(c, corr), "triplets")  # nine checks read them, twice
    labels = cut(triplets.label_genes(trip, gene_set(c)).select("gene", "type"), "labels")
    info = triplets.peak_info(corr.withColumn("pair_ix", F.col("gene"))).select("peak")
    clean = validate.check_results(corr, trip, labels, info).withColumn("planted", F.lit(False))
    gene = F.col("gene").cast("long")
    twice = labels.where(gene % 70 == 0)
    planted = validate.check_results(
        corr.withColumn("spearman_r", F.when(gene % 50 == 0, F.col("spearman_r") / 100).otherwise(F.col("spearman_r"))),
        trip.unionByName(trip.withColumn("target_gene", F.col("TF"))),
        labels.where(gene % 20 != 0).withColumn("type", F.when(F.col("type") == "TF", "none").otherwise(F.col("type"))).union(twice).union(twice),
        info.where("peak like '%000-%' and peak not like '%1000-%'").union(c.spark.createDataFrame([("nowhere",)], "peak string")),
    )
    return clean.union(planted.withColumn("planted", F.lit(True))).select("planted", "check", "passed")


@query("""with w as (select count(distinct peak) as w from {correlated}), n as (select count(*) as n from {cells}), hi as (select max(coalesce(value, 0)) as hi from (select cell_id from {cells}) cross join (select distinct peak from {correlated}) left join {atac_p} using (cell_id, peak))
select s.planted, k."check", case k."check" when 'noise present' then not s.planted when 'a row for each cell' then not s.planted when 'matrix width' then not s.planted when 'no row but for a cell' then true else hi >= 1 end as passed
from (select unnest([false, true]) as planted) s cross join (select unnest(['matrix width', 'a row for each cell', 'no row but for a cell', 'noise present', 'counts present']) as "check") k cross join hi""")
def validate_matrix(c: Context) -> DataFrame:
    """The model's matrix with noise, and without it, a cell and a column of some cells (without columns, one too many)."""
    corr = cut(correlated(c), "correlated")
    peaks = corr.select("peak").distinct()
    good = triplets.peak_vectors(triplets.peak_matrix(c.cells, peaks, c.atac_p, 1e-5), c.cells)
    few = c.cells.where("cell_id <> 2")
    bad = triplets.peak_vectors(triplets.peak_matrix(few, peaks, c.atac_p), few)
    other = F.when(F.size("peaks") > 0, F.slice("peaks", 1, F.greatest(F.size("peaks") - 1, F.lit(0)))).otherwise(F.array(F.lit(None).cast("double")))
    bad = bad.withColumn("peaks", F.when(F.col("cell_id") == 1, other).otherwise(F.col("peaks")))
    checked = validate.check_matrix(good, c.cells, peaks).withColumn("planted", F.lit(False))
    return checked.union(validate.check_matrix(bad, c.cells, peaks).withColumn("planted", F.lit(True))).select("planted", "check", "passed")


def pwm(c: Context) -> DataFrame:
    """A motif for each type of part: how often which size remainder stands in which place of the keys, as log odds."""
    return c.pwm


_NORMAL = """with per as (select motif_id, pos, avg(weight) as m, var_pop(weight) as v, min(weight) as lo, max(weight) as hi from {pwm} group by 1, 2),
s as (select motif_id, sum(m) as m, sum(v) as v, sum(lo) as lo, sum(hi) as hi from per group by 1),
t as (select motif_id, case when v > 0 then greatest(lo, least(hi, m + ZZ * sqrt(v))) else hi end as threshold from s)"""


_EXACT = """with recursive width as (select motif_id, max(pos) + 1 as w from {pwm} group by 1),
words as (select motif_id, 0 as pos, 0::double as score from width union all select x.motif_id, x.pos + 1, x.score + p.weight from words x join {pwm} p on p.motif_id = x.motif_id and p.pos = x.pos),
scores as (select x.motif_id, w, round(score, 3) as score, count(*) as n from words x join width using (motif_id) where pos = w group by 1, 2, 3),
tails as (select *, sum(n) over (partition by motif_id order by score desc) / pow(4.0, w) as tail from scores)
select motif_id, round(coalesce(min(case when tail <= pow(5.0, -4) * (1 + 1e-12) then score end), max(score)), 6) as threshold from tails group by 1"""


@query(_EXACT)
def pwm_threshold_exact(c: Context) -> DataFrame:
    return motifs.exact_thresholds(pwm(c)).withColumn("threshold", F.round("threshold", 6))


def _normal_sql(tail: str) -> str:
    from statistics import NormalDist

    return _NORMAL.replace("ZZ", repr(NormalDist().inv_cdf(1 - motifs.MOTIF_P))) + tail


@query(_normal_sql(" select motif_id, round(threshold, 6) as threshold from t"))
def pwm_threshold_normal(c: Context) -> DataFrame:
    return motifs.threshold_normal(pwm(c)).withColumn("threshold", F.round("threshold", 6))


@query(_normal_sql(" select p.motif_id, cast(w - 1 - pos as int) as pos, translate(base, 'ACGT', 'TGCA') as base, weight from {pwm} p join (select motif_id, max(pos) + 1 as w from {pwm} group by 1) x on p.motif_id = x.motif_id"))
def pwm_revcomp(c: Context) -> DataFrame:
    return motifs.reverse_complement(pwm(c))


_SCAN = """, both_ as (select motif_id, pos, base, weight, '+' as strand from {pwm} union all select p.motif_id, w - 1 - pos, translate(base, 'ACGT', 'TGCA'), weight, '-' from {pwm} p join (select motif_id, max(pos) + 1 as w from {pwm} group by 1) x on p.motif_id = x.motif_id),
letters as (select peak, i, substr(seq, cast(i + 1 as int), 1) as base from (select peak, seq, unnest(range(length(seq))) as i from {seqs})),
sc as (select motif_id, strand, peak, i - pos as at_, sum(weight) as score, count(*) as n from letters join both_ using (base) group by 1, 2, 3, 4),
best as (select sc.motif_id, peak, max(round(score, 9)) as best from sc join (select motif_id, max(pos) + 1 as w from {pwm} group by 1) x on sc.motif_id = x.motif_id where n = w group by 1, 2)
select best.motif_id, peak from best join t on best.motif_id = t.motif_id where best >= round(threshold, 9)"""


@query(_normal_sql(_SCAN))
def pwm_scan_relational(c: Context) -> DataFrame:
    return motifs.scan_relational(c.seqs, pwm(c), motifs.threshold_normal(pwm(c)))


@query(_normal_sql(_SCAN))
def pwm_scan(c: Context) -> DataFrame:
    return motifs.scan(c.seqs, pwm(c), motifs.threshold_normal(pwm(c)))


@query("select p_partkey, 'ENS' || cast(p_partkey as string) as gene_id, case when p_partkey % 7 = 0 then null else p_name end as gene_name from {part}")
def src_gtf_attr(c: Context) -> DataFrame:
    name = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.concat(F.lit('gene_name "'), F.col("p_name"), F.lit('"; ')))
    s = F.concat(F.lit('gene_id "ENS'), F.col("p_partkey"), F.lit('"; '), name, F.lit('tag "gene_name x"'))
    return c.part.select("p_partkey", gtf_attribute(s, "gene_id").alias("gene_id"), gtf_attribute(s, "gene_name").alias("gene_name"))


@query("select p_brand, cast(count(*) as bigint) as n from {part} where p_partkey % 50 = 0 group by 1")
def split_packed_tfs(c: Context) -> DataFrame:
    return motif_db(c).select(F.col("Accession").alias("p_brand"), F.size(split_tfs(F.col("TFs"))).cast("long").alias("n"))


@query("select target_gene, peak, round(spearman_r, 6) as spearman_r, TF from {trip}")
def pipeline_phase3(c: Context) -> DataFrame:
    r = phases.relate(genes(c), gene_set(c), c.rna_g, c.atac_p, c.cells, c.peaks, motif_db(c), matches=c.matches)
    return r.triplets.withColumn("spearman_r", F.round("spearman_r", 6))
