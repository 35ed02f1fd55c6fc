"""Mixing sources to target weights over a domain-language-source tree."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duoscope.llm.common import WORD_RE, cut, quoted, whole_row

LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """A domain for a source that names none: one of d0 to d3 by the first hex digit of its MD5."""
    return F.concat(F.lit("d"), F.ascii(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 1)) % 4)


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def _weight(level: Column, weights: Mapping[str, float], default: float) -> Column:
    if not weights:
        return F.lit(float(default))
    return F.coalesce(F.element_at(F.create_map(*map(F.lit, chain(*((k, float(v)) for k, v in weights.items())))), level), F.lit(float(default)))


def fill(children: DataFrame, parent: Sequence[str]) -> DataFrame:
    """Adds alloc: each parent's budget dealt to its children by weight, none above its capacity.

    What a child cannot take goes to its siblings by their weights. In the order of capacity / weight the full children
    come first: child i is full if capacity_i <= weight_i * (budget - capacities before) / (weights from i on). So two
    running sums settle it, without rounds. Children without weight get nothing.
    """
    by = [F.col(c) for c in parent] or [F.lit(1)]
    order = Window.partitionBy(*by).orderBy(F.expr("cap / weight"), "key")
    sat, all_of = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*by)
    rows = children.where("weight > 0").withColumn("__before", F.coalesce(F.sum("cap").over(sat), F.lit(0.0)))
    rows = rows.withColumn("__left", F.sum("weight").over(all_of) - F.coalesce(F.sum("weight").over(sat), F.lit(0.0)))
    rows = rows.withColumn("__full", F.col("cap") * F.col("__left") <= F.col("weight") * (F.col("budget") - F.col("__before")))
    rest = F.col("budget") - F.coalesce(F.sum(F.when(F.col("__full"), F.col("cap"))).over(all_of), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("__full"), F.col("weight"))).over(all_of)
    rows = rows.withColumn("alloc", F.when(F.col("__full"), F.col("cap")).otherwise(F.greatest(F.lit(0.0), rest) * F.col("weight") / open_weight))
    return rows.drop("__before", "__left", "__full")


def leaf_budgets(leaves: DataFrame, levels: Sequence[str], weights: Sequence[Mapping[str, float]], fraction: float, max_epochs: int, default: float = 1.0) -> DataFrame:
    """(*levels, avail, target): tokens that each leaf has and is to give; target is at most max_epochs * avail.

    Weights propagate from the root. A node's capacity is that of its leaves, so a shortage is met by siblings first, and
    only what a whole family lacks goes to the family's own siblings. The total is fraction * all tokens. One row per
    leaf: the corpus is aggregated before, and a family is sorted in one task.
    """
    nodes = leaves.withColumn("cap", F.col("avail").cast("double") * max_epochs)
    total = float(nodes.agg(F.coalesce(F.sum("avail"), F.lit(0))).first()[0]) * fraction
    budget = None
    for i in range(len(levels)):
        path = list(levels[: i + 1])
        child = nodes.groupBy(*path).agg(F.sum("cap").alias("cap")).withColumn("weight", _weight(F.col(path[-1]), weights[i], default)).withColumn("key", F.col(path[-1]))
        child = child.withColumn("budget", F.lit(total)) if budget is None else child.join(budget, path[:-1])
        budget = fill(child, path[:-1]).select(*path, F.col("alloc").alias("budget"))
    return leaves.join(budget, list(levels), "left").select(*levels, "avail", F.floor(F.round(F.coalesce("budget", F.lit(0.0)), 3)).cast("long").alias("target"))


def _position(seed: int, epoch: Column, key: Column, text_md5: Column) -> Column:
    """Where a row stands in an epoch of its leaf: 32 hex digits."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit("")), F.coalesce(text_md5, F.lit(""))))


def mix(
    docs: DataFrame, weights: Sequence[Mapping[str, float]], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    fraction: float = 1.0, max_epochs: int = 4, seed: int = 17, whole_rows: bool = False,
) -> DataFrame:
    """The mixture: doc_id, domain, lang, source, tokens, copies for each row that is in it; or (whole_rows) the rows
    of docs with all their columns, each as often as it is in the mixture.

    A leaf of `avail` tokens and a target gives target div avail whole epochs and, of the epoch after, the longest prefix
    of whole rows whose tokens stay within the rest. An epoch's order is by MD5 of seed, epoch, id and text. Tokens are
    words. A null level is the empty name, a null text has no tokens; a leaf without tokens gives nothing. Equal rows
    are interchangeable. An empty table gives an empty result.

    No leaf is sorted: sums by the first three hex digits of the order give the bucket in which a leaf's prefix ends, and
    only that bucket (a 4096th) is summed row by row. The sums need an id, a text hash and a count for each row; texts
    are not shuffled. The table of leaves is broadcast if Spark finds it below its threshold, and joined by sort else.
    """
    level = {"domain": domain_of(F.col(source_col)), "lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("")), "source": F.coalesce(F.col(source_col).cast("string"), F.lit(""))}
    named = [level[c].alias(f"__{c}") for c in LEVELS]
    path = [f"__{c}" for c in LEVELS]
    slim = docs.select(F.col(id_col).alias("__id"), *named, F.md5(F.col(text_col).cast("binary")).alias("__md5"), token_count(F.col(text_col)).alias("__tokens"))
    slim = cut(slim, "mix")
    leaves = cut(slim.groupBy(*path).agg(F.sum("__tokens").alias("avail")).where("avail > 0"), "leaves")
    plan = cut(leaf_budgets(leaves, path, weights, fraction, max_epochs).selectExpr(*path, "target div avail as __epochs", "target % avail as __rest"), "plan")

    def positioned(rows: DataFrame) -> DataFrame:
        rows = rows.join(plan, path).withColumn("__h", _position(seed, F.col("__epochs"), F.col("__id"), F.col("__md5")))
        return rows.withColumn("__sub", F.substring("__h", 1, 3))

    sums = positioned(slim).groupBy(*path, "__rest", "__sub").agg(F.sum("__tokens").alias("n"))
    running = Window.partitionBy(*path).orderBy("__sub")
    ends = sums.withColumn("upto", F.sum("n").over(running)).where("upto > __rest")
    ends = cut(ends.groupBy(*path).agg(F.min(F.struct("__sub", (F.col("upto") - F.col("n")).alias("off"))).alias("e")).select(*path, F.col("e.__sub").alias("__end"), F.col("e.off").alias("__off")), "ends")

    # __rest < avail, so a leaf's prefix ends in one of its buckets
    rows = slim if not whole_rows else docs.select(whole_row(docs).alias("__row"), F.col(id_col).alias("__id"), *named, F.md5(F.col(text_col).cast("binary")).alias("__md5"))
    rows = positioned(rows).join(ends, path)
    sure = rows.where("__sub <> __end").withColumn("copies", F.col("__epochs") + (F.col("__sub") < F.col("__end")).cast("long"))
    last = rows.where("__sub = __end")
    if whole_rows:
        last = last.withColumn("__tokens", token_count(F.col(f"__row.{quoted(text_col)}")))
    within = Window.partitionBy(*path).orderBy("__h", "__tokens").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("__sum", F.sum("__tokens").over(within) + F.col("__off"))
    last = last.withColumn("copies", F.col("__epochs") + (F.col("__sum") <= F.col("__rest")).cast("long"))
    if whole_rows:
        out = sure.select("__row", "copies").union(last.select("__row", "copies")).where("copies > 0")
        return out.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("__row.*")
    wanted = [F.col("__id").alias("doc_id"), *(F.col(p).alias(c) for p, c in zip(path, LEVELS, strict=True)), F.col("__tokens").alias("tokens"), "copies"]
    return sure.select(*wanted).union(last.select(*wanted)).where("copies > 0")


#: Production weights: by domain, by language, by source (all alike).
WEIGHTS = ({"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0}, {"en": 6.0, "de": 2.0, "fr": 2.0, "es": 1.0}, {})

MIX_SQL = r"""
with slim as (
  select doc_id, 'd' || (ascii(substr(md5(coalesce(source, '')), 1, 1)) % 4) as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
         md5(text) as m, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as tokens
  from documents),
leaves as (select domain, lang, source, cast(sum(tokens) as bigint) as avail from slim group by all having sum(tokens) > 0),
w1 as (
  select domain, cap, weight, (select cast(sum(avail) as double) from leaves) as budget
  from (select domain, sum(cast(avail as double) * 4) as cap, case domain when 'd0' then 4.0::double when 'd1' then 3.0::double when 'd2' then 2.0::double else 1.0::double end as weight from leaves group by domain)),
f1 as (
  select *, cap * (sum(weight) over () - coalesce(sum(weight) over o, 0)) <= weight * (budget - coalesce(sum(cap) over o, 0)) as full_
  from w1 window o as (order by cap / weight, domain rows between unbounded preceding and 1 preceding)),
a1 as (select domain, case when full_ then cap else greatest(0, budget - coalesce(sum(cap) filter (full_) over (), 0)) * weight / sum(weight) filter (not full_) over () end as budget from f1),
w2 as (
  select c.domain, lang, cap, weight, budget
  from (select domain, lang, sum(cast(avail as double) * 4) as cap, case lang when 'en' then 6.0::double when 'de' then 2.0::double when 'fr' then 2.0::double else 1.0::double end as weight from leaves group by domain, lang) c
  join a1 on c.domain = a1.domain),
f2 as (
  select *, cap * (sum(weight) over (partition by domain) - coalesce(sum(weight) over o, 0)) <= weight * (budget - coalesce(sum(cap) over o, 0)) as full_
  from w2 window o as (partition by domain order by cap / weight, lang rows between unbounded preceding and 1 preceding)),
a2 as (
  select domain, lang, case when full_ then cap else greatest(0, budget - coalesce(sum(cap) filter (full_) over p, 0)) * weight / sum(weight) filter (not full_) over p end as budget
  from f2 window p as (partition by domain)),
w3 as (
  select c.domain, c.lang, source, avail, cast(avail as double) * 4 as cap, 1.0::double as weight, budget
  from leaves c join a2 on c.domain = a2.domain and c.lang = a2.lang),
f3 as (
  select *, cap * (sum(weight) over (partition by domain, lang) - coalesce(sum(weight) over o, 0)) <= weight * (budget - coalesce(sum(cap) over o, 0)) as full_
  from w3 window o as (partition by domain, lang order by cap / weight, source rows between unbounded preceding and 1 preceding)),
plan as (
  select domain, lang, source, avail,
         cast(floor(round(case when full_ then cap else greatest(0, budget - coalesce(sum(cap) filter (full_) over p, 0)) * weight / sum(weight) filter (not full_) over p end, 3)) as bigint) as target
  from f3 window p as (partition by domain, lang)),
pos as (
  select s.*, target // avail as epochs, target % avail as rest, md5('17:' || (target // avail) || ':' || coalesce(cast(doc_id as varchar), '') || ':' || coalesce(m, '')) as h
  from slim s join plan p on s.domain = p.domain and s.lang = p.lang and s.source = p.source),
run as (select *, sum(tokens) over (partition by domain, lang, source order by h, tokens rows unbounded preceding) as upto from pos)
select doc_id, domain, lang, source, tokens, cast(epochs + case when upto <= rest then 1 else 0 end as bigint) as copies
from run where epochs + case when upto <= rest then 1 else 0 end > 0
"""
