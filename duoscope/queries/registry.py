"""All queries of the library proper: name -> callable, name -> DuckDB SQL.

The domain tables come from the driver's tables by the SQL in ADAPTERS, which both engines read: {x} stands for another
adapter or a table. Spark binds it to a DataFrame, DuckDB to a CTE or view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

ADAPTERS = {
    "cells": "select s_suppkey as cell_id, s_name as barcode, cast(s_nationkey as string) as cell_type, cast(n_regionkey as string) as donor_id, s_suppkey - 1 as cell_ix from {supplier} join {nation} on s_nationkey = n_nationkey",
    "rna": "select l_suppkey as cell_id, l_partkey as feature_id, sum(l_quantity) as value from {lineitem} where l_returnflag = 'N' group by l_suppkey, l_partkey",
    "atac": "select l_suppkey as cell_id, l_partkey as feature_id, cast(count(*) as double) as value from {lineitem} where l_returnflag <> 'N' group by l_suppkey, l_partkey",
    "features": "select p_partkey as feature_id, case when p_type = 'PROMO' then 'MT-' || p_name when p_partkey % 3 = 0 then 'chr' || p_name else p_name end as feature_name, case when p_partkey % 2 = 0 then 'Gene Expression' else 'Peaks' end as feature_type from {part}",
    "genes": "select 'chr' || cast(p_partkey % 5 + 1 as string) as chrom, p_partkey * 1000 as g_start, p_partkey * 1000 + p_size * 100 as g_end, case p_partkey % 30 when 0 then '-' when 10 then '+' else '.' end as strand, cast(p_partkey as string) as gene_name from {part} where p_partkey % 10 = 0",
    "dup_genes": "select chrom, g_start, g_end, strand, cast(cast(gene_name as bigint) % 400 as string) as gene_name from {genes}",
    "peaks": "select p_partkey as feature_id, case when p_partkey % 97 = 0 then 'GL' || cast(p_partkey as string) || '.1:1-2' else 'chr' || cast(p_partkey % 5 + 1 as string) || case when p_partkey % 2 = 0 then ':' else '-' end || cast(p_partkey * 1000 as string) || '-' || cast(p_partkey * 1000 + 500 as string) end as peak from {part}",
    "good_peaks": "select feature_id, peak, 'chr' || cast(feature_id % 5 + 1 as string) as p_chrom, feature_id * 1000 as p_start, feature_id * 1000 + 500 as p_end from {peaks} where peak like 'chr%'",
    "rna_g": "select cell_id, cast(feature_id as string) as gene, value from {rna}",
    "atac_p": "select cell_id, peak, value from {atac} join {peaks} using (feature_id)",
    "atac_b": "select cell_id, peak, cast(1 as double) as value from {atac_p}",
    "matches": "select p_brand as motif_id, peak from {part} join {peaks} on p_partkey = feature_id where p_partkey % 3 = 0",
    "vectors": "select vec_id, label, embedding, vec_id % 3 = 0 as is_rna, cast(vec_id % 5 as string) as donor_id, cast(label as string) as cell_type from {embeddings}",
    "rna_cells": "select user_id as donor, event_id as cell from {events} where event_type in ('view', 'click') and user_id % 7 <> 0",
    "atac_cells": "select user_id as donor, event_id as cell from {events} where event_type in ('purchase', 'error') and user_id % 11 <> 0",
    "label_model": "select p_partkey as feature_id, label, round(((p_partkey * k) % 19 - 9) / 10.0, 2) as weight, p_size / 50.0 as mean, (p_partkey % 4) / 4.0 as scale from {part} cross join (select 'type' || cast(n_regionkey as string) as label, n_nationkey * 7 + 3 as k from {nation} where n_nationkey < 6) l where p_partkey % 3 = 0",
    "intercepts": "select 'type' || cast(n_regionkey as string) as label, -cast(n_nationkey as double) / 4 as intercept from {nation} where n_nationkey < 6",
    "pwm_cells": "select motif_id, pos, base, k from (select distinct p_type as motif_id, 5 + length(p_type) % 2 as w from {part}) m cross join (select 0 as pos union all select 1 union all select 2 union all select 3 union all select 4 union all select 5) p cross join (select 'A' as base, 0 as k union all select 'C', 1 union all select 'G', 2 union all select 'T', 3) b where pos < w",
    "pwm_counts": "select p_type as m, p_partkey % 6 as p, p_size % 4 as s, count(*) as n from {part} group by p_type, p_partkey % 6, p_size % 4",
    "pwm": "select motif_id, pos, base, round(ln((coalesce(n, 0) + cast(0.25 as double)) / (sum(coalesce(n, 0)) over (partition by motif_id, pos) + 1) * 4), 3) as weight from {pwm_cells} left join {pwm_counts} on motif_id = m and pos = p and k = s",
    "seqs": "select 'd' || cast(doc_id as string) as peak, regexp_replace(upper(text), '[^ACGTN]', '' GLOBAL) as seq from {documents}",
}
#: A window around a TSS, and its pairs, for the oracles.
_WINDOWS = "select gene_name as gene, chrom, greatest(0, case when strand = '-' then g_end - 250000 else g_start - 250000 end) as a, case when strand = '-' then g_end + 250000 else g_start + 250000 end as b from {genes}"
ONLY_SQL = {
    "windows": _WINDOWS,
    "pairs": "select distinct gene, peak from {windows} join {good_peaks} on chrom = p_chrom and p_start < b and p_end > a",
    "shared": "select p.gene, p.peak, r.value as x, t.value as y from {pairs} p join {rna_g} r on p.gene = r.gene join {atac_p} t on p.peak = t.peak and r.cell_id = t.cell_id where r.value > 0 and t.value > 0",
    "ranked": "select gene, peak, rank() over (partition by gene, peak order by x) + (count(*) over (partition by gene, peak, x) - 1) / 2.0 as rx, rank() over (partition by gene, peak order by y) + (count(*) over (partition by gene, peak, y) - 1) / 2.0 as ry from {shared}",
    "rho": "select gene, peak, count(*) as n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 9) as spearman_r from {ranked} group by gene, peak",
    "correlated": "select gene, peak, spearman_r from {rho} where n >= 2 and abs(spearman_r) > 0.1 and not isnan(spearman_r)",
    "motif_tf": "select distinct p_brand as motif_id, cast(p_partkey as string) as TF from {part} where p_partkey % 50 = 0",
    "tf_peak": "select distinct TF, peak from {matches} join {motif_tf} using (motif_id)",
    "trip": "select c.gene as target_gene, c.peak, spearman_r, TF from {correlated} c join {tf_peak} t on c.peak = t.peak where TF <> c.gene",
}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
_REF = re.compile(r"\{(\w+)\}")


class Context:
    """The domain tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in ADAPTERS:
                text = ADAPTERS[name].replace(" GLOBAL)", ")")
                self._made[name] = self.spark.sql(text, **{r: getattr(self, r) for r in set(_REF.findall(text))})
            elif name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._made[name]


def duck(text: str) -> str:
    """The SQL with a CTE for each adapter that it stands on."""
    known = ADAPTERS | ONLY_SQL
    order: list[str] = []

    def visit(t: str) -> None:
        for r in _REF.findall(t):
            if r in known and r not in order:
                visit(known[r])
                order.append(r)

    visit(text)
    plain = lambda t: _REF.sub(r"\1", t).replace("'' GLOBAL)", "'', 'g')")
    ctes = [f"{n} as ({plain(known[n])})" for n in order]
    body = plain(text).strip()
    for start in ("with recursive ", "with "):
        if body.startswith(start):
            return start + ",\n".join([*ctes, body.removeprefix(start)])
    return ("with " + ",\n".join(ctes) + "\n" if ctes else "") + body


def query(sql: str | None = None) -> Callable[[Callable[[Context], DataFrame]], Callable[[Context], DataFrame]]:
    """Registers a function of a Context under its name, with its oracle."""

    def add(f: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        name = f.__name__.rstrip("_")  # triplets_ is a query, triplets a module
        if name in QUERIES:
            raise ValueError(f"{name} is there already")
        QUERIES[name] = lambda spark, sf_dir: f(Context(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = duck(sql)
        return f

    return add


from duoscope.queries import basics, cells, files, relations  # noqa: E402, F401
