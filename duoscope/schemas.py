"""Fixed schemas of the result tables, and checks of what comes in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

GENES = "Chromosome string, Start long, End long, Strand string, gene_name string, gene_id string"
PEAKS = "Chromosome string, Start long, End long, Name string"
PAIRS = "gene string, peak string"
CORRELATED = "gene string, peak string, spearman_r double"
MOTIF_DB = "Accession string, ID string, Name string, TFs string, EnsemblID string"
MOTIF_MATCHES = "motif_id string, peak string"
TRIPLETS = "target_gene string, peak string, spearman_r double, TF string"
GENE_LABELS = "gene string, type string, associated_peaks string, associated_TFs string"
PEAK_INFO = "peak string, associated_genes string"
CROSS_PAIRS = "rna_cell string, atac_cell string, cell_type string, atac_cell_type string, distance double, donor_id string, anchor string"


def require_columns(df: DataFrame, names: Iterable[str], what: str = "table") -> DataFrame:
    """The table itself; KeyError if a column is missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise KeyError(f"{what} lacks {missing}; it has {df.columns}")
    return df


def empty(spark, schema: str) -> DataFrame:
    """A typed table without rows: what an operator returns where nothing matches."""
    return spark.createDataFrame([], schema)
