"""One query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoscope.llm.common import table
from duoscope.llm.decontam import leaks
from duoscope.llm.hard_negatives import NEGATIVES_SQL, hard_negatives, integer_vectors, with_planted_labels
from duoscope.llm.infill import INFILL_SQL, infill_report
from duoscope.llm.licenses import license_scan
from duoscope.llm.line_dedup import line_report
from duoscope.llm.minhash import NEAR_SQL, near_classes
from duoscope.llm.mixing import MIX_SQL, WEIGHTS, mix
from duoscope.llm.ngram_join import NGRAM_SQL, linked_classes
from duoscope.llm.quality import QUALITY_SQL, quality_rules
from duoscope.llm.secret_scan import secret_scan
from duoscope.llm.sharding import shard_by_key
from duoscope.llm.toxicity import score_toxicity
from duoscope.llm.warc import WARC_SQL, warc_round_trip


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_key(table(spark, sf_dir, "documents"), weights=[1.0] * 24)


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), WEIGHTS, fraction=1.0, max_epochs=4, seed=17)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"), k=4, per_cent=80)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(table(spark, sf_dir, "pages"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_classes(table(spark, sf_dir, "documents"), k=3, per_cent=90).withColumnRenamed("id", "doc_id")


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill_report(table(spark, sf_dir, "documents"), seed=42, infill_per_cent=50, spm_per_cent=80)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = with_planted_labels(table(spark, sf_dir, "embeddings"), every=7, labels=10)
    vectors = integer_vectors(labelled, "vec_id", "label", "embedding", scale=256)
    found = hard_negatives(vectors, every=50, n_positives=5, n_negatives=3, least=50, most=95)
    return found.drop("positive_rank")  # the columns of the SQL; the operator's own are more


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_decontamination,
        op3_toxicity,
        op4_mixing,
        op5_line_dedup,
        op6_minhash_dedup,
        op7_warc,
        op8_quality_rules,
        op9_license_scan,
        op10_secret_scan,
        op11_ngram_join,
        op12_infill,
        op13_hard_negatives,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_mixing": MIX_SQL,
    "op6_minhash_dedup": NEAR_SQL,
    "op7_warc": WARC_SQL,
    "op8_quality_rules": QUALITY_SQL,
    "op11_ngram_join": NGRAM_SQL,
    "op12_infill": INFILL_SQL,
    "op13_hard_negatives": NEGATIVES_SQL,
}
