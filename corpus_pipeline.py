"""The corpus pipeline: quality rules, near-duplicates, benchmark decontamination, mixing, sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs; the table before it goes. All but the last return the columns of documents, and columns beyond these, whatever
their names, are carried along. No stage fails on null texts, ids, languages or sources, on repeated rows or on an empty
table; what becomes of them is said at each stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from duoscope.llm.common import release, remove_at_end, shared_dir, table
from duoscope.llm.decontam import without_leaks
from duoscope.llm.minhash import first_of_each_class
from duoscope.llm.mixing import WEIGHTS, mix
from duoscope.llm.quality import clean_documents
from duoscope.llm.sharding import shard_by_key


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines that too many documents of a source share go from the rest.

    A null or empty text has no words and is rejected; a null source is a source of its own; repeated rows share a verdict.
    """
    return clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: five-word shingles, a similarity of 0.8 or more.

    It's the one with the smallest id, of rows that share it the least text. Texts without words and rows without an id stay.
    """
    return first_of_each_class(docs, k=5, per_cent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; a null text holds none, repeated rows go or stay together."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """As many tokens as came in, dealt by the weights of domains, languages and sources: rows go or repeat.

    A null language or source is the empty name; a leaf without tokens gives nothing; equal rows are interchangeable.
    """
    return mix(docs, WEIGHTS, fraction=1.0, max_epochs=4, seed=17, whole_rows=True)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard and slot of every row that is left; a null id hashes as the empty string, equal rows get slots of their own."""
    return shard_by_key(docs, weights=[1.0] * 24)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: MinHash candidates and components are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i == len(STAGES) - 1:
            return out
        path = remove_at_end(spark, f"{shared_dir(spark)}/duoscope-pipeline-{name}-{uuid.uuid4().hex}")
        out.write.parquet(path)
        release(before)
        before, docs = path, spark.read.parquet(path)
    return docs
