"""Tables between the steps of iterative operators."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """The same rows from a table in the folder of spark.checkpoint.dir: the plan ends there, and what it knew of its rows
    with it, so that plans don't grow with the rounds and a lost executor costs no recomputation.

    Without such a folder the rows are persisted, and the plan goes on, on one machine; on a cluster that is an error. Tables go by release(),
    or when the application ends.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return df.persist()
    path = f"{folder.rstrip('/')}/duoscope-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _written[path] = spark
    return out


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """The rows with their place from 0 in the order of a key without repeats: ranges of the key are ordered task by task."""
    ranges = cut(df.repartitionByRange(key).withColumn("__range", F.spark_partition_id()), "ranges")
    before = ranges.groupBy("__range").agg(F.count("*").alias("n"))  # a row a task
    before = before.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    at = F.row_number().over(Window.partitionBy("__range").orderBy(key)) - 1
    return ranges.withColumn("__at", at).join(before, "__range").withColumn(name, F.col("__before") + F.col("__at")).drop("__range", "__before", "__at")


def release(*tables: DataFrame) -> None:
    """Removes tables of cut() that nothing reads any more."""
    for t in tables:
        path = getattr(t, "_cut_path", None)
        if path is None:
            t.unpersist()
        elif path in _written:
            _remove(_written.pop(path), path)


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended first
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _written.items():
        _remove(spark, path)
