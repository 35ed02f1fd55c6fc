"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Words are maximal runs of anything but space, tab, LF, VT, FF and CR.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. On one machine (tests) a new temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="duoscope-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "step", small: bool = False) -> DataFrame:
    """The same rows from a table in the shared folder: the lineage ends there, and a lost executor costs no recomputation.

    Parquet keeps the sizes known for the choice of joins, and columns that a later step doesn't read stay on disk. The
    tables go by release(), or else when the application ends. small: a table of a few numbers a row, written by four
    tasks for each core of the cluster at most, as the number of files would cost more than their contents.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(4 * spark.sparkContext.defaultParallelism)
    path = f"{shared_dir(spark)}/duoscope-{name}-{uuid.uuid4().hex}"
    with _arrow_rows(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    _written[path] = spark
    return out


@contextlib.contextmanager
def _arrow_rows(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Smaller Arrow batches while a table is written, as workers hold several forms of a batch at once; then as before."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(was)) if int(was) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, was)


def release(*tables: DataFrame | str | None) -> None:
    """Removes tables of cut(), or folders by path, that nothing reads any more: what stood on them has been written."""
    for t in tables:
        path = t if isinstance(t, str) else getattr(t, "_cut_path", None)
        if path in _written:
            _remove(_written.pop(path), path)


def remove_at_end(spark: SparkSession, path: str) -> str:
    """The path; the folder goes by release(), or when the application ends."""
    _written[path] = spark
    return path


_written: dict[str, SparkSession] = {}


def _remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the application may have ended first
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _remove_all() -> None:
    for path, spark in _written.items():
        _remove(spark, path)


def quoted(name: str) -> str:
    """The name of a column as it may stand in an expression, whatever its characters."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, under their names, which may hold dots and back-ticks."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in df.columns))


def text_key(*cols: Column) -> list[Column]:
    """96 bits that stand for the values of the columns; null differs from the empty string."""
    marked = [x for c in cols for x in (c.isNull(), c)]
    return [F.xxhash64(*marked).alias("__k1"), F.hash(*marked).alias("__k2")]


def map_texts(docs: DataFrame, keep: list[Column], text_col: str, schema: str, make: Callable[[], Callable[[str | None], tuple]]) -> DataFrame:
    """The kept columns, and what make()(text) returns for each row's text, as columns of the schema ("a long, b string").

    The other columns stay in the JVM; only the text goes to Python, in Arrow batches that Spark bounds by their bytes. make() is called
    once for each task.
    """
    fields = StructType.fromDDL(schema)

    @F.pandas_udf(fields)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        f = make()
        for s in texts:
            yield pd.DataFrame([f(t) for t in s], columns=fields.names, dtype=object)

    rows = docs.select(*keep, of(F.col(text_col)).alias("__m"))
    return rows.select(*rows.columns[:-1], "__m.*")
