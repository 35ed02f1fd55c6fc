"""WARC archives: a writer with revisit records, and a splittable reader that proves record boundaries by their chain."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote_plus

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duoscope.llm.common import cut, release, remove_at_end, shared_dir

VERSION = "WARC/1.1\r\n"
#: Fixed value: the profile URI of a revisit record for an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = VERSION.encode()
_END = "\r\n\r\n"


# -- writing ----------------------------------------------------------------------------------------------------------


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 1000) -> DataFrame:
    """(page_id, url, payload, digest, bytes, record_type, refers_to, alike, one_target), a row per input row.

    Of the rows with equal payloads of min_revisit_bytes or more, one with the largest id is a response and the others
    revisit it; rows with smaller payloads are responses. A null html is an empty payload. Rows of one id and one
    payload are alike: if that id is the largest, all of them are responses. A null id is below any other; rows whose
    group has none but null ids are responses. Groups are keyed by digest and length with map-side maxima, so that a
    group of a third of all rows is a row per task; payloads aren't shuffled for it, nor is any of them held twice. alike
    tells that other rows have the same id and payload, one_target that just one row is what a revisit refers to.
    """
    payload = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))).withColumn("bytes", F.octet_length("payload").cast("long"))
    # ids and digests alone, of which all groups are made
    slim = cut(rows.groupBy("digest", "page_id").agg(F.count("*").alias("n"), F.max("bytes").alias("bytes")), "digests")
    last = slim.groupBy("digest").agg(F.max("page_id").alias("last"), F.max_by("n", "page_id").alias("last_n"), F.sum("n").alias("n"), F.max("bytes").alias("b"), F.max("n").alias("most"))
    last = cut(last.where("n > 1").select("digest", F.when(F.col("b") >= min_revisit_bytes, F.col("last")).alias("last"), (F.col("last_n") == 1).alias("one_target"), (F.col("most") > 1).alias("some_alike")), "digests")
    twice = cut(slim.where("n > 1").select("digest", F.col("page_id").alias("twin"), F.lit(True).alias("alike")), "digests")
    # of known sizes, the tables of repeated digests are broadcast where they are small, and no payload is shuffled
    rows = rows.join(last, "digest", "left").join(twice.withColumnRenamed("digest", "d"), (F.col("digest") == F.col("d")) & F.col("some_alike") & F.col("page_id").eqNullSafe(F.col("twin")), "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    kind = F.when(again, "revisit").otherwise("response").alias("record_type")
    return rows.select("page_id", "url", "payload", "digest", "bytes", kind, F.when(again, F.col("last")).alias("refers_to"), F.coalesce("alike", F.lit(False)).alias("alike"), F.coalesce("one_target", F.lit(False)).alias("one_target"))


def record_text(row: DataFrame) -> Column:
    """A record without its two final line breaks, from the columns of plan_records().

    A record's id comes from its page's id and payload, so equal pages give equal archives; rows that are alike in both
    get random ids instead, as every id must be unique, and a revisit of such rows names the page but no record.
    """

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), F.regexp_replace(value, r"[\r\n]+", " "), F.lit("\r\n")), F.lit(""))

    def record_id(page: Column) -> Column:
        h = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), F.col("digest")))
        return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in (F.substring(h, a, n), F.lit("-" if a < 21 else ">"))])

    own = F.when(F.col("alike"), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).otherwise(record_id(F.col("page_id")))
    target = F.when(F.col("one_target"), record_id(F.col("refers_to")))

    revisit = F.col("record_type") == "revisit"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(_END))
    block_bytes = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    # the driver's clock isn't asked: equal pages give equal archives
    head = F.concat(
        F.lit(VERSION), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", own),
        F.lit("WARC-Date: 2024-01-01T00:00:00Z\r\n"), line("WARC-Target-URI", F.col("url")), line("X-Page-ID", F.url_encode(F.col("page_id").cast("string"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", target), line("X-Refers-To-Page", F.url_encode(F.col("refers_to").cast("string"))), F.lit(f"WARC-Profile: {PROFILE}\r\n"))).otherwise(""),
        F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", block_bytes.cast("string")), F.lit("\r\n"),
    )
    return F.concat(head, http, F.when(revisit, "").otherwise(F.col("payload")))


def write_warc(records: DataFrame, path: str) -> None:
    """A WARC file per task under path, through Spark's own writer: record, two line breaks, record, ..."""
    records.select(record_text(records).alias("value")).write.option("lineSep", _END).text(path)


# -- reading ----------------------------------------------------------------------------------------------------------

_HEADER = re.compile(rb"([^\r\n:]+):[ \t]*([^\r\n]*)")


def _parse(raw: bytes) -> tuple[dict[bytes, bytes], int, int]:
    """Headers (lower-cased names) of what follows the version line, where the block begins, and its declared length (-1: none)."""
    at = raw.find(b"\r\n\r\n")
    if at < 0:
        return {}, 0, -1
    heads = {k.strip().lower(): v.strip() for k, v in _HEADER.findall(raw[:at])}
    n = heads.get(b"content-length", b"")
    return heads, at + 4, int(n) if n.isdigit() else -1


def _fields(raw: bytes) -> tuple:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, ok of a whole record without its version line."""
    heads, at, n = _parse(raw)
    block = raw[at : at + n]
    cut_at = block.find(b"\r\n\r\n")
    http = dict((k.lower(), v) for k, v in _HEADER.findall(block[:cut_at]))
    payload = block[cut_at + 4 :]
    said = heads.get(b"warc-payload-digest", b"").decode().removeprefix("sha1:")
    revisit = heads.get(b"warc-type") == b"revisit"
    digest = said if revisit else hashlib.sha1(payload).hexdigest()
    page, other = heads.get(b"x-page-id"), heads.get(b"x-refers-to-page")
    size = int(http.get(b"content-length", b"0")) if revisit else len(payload)
    return _named(page), size, digest, heads.get(b"warc-type", b"").decode(), _named(other), digest == said


def _named(page: bytes | None) -> str | None:
    """The id in a header, where it stands percent-encoded: its spaces and breaks are its own, and the empty id isn't none."""
    return None if page is None else unquote_plus(page.decode())


def _chunks(spark: SparkSession, path: str, work: Callable[[int, bytes], tuple], schema: str) -> DataFrame:
    """(file, block, at, size, *work's columns) for each run of bytes after a version line, wherever it stands.

    The text source splits files at any byte and hands out the runs between separators in order. at is the offset of the
    run's separator within its split: a running sum per split, which a task keeps as it goes.
    """
    lines = spark.read.option("lineSep", VERSION).text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("raw"))
    extra = [x.split()[0] for x in schema.split(", ")]

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, at = None, 0
        for batch in batches:
            out = []
            for file, block, raw in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if (file, block) != split:
                    split, at = (file, block), 0
                out.append((file, block, at, len(raw), *work(at, raw)))
                at += len(raw) + len(_MAGIC)
            yield pa.RecordBatch.from_pandas(pd.DataFrame(out, columns=["file", "block", "at", "size", *extra], dtype=object), schema=arrow, preserve_index=False)

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}
    arrow = pa.schema([("file", pa.string()), ("block", pa.int64()), ("at", pa.int64()), ("size", pa.int64()), *((n, kinds[x.split()[1]]) for n, x in zip(extra, schema.split(", "), strict=True))])
    return lines.mapInArrow(go, f"file string, block long, at long, size long, {schema}")


_FIELDS = "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, ok boolean"


def read_warc(spark: SparkSession, path: str, region: int = 8 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, ok) of every record under path.

    1. Every place with a version line is a candidate; its header gives a successor: where the next record must begin.
       Lines of that kind inside payloads are candidates too, and may even carry whole embedded records.
    2. Candidates are grouped by regions of a file; each region links every candidate to the first candidate that its
       chain reaches beyond the region. Then pointers from the start of each file double: after n rounds the chain has
       passed 2**n regions. What the chain never visits is no record.
    3. A run of bytes behind a rejected candidate belongs to the record visited before it; such records are put together
       again from their runs, which alone are read a second time.

    A chain that breaks (a truncated file) ends there with the last whole record. ok tells whether the payload has the
    digest that its header declares (a revisit has no payload to check). Records of the text source are whole in a task:
    a payload must fit into memory, a file needn't.
    """

    def first(at: int, raw: bytes) -> tuple:
        heads, start, n = _parse(raw)
        if n < 0:
            return -1, False, *([None] * 6)
        whole = len(raw) == start + n + len(_END)
        return start + n + len(_END) + len(_MAGIC), whole, *(_fields(raw) if whole else [None] * 6)

    scan = cut(_chunks(spark, path, first, f"reach long, whole boolean, {_FIELDS}"), "warc")
    starts = scan.groupBy("file", "block").agg((F.max(F.col("at") + F.col("size")) + len(_MAGIC)).alias("sum"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("file", "block", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    # a file begins with a version line, so its first run is empty and every other run begins at a candidate
    placed = scan.join(starts, ["file", "block"]).withColumn("off", F.col("base") + F.col("at") - len(_MAGIC))
    placed = placed.where("off >= 0")
    links = placed.select("file", "off", F.when(F.col("reach") > 0, F.col("off") + F.col("reach")).alias("next"), F.floor(F.col("off") / region).alias("region"))
    links = cut(links, "warc")

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off", ascending=False, ignore_index=True)
        out: dict[int, int | None] = {}
        for off, nxt in zip(pdf["off"], pdf["next"], strict=True):
            nxt = None if pd.isna(nxt) else int(nxt)
            out[off] = out.get(nxt, nxt) if nxt in out else nxt
        pdf["exit"] = pd.array([out[o] for o in pdf["off"]], dtype="Int64")
        return pdf[["file", "off", "exit"]]

    jump = cut(links.groupBy("file", "region").applyInPandas(leave, "file string, off long, exit long"), "warc")
    jump = jump.where("exit is not null").join(links.select("file", F.col("off").alias("exit")), ["file", "exit"], "left_semi")
    jump = cut(jump.select("file", "off", "exit"), "warc")
    entries = cut(links.groupBy("file").agg(F.min("off").alias("off")).where("off = 0"), "warc")
    while True:
        further = entries.join(jump, ["file", "off"]).select("file", F.col("exit").alias("off"))
        more = cut(entries.union(further).distinct(), "warc")
        if more.count() == entries.count():
            break
        entries = more
        hop = jump.select("file", F.col("off").alias("exit"), F.col("exit").alias("__far"))
        jump = cut(jump.join(hop, ["file", "exit"]).select("file", "off", F.col("__far").alias("exit")), "warc")

    def visit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off", ignore_index=True)
        at = dict(zip(pdf["off"], pdf["next"], strict=True))
        seen = set()
        for off in pdf.loc[pdf["entry"], "off"]:
            while off in at and off not in seen:
                seen.add(off)
                off = at[off]
                if pd.isna(off):
                    break
                off = int(off)
        pdf["record"] = [o in seen for o in pdf["off"]]
        return pdf[["file", "off", "next", "region", "record"]]

    marked = links.join(entries.withColumn("entry", F.lit(True)), ["file", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    marked = cut(marked.groupBy("file", "region").applyInPandas(visit, "file string, off long, next long, region long, record boolean"), "warc")
    kept = marked.where("record").select("file", "off")
    rows = placed.join(kept, ["file", "off"])
    whole = rows.where("whole").select(*[x.split()[0] for x in _FIELDS.split(", ")])

    broken = cut(rows.where("not whole and reach > 0").select("file", "off", (F.col("off") + F.col("reach")).alias("end")), "warc")
    if broken.isEmpty():
        return whole
    # the runs of a broken record lie between its start and its end; both sides meet by the regions that they touch
    touched = broken.select("file", F.col("off").alias("owner"), "end", F.explode(F.sequence(F.floor(F.col("off") / region), F.floor((F.col("end") - 1) / region))).alias("region"))
    owned = marked.select("file", "off", "region").join(touched, ["file", "region"]).where("off >= owner and off < end").select("file", "off", "owner", "end")
    again = _chunks(spark, path, lambda at, raw: (raw,), "raw binary").join(starts, ["file", "block"]).withColumn("off", F.col("base") + F.col("at") - len(_MAGIC))
    parts = again.join(owned, ["file", "off"]).select("file", "owner", "end", "off", "raw")

    def mend(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("off")
        raw = _MAGIC.join(pdf["raw"])
        if len(raw) + len(_MAGIC) < pdf["end"].iloc[0] - pdf["owner"].iloc[0]:
            return pd.DataFrame(columns=[x.split()[0] for x in _FIELDS.split(", ")])  # truncated
        return pd.DataFrame([_fields(raw)], columns=[x.split()[0] for x in _FIELDS.split(", ")])

    return whole.union(parts.groupBy("file", "owner").applyInPandas(mend, _FIELDS))


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_revisit_bytes: int = 1000, path: str | None = None) -> DataFrame:
    """Writes the pages as WARC archives into the shared folder (or path), reads them back and returns what was read.

    page_id, payload_bytes, payload_digest (lower-case hex SHA-1), record_type, refers_to, a row per page. See
    plan_records() for nulls, ties and repeated rows; an empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    path = path or remove_at_end(spark, f"{shared_dir(spark)}/duoscope-warc-{uuid.uuid4().hex}")
    write_warc(plan_records(pages, id_col, url_col, html_col, min_revisit_bytes), path)
    kind = dict(pages.dtypes)[id_col]
    found = read_warc(spark, path)
    return found.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


#: What the archives must give back, from the pages themselves.
WARC_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as digest from pages),
g as (select *, octet_length(payload) as n, max(page_id) over (partition by digest) as last from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest, case when n >= 1000 and page_id is distinct from last then 'revisit' else 'response' end as record_type,
       case when n >= 1000 and page_id is distinct from last then last end as refers_to
from g
"""
