"""WARC archives with revisit resolution.

Archives are cut by bytes: tasks lay gzip members, one a record, end to end until ARCHIVE_BYTES are reached, and such an
archive is one row of Spark's text writer, which commits whole files, so lost tasks are written anew.  The writer's
line end is an empty gzip member, so each file ends with one.  Every record can be read alone.  ``read_records`` reads
archives as binary files and follows Content-Length, so payloads may hold anything.

``resolve`` works on headers alone: grouped by payload digest with partial aggregation, then joined back with a
salt, as one payload may be behind a third of all records.  ``write_deduplicated`` brings each archive the targets of
its revisits (one stored row an archive; by its size Spark broadcasts that table, or sorts it and the compressed
archives) and writes it again with fresh headers, revisits without their payload.  A record's new id is a function of
its old one, so a revisit names its response by the id that it has in the new archives.

Defined cases: null payload is empty.  Null urls have no target header.  Null page ids come after all others in
choosing a response; refers_to is then null.  Of rows that repeat a page id and payload one is the response.  A
revisit whose original is not in the archives stays a revisit and refers to nothing.  An empty table gives empty
archives and an empty result.  Columns other than the three named ones do not matter.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.scratch import scratch_dir, stored

#: An archive is closed once it has this many bytes; a longer record has one of its own.
ARCHIVE_BYTES = 16 << 20
SALTS = 16
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
END = b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
FIELDS = "path string, nth int, record_id string, page_id bigint, url string, date string, type string, digest string, bytes bigint, refers_to bigint"


def _member(data: bytes) -> bytes:
    """A gzip member without a time, as the format advises to compress each record on its own."""
    made = zlib.compressobj(1, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def _record(fields: dict, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return _member(f"WARC/1.1\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode("utf-8", "surrogateescape") + block + END)


def _archives(records: Iterable[bytes], most: int) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for record in records:
        held.append(record)
        size += len(record)
        if size >= most:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])


def _write(archives: DataFrame, path: str) -> None:
    """A file for each row; the text writer passes the bytes of a string on as they are."""
    options = {"encoding": "ISO-8859-1", "lineSep": _member(b"").decode("iso-8859-1"), "maxRecordsPerFile": "1", "compression": "none"}
    archives.select(F.col("archive").cast("string")).write.options(**options).text(path)


def write_archives(pages: DataFrame, path: str, id: str = "page_id", url: str = "url", payload: str = "html") -> None:
    """A response record for each row."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for page, target, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = body.as_buffer().to_pybytes() if body.is_valid else b""
                fields = {
                    "WARC-Type": "response", "WARC-Date": DATE, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>",
                    "WARC-Target-URI": target and target.replace("\r", "%0D").replace("\n", "%0A"), "Page-ID": page,
                    "Content-Type": "application/http; msgtype=response",
                }
                yield _record(fields, HTTP.format(len(data)).encode() + data)

    src = pages.select(F.col(id).cast("long").alias("id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("string").cast("binary").alias("body"))
    most = ARCHIVE_BYTES
    _write(src.mapInArrow(lambda batches: _archives(records(batches), most), "archive binary"), path)


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of a gzip archive."""
    with gzip.GzipFile(fileobj=io.BytesIO(content)) as raw, io.BufferedReader(raw, 1 << 20) as file:
        while first := file.readline():
            if not first.strip():
                continue
            if not first.startswith(b"WARC/"):
                raise ValueError(f"no record begins with {first[:40]!r}")
            head = {}
            while line := file.readline().rstrip(b"\r\n"):
                key, _, value = line.decode("utf-8", "surrogateescape").partition(":")
                head[key.lower()] = value.strip()
            yield head, file.read(int(head["content-length"]))


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _seen(head: dict[str, str], block: bytes) -> tuple:
    """record id, page id, url, date, type, digest, payload bytes, page referred to."""
    number = lambda k: int(head[k]) if k in head else None
    own = (head.get("warc-record-id"), number("page-id"), head.get("warc-target-uri"), head.get("warc-date"), head["warc-type"])
    if head["warc-type"] == "revisit":
        return (*own, head.get("warc-payload-digest", "").removeprefix("sha1:") or None, number("payload-length"), number("refers-to-page"))
    payload = block.partition(END)[2]
    return (*own, _digest(payload), len(payload), None)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """FIELDS of every record: where it stands, its headers, and digest and size of its payload as read."""
    schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[t]) for n, t in (f.split() for f in FIELDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(place, k, *_seen(head, block)) for k, (head, block) in enumerate(parsed(content.as_buffer()))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return _files(spark, path).mapInArrow(run, FIELDS)


def resolve(headers: DataFrame, min_payload: int = 0) -> DataFrame:
    """``headers`` with the decision of each record: type, digest, bytes, refers_to and target (the response's id, url, date).

    Of responses with equal payloads of at least ``min_payload`` bytes the one with the largest page id stays, and
    the others, and revisits with that digest, refer to it; smaller ones stay as they are.
    """
    counted = headers.where((F.col("bytes") >= min_payload) | (F.col("type") == "revisit"))
    original = F.when(F.col("type") == "response", F.struct("page_id", "record_id", "bytes", "url", "date"))
    groups = counted.groupBy("digest").agg(F.max(original).alias("best"), F.count("*").alias("n")).where("n > 1 and best is not null")
    groups = groups.select("digest", "best", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = headers.withColumn("salt", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int"))
    met = salted.join(groups, ["digest", "salt"], "left")
    again = F.col("best").isNotNull() & ((F.col("bytes") >= min_payload) | (F.col("type") == "revisit")) & (F.col("record_id") != F.col("best.record_id"))
    return met.select(
        "path", "nth", "record_id", "page_id", "digest",
        F.when(again, "revisit").otherwise(F.col("type")).alias("type"),
        F.coalesce("bytes", F.when(again, F.col("best.bytes"))).alias("bytes"),
        F.when(again, F.struct("best.record_id", "best.url", "best.date")).alias("target"),
        F.when(again, F.col("best.page_id")).otherwise(F.col("refers_to")).alias("refers_to"),
    )


def renewed(record_id: str) -> str:
    """The id in the new archives of a record of the old ones."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, record_id)}>"


def write_deduplicated(spark: SparkSession, path: str, decisions: DataFrame, to: str) -> None:
    """The archives at ``path`` again, with fresh headers and revisits in place of repeated payloads."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content, plan in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                targets = {d["nth"]: (d["target"], d["refers_to"]) for d in plan or ()}
                for nth, (head, block) in enumerate(parsed(content.as_buffer())):
                    http, gap, payload = block.partition(END)
                    _, page, url, date, kind, digest, size, refers = _seen(head, block)
                    target, refers = targets.get(nth, (None, refers))
                    again = kind == "revisit" or target is not None
                    fields = {
                        "WARC-Type": "revisit" if again else kind, "WARC-Date": date or DATE, "WARC-Record-ID": renewed(head.get("warc-record-id", "")),
                        "WARC-Target-URI": url, "WARC-Payload-Digest": digest and f"sha1:{digest}", "WARC-Profile": PROFILE if again else None,
                        "WARC-Refers-To": target and renewed(target["record_id"]), "WARC-Refers-To-Target-URI": target and target["url"], "WARC-Refers-To-Date": target and target["date"],
                        "Page-ID": page, "Payload-Length": size, "Refers-To-Page": refers, "Content-Type": "application/http; msgtype=response",
                    }
                    yield _record(fields, http + gap + (b"" if again else payload))

    own = decisions.where("target is not null").groupBy("path").agg(F.collect_list(F.struct("nth", "target", "refers_to")).alias("plan"))
    met = _files(spark, path).join(stored(own), "path", "left").select("content", "plan")
    most = ARCHIVE_BYTES
    _write(met.mapInArrow(lambda batches: _archives(records(batches), most), "archive binary"), to)


def deduplicated(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", min_payload: int = 0) -> tuple[DataFrame, str]:
    """Write archives of ``pages``, resolve and write them again; (records as read from the new archives, their path)."""
    spark = pages.sparkSession
    first, second = scratch_dir(spark), scratch_dir(spark)
    write_archives(pages, first, id, url, payload)
    headers = stored(read_records(spark, first))
    write_deduplicated(spark, first, resolve(headers, min_payload), second)
    return read_records(spark, second), second


def op3_warc_revisit(spark, sf_dir: str) -> DataFrame:
    """A record for each page as read back from the deduplicated archives; null html is an empty payload."""
    records, _ = deduplicated(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return records.select("page_id", F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, h, octet_length(encode(h)) AS n, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, n AS payload_bytes,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        1 + ((('0x' || substr(x, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM d
"""
