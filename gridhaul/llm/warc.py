"""WARC archives with revisit records, deduplicated by payload digest.

Headers (page id, url, digest, length) are written once and shuffled by digest to find the original of each payload that
occurs more than once; headers of the others join it and become revisit records, which need no payload. Pages whose
digest isn't repeated, as a bitmap of the repeated digests tells, become responses where they are; only pages that may be revisits are
shuffled, by page, to leave the revisits out. Archives are WARC/1.1, a gzip member a record (records of 16 MB and more take several), in
files that end with the record that reaches FILE_BYTES, a folder for every so manieth file of a task, written by Spark's own committer: the line separator of its text writer is the zero byte that ends every member.
They are read back a member at a time, and revisit records are resolved by joining them to the response that they refer to.

Payloads under min_bytes are never revisits. Of equal payloads the largest page_id is the response; repeated
rows with that id are all responses. A null page_id is written without one and loses to any id; null html is
an empty payload; a null url has no target header. An empty table writes no record and reads back none.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridhaul.llm import common

MIN_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPED = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, record_id string, refers_id string, date string"
FILE_BYTES = 64 << 20  # an archive file ends with the record that reaches so many bytes
MEMBER = (1 << 24) - 1  # bytes in a gzip member; the last byte of its length is zero


def digests(pages: DataFrame) -> DataFrame:
    """page_id, url, html with the payload's digest (SHA-1, bare hex) and length in bytes."""

    def hashed(b: pa.RecordBatch) -> pa.RecordBatch:
        body = common.blobs(b.column("html"))
        cols = [b.column("page_id"), b.column("url"), b.column("html"), pa.array([hashlib.sha1(x).hexdigest() for x in body]), pa.array([len(x) for x in body], pa.int64())]
        return pa.RecordBatch.from_arrays(cols, names=["page_id", "url", "html", "digest", "bytes"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(common.per_batch(hashed), "page_id long, url string, html string, digest string, bytes long")


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"


def _hash(digest: str) -> int:
    return int(digest[:14], 16)


def _record(page: int | None, url: str | None, digest: str, size: int, payload: str | None, refers: tuple | None, date: str) -> bytes:
    """A record; a revisit if it refers to (page, url)."""
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: {_record_id(page, url, digest)}", f"WARC-Date: {date}"]
    head += [f"WARC-Target-URI: {' '.join(url.split())}"] if url else []
    head += [f"X-Page-ID: {page}"] if page is not None else []
    head += [f"WARC-Payload-Digest: sha1:{digest}"]
    if refers:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(*refers, digest)}", f"WARC-Refers-To-Date: {date}"]
        head += [f"WARC-Refers-To-Target-URI: {' '.join(refers[1].split())}"] if refers[1] else []
    # an http response message: its head, a blank line, the payload
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    body = (http + (payload or "")).encode()
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def _members(record: bytes) -> bytes:
    return b"".join(gzip.compress(record[at : at + MEMBER], 6, mtime=0) for at in range(0, len(record), MEMBER))


def write_archives(pages: DataFrame, path: str, min_bytes: int = MIN_BYTES, date: str = DATE, file_bytes: int = FILE_BYTES) -> None:
    """Write every page as a response or revisit record, with fresh headers."""
    spark = pages.sparkSession
    head = common.work_table(digests(pages).drop("html"), "warc-headers")
    large = head.filter(F.col("bytes") >= min_bytes)
    original = F.max(F.struct("page_id", "url")).alias("original")
    copies = common.work_table(large.groupBy("digest", "bytes").agg(F.count(F.lit(1)).alias("n"), original).filter("n > 1").drop("n"), "warc-originals")
    again = common.spread_join(large, copies, ["digest", "bytes"], "page_id").filter(~F.col("page_id").eqNullSafe(F.col("original.page_id")))
    again = common.work_table(again.select("page_id", "url", "digest", "bytes", F.col("original.page_id").alias("first_id"), F.col("original.url").alias("first_url")), "warc-revisits")
    hits = spark.sparkContext.broadcast(common.bitmap(copies.select(F.conv(F.substring("digest", 1, 14), 16, 10).cast("long").alias("h")), copies.count()))

    def flagged(b: pa.RecordBatch) -> pa.RecordBatch:
        maybe = [n >= min_bytes and common.in_bitmap(hits.value, _hash(d)) for d, n in zip(b.column("digest").to_pylist(), b.column("bytes").to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe, pa.bool_())], names=[*b.schema.names, "maybe"])

    rows = digests(pages)
    rows = rows.mapInArrow(common.per_batch(flagged), ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", maybe boolean")
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))
    gone = again.select(key.alias("key"), "digest").distinct()
    firsts = rows.filter("maybe").withColumn("key", key).join(gone, ["key", "digest"], "left_anti").drop("key")
    kept = rows.filter("NOT maybe").unionByName(firsts).select("page_id", "url", "digest", "bytes", F.coalesce("html", F.lit("")).alias("html"), F.lit(None).cast("long").alias("first_id"), F.lit(None).cast("string").alias("first_url"), F.lit(False).alias("revisit"))
    kept = kept.unionByName(again.withColumns({"html": F.lit(None).cast("string"), "revisit": F.lit(True)}))

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, written = ("page_id", "url", "digest", "bytes", "html", "first_id", "first_url", "revisit"), 0
        for b in batches:
            out, files = [], []
            for page, url, digest, size, html, first, first_url, revisit in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                out.append(_members(_record(page, url, digest, size, html, (first, first_url) if revisit else None, date))[:-1])
                files.append(written // file_bytes)
                written += len(out[-1]) + 1
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(files, pa.int64())], names=["value", "file"])

    lines = kept.mapInArrow(records, "value binary, file long").select(F.col("value").cast("string").alias("value"), "file")
    lines.write.partitionBy("file").option("lineSep", "\0").option("compression", "none").text(path)
    common.discard(head, copies, again)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, unpacked member by member."""
    at, held = 0, b""
    while at < len(data):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            if at >= len(data):
                raise ValueError("an archive ends inside a member")
            parts.append(member.decompress(data[at : at + (1 << 16)]))
            at = min(at + (1 << 16), len(data)) - len(member.unused_data)
        held += b"".join(parts)
        end = held.find(b"\r\n\r\n")
        if end < 0:
            continue
        version, *lines = held[:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no record before byte {at}")
        head = dict(x.split(": ", 1) for x in lines)
        stop = end + 4 + int(head["Content-Length"])
        if len(held) >= stop + 4:  # a record of 16 MB and more goes on in the next member
            yield head, held[end + 4 : stop]
            held = b""
    if held:
        raise ValueError("an archive ends inside a record")


def read_archives(spark, path: str, with_payload: bool = False) -> DataFrame:
    """One row a record, revisits resolved to the response that they refer to; payload only of responses."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    schema = TYPED + (", payload string" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = {"page_id": pa.int64(), "payload_bytes": pa.int64()}
        return pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = []
                for head, block in parse(content.as_py()):
                    payload = block[block.index(b"\r\n\r\n") + 4 :]
                    revisit = head["WARC-Type"] == "revisit"
                    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if not revisit and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"payload of {head['WARC-Record-ID']} is damaged")
                    page = head.get("X-Page-ID")
                    row = (int(page) if page else None, head.get("WARC-Target-URI"), head["WARC-Type"], digest, None if revisit else len(payload), head["WARC-Record-ID"], head.get("WARC-Refers-To"), head["WARC-Date"])
                    rows.append((*row, payload.decode() if not revisit else None) if with_payload else row)
                    if len(rows) == 500:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    rows = files.mapInArrow(opened, schema)
    found = rows.filter("record_type = 'response'")
    first = found.select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("first_bytes")).dropDuplicates(["refers_id"])
    again = rows.filter("record_type = 'revisit'").drop("payload_bytes").join(first, "refers_id").withColumnRenamed("first_bytes", "payload_bytes")
    return found.withColumn("refers_to", F.lit(None).cast("long")).unionByName(again)


def query(spark, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    path = common.fresh_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS first_id FROM p)
SELECT page_id, payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> first_id THEN first_id END AS refers_to
FROM w
"""
