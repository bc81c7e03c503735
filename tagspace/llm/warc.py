"""WARC archives: a writer of gzip members, one record each, and a splittable reader.

Reader tasks get byte ranges of the files. A task looks for the gzip magic in its range and
takes a place as a member's start only if the bytes from there inflate to a WARC version line.
It owns the records that start inside its range, and reads past the end of the range to finish
the last. So a file of any length is read by many tasks, none of which needs an index.

Equal payloads are written once: the record with the largest page_id is the response, the
others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_path, written

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
#: Bytes of a file that one reader task owns, and of one read.
SPLIT_BYTES, READ_BYTES = 16 << 20, 1 << 20
#: Most reader tasks; beyond it a task reads several ranges.
MOST_TASKS = 20_000
#: Smallest payload that a revisit may replace.
LEAST_PAYLOAD = 0
_URL_SAFE = "".join(map(chr, range(33, 127))).replace("%", "")

RECORD = ("record_type string, record_id string, target_uri string, refers_to_id string, "
          "payload_digest string, payload_bytes long, payload binary, path string, offset long")


def _connect(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w[\w+.-]+:", uri) else f"file://{uri}")


def _id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def member(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None,
           revisit: bool) -> bytes:
    """One record as a gzip member; a revisit has no payload of its own."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = [f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}",
            f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_URL_SAFE)}")
    if revisit:
        head.append(f"WARC-Refers-To: {_id(refers_to)}")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        payload = b""
    block = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(payload)}"]).encode()
    deflate = zlib.compressobj(6, zlib.DEFLATED, 31)
    return deflate.compress(block + b"\r\n\r\n" + payload + b"\r\n\r\n") + deflate.flush()


def plan_records(pages: DataFrame, least: int = LEAST_PAYLOAD) -> DataFrame:
    """(page_id, url, html, refers_to) of every page; refers_to is null for responses.

    Only payloads that occur more than once, by SHA-256 and length, are looked up; their
    counts are summed before the shuffle, whatever their number of copies.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"), html.alias("html"))
    same = F.sha2(F.col("html").cast("binary"), 256)
    keyed = rows.where(F.octet_length("html") >= least)
    repeated = written(keyed.groupBy(same.alias("key"))
                       .agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n"))
                       .where("n > 1").select("key", "response"), "repeated")
    rows = rows.withColumn("key", F.when(F.octet_length("html") >= least, same))
    other = ~F.col("page_id").eqNullSafe(F.col("response"))
    return (rows.join(repeated, "key", "left")
            .select("page_id", "url", "html",
                    F.when(other, F.col("response")).alias("refers_to")))


def write_warc(pages: DataFrame, folder: str, least: int = LEAST_PAYLOAD) -> DataFrame:
    """Write one archive per task under ``folder`` (a URI that all executors can reach) and
    return the written manifest (path, bytes, records). A repeated task writes a file of its
    own name; only files named in the manifest count."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = path = None
        count = size = 0
        for batch in batches:
            if out is None and batch.num_rows:
                store, base = _connect(folder)
                store.create_dir(base, recursive=True)
                path = f"{base}/{uuid.uuid4().hex}.warc.gz"
                out = store.open_output_stream(path, compression=None)
            for i in range(batch.num_rows):
                page_id, url, html, refers_to = (c[i].as_py() for c in batch.columns)
                data = member(page_id, url, html.encode(), refers_to, refers_to is not None)
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]})

    return written(plan_records(pages, least).mapInArrow(
        write, "path string, bytes long, records long"), "manifest")


def _inflate(source: pa.NativeFile, at: int, size: int) -> tuple[bytes, int] | None:
    """The record that starts at ``at`` and the end of its member; None if none starts there."""
    source.seek(at)
    inflate, parts, seen, read = zlib.decompressobj(31), [], 0, 0
    while not inflate.eof:
        data = source.read(min(READ_BYTES, 4096 if not read else READ_BYTES))
        if not data:
            return None
        read += len(data)
        try:
            parts.append(inflate.decompress(data))
        except zlib.error:
            return None
        seen += len(parts[-1])
        if seen >= len(VERSION) and not b"".join(parts[:4])[:len(VERSION)].startswith(VERSION):
            return None
    record = b"".join(parts)
    return (record, at + read - len(inflate.unused_data)) if record.startswith(VERSION) else None


def range_members(source: pa.NativeFile, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of the members that start in [start, end)."""
    size, at = source.size(), start
    while at < end:
        source.seek(at)
        window = source.read(min(READ_BYTES, end - at) + len(MAGIC) - 1)
        hit = window.find(MAGIC)
        if hit < 0:
            at += max(1, len(window) - len(MAGIC) + 1)
            continue
        at += hit
        while at < end:  # members follow one another
            found = _inflate(source, at, size)
            if found is None:
                at += 1
                break
            yield at, found[0]
            at = found[1]
            source.seek(at)
            if source.read(len(MAGIC)) != MAGIC:
                break


def parsed(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode().split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    return fields, rest[:int(fields.get("content-length", 0))]


def read_warc(spark: SparkSession, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """All records (columns of ``RECORD``) of the archives listed as (path, bytes)."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))
    ranges = (files.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
              .select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end")))
    # a range is a few bytes to Spark and much work: one task each, up to a bound
    ranges = ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        for batch in batches:
            for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, name = _connect(path)
                rows, held = [], 0
                with store.open_input_file(name) as source:
                    for offset, record in range_members(source, start, end):
                        fields, payload = parsed(record)
                        uri = fields.get("warc-target-uri")
                        rows.append((fields.get("warc-type"), fields.get("warc-record-id"),
                                     None if uri is None else unquote(uri), fields.get("warc-refers-to"),
                                     fields.get("warc-payload-digest", "").rpartition(":")[2],
                                     int(fields.get("x-payload-length", len(payload))), payload, path,
                                     offset))
                        held += len(payload)
                        if held > READ_BYTES * 8:
                            yield _batch(rows, names)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, names)

    return ranges.mapInArrow(read, RECORD)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [pa.string()] * 5 + [pa.int64(), pa.binary(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def warc_round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Per page, from the archives read back: page_id, payload_bytes, payload_digest,
    record_type, refers_to, target_uri.

    The digest of a response is that of the payload as read; a revisit carries its own in the
    header. Defined cases: a null html is an empty payload; a null url gives no target URI; a
    null page_id never wins over an id, and comes back as null; rows that repeat the winner's
    page_id are responses too; no pages give no files and no rows; other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or shared_path(spark, "warc")
    records = read_warc(spark, write_warc(pages, folder))
    number = r"^<urn:page:(-?\d+)>$"

    def page(column: str):
        return F.expr(f"try_cast(regexp_extract({column}, '{number}', 1) AS bigint)".replace("\\", "\\\\"))

    full = F.col("record_type") == "response"
    return records.select(
        page("record_id").alias("page_id"),
        F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", page("refers_to_id").alias("refers_to"), "target_uri")
