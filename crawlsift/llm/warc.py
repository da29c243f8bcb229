"""WARC archives as a chunked record table: (record, chunk) rows whose bytes, one after another, are WARC/1.1 records.

A payload is cut into chunks of at most `chunk_bytes`; each chunk row carries the digest of the payload so far, so a reader checks a
record while it streams through and never holds more than a chunk. Records of equal payloads of at least `revisit_bytes` are written
once (that with the smallest page id) and else as revisits, which hold headers only. A response is named by its page id and digest, and
revisits refer to it by that name.

Cases: null html is an empty payload; rows that share the smallest page id of a payload are all responses; null page ids are never the
first unless all are null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import itertools
import string
from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import small_batches, utf8, written

CHUNK_SCHEMA = "record string, chunk int, chunks int, data binary, digest_so_far string"


def revisits(pages: DataFrame, revisit_bytes: int = 100) -> DataFrame:
    """page rows with payload, digest and refers_to (null for responses)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), utf8(F.col("html")).alias("payload"), F.coalesce("url", F.lit("")).alias("url"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads = rows.where(F.length("payload") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("head"), F.count("*").alias("n")).where("n > 1").select("digest", "head")
    rows = rows.join(heads, "digest", "left")
    return rows.withColumn("refers_to", F.expr("CASE WHEN page_id IS DISTINCT FROM head THEN head END")).drop("head")


def write_archive(pages: DataFrame, revisit_bytes: int = 100, chunk_bytes: int = 1 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes the record table into the shared folder and returns it as read from there. `date` is the capture time that all records state."""

    def chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count_of = TaskContext.get().partitionId(), itertools.count()
        for batch in small_batches(batches, 64):
            out: list[list] = [[], [], [], [], []]
            ids, urls, digests, refers, lengths = (batch[c].to_pylist() for c in ("page_id", "url", "digest", "refers_to", "length"))
            payloads = batch["payload"]
            for i, (page, url, digest, ref, length) in enumerate(zip(ids, urls, digests, refers, lengths)):
                record = f"{'' if page is None else page}#{task}.{next(count_of)}"  # unique also where rows repeat an id
                name = f"<urn:page:{'' if page is None else page}:{digest}>" if ref is None else f"<urn:page:{record}>"
                size = 0 if ref is not None else length
                head = [
                    "WARC/1.1", f"WARC-Type: {'response' if ref is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}",
                    "WARC-Target-URI: " + quote(url, safe=string.punctuation), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}",
                    *([f"WARC-Refers-To: <urn:page:{ref}:{digest}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if ref is not None else []),
                    "Content-Type: text/html", f"Content-Length: {size}",
                ]
                body = memoryview(payloads[i].as_buffer()) if size else memoryview(b"")
                count, sha = max(1, -(-size // chunk_bytes)), hashlib.sha256()
                for c in range(count):
                    part = body[c * chunk_bytes : (c + 1) * chunk_bytes]
                    sha.update(part)
                    lead = ("\r\n".join(head) + "\r\n\r\n").encode() if c == 0 else b""
                    for column, value in zip(out, (record, c, count, b"".join([lead, part, b"\r\n\r\n" if c == count - 1 else b""]), sha.hexdigest())):
                        column.append(value)
                    if sum(map(len, out[3][-8:])) > 4 * chunk_bytes:
                        yield _chunk_batch(out)
                        out = [[], [], [], [], []]
            if out[0]:
                yield _chunk_batch(out)

    rows = revisits(pages, revisit_bytes)
    empty = F.lit(b"")
    rows = rows.select("page_id", "url", "digest", "refers_to", F.length("payload").alias("length"), F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(empty).alias("payload"))
    return written(rows.mapInArrow(chunks, CHUNK_SCHEMA))


def _chunk_batch(columns: list[list]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[c.split()[0] for c in CHUNK_SCHEMA.split(", ")])


def _header(text: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)\r?$", 1), F.lit(""))


def read_archive(chunks: DataFrame) -> DataFrame:
    """One row per record, from the archive's bytes alone: page_id, payload_bytes, payload_digest, record_type, refers_to, intact.

    Records of one chunk are read where they lie. The chunks of longer records meet in order in one task, one chunk at a time.
    """
    short = chunks.where("chunks = 1")
    at = F.expr("position(X'0D0A0D0A' IN data)")
    short = short.withColumn("at", at).select(
        F.decode(F.expr("substring(data, 1, at)"), "UTF-8").alias("head"), F.expr("substring(data, at + 4, length(data) - at - 7)").alias("body"))
    short = short.select("head", F.sha2("body", 256).alias("sha"), F.length("body").cast("long").alias("n"))

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha, head, n, whole = hashlib.sha256(), "", 0, True
        for batch in small_batches(batches, 1):
            row = batch.to_pylist()[0]
            data, last = row["data"], row["chunk"] == row["chunks"] - 1
            if row["chunk"] == 0:
                cut = data.index(b"\r\n\r\n")
                sha, head, n, whole, data = hashlib.sha256(), data[:cut].decode(), 0, True, memoryview(data)[cut + 4 :]
            data = memoryview(data)[:-4] if last else data
            sha.update(data)
            n += len(data)
            whole &= sha.hexdigest() == row["digest_so_far"]
            if last:
                yield pa.RecordBatch.from_arrays([pa.array([head]), pa.array([sha.hexdigest() if whole else ""]), pa.array([n], pa.int64())], names=["head", "sha", "n"])

    long = chunks.where("chunks > 1").repartition("record").sortWithinPartitions("record", "chunk").mapInArrow(stream, "head string, sha string, n long")
    of = lambda name: _header(F.col("head"), name)
    page = lambda name: F.nullif(F.regexp_extract(of(name), r"<urn:page:(-?\d*)(?:[:#][\da-f.]+)?>", 1), F.lit("")).cast("long")
    rows = short.union(long).select(
        page("WARC-Record-ID").alias("page_id"), of("X-Payload-Length").cast("long").alias("stated"), F.regexp_replace(of("WARC-Payload-Digest"), "^sha256:", "").alias("stated_digest"),
        of("WARC-Type").alias("record_type"), page("WARC-Refers-To").alias("refers_to"), "sha", "n")
    response = F.col("record_type") == "response"
    return rows.select(
        "page_id", F.when(response, F.col("n")).otherwise(F.col("stated")).alias("payload_bytes"),
        F.when(response, F.col("sha")).otherwise(F.col("stated_digest")).alias("payload_digest"), "record_type", "refers_to",
        F.when(response, (F.col("sha") == F.col("stated_digest")) & (F.col("n") == F.col("stated"))).otherwise(F.lit(True)).alias("intact"))
