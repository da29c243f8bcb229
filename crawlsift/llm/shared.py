"""Helpers of the training-data operators: shared folder, written tables, label split, small Arrow batches."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task turns into Python objects at a time, and that travel to Python together.
ROWS, BATCH_ROWS = 256, 1024


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Where that is unset, one of this machine, which serves local sessions only, as in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors see")
    return f"{base.rstrip('/') if base else tempfile.mkdtemp(prefix='llm-')}/{uuid.uuid4().hex}"


def text_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batches to BATCH_ROWS rows where they are larger: rows hold whole texts, and an executor's buffers outside
    its heap grow with the batch."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def written(df: DataFrame) -> DataFrame:
    """The table as Parquet in the shared folder, read again: cuts the lineage and survives lost executors."""
    folder = shared_folder(df.sparkSession)
    text_batches(df.sparkSession)
    df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def remainder_is(doc_id: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def bounded_sample(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """About `rows` rows at most, chosen by a hash of the key, so alike in every run; all where there are fewer."""
    n = df.count()
    return df if n <= rows else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * rows / n))


def small_batches(batches: Iterable[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
    released()


def released() -> None:
    """Gives memory that a task no longer uses back: workers are kept for later tasks, also of other stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library is another one
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def cuts(body, size: int, between) -> Iterator[tuple[int, int]]:
    """Where a long text (as bytes) may be cut: pieces of `size` bytes or a little more, each ending with a match of the pattern."""
    start = 0
    while start < len(body):
        found = between.search(body, min(len(body), start + size))
        stop = found.end() if found else len(body)
        yield start, stop
        start = stop


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer on this machine; it is the same on every worker."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def utf8(text: Column) -> Column:
    return F.coalesce(text.cast("binary"), F.lit(b""))
