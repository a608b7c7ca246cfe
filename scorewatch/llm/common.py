"""Shared helpers: durable intermediate tables and text in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.session import scratch_path

# While a table is written: shuffle files go when it is done, and Python gets smaller batches, by rows and by bytes
# (a batch is held as buffers of Spark, as a message and as a table in Python, and rows with packed entries are large).
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}
CHUNK_BYTES = 2 * 1024 * 1024
CHUNK_ROWS = 1024
# For work that makes some ten values of eight bytes of every byte.
SMALL_BYTES, SMALL_ROWS = 256 * 1024, 128
FILTER_BITS = 1 << 26


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Shuffle files go as soon as a job has ended, and Python gets smaller batches."""
    before = {key: spark.conf.get(key) for key in _WRITING}
    try:
        for key, value in _WRITING.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def store(df: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` to ``path`` and read it back.

    The lineage ends here, so a lost executor costs a read. Shuffle files of this
    write are released as soon as it has ended.
    """
    spark = df.sparkSession
    with writing(spark):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``store`` into a new folder under ``spark.checkpoint.dir``."""
    return store(df, scratch_path(df.sparkSession, name), codec)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def bit_filter(rows: DataFrame, value: Column) -> tuple[np.ndarray, Column]:
    """Bits of the slots that ``value`` takes in ``rows``, and the slot of a row as a column.

    There are ``FILTER_BITS``, whatever the input, so what comes to the driver is bounded. A row whose bit is not set has no equal
    in ``rows``; with very many values nearly all bits are set and little is spared.
    """
    slot = F.xxhash64(value).bitwiseAND(F.lit(FILTER_BITS - 1))
    places = rows.select((slot + 1).alias("x"))  # places and buckets count from one
    found = places.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in found.collect():
        out[(bucket - 1) * 4096:bucket * 4096] = np.frombuffer(bits, np.uint8)
    return out, slot


def bits_at(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which slots are set."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = CHUNK_BYTES, rows: int = CHUNK_ROWS) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about ``limit`` bytes of text and at most ``rows`` rows each; a longer text comes alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and (held + size > limit or i - start >= rows):
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size
        if len(sizes) > start:
            yield batch.slice(start, len(sizes) - start)


def small_chunks(batches: Iterator[pa.RecordBatch], rows: int = SMALL_ROWS) -> Iterator[pa.RecordBatch]:
    """``chunks`` of so little text that arrays made of it take a few megabytes each.

    The C library gives such blocks back to the system again and again, which takes more time than the work; once it was given
    back a large one, it keeps up to twice that size instead (glibc; elsewhere this has no effect).
    """
    np.empty(30 << 20, np.uint8)
    return chunks(batches, limit=SMALL_BYTES, rows=rows)


def rows_of(batches: Iterator[pa.RecordBatch], step: int = 64) -> Iterator[dict]:
    """Rows as dicts, few at a time, so that large values are not held twice over."""
    for batch in batches:
        for i in range(0, batch.num_rows, step):
            yield from batch.slice(i, step).to_pylist()


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """Texts of a batch; a null one is empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def record(fields: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A record batch from named values with their Arrow types."""
    return pa.record_batch([pa.array(v, t) for v, t in fields.values()], names=list(fields))
