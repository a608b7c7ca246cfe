"""Token ids on disk: frequency-ranked, byte-aligned codes with separate control bytes."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import chunks, partitions, record, rows_of, store, stored, texts_of
from scorewatch.llm.tokenizing import encode

BLOCK_TOKENS = 1 << 18
# Two bits per value say how many bytes it has; this table has the four lengths of a control byte.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes (four values each, two bits a value) and data bytes of unsigned values."""
    return pack_streams(values, [len(values)])[:2]


def pack_streams(values: np.ndarray, counts: list[int]) -> tuple[bytes, bytes, np.ndarray]:
    """``pack`` of each so many values, one after the other, and how many data bytes each of these streams has."""
    v, counts = np.ascontiguousarray(values, "<u4"), np.asarray(counts, np.int64)
    extra = (v > 0xFF).astype(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    slots = -(-counts // 4) * 4  # a stream fills its last control byte
    padded = np.zeros(slots.sum(), np.uint8)
    ends = np.cumsum(counts)
    padded[np.arange(len(v)) + np.repeat(np.cumsum(slots) - slots - (ends - counts), counts)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    sizes = np.diff(np.concatenate([[0], np.cumsum(extra, dtype=np.int64)])[np.concatenate([[0], ends])]) + counts
    return control.astype(np.uint8).tobytes(), data.tobytes(), sizes


def unpack(control: bytes, data: bytes, counts: list[int]) -> np.ndarray:
    """The values of streams of ``pack``, one after the other: byte counts come from a table, bytes by one gather per position."""
    counts = np.asarray(counts, np.int64)
    slots = -(-counts // 4) * 4  # a stream fills its last control byte
    place = np.arange(slots.sum()) - np.repeat(np.cumsum(slots) - slots, slots)
    lengths = _LENGTHS[np.frombuffer(control, np.uint8)].ravel()[place < np.repeat(counts, slots)].astype(np.int64)
    starts = np.cumsum(lengths) - lengths
    raw = np.frombuffer(data, np.uint8)
    out = raw[starts].astype(np.uint32) if len(starts) else np.zeros(0, np.uint32)
    for i in range(1, 4):
        has = np.flatnonzero(lengths > i)
        out[has] |= raw[starts[has] + i].astype(np.uint32) << np.uint32(8 * i)
    return out


def tokenize(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id`` and ``ids`` of every text and the end id; and per task one row of how often each id occurred.

    ``ids`` has its width as first byte: 16 bits an id where all fit, else 32. The rows of counts have
    ``used`` and ``counts`` instead.
    """
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        total = np.zeros(0, np.int64)

        def rows(doc, ids, used, counts):
            return record({
                "doc_id": (doc, pa.int64()), "ids": (ids, pa.binary()),
                "used": (used, pa.list_(pa.int64())), "counts": (counts, pa.list_(pa.int64()))})

        for batch in chunks(batches):
            ids = [np.concatenate([x, end]) for x in encode(tokenizer, texts_of(batch))]
            n = np.bincount(np.concatenate(ids))
            total, n = (np.pad(x, (0, max(len(total), len(n)) - len(x))) for x in (total, n))
            total = total + n
            narrow = [b"\2" + x.astype("<u2").tobytes() if x.max() < 65536 else b"\4" + x.tobytes() for x in ids]
            yield rows(batch.column("doc_id"), narrow, [None] * len(ids), [None] * len(ids))
        used = np.flatnonzero(total)
        yield rows([None], [None], [used], [total[used]])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, used array<long>, counts array<long>")


def _wide(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode all documents into ``path/ranks`` and ``path/blocks``, in ascending ``doc_id`` order.

    A null or empty text has the end id alone. Rows with equal ``doc_id`` stay next to each
    other; a null ``doc_id`` comes first. An empty table gives empty folders. Ids are
    replaced by their rank in the whole corpus, so frequent ones take one byte. A block
    holds whole documents, ``BLOCK_TOKENS`` or one long document; each document is a
    stream of its own in it, so it can be read alone. Only the vocabulary's counts,
    whose number the tokenizer bounds, reach the driver.
    """
    spark = docs.sparkSession
    made = stored(tokenize(docs, tokenizer, end_id), "tokens")
    tokens = made.filter("used IS NULL").select("doc_id", "ids")
    each = made.filter("used IS NOT NULL").select(F.inline(F.arrays_zip("used", "counts")))
    counts = each.groupBy(F.col("used").alias("id")).agg(F.sum("counts").alias("n")).orderBy(F.desc("n"), "id").collect()
    ids = np.array([r["id"] for r in counts], np.int64)
    rank_of = np.zeros(int(ids.max(initial=0)) + 1, np.uint32)
    rank_of[ids] = np.arange(len(ids), dtype=np.uint32)
    ranks = spark.createDataFrame([(i, int(x)) for i, x in enumerate(ids)], "rank long, id long")
    ranks.coalesce(1).write.parquet(f"{path}/ranks")
    shared = spark.sparkContext.broadcast(rank_of)

    def block(batches):
        part, seq, start, held, size = TaskContext.get().partitionId(), 0, 0, [], 0

        def out():
            lengths = [len(x) for _, x in held]
            control, data, sizes = pack_streams(shared.value[np.concatenate([x for _, x in held])], lengths)
            return record({
                "part": ([part], pa.int32()), "seq": ([seq], pa.int64()), "start": ([start], pa.int64()),
                "doc_ids": ([[d for d, _ in held]], pa.list_(pa.int64())),
                "lengths": ([lengths], pa.list_(pa.int64())),
                "n_tokens": ([size], pa.int64()),
                "control": ([control], pa.binary()),
                "data": ([data], pa.binary()),
                "data_sizes": ([sizes], pa.list_(pa.int64())),
            })

        for r in rows_of(batches):
            ids = _wide(r["ids"])
            if held and size + len(ids) > BLOCK_TOKENS:
                yield out()
                seq, start, held, size = seq + 1, start + size, [], 0
            held.append((r["doc_id"], ids))
            size += len(ids)
        if held:
            yield out()

    ordered = tokens.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "ids")
    blocks = ordered.mapInArrow(block, (
        "part int, seq long, start long, doc_ids array<long>, lengths array<long>, n_tokens long, "
        "control binary, data binary, data_sizes array<long>"
    ))
    store(blocks, f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Documents of ``write_token_files``: ``doc_id``, ``start``, ``n_tokens`` and ``ids``.

    ``start`` is the number of ids of all documents before. A block knows its start in
    its part of the order; one row per part is added up to place the parts.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    ranks = spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()
    id_of = spark.sparkContext.broadcast(np.array([r["id"] for r in ranks], np.uint32))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.groupBy("part").agg(F.sum("n_tokens").alias("__n")).select(
        "part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = blocks.join(F.broadcast(offsets), "part").withColumn("start", F.col("start") + F.col("__before"))

    def run(batches):
        for r in rows_of(batches, 1):
            n = np.array(r["lengths"], np.int64)
            ids = id_of.value[unpack(r["control"], r["data"], n)].astype("<u4")
            ends = np.cumsum(n)
            yield record({
                "doc_id": (r["doc_ids"], pa.int64()), "start": (r["start"] + ends - n, pa.int64()), "n_tokens": (n, pa.int64()),
                "ids": ([ids[b - k:b].tobytes() for b, k in zip(ends, n)], pa.binary()),
            })

    wanted = ["start", "doc_ids", "lengths", "control", "data"]
    return placed.select(*wanted).mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def with_crc(tokens: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``."""
    return tokens.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
