"""Packing documents into sequences of fixed length by rounds of best fit."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import chunks, partitions, record, stored, texts_of
from scorewatch.llm.tokenizing import encode

BUNDLE_SHARE = 16


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int) -> DataFrame:
    """Pieces of at most ``length`` tokens of every document and its end id.

    A longer document's first piece is the shorter one. Pieces of at most a sixteenth of a
    sequence are chained in bundles of at most an eighth within their task, so that a
    sequence takes few items; ``item`` names the bundle, or the piece itself, and
    ``item_offset`` the place in it.
    """
    small, most = max(1, length // BUNDLE_SHARE), max(1, length // BUNDLE_SHARE) * 2
    end = np.array([end_id], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        item = (TaskContext.get().partitionId() + 1) << 40
        bundle, filled = item, most
        for batch in chunks(batches):
            rows = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(tokenizer, texts_of(batch))):
                ids = np.concatenate([ids, end]).astype("<u4")
                starts = [0, *range(len(ids) % length or length, len(ids), length)]
                for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                    n = b - a
                    if n <= small:
                        if filled + n > most:
                            item += 1
                            bundle, filled = item, 0
                        own, offset, filled = bundle, filled, filled + n
                    else:
                        item += 1
                        own, offset = item, 0
                    rows.append((doc, k, a, n, zlib.crc32(ids[a:b].tobytes()), own, offset))
            doc, k, a, n, crc, own, offset = zip(*rows)
            yield record({
                "doc_id": (doc, pa.int64()), "piece": (k, pa.int32()), "start": (a, pa.int64()), "length": (n, pa.int64()),
                "ids_crc32": (crc, pa.int64()), "item": (own, pa.int64()), "item_offset": (offset, pa.int64()),
            })

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, (
        "doc_id long, piece int, start long, length long, ids_crc32 long, item long, item_offset long"))


def _sweep(merged: DataFrame) -> DataFrame:
    """Gaps (kind 0) and items (kind 1) range-sorted from large to small, with running counts.

    ``s`` is the running count of gaps less items in the row's part, its own row included,
    and ``low`` the lowest count before the row (0 at the part's start).
    """
    def run(batches):
        part, s, low = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            step = 1 - 2 * b.column("kind").to_numpy(zero_copy_only=False).astype(np.int64)
            total = s + np.cumsum(step)
            lows = np.minimum.accumulate(np.concatenate([[low], np.minimum(total, low)]))
            yield record({
                "value": (b.column("value"), pa.int64()), "kind": (b.column("kind"), pa.int32()), "id": (b.column("id"), pa.int64()),
                "part": (np.full(len(step), part), pa.int32()), "s": (total, pa.int64()), "low": (lows[:-1], pa.int64()),
            })
            if len(step):
                s, low = int(total[-1]), int(lows[-1])

    order = [F.desc("value"), F.asc("kind"), F.asc("id")]
    return merged.repartitionByRange(partitions(merged.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(
        run, "value long, kind int, id long, part int, s long, low long")


def match_round(items: DataFrame, gaps: DataFrame) -> DataFrame:
    """One round: every gap takes at most one item, every item the tightest gap left to it.

    Going from large to small, an item takes the last gap not yet taken, as brackets are
    matched. Which one that is follows from running counts: a gap that raises the count to
    ``c`` belongs to the next item that lowers it from ``c``. Rows of one count alternate
    between gaps and items and differ in size, so such a group is at most twice as long as there
    are sizes, however many documents there are. Returns all rows with the partner's id and size.
    """
    merged = gaps.select(F.col("gap").alias("value"), F.lit(0).alias("kind"), F.col("bin").alias("id")).unionByName(
        items.select(F.col("length").alias("value"), F.lit(1).alias("kind"), F.col("item").alias("id")))
    swept = stored(_sweep(merged), "sweep")
    # one row per part: its whole step and its lowest count
    parts = swept.groupBy("part").agg(
        F.sum(1 - 2 * F.col("kind")).alias("__step"), F.least(F.min("s"), F.lit(0)).alias("__min"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = parts.select("part", "__step", "__min", F.coalesce(F.sum("__step").over(before), F.lit(0)).alias("__base"))
    lowest = F.coalesce(F.min(F.col("__base") + F.col("__min")).over(before), F.lit(0))
    offsets = based.select("part", "__base", F.least(lowest, F.lit(0)).alias("__floor"))
    rows = swept.join(F.broadcast(offsets), "part")
    is_item = F.col("kind") == 1
    count = F.col("__base") + F.col("s") + F.when(is_item, 1).otherwise(0)
    floor = F.least("__floor", F.col("__base") + F.col("low"))
    keyed = rows.select("value", "kind", "id", F.when(is_item & (count <= floor), None).otherwise(count).alias("__count"))
    order = Window.partitionBy("__count").orderBy(F.desc("value"), "kind", "id")
    other = F.when(is_item, F.lag(F.struct("kind", "id", "value")).over(order)).otherwise(
        F.lead(F.struct("kind", "id", "value")).over(order))
    matched = keyed.filter(F.col("__count").isNotNull()).withColumn("__other", other)
    fits = F.col("__other.kind") != F.col("kind")
    out = ["value", "kind", "id"]
    return matched.select(
        *out, F.when(fits, F.col("__other.id")).alias("other_id"), F.when(fits, F.col("__other.value")).alias("other_value"),
    ).unionByName(keyed.filter(F.col("__count").isNull()).select(
        *out, F.lit(None).cast("long").alias("other_id"), F.lit(None).cast("long").alias("other_value")))


def place_items(items: DataFrame, length: int) -> DataFrame:
    """``item``, ``length`` and ``bin`` for items of 1 to ``length`` tokens, in few bins.

    Items over half a bin open bins of their own. Then come rounds of ``match_round``, in which a
    gap offers as many equal slots as the largest item left fits in; after each, gaps shrink by what they
    took. Where the rest surely does not fit, its largest items open bins: as many as the tokens
    beyond the gaps need at least. An empty table gives an empty result. Per round only a few
    sums and, to open bins, counts by size (at most ``length`` rows) reach the driver.
    """
    half = length // 2
    bins = lambda rows: rows.select("item", "length", F.col("item").alias("bin"))
    opened = items.filter(F.col("length") > half)
    placed = [bins(opened)]
    gaps = opened.filter(F.col("length") < length).select(F.col("item").alias("bin"), (length - F.col("length")).alias("gap"))
    rest = items.filter(F.col("length") <= half)
    left = _sums(rest, gaps)
    while left["n"]:
        free = left["gaps"] if left["shortest"] <= left["widest"] else 0
        if left["tokens"] > free:
            chosen = rest.join(F.broadcast(_largest(rest, -(-(left["tokens"] - free) // length))), "length").filter(
                (F.pmod(F.xxhash64("item"), F.col("__n")) < F.col("__need")) | (F.col("item") == F.col("__first")))
            chosen = stored(chosen.select("item", "length"), "opened")
            placed.append(bins(chosen))
            gaps = gaps.unionByName(chosen.select(F.col("item").alias("bin"), (length - F.col("length")).alias("gap")))
            rest = rest.join(chosen.select("item"), "item", "left_anti")
        done = stored(match_round(rest, _slots(gaps, left["longest"])), "round")
        item, hit = F.col("kind") == 1, F.col("other_id").isNotNull()
        placed.append(done.filter(item & hit).select(
            F.col("id").alias("item"), F.col("value").alias("length"), F.col("other_id").alias("bin")))
        gaps = done.filter(~item).groupBy(F.col("id").alias("bin")).agg(
            F.sum(F.col("value") - F.coalesce("other_value", F.lit(0))).alias("gap")).filter(F.col("gap") > 0)
        rest = done.filter(item & ~hit).select(F.col("id").alias("item"), F.col("value").alias("length"))
        left = _sums(rest, gaps)
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out


def _slots(gaps: DataFrame, longest: int) -> DataFrame:
    """Each gap as equal parts that fit any item; the first has what is over."""
    n = F.greatest(F.lit(1), F.floor(F.col("gap") / longest)).cast("int")
    return gaps.withColumn("__n", n).withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(
        "bin", (F.floor(F.col("gap") / F.col("__n")) + F.when(F.col("__i") == 1, F.col("gap") % F.col("__n")).otherwise(0)).cast("long").alias("gap"))


def _sums(rest: DataFrame, gaps: DataFrame) -> dict[str, int]:
    both = rest.select("length", F.lit(None).cast("long").alias("gap")).unionByName(
        gaps.select(F.lit(None).cast("long").alias("length"), "gap"))
    zero = F.lit(0)
    return both.agg(
        F.count("length").alias("n"), F.coalesce(F.sum("length"), zero).alias("tokens"), F.coalesce(F.sum("gap"), zero).alias("gaps"),
        F.coalesce(F.max("length"), zero).alias("longest"), F.coalesce(F.min("length"), zero).alias("shortest"),
        F.coalesce(F.max("gap"), zero).alias("widest"),
    ).first().asDict()


def _largest(rest: DataFrame, k: int) -> DataFrame:
    """Which of each size are among the ``k`` largest: all, or of the last size about the right number."""
    sizes = rest.groupBy("length").agg(F.count("*").alias("__n"), F.min("item").alias("__first"))
    above = F.coalesce(F.sum("__n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    need = sizes.withColumn("__need", F.lit(k) - above).filter(F.col("__need") > 0)
    return need.select("length", "__n", "__need", "__first")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, length: int = 2048) -> DataFrame:
    """Pieces of all documents with their ``sequence_id`` and ``offset`` in it.

    A null or empty text is its end id alone. Rows with equal ``doc_id`` are packed one by
    one; a null ``doc_id`` stays null. An empty table gives no rows.
    """
    pieces = stored(cut_documents(docs, tokenizer, end_id, length), "pieces")
    items = stored(pieces.groupBy("item").agg(F.sum("length").alias("length")), "items")
    placed = place_items(items, length)
    # a bin has at most ``length`` items
    before = Window.partitionBy("bin").orderBy(F.desc("length"), "item").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.select("item", "bin", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("__offset"))
    return pieces.join(offsets, "item").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("bin").alias("sequence_id"),
        (F.col("__offset") + F.col("item_offset")).alias("offset"))
