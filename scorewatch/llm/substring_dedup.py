"""Removal of word passages that an earlier document has, by factors relative to reference blocks.

Documents are factored, as in relative Lempel-Ziv parsing, against an index of the corpus that is
cut in blocks. A factor is a longest run of positions whose windows continue one earlier
occurrence; where a factor ends, the next position is looked up by itself, so a window
that crosses two factors is found if any earlier document has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import partitions, record, small_chunks, stored
from scorewatch.llm.wordhash import Words, joined_words, mix, sliding_min, window_hashes, words_of

GRAM = 8
FLUSH_WINDOWS = 1 << 19
_FACTOR = "doc_id long, start long, windows int, ref_id long, ref_start long"


def _anchors(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all windows inside a text, and each one's anchor: its least short-gram hash.

    Equal windows have equal anchors, and neighbours mostly share one, so few anchors stand for all windows.
    """
    gram = min(GRAM, window)
    least = sliding_min(window_hashes(words.hashes, gram, 1), window - gram + 1)
    row = words.row_of_word()
    inside = np.flatnonzero(row[: len(least)] == row[window - 1:window - 1 + len(least)])
    return inside, least[inside]


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)


def _anchor_rows(docs: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_chunks(batches):
            words, ids = words_of(batch.column("text")), _rows(batch)
            starts, anchors = _anchors(words, window)
            row = words.row_of_word()[starts]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (anchors[1:] != anchors[:-1])
            yield record({"anchor": (anchors[new].view(np.int64), pa.int64()), "doc_id": (ids[row[new]], pa.int64())})

    return docs.mapInArrow(run, "anchor long, doc_id long")


def _alike(group: np.ndarray, i: int, j: int, most: int) -> int:
    """How many of ``most`` windows from ``i`` on are those from ``j`` on."""
    done, step = 0, 64
    while done < most:
        n = min(step, most - done)
        same = group[i + done:i + done + n] == group[j + done:j + done + n]
        if not same.all():
            return done + int(same.argmin())
        done, step = done + n, 4 * step
    return most


def _factors(h1, h2, doc, start) -> tuple[np.ndarray, np.ndarray, pa.RecordBatch]:
    """Order by document and place, which windows in it an earlier document has, and factors of those.

    A factor starts at the least (document, place) that has its first window, and goes on there
    as long as it can, so its length does not depend on where the next window was first.
    """
    order = np.lexsort((start, doc))
    h1, h2, doc, start = h1[order], h2[order], doc[order], start[order]
    by = np.lexsort((h2, h1))  # stable: equal windows stay in the order of documents and places
    head = np.ones(len(by), bool)
    head[1:] = (h1[by][1:] != h1[by][:-1]) | (h2[by][1:] != h2[by][:-1])
    group, first = np.empty(len(by), np.int64), np.empty(len(by), np.int64)
    group[by] = np.cumsum(head) - 1
    first[by] = by[np.flatnonzero(head)][group[by]]
    late = doc > doc[first]

    def ends(cut):
        at = np.append(np.flatnonzero(cut), len(cut))
        return np.repeat(at[1:], np.diff(at))

    cut = np.ones(len(by), bool)
    cut[1:] = (doc[1:] != doc[:-1]) | (start[1:] != start[:-1] + 1)
    end = ends(cut)  # of the neighbouring windows
    cut[1:] |= late[1:] != late[:-1]
    own = ends(cut)
    at, n = [], []
    for i in np.flatnonzero(cut & late).tolist():
        last = int(own[i])
        while i < last:
            j = int(first[i])
            at.append(i)
            n.append(_alike(group, i, j, min(last - i, int(end[j]) - j)))
            i += n[-1]
    at = np.array(at, np.int64)
    return order, late, record({
        "doc_id": (doc[at], pa.int64()), "start": (start[at], pa.int64()), "windows": (n, pa.int32()),
        "ref_id": (doc[first[at]], pa.int64()), "ref_start": (start[first[at]], pa.int64()),
    })


def _ask(flagged: DataFrame, window: int, blocks: int) -> DataFrame:
    """Factors found within a task, and windows sent to the reference block of their anchor.

    A task sends a window once, however many of its documents have it; the others have
    an earlier document in the task already. So a passage of very many documents is
    sent once per task.
    """
    def flush(held):
        h1, h2, anchor, doc, start = (np.concatenate(x) for x in zip(*held))
        order, known, found = _factors(h1, h2, doc, start)
        h1, h2, anchor, doc, start = (x[order] for x in (h1, h2, anchor, doc, start))
        none = pa.nulls(found.num_rows, pa.binary())
        yield pa.record_batch(
            [pa.nulls(found.num_rows, pa.int32()), *found.columns, *[none] * 4],
            names=["block", *found.schema.names, "h1", "h2", "docs", "starts"])
        block = (mix(anchor) % np.uint64(blocks)).astype(np.int64)
        block[known] = -1
        order = np.argsort(block, kind="stable")
        at = np.searchsorted(block[order], np.arange(blocks + 1))
        full = [b for b in range(blocks) if at[b + 1] > at[b]]
        part = lambda x, dtype: [x[order[at[b]:at[b + 1]]].astype(dtype).tobytes() for b in full]
        n = len(full)
        yield pa.record_batch(
            [pa.array(full, pa.int32()), *[pa.nulls(n, f.type) for f in found.schema],
             *[pa.array(part(x, t), pa.binary()) for x, t in ((h1, "<u8"), (h2, "<u8"), (doc, "<i8"), (start, "<i8"))]],
            names=["block", *found.schema.names, "h1", "h2", "docs", "starts"])

    def run(batches):
        held, size = [], 0
        for batch in small_chunks(batches):
            words, ids = words_of(batch.column("text")), _rows(batch)
            starts, anchors = _anchors(words, window)
            row = words.row_of_word()[starts]
            wanted = np.zeros(len(starts), bool)
            at = np.searchsorted(row, np.arange(len(ids) + 1))
            for i, shared in enumerate(batch.column("anchors").to_pylist()):
                wanted[at[i]:at[i + 1]] = np.isin(anchors[at[i]:at[i + 1]], np.array(shared, np.int64).view(np.uint64))
            starts, anchors, row = starts[wanted], anchors[wanted], row[wanted]
            h1, h2 = (window_hashes(words.hashes, window, s)[starts] for s in (2, 3))
            marks = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
            held.append((h1, h2, anchors, ids[row], marks[row] << 32 | starts - words.first[row]))
            size += len(starts)
            if size >= FLUSH_WINDOWS:
                yield from flush(held)
                held, size = [], 0
        if size:
            yield from flush(held)

    return flagged.mapInArrow(run, f"block int, {_FACTOR}, h1 binary, h2 binary, docs binary, starts binary")


def _answer(asks: DataFrame) -> DataFrame:
    """Factor the windows that met in each reference block."""
    def block_factors(rows):
        h1, h2, doc, start = (np.concatenate([np.frombuffer(r[c], t) for r in rows]) for c, t in (
            ("h1", "<u8"), ("h2", "<u8"), ("docs", "<i8"), ("starts", "<i8")))
        return _factors(h1, h2, doc, start)[2]

    def run(batches):
        block, rows = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["block"] != block:
                    if rows:
                        yield block_factors(rows)
                    block, rows = r["block"], []
                rows.append(r)
        if rows:
            yield block_factors(rows)

    return asks.mapInArrow(run, _FACTOR)


def duplicate_factors(docs: DataFrame, window: int = 50) -> DataFrame:
    """Factors of at least ``window`` words that an earlier document has too.

    One row per factor: ``doc_id``, its first word ``start``, its number of ``windows`` (words
    less ``window`` - 1) and a place ``ref_id``, ``ref_start`` of a document with a smaller ``doc_id`` that
    has the same words. Every window that starts in a smaller document is in
    a factor. Documents with fewer words, null texts and null ids have none; a repeat
    within one document is none, nor is one of two rows with equal ``doc_id``. ``mark`` tells
    different texts of one ``doc_id`` apart.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long"), "text", _mark()).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = stored(_anchor_rows(texts, window), "anchors")
    shared = stored(
        anchors.groupBy("anchor").agg(F.min("doc_id").alias("__a"), F.max("doc_id").alias("__b")).filter("__a < __b").select("anchor"),
        "shared-anchors")
    flags = anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    # a block is a task's work, so a task sends at most one row to each task after it
    blocks = partitions(spark)
    asks = stored(_ask(texts.join(flags, "doc_id"), window, blocks), "windows")
    ask = asks.filter("block IS NOT NULL").select("block", "h1", "h2", "docs", "starts")
    met = _answer(ask.repartition(blocks, "block").sortWithinPartitions("block"))
    known = asks.filter("block IS NULL").select("doc_id", "start", "windows", "ref_id", "ref_start")
    place = lambda c: F.col(c).bitwiseAND(F.lit(2**32 - 1)).cast("int").alias(c)
    return stored(known.unionByName(met).select(
        "doc_id", F.shiftright("start", 32).alias("mark"), place("start"), "windows", "ref_id", place("ref_start")), "factors")


def _mark() -> Column:
    return F.shiftright(F.crc32("text"), 1).alias("mark")


def _spans(batch: pa.RecordBatch, words: Words, window: int, factors_column: str) -> np.ndarray:
    """Which words of a chunk its factors cover."""
    change = np.zeros(len(words.hashes) + 1, np.int64)
    for i, factors in enumerate(batch.column(factors_column).to_pylist()):
        for f in factors or ():
            at = words.first[i] + f["start"]
            change[at] += 1
            change[min(at + f["windows"] + window - 1, words.first[i + 1])] -= 1
    return np.cumsum(change[:-1]) > 0


def _with_factors(docs: DataFrame, window: int) -> tuple[DataFrame, str]:
    """``docs`` with the factors of each row, and the name of their column, which ``docs`` lacks."""
    tag = ""
    while {f"{n}{tag}" for n in ("__id", "__mark", "__factors")} & {c.lower() for c in docs.columns}:
        tag += "_"
    own, mark, factors = f"__id{tag}", f"__mark{tag}", f"__factors{tag}"
    found = duplicate_factors(docs, window).groupBy(F.col("doc_id").alias(own), F.col("mark").alias(mark)).agg(
        F.collect_list(F.struct("start", "windows")).alias(factors))
    rows = docs.withColumns({own: F.col("doc_id").cast("long"), mark: _mark()})
    return rows.join(found, [own, mark], "left").drop(own, mark), factors


def removal_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept_sha256`` of every row."""
    import hashlib

    def run(batches):
        for batch in small_chunks(batches):
            words = words_of(batch.column("text"))
            gone = _spans(batch, words, window, factors)
            out, ends = joined_words(words, ~gone)
            before = np.concatenate([[0], np.cumsum(gone)])[words.first]
            yield record({
                "doc_id": (batch.column("doc_id"), pa.int64()), "n_words": (np.diff(words.first), pa.int64()),
                "n_removed": (np.diff(before), pa.int64()),
                "kept_sha256": ([hashlib.sha256(out[a:b]).hexdigest() for a, b in ends.T], pa.string()),
            })

    rows, factors = _with_factors(docs.select(F.col("doc_id").cast("long"), "text"), window)
    return rows.select("doc_id", "text", factors).mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_duplicates(docs: DataFrame, window: int = 50) -> DataFrame:
    """``docs`` with covered words cut from ``text``; all else in it, and other columns, stay as they are.

    A removed stretch goes with the white space after it. A document may end up with an empty text.
    """
    def run(batches):
        for batch in small_chunks(batches):
            words = words_of(batch.column("text"))
            gone = _spans(batch, words, window, factors)
            texts = batch.column("text").to_pylist()
            for i in range(len(texts)):
                a, b = words.first[i], words.first[i + 1]
                if gone[a:b].any():
                    keep = np.ones(words.offsets[i + 1] - words.offsets[i], bool)
                    ends = np.append(words.starts[a + 1:b], words.offsets[i + 1])
                    for s, e in zip(words.starts[a:b][gone[a:b]], ends[gone[a:b]]):
                        keep[s - words.offsets[i]:e - words.offsets[i]] = False
                    texts[i] = words.data[words.offsets[i]:words.offsets[i + 1]][keep].tobytes().decode()
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.record_batch(columns, names=names)

    names = docs.columns
    rows, factors = _with_factors(docs, window)
    return rows.mapInArrow(run, docs.schema)
