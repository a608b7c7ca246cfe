"""Byte-level BPE by a local rank file: encoding in safe pieces, decoding to raw bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import chunks, record, texts_of
from scorewatch.llm.tokenizing import pieces

MOST_IDS = 1 << 16
LONG_SPACE = 100_000
# What the library's pattern takes as white space.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


@functools.lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The library's encoder over a rank file (``base64 rank`` lines), without special tokens."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def parts_of(text: str, longest: int = LONG_SPACE) -> Iterator[tuple[bool, str]]:
    """Parts of a text whose ids follow each other; true marks white space that is one match of the pattern.

    The pattern takes a run of white space as one match, but for its last character if more text follows. In the
    library such a long match overflows the stack, so runs of ``longest`` characters and more are cut out by that rule.
    """
    start = 0
    for run in re.finditer(f"[{_SPACE}]{{{longest},}}", text):
        if run.start() > start:
            yield from ((False, p) for p in pieces(text[start:run.start()]))
        start = run.end() if run.end() == len(text) else run.end() - 1
        yield True, text[run.start():start]
    if start < len(text):
        yield from ((False, p) for p in pieces(text[start:]))


def ids_of(codec, text: str) -> np.ndarray:
    """Ids of a whole text."""
    found = [np.array(codec._encode_single_piece(p.encode()), np.uint32) if space else codec.encode_to_numpy(p, disallowed_special=())
             for space, p in parts_of(text)]
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def encode_texts(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id`` and ``ids`` of every whole text; a null text is empty and has no ids.

    A text longer than a piece is cut where a single blank stands between two words:
    every match of the pattern starts or ends there, so the ids do not change. A text without
    any such blank is encoded in one go, but for long white space (``parts_of``). Rows come
    out as they come in, repeated ones too; other columns are not read; an empty table gives no rows. A task
    holds the ids of about ``CHUNK_BYTES`` of text, or of one longer text.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = encoding(path, pattern)
        for batch in chunks(batches):
            ids = [ids_of(codec, t) for t in texts_of(batch)]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
            values = np.concatenate([*ids, np.zeros(0, np.uint32)]).view(np.int32)
            yield pa.record_batch(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_ids(tokens: DataFrame, path: str, pattern: str) -> DataFrame:
    """``tokens`` with ``decoded``: the raw bytes of ``ids``, valid UTF-8 or not; null ids give none.

    Rows come out in groups of about ``MOST_IDS`` ids, or one longer row; no more than that many are Python integers at a time.
    """
    def run(batches):
        codec = encoding(path, pattern)
        for whole in batches:
            sizes = whole.column("ids").value_lengths().fill_null(0).to_numpy()
            for b in _groups(whole, sizes):
                lists = b.column("ids")
                ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())])
                values = lists.flatten().to_numpy()
                raw = [b"".join(codec.decode_bytes(values[i:min(i + MOST_IDS, end)].tolist()) for i in range(start, end, MOST_IDS))
                       for start, end in zip(ends[:-1], ends[1:])]
                yield record({"doc_id": (b.column("doc_id"), pa.int64()), "ids": (lists, pa.list_(pa.int32())), "decoded": (raw, pa.binary())})

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def _groups(batch: pa.RecordBatch, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``MOST_IDS`` ids, or one row that has more."""
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and held + n > MOST_IDS:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if len(sizes) > start:
        yield batch.slice(start, len(sizes) - start)


def ids_sha256(ids: str) -> Column:
    """Digest of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ","), 256)


def digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
