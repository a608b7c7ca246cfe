"""Phrases of a language whose words go together, found by Rabin-Karp fingerprints.

A prefix polynomial over the words of a chunk of texts gives the fingerprint of every n-gram by
two table look-ups. Fingerprints are counted per chunk and summed by a shuffle, along with one
pointer to an occurrence and the range of a second fingerprint; where that range is not a
single value, texts collided and are counted apart. Only phrases that are frequent are read back
from the text, where their fingerprints must be found again.

Longer phrases are counted in rounds: both parts of a frequent phrase that leave out one word
are frequent, so a round skips n-grams whose parts are not in a bitmap of the frequent ones. The
bitmap has a fixed size; when it fills up, less is skipped and nothing is lost.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewatch.llm.common import chunks, record, stored
from scorewatch.llm.wordhash import mix

LEAST_COUNT = 30
LONGEST = 4
INSIDE_PERCENT = 80
SCALE = 2_000_000
#: Bits of the filter between rounds: 8 MB, whatever the input.
FILTER_BITS = 1 << 26
TEXT_BYTES = 1024 * 1024
_OUT_ROWS = 20_000

_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_BETWEEN = _ENDS_PIECE.copy()
_BETWEEN[[9, 32]] = True
_SEPARATOR = re.compile("[.,;:!?\n\x0b\x0c\r]")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Fingerprints:
    """Prefix polynomials modulo 2^64 with an odd base and a random value per byte."""

    def __init__(self, seed: int, bits: int = 64) -> None:
        self.values = mix(np.arange(256, dtype=np.uint64) + np.uint64(seed << 32))
        self.base = int(mix(np.array([seed], np.uint64))[0]) | 1
        self.inverse = pow(self.base, -1, 1 << 64)
        self.mask = np.uint64((1 << bits) - 1)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            for name, factor in (("powers", self.base), ("inverses", self.inverse)):
                steps = np.full(n, factor, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefixes(self, data: np.ndarray) -> np.ndarray:
        self._grow(len(data) + 1)
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.powers[:len(data)])])

    def between(self, prefixes: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
        """Fingerprints of ``[start, end)``, salted by language."""
        return mix((prefixes[end] - prefixes[start]) * self.inverses[start] + salt) & self.mask


class PieceWords:
    """Words of a chunk of texts as one run of bytes, lower-cased and with one blank after each."""

    def __init__(self, texts: pa.Array) -> None:
        # every text is closed by a line end, so no piece spans two texts
        none, end = (pa.scalar(x, pa.large_string()) for x in ("", "\n"))
        joined = pc.binary_join_element_wise(texts.cast(pa.large_string()), none, end)
        offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset:joined.offset + len(joined) + 1]
        raw = np.frombuffer(joined.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if len(joined) else np.zeros(0, np.uint8)
        inside = ~_BETWEEN[raw]
        after = np.zeros(len(raw), bool)
        after[1:] = inside[:-1]
        starts = np.flatnonzero(inside & ~after)
        ends = np.flatnonzero(~inside & after)
        keep = inside | after
        self.data = _LOWER[raw[keep]]
        sizes = ends - starts
        self.ends = np.cumsum(sizes + 1) - 1
        self.starts = self.ends - sizes
        self.data[self.ends] = 32
        self.piece = np.cumsum(_ENDS_PIECE[raw], dtype=np.int64)[starts]
        self.text = np.searchsorted(offsets - offsets[0], starts, side="right") - 1
        self.first = np.searchsorted(starts, (offsets - offsets[0])[:-1])

    def phrase(self, word: int, k: int) -> str:
        return self.data[self.starts[word]:self.ends[word + k - 1]].tobytes().decode() if k else ""


def _sections(texts: pa.Array) -> Iterator[tuple[PieceWords, int]]:
    """Words of a chunk, and how many came before; a long text is taken in sections that end at a separator."""
    if len(texts) != 1 or len(texts[0].as_py()) <= TEXT_BYTES:
        yield PieceWords(texts), 0
        return
    text, start, before = texts[0].as_py(), 0, 0
    while start < len(text):
        end = _SEPARATOR.search(text, start + TEXT_BYTES) if len(text) - start > TEXT_BYTES else None
        stop = end.end() if end else len(text)
        words = PieceWords(pa.array([text[start:stop]]))
        yield words, before
        start, before = stop, before + len(words.starts)


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _in_filter(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    x = fp & np.uint64(FILTER_BITS - 1)
    return (bits[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _ngrams(words: PieceWords, salt: np.ndarray, k: int, bits: np.ndarray | None, strong: Fingerprints, check: Fingerprints):
    """First word, fingerprint and check of every n-gram of ``k`` words within a piece whose parts pass the filter."""
    n = len(words.starts)
    at = np.arange(max(0, n - k + 1))
    at = at[words.piece[at] == words.piece[at + k - 1]]
    prefixes = strong.prefixes(words.data)
    if bits is not None and k > 1:
        part = np.arange(n - k + 2)
        known = _in_filter(bits, strong.between(prefixes, words.starts[part], words.ends[part + k - 2], salt[words.text[part]]))
        at = at[known[at] & known[at + 1]]
    own = salt[words.text[at]]
    fp = strong.between(prefixes, words.starts[at], words.ends[at + k - 1], own)
    return at, fp, check.between(check.prefixes(words.data), words.starts[at], words.ends[at + k - 1], own)


def _entries(docs: DataFrame, k: int, bits: np.ndarray | None, hash_bits: int) -> DataFrame:
    """Counts of n-grams per chunk: ``fp``, ``chk``, ``n`` and a pointer (``key`` of the text, ``pos`` of the first word).

    In the first round every word is also an occurrence of the empty phrase (``pos`` -1), whose count is the language's total.
    """
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strong, check = Fingerprints(1, hash_bits), Fingerprints(2)
        for batch in chunks(batches, limit=TEXT_BYTES):
            salt = np.array([_salt(x) for x in batch.column("lang").to_pylist()], np.uint64)
            key = batch.column("key").to_numpy()
            for words, before in _sections(batch.column("text")):
                yield from count(words, before, salt, key, strong, check)

    def count(words, before, salt, key, strong, check) -> Iterator[pa.RecordBatch]:
        at, fp, chk = _ngrams(words, salt, k, shared.value, strong, check)
        found = [(at, fp, chk, before + at - words.first[words.text[at]])]
        if k == 1:
            own, none = salt[words.text[at]], np.zeros_like(at)
            found.append((at, *(f.between(np.zeros(1, np.uint64), none, none, own) for f in (strong, check)), none - 1))
        for at, fp, chk, pos in found:
            if not len(at):
                continue
            order = np.argsort(fp)
            at, fp, chk, pos = at[order], fp[order], chk[order], pos[order]
            new = np.flatnonzero(np.concatenate([[True], (fp[1:] != fp[:-1]) | (chk[1:] != chk[:-1])]))
            counts = np.diff(np.append(new, len(fp)))
            columns = (_signed(fp[new]), _signed(chk[new]), counts, key[words.text[at[new]]], pos[new])
            for i in range(0, len(new), _OUT_ROWS):
                yield record({name: (c[i:i + _OUT_ROWS], pa.int64()) for name, c in zip(("fp", "chk", "n", "key", "pos"), columns, strict=True)})

    return docs.mapInArrow(run, "fp long, chk long, n long, key long, pos long")


def _summed(entries: DataFrame, *by: str) -> DataFrame:
    return entries.groupBy(*by).agg(
        F.sum("n").alias("a"), F.min("chk").alias("low"), F.max("chk").alias("high"),
        F.min_by("pos", "key").alias("pos"), F.min("key").alias("key"))


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """One bit for the lowest bits of each fingerprint, as bytes; at most ``FILTER_BITS`` come to the driver."""
    place = frequent.select((F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1)) + 1).alias("x"))  # places and buckets count from one
    rows = place.groupBy(F.bitmap_bucket_number("x").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("bits"))
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for bucket, bits in rows.collect():
        start = (bucket - 1) * 4096
        out[start:start + 4096] = np.frombuffer(bits, np.uint8)[:len(out) - start]
    return out


def _read_back(docs: DataFrame, wanted: DataFrame, hash_bits: int) -> DataFrame:
    """``lang``, ``k``, ``phrase`` and ``a`` of the wanted fingerprints, from one occurrence each.

    Of equal texts one is read. Should two texts share a ``key``, the one in which the fingerprint is found again counts.
    """
    per_text = wanted.groupBy("key").agg(F.collect_list(F.struct("k", "fp", "low", "a", "pos")).alias("wants"))
    texts = docs.join(wanted.select("key").distinct(), "key", "left_semi").withColumn("__crc", F.crc32("text"))
    texts = texts.groupBy("key", "__crc").agg(F.first(F.struct("lang", "text")).alias("t")).select("key", "t.lang", "t.text")
    kind = "struct<k:int,fp:long,low:long,a:long,pos:long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strong, check = Fingerprints(1, hash_bits), Fingerprints(2)
        for batch in chunks(batches, limit=TEXT_BYTES):
            langs = batch.column("lang").to_pylist()
            salt = np.array([_salt(x) for x in langs], np.uint64)
            lists = batch.column("wants")
            wants = lists.flatten()
            row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())
            columns = [row, *(wants.field(name).to_numpy() for name in ("k", "fp", "low", "a", "pos"))]
            for words, before in _sections(batch.column("text")):
                yield find(words, before, langs, salt, *columns, strong, check)

    def find(words, before, langs, salt, row, k, fp, low, a, pos, strong, check) -> pa.RecordBatch:
        pos = pos - before
        size = np.diff(np.append(words.first, len(words.starts)))[row]
        fits = (pos >= 0) & (pos + np.maximum(k, 1) <= size)
        row, k, fp, low, a, pos = (x[fits] for x in (row, k, fp, low, a, pos))
        at = words.first[row] + pos
        start = words.starts[at] * (k > 0)
        end = words.ends[at + np.maximum(k, 1) - 1] * (k > 0)
        found = np.ones(len(at), bool)
        for hashes, value in ((strong, fp), (check, low)):
            found &= _signed(hashes.between(hashes.prefixes(words.data), start, end, salt[row])) == value
        at, k, row, a = at[found], k[found], row[found], a[found]
        return record({
            "lang": ([langs[i] for i in row], pa.string()), "k": (k, pa.int32()),
            "phrase": ([words.phrase(i, n) for i, n in zip(at, k, strict=True)], pa.string()), "a": (a, pa.int64())})

    joined = texts.join(per_text, "key").select("key", "lang", "text", F.col("wants").cast(f"array<{kind}>").alias("wants"))
    return joined.mapInArrow(run, "lang string, k int, phrase string, a long").distinct()


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, longest: int = LONGEST, hash_bits: int = 64) -> DataFrame:
    """``lang``, ``k``, ``phrase``, ``a``: phrases of up to ``longest`` words that occur ``least`` times in a language.

    ``k`` is the number of words; the row with ``k`` 0 holds the number of all words. ``docs`` needs
    ``text`` and ``lang`` (null: ``und``); other columns are ignored. A null or empty text has no
    words, repeated rows count again, an empty table gives no rows, texts of any length are read whole.
    ``hash_bits`` weakens the fingerprints, for tests of collisions.
    """
    lang, text = F.coalesce("lang", F.lit("und")), F.coalesce("text", F.lit(""))
    texts = docs.select(lang.alias("lang"), text.alias("text")).withColumn("key", F.xxhash64("lang", "text")).filter("text <> ''")
    bits, wanted = None, []
    for k in range(1, longest + 1):
        counted = stored(_summed(_entries(texts, k, bits, hash_bits), "fp").filter(F.col("a") >= least), f"phrases-{k}")
        clean, mixed = counted.filter("low = high"), counted.filter("low <> high")
        if not mixed.isEmpty():  # other texts have the same fingerprint: count each of them
            again = _entries(texts, k, bits, hash_bits).join(mixed.select("fp"), "fp", "left_semi")
            apart = _summed(again, "fp", "chk").filter(F.col("a") >= least).drop("chk")
            clean = clean.unionByName(stored(apart, f"collided-{k}"))
        if k < longest:
            bits = _filter_of(counted)
        size = F.when(F.col("pos") < 0, 0).otherwise(k)
        wanted.append(clean.select(size.cast("int").alias("k"), "fp", "low", "a", "key", F.greatest("pos", F.lit(0)).alias("pos")))
    every = wanted[0]
    for more in wanted[1:]:
        every = every.unionByName(more)
    return _read_back(texts, every, hash_bits)


def _words(phrase: str, start: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), start, size), " ")


def scored_phrases(frequent: DataFrame, inside_percent: int = INSIDE_PERCENT) -> DataFrame:
    """``lang``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score`` of the candidates that stay.

    A cut after its first words gives a phrase the score ``SCALE * a / (l + r)``, rounded down; the
    least of its cuts counts, of equals the first. A phrase inside a longer one with at least
    ``inside_percent`` of its count goes. Sums and products are decimals.
    """
    counts = frequent.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f"))
    phrases = frequent.filter("k >= 2")
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = phrases.select("lang", "phrase", "k", "a", cut)
    cuts = cuts.withColumn("part", _words("phrase", F.lit(1), F.col("cut"))).join(counts.withColumnRenamed("f", "l"), ["lang", "part"])
    cuts = cuts.withColumn("part", _words("phrase", F.col("cut") + 1, F.col("k") - F.col("cut"))).join(counts.withColumnRenamed("f", "r"), ["lang", "part"])
    big = "decimal(20,0)"
    score = F.expr(f"CAST(a AS {big}) * {SCALE} DIV (CAST(l AS {big}) + CAST(r AS {big}))").cast("long")
    best = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    longer = phrases.filter("k > 2").select("lang", "phrase", "k", F.col("a").alias("longer"), F.explode(F.expr(
        "flatten(transform(sequence(2, k - 1), s -> transform(sequence(1, k - s + 1), i -> struct(i, s))))")).alias("x"))
    inside = longer.select("lang", _words("phrase", F.col("x.i"), F.col("x.s")).alias("phrase"), "longer")
    inside = inside.groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
    totals = frequent.filter("k = 0").select("lang", F.col("a").alias("n"))
    kept = best.join(inside, ["lang", "phrase"], "left").filter(
        F.col("longer").isNull() | (F.col("longer").cast(big) * 100 < F.col("a").cast(big) * inside_percent))
    return kept.join(totals, "lang").select("lang", "phrase", "a", "best.l", "best.r", "n", "best.score")


def collocations(docs: DataFrame, top: int = 2000, **options: int) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    Order: score, then count, both descending, then the phrase's bytes. See ``frequent_phrases`` for nulls,
    empty tables and options.
    """
    frequent = stored(frequent_phrases(docs, **options), "phrases")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored_phrases(frequent).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
