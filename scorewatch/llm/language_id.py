"""Language of a text by the nearest centroid of normalised n-gram vectors, several per language."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import record, small_chunks, writing
from scorewatch.llm.wordhash import mix, words_of

UNKNOWN = "und"
_ASCII_LETTER = re.compile("[A-Za-z]")
BINS = 4096
GRAMS = (1, 2, 3)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
CENTROIDS = 4
# A centroid of fewer texts of its language than this share is an odd text, not a kind of text, and is dropped.
CENTROID_SHARE = 0.02
SAMPLE_PER_LANGUAGE = 500
# A text is rejected if its best cosine is below this part of what all but a small share of the learned texts
# of its length and nearest language reach. Cosines grow with length, so each doubling of the bytes is a class.
REJECT_SHARE = 0.01
REJECT_SLACK = 0.75
LENGTHS = 24
# Very short texts say little: they get half.
SHORT_BYTES, SHORT_SLACK = 64, 0.5
# A class with fewer texts has no quantile of its own.
LEAST_TEXTS = 100
STEPS = 1000


def gram_counts(texts: pa.Array) -> np.ndarray:
    """Hashed byte n-grams of each text's words (blank before and after, A-Z as a-z), as rows of ``BINS``."""
    words = words_of(texts)
    n = len(words.first) - 1
    counts = np.zeros(n * BINS, np.int32)
    if not len(words.starts):
        return counts.astype(np.float32).reshape(n, BINS)
    # words with one blank before each
    sizes = words.ends - words.starts
    place = np.concatenate([[0], np.cumsum(sizes + 1)])
    flat = np.full(place[-1], 32, np.uint64)
    heads = np.cumsum(sizes) - sizes
    steps = np.arange(sizes.sum())
    flat[np.repeat(place[:-1] + 1 - heads, sizes) + steps] = _LOWER[words.data[np.repeat(words.starts - heads, sizes) + steps]]
    row = np.repeat(words.row_of_word(), sizes + 1)
    for k in GRAMS:
        key = np.full(len(row), k, np.uint64)
        for i in range(k):
            ahead = np.full(len(row), 32, np.uint64)  # past the text's end: blanks
            ahead[: len(row) - i] = np.where(row[i:] == row[: len(row) - i], flat[i:len(row)], np.uint64(32))
            key = key << np.uint64(8) | ahead
        counts += np.bincount(row * BINS + (mix(key) % np.uint64(BINS)).astype(np.int64), minlength=n * BINS).astype(np.int32)
    return counts.astype(np.float32).reshape(n, BINS)


@dataclass
class Model:
    """Unit centroids with their languages, bin weights, and the least cosines that are accepted, by language and length class."""

    langs: list[str]
    centroids: np.ndarray
    lang_of: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language, the best cosine, and the length class of each text."""
        counts = gram_counts(texts)
        cosine = self.vectors(counts) @ self.centroids.T
        best = np.argmax(cosine, axis=1)
        return self.lang_of[best], np.clip(cosine[np.arange(len(best)), best], 0, 1), length_class(counts)


def length_class(counts: np.ndarray) -> np.ndarray:
    """Power of two of the bytes in words and one blank before each, which are as many as the 1-grams."""
    size = counts.sum(1, dtype=np.float64) / len(GRAMS)
    return np.clip(np.log2(np.maximum(size, 1)).astype(np.int64), 0, LENGTHS - 1)


def limits(seen: np.ndarray) -> np.ndarray:
    """Least cosines by language and length class, from counts of texts by language, class and cosine in steps.

    A class with few texts of a language takes the limit of all languages, and if these have few as well, that
    of the classes around it that have enough together.
    """
    def quantile(n: np.ndarray) -> float:
        return float(np.searchsorted(np.cumsum(n), REJECT_SHARE * n.sum(), side="right")) / STEPS

    every = seen.sum(0)
    out = np.zeros(seen.shape[:2])
    for lang, own in enumerate(seen):
        for at in range(LENGTHS):
            if own[at].sum() >= LEAST_TEXTS:
                out[lang, at] = quantile(own[at])
                continue
            near = 0
            while near < LENGTHS and every[max(at - near, 0):at + near + 1].sum() < LEAST_TEXTS:
                near += 1
            out[lang, at] = quantile(every[max(at - near, 0):at + near + 1].sum(0))
    # of few texts in all, centroids are the texts themselves, which new ones cannot reach
    few = every.sum() < LEAST_TEXTS
    return out * np.where(few | (2.0 ** np.arange(LENGTHS) < SHORT_BYTES), SHORT_SLACK, REJECT_SLACK)


def _cluster(v: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Spherical k-means from spread starting points; at most ``k`` unit centroids, none of odd texts alone."""
    picks = [0]
    nearest = v @ v[0]
    while len(picks) < min(k, len(v)):
        picks.append(int(np.argmin(nearest)))
        nearest = np.maximum(nearest, v @ v[picks[-1]])
    c = v[picks]
    for _ in range(rounds):
        own = np.argmax(v @ c.T, axis=1)
        c = np.stack([v[own == i].sum(0) if (own == i).any() else c[i] for i in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    texts = np.bincount(np.argmax(v @ c.T, axis=1), minlength=len(c))
    return c[texts >= min(CENTROID_SHARE * len(v), texts.max())]


def learn(docs: DataFrame, sample: int = SAMPLE_PER_LANGUAGE, centroids: int = CENTROIDS) -> Model | None:
    """Fit on rows with a text, a letter and a ``lang``.

    Document frequencies of the bins are counted over all of them; the centroids are fitted on at most
    ``sample`` documents per language, those with the lowest hashes of ``doc_id``. Frequencies are ``BINS`` numbers and the
    sample is bounded, so the driver holds no more at any size. What cosine a text of some length must reach is
    learned from all of them again, by counts of cosines. ``None`` if there is no such row.
    """
    known = docs.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long"), "text", "lang")

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(BINS, np.int64), 0
        for batch in small_chunks(batches):
            total += (gram_counts(batch.column("text")) > 0).sum(0)
            rows += batch.num_rows
        yield record({"bin": ([-1, *range(BINS)], pa.int32()), "n": ([rows, *total], pa.int64())})

    with writing(docs.sparkSession):
        sums = known.mapInArrow(frequencies, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    seen = {r["bin"]: r["n"] for r in sums}
    if not seen.get(-1):
        return None
    idf = np.log((1 + seen[-1]) / (1 + np.array([seen[i] for i in range(BINS)], float))) + 1

    def counted(batches):
        for batch in small_chunks(batches):
            counts = gram_counts(batch.column("text"))
            yield record({
                "lang": (batch.column("lang"), pa.string()), "place": (batch.column("place"), pa.int64()),
                "hash": (batch.column("hash"), pa.int64()), "counts": ([c.astype("<u4").tobytes() for c in counts], pa.binary())})

    share = known.groupBy("lang").agg(F.count("*").alias("__n"))
    # the whole hash decides between equal places, and the counts between equal ids
    hashed = known.withColumn("hash", F.xxhash64("doc_id", F.lit("sample"))).withColumn("place", F.pmod("hash", F.lit(1 << 20)))
    drawn = hashed.join(F.broadcast(share), "lang").filter(F.col("place") < F.lit(1.3 * sample * (1 << 20)) / F.col("__n"))
    with writing(docs.sparkSession):
        rows = drawn.select("lang", "place", "hash", "text").mapInArrow(counted, "lang string, place long, hash long, counts binary").toArrow()
    by_lang: dict[str, list] = {}
    for lang, _, _, raw in sorted(zip(*(rows.column(c).to_pylist() for c in ("lang", "place", "hash", "counts")))):
        by_lang.setdefault(lang, []).append(np.frombuffer(raw, "<u4"))
    model = Model(sorted(by_lang), np.zeros((0, BINS), np.float32), np.zeros(0, np.int64), idf.astype(np.float32), np.zeros((0, LENGTHS)))
    parts = []
    for lang in model.langs:
        v = model.vectors(np.array(by_lang[lang][:sample], np.float32))
        parts.append(_cluster(v, centroids))
    model.centroids = np.concatenate(parts).astype(np.float32)
    model.lang_of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    shape = (len(model.langs), LENGTHS, STEPS + 1)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def reached(batches):
        seen = np.zeros(np.prod(shape), np.int64)
        for batch in small_chunks(batches):
            lang, cosine, length = shared.value.predict(batch.column("text"))
            np.add.at(seen, np.ravel_multi_index((lang, length, (cosine * STEPS).astype(np.int64)), shape), 1)
        at = np.flatnonzero(seen)
        yield record({"at": (at, pa.int64()), "n": (seen[at], pa.int64())})

    with writing(docs.sparkSession):
        cosines = known.mapInArrow(reached, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros(np.prod(shape), np.int64)
    seen[cosines.column("at").to_numpy()] = cosines.column("n").to_numpy()
    model.least = limits(seen.reshape(shape))
    return model


def _predicted(batch: pa.RecordBatch, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and rejection of each text of a chunk."""
    text = batch.column("text")
    # a byte beyond ASCII may be a letter or not; only such texts are looked at character by character
    letter = np.array([bool(t) and (bool(_ASCII_LETTER.search(t)) or any(map(str.isalpha, t))) for t in text.to_pylist()], bool)
    if model is None:
        letter[:] = False
        return [UNKNOWN] * len(letter), np.zeros(len(letter)), ~letter
    best, score, length = model.predict(text)
    lang = [model.langs[b] if has else UNKNOWN for b, has in zip(best, letter)]
    return lang, np.where(letter, score, 0.0), ~letter | (score < model.least[best, length])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """``doc_id`` with ``lang_pred``, ``score`` (best cosine) and ``rejected`` for every row.

    ``lang_pred`` is the language of the nearest centroid, ``und`` where the text is null or has no
    letter (score 0). ``rejected``: ``und``, or clearly farther from every centroid than learned texts of its length are. Ties
    go to the first language by name. Only the text is looked at. Without a model all are ``und``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_chunks(batches):
            lang, score, rejected = _predicted(batch, shared.value)
            yield record({
                "doc_id": (batch.column("doc_id"), pa.int64()), "lang_pred": (lang, pa.string()),
                "score": (score, pa.float64()), "rejected": (rejected, pa.bool_())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in small_chunks(batches):
            yield batch.filter(pa.array(~_predicted(batch, shared.value)[2]))

    return docs.mapInArrow(run, docs.schema)
