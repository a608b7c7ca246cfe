"""Quality rules by distribution: character classes and common words against language references."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import CHUNK_ROWS, chunks, record, small_chunks, texts_of, writing
from scorewatch.llm.wordhash import Words, mix, window_hashes, words_of

# Character classes, by byte: small, capital, digit, blank, line end, stop, mark, symbol, other ASCII, beyond ASCII.
CLASSES = 10
_SKIP = CLASSES  # later bytes of a character
_CLASS = np.full(256, 9, np.int64)
_CLASS[:128] = 8
_CLASS[ord("a"):ord("z") + 1], _CLASS[ord("A"):ord("Z") + 1], _CLASS[ord("0"):ord("9") + 1] = 0, 1, 2
_CLASS[[32, 9]], _CLASS[[10, 11, 12, 13]] = 3, 4
_CLASS[[ord(c) for c in ".,"]], _CLASS[[ord(c) for c in ";:!?'\"()-"]] = 5, 6
_SYMBOLS = "#*$%&|<>"
_CLASS[[ord(c) for c in _SYMBOLS]] = 7
_CLASS[128:192] = _SKIP
_IS_SYMBOL = np.isin(np.arange(256), [ord(c) for c in _SYMBOLS])
REPEAT_WINDOW = 8
# A word is a candidate for the common ones of a task if it is one in so many words.
TASK_SHARE = 5000
TOP_PARTS = 64


@dataclass(frozen=True)
class Rules:
    """Limits of the rules. Distances are Jensen-Shannon distances to base 2, from 0 to 1."""

    min_words: int = 20
    max_repeat_percent: int = 30
    common_words: int = 64
    # a short text says little about a distribution: limits are wider by noise / sqrt(size), and none below the guards
    min_chars_for_classes: int = 100
    max_class_distance: float = 0.25
    class_noise: float = 0.8
    min_words_for_common: int = 60
    max_common_distance: float = 0.3
    common_noise: float = 1.2


def class_counts(words: Words) -> np.ndarray:
    """Characters of each class in each text."""
    n = len(words.first) - 1
    row = np.repeat(np.arange(n), np.diff(words.offsets))
    return np.bincount(row * (CLASSES + 1) + _CLASS[words.data], minlength=n * (CLASSES + 1)).reshape(n, CLASSES + 1)[:, :CLASSES]


def distances(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of ``counts`` to each row of ``reference``; 1 for empty rows."""
    total = counts.sum(1, keepdims=True)
    p = (counts / np.maximum(total, 1))[:, None, :]
    q = (reference / np.maximum(reference.sum(1, keepdims=True), 1))[None]
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(-1)
        out = np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))
    return np.where(total > 0, out, 1.0)


@dataclass
class References:
    """Per language: class counts, common words (hashes) and their counts, then those of all other words."""

    langs: list[str]
    classes: np.ndarray
    words: list[np.ndarray]
    counts: list[np.ndarray]


def learn_references(docs: DataFrame, rules: Rules = Rules()) -> References:
    """References from all documents with a language.

    Character classes are counted in full. A task reports the words that are at least one in
    ``TASK_SHARE`` of its words of a language; the ``TASK_SHARE`` reported most are candidates, which hold every word
    that is two in ``TASK_SHARE`` of all, however the table is split. Candidates are counted over all rows again, and
    the most frequent become the common words. What reaches the driver is bounded by languages times
    task-independent table sizes. No document with a language gives no references.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, tuple[np.ndarray, list]] = {}
        for batch in chunks(batches):
            words = words_of(batch.column("text"), lower=True)
            classes, langs = class_counts(words), np.array(batch.column("lang").to_pylist(), object)
            row = words.row_of_word()
            for lang in dict.fromkeys(langs):
                own = langs == lang
                total, held = seen.setdefault(lang, (np.zeros(CLASSES, np.int64), []))
                total += classes[own].sum(0)
                held.append(np.unique(words.hashes[own[row]], return_counts=True))
                if len(held) > 16:
                    held[:] = [_added(held)]
        for lang, (total, held) in seen.items():
            token, n = _added(held)
            often = n * TASK_SHARE >= n.sum()
            kinds = [*[0] * CLASSES, 2, *[1] * int(often.sum())]
            keys = np.concatenate([np.arange(CLASSES), [0], token[often].view(np.int64)])
            yield record({
                "lang": ([lang] * len(kinds), pa.string()), "kind": (kinds, pa.int32()), "key": (keys, pa.int64()),
                "n": (np.concatenate([total, [n.sum()], n[often]]), pa.int64()),
            })

    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    sums = known.mapInArrow(run, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    found: dict[tuple[str, int], list] = {}
    with writing(docs.sparkSession):
        tops = _top(sums, max(CLASSES, rules.common_words, TASK_SHARE)).collect()
    for r in tops:
        found.setdefault((r["lang"], r["kind"]), []).append(r)
    candidates = {lang: np.sort(np.array([r["key"] for r in top], np.int64).view(np.uint64)) for (lang, kind), top in found.items() if kind == 1}
    shared = docs.sparkSession.sparkContext.broadcast(candidates)

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in chunks(batches):
            words, langs = words_of(batch.column("text"), lower=True), np.array(batch.column("lang").to_pylist(), object)
            row = words.row_of_word()
            for lang in shared.value.keys() & set(langs):
                keys, own = shared.value[lang], words.hashes[(langs == lang)[row]]
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                total = seen.setdefault(lang, np.zeros(len(keys), np.int64))
                total += np.bincount(at[keys[at] == own], minlength=len(keys))
        for lang, total in seen.items():
            some = total > 0
            yield record({
                "lang": ([lang] * int(some.sum()), pa.string()), "kind": ([1] * int(some.sum()), pa.int32()),
                "key": (shared.value[lang][some].view(np.int64), pa.int64()), "n": (total[some], pa.int64())})

    exact = known.mapInArrow(again, "lang string, kind int, key long, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    common: dict[str, list] = {}
    with writing(docs.sparkSession):
        tops = _top(exact, rules.common_words).collect()
    for r in tops:
        common.setdefault(r["lang"], []).append(r)
    langs = sorted({lang for lang, _ in found})
    classes = np.zeros((len(langs), CLASSES))
    words, counts = [], []
    for i, lang in enumerate(langs):
        for x in found[lang, 0]:
            classes[i, x["key"]] = x["n"]
        best = sorted(common.get(lang, []), key=lambda x: x["key"] % 2**64)
        words.append(np.array([x["key"] for x in best], np.int64).view(np.uint64))
        n = np.array([x["n"] for x in best], float)
        counts.append(np.append(n, found[lang, 2][0]["n"] - n.sum()))
    return References(langs, classes, words, counts)


def _top(sums: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest counts of each language and kind, first of each of ``TOP_PARTS`` parts, so that no task reads more than their tops."""
    for keys in (["lang", "kind", F.pmod(F.xxhash64("key"), F.lit(TOP_PARTS))], ["lang", "kind"]):
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("key")))
        sums = sums.withColumn("place", place).filter(F.col("place") <= k).drop("place")
    return sums


def _added(held: list) -> tuple[np.ndarray, np.ndarray]:
    token, at = np.unique(np.concatenate([t for t, _ in held]), return_inverse=True)
    return token, np.bincount(at, np.concatenate([n for _, n in held])).astype(np.int64)


def common_counts(words: Words, common: np.ndarray) -> np.ndarray:
    """Per text, the counts of each common word, then of all other words."""
    n, k = len(words.first) - 1, len(common)
    if k:
        at = np.minimum(np.searchsorted(common, words.hashes), k - 1)
        at = np.where(common[at] == words.hashes, at, k)
    else:
        at = np.zeros(len(words.hashes), np.int64)
    return np.bincount(words.row_of_word() * (k + 1) + at, minlength=n * (k + 1)).reshape(n, k + 1)


def repeated_words(words: Words, k: int = REPEAT_WINDOW) -> np.ndarray:
    """Per text, words in windows of ``k`` words that the text has at least twice."""
    row, h = words.row_of_word(), window_hashes(words.hashes, k)
    inside = np.flatnonzero(row[: len(h)] == row[k - 1:k - 1 + len(h)]) if len(h) else np.zeros(0, np.int64)
    own = mix(h[inside] + mix(row[inside].astype(np.uint64)))
    order = np.argsort(own)
    same = own[order][1:] == own[order][:-1]
    twice = np.zeros(len(own), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    change = np.zeros(len(words.hashes) + k + 1, np.int64)
    np.add.at(change, inside[twice], 1)
    np.add.at(change, inside[twice] + k, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(change)[: len(words.hashes)] > 0)])
    return np.diff(covered[words.first])


def _verdicts(batch: pa.RecordBatch, ref: References, rules: Rules) -> dict[str, np.ndarray]:
    """Counts, distances and verdict of each text of a chunk."""
    column = batch.column("text")
    words, lower = words_of(column), words_of(column, lower=True)
    n_words, n = np.diff(words.first), batch.num_rows
    marks = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)])
    in_words = np.concatenate([[0], np.cumsum(marks[words.ends] - marks[words.starts])])
    symbols = np.concatenate([[0], np.cumsum(_IS_SYMBOL[words.data])])
    lines = [[x for x in t.split("\n") if x.strip("\t\x0b\x0c\r ")] if "\n" in t else [] for t in texts_of(batch)]
    repeats = repeated_words(words)
    failed = (n_words < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n_words)
    classes, chars = class_counts(words), marks[words.offsets[1:]] - marks[words.offsets[:-1]]
    if ref.langs:
        by_class = distances(classes, ref.classes)
        by_word = np.stack([distances(common_counts(lower, w), c[None])[:, 0] for w, c in zip(ref.words, ref.counts)], 1)
        best = np.argmin(by_class + by_word, axis=1)
        class_distance, common_distance = by_class[np.arange(n), best], by_word[np.arange(n), best]
    else:
        class_distance = common_distance = np.zeros(n)
    wider = lambda limit, noise, size: limit + noise / np.sqrt(np.maximum(size, 1))
    far = class_distance > wider(rules.max_class_distance, rules.class_noise, chars)
    far &= chars >= rules.min_chars_for_classes
    far |= (common_distance > wider(rules.max_common_distance, rules.common_noise, n_words)) & (n_words >= rules.min_words_for_common)
    return {
        "n_words": n_words, "word_chars": np.diff(in_words[words.first]), "n_symbols": np.diff(symbols[words.offsets]),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64), "n_repeat_words": repeats,
        "base_failed": failed, "kept": ~failed & ~far, "class_distance": class_distance, "common_distance": common_distance,
    }


def judge(docs: DataFrame, references: References, rules: Rules = Rules()) -> DataFrame:
    """Every row's counts, distances to the nearest language and verdict.

    ``base_failed``: fewer than ``min_words`` words, or too many in repeated windows. The
    distances are those to the language that fits best, whatever language a row
    claims; a text shorter than a guard passes that rule. Null and empty texts have no words
    and fail; repeated rows are judged alike; columns other than ``doc_id`` and ``text`` are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def run(batches):
        for batch in small_chunks(batches, CHUNK_ROWS):
            found = _verdicts(batch, shared.value, rules)
            kinds = {"base_failed": pa.bool_(), "kept": pa.bool_(), "class_distance": pa.float64(), "common_distance": pa.float64()}
            yield record({"doc_id": (batch.column("doc_id"), pa.int64())} | {c: (x, kinds.get(c, pa.int64())) for c, x in found.items()})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, (
        "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
        "base_failed boolean, kept boolean, class_distance double, common_distance double"))


def keep_good(docs: DataFrame, references: References, rules: Rules = Rules()) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, unchanged."""
    shared = docs.sparkSession.sparkContext.broadcast(references)

    def run(batches):
        for batch in small_chunks(batches, CHUNK_ROWS):
            yield batch.filter(pa.array(_verdicts(batch, shared.value, rules)["kept"]))

    return docs.mapInArrow(run, docs.schema)
