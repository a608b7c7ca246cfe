"""Phrase mining against plain counting."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from scorewatch.llm import collocations as c

SCHEMA = "doc_id long, text string, lang string, fp long, key string, phrase string"
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, top=2000):
    f, n, out = defaultdict(Counter), Counter(), []
    for _, text, lang, *_ in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(_LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in (1, 2, 3, 4):
                f[lang or "und"].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        inside = {p[i:i + s] for p, a in cand.items() for s in range(2, len(p)) for i in range(len(p) - s + 1) if 100 * a >= 80 * counts[p[i:i + s]]}
        rank = []
        for p, a in cand.items():
            if p not in inside:
                score, k = min((2_000_000 * a // (counts[p[:k]] + counts[p[k:]]), k) for k in range(1, len(p)))
                rank.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(rank)[:top])]
    return sorted(out)


def corpus(seed):
    rng = np.random.default_rng(seed)
    words = ["New", "york", "été", "a", "of", "b-c", " x", "İ", "new"]
    marks = [" ", " ", "  ", "\t", ", ", ".\n", " ; ", "\x0b", " \r"]
    rows = []
    for i in range(150):
        text = "".join(str(rng.choice(words)) + str(rng.choice(marks)) for _ in range(rng.integers(0, 60)))
        if i % 3 == 0:
            text += "once upon a time " * int(rng.integers(1, 4))
        rows.append((i, text, [None, "en", "fr"][i % 3], 1, "k", "p"))
    rows += [(500, None, "en", 0, "", ""), (None, "", None, 0, "", ""), (501, " , . ", "en", 0, "", "")]
    hot = ("hot passage of text, " * 5, "en")
    return rows + [(600 + i, *hot, 0, "", "") for i in range(60)] + rows[:20]


@pytest.mark.parametrize("options", [{}, {"hash_bits": 6}, {"least": 3, "hash_bits": 11}])
def test_equals_plain_counting(spark, options):
    rows = corpus(3)
    got = c.collocations(spark.createDataFrame(rows, SCHEMA), **options).collect()
    want = brute(rows, options.get("least", 30))
    assert sorted(map(tuple, got)) == want and want


def test_top_and_ties(spark):
    rows = [(0, "d c. b a. a b. c d." * 40, "en", 0, "", "")]
    got = c.collocations(spark.createDataFrame(rows, SCHEMA), top=3).collect()
    assert sorted(map(tuple, got)) == brute(rows, top=3) and len(got) == 3


def test_empty_table(spark):
    assert c.collocations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_very_long_texts_are_taken_in_sections(spark, monkeypatch):
    rng = np.random.default_rng(5)
    text = "".join(str(rng.choice(["x", "yy", "Zed"])) + str(rng.choice([" ", ". "])) for _ in range(400_000))
    rows = [(1, text, "en", 0, "", ""), (2, "no mark " * 200_000, "en", 0, "", "")]
    assert len(text) > c.TEXT_BYTES
    got = c.collocations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_fingerprints_of_equal_words_are_equal_wherever_they_stand():
    words = c.PieceWords(pa.array(["Big cat,  big\tcat", "a big cat", None and "", ""]))
    hashes = c.Fingerprints(7)
    at = np.array([0, 2, 5])
    fp = hashes.between(hashes.prefixes(words.data), words.starts[at], words.ends[at + 1], np.zeros(3, np.uint64))
    assert len(set(fp)) == 1 and [words.phrase(i, 2) for i in at] == ["big cat"] * 3
