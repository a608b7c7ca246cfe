"""Passage removal against a plain dictionary of windows."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorewatch.llm import substring_dedup as s

SCHEMA = "doc_id long, text string, start string"


def brute(rows, window):
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, *_ in rows]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - window + 1):
                key = tuple(w[i:i + window])
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - window + 1):
            if d is not None and least[tuple(w[i:i + window])] < d:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(d), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def corpus(seed, n=120, window=12):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}é" for i in range(400)]
    passages = [list(rng.choice(vocabulary, size)) for size in (window - 1, window, window + 1, 3 * window, 90)]
    rows = []
    for i in range(n):
        text = list(rng.choice(vocabulary, rng.integers(0, 60)))
        for _ in range(rng.integers(0, 3)):
            p = passages[rng.integers(len(passages))]
            cut = rng.integers(0, 4)
            at = rng.integers(0, len(text) + 1)
            text[at:at] = p[cut:]
        rows.append(((i * 77) % n, rng.choice([" ", "\n", " \t"]).join(text), "x"))
    rows += [(n + 1, rows[3][1], None), (n + 2, None, "x"), (n + 3, "", "x"), (n + 4, " \n ", "x"), (None, rows[3][1], "x"), (5, rows[5][1], "x")]
    return rows


@pytest.mark.parametrize("seed,window", [(1, 12), (2, 12), (3, 5), (4, 50)])
def test_against_brute_force(spark, monkeypatch, seed, window):
    monkeypatch.setattr(s, "FLUSH_WINDOWS", 500)
    rows = corpus(seed, window=window)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in s.removal_digests(df, window).collect())
    assert got == brute(rows, window)
    cut = s.remove_duplicates(df, window)
    assert cut.columns == df.columns
    texts = [(str(r["doc_id"]), r["text"]) for r in cut.collect()]
    words = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in texts]
    assert sorted((d, hashlib.sha256(" ".join(w).encode()).hexdigest()) for d, w in words) == sorted((g[0], g[3]) for g in got)
    whole = {d for d, _, removed, _ in got if removed} ^ {d for d, *_ in got}
    assert {(d, t) for d, t in texts if d in whole} == {(str(d), t) for d, t, _ in rows if str(d) in whole}


def test_factors_point_at_equal_words(spark):
    rows = corpus(9)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append((t or "").split())
    for f in s.duplicate_factors(spark.createDataFrame(rows, SCHEMA), 12).collect():
        n = f["windows"] + 11
        assert f["ref_id"] < f["doc_id"]
        assert any(a[f["start"]:f["start"] + n] == b[f["ref_start"]:f["ref_start"] + n] for a in texts[f["doc_id"]] for b in texts[f["ref_id"]])


def test_near_copies_have_few_factors(spark):
    """A factor ends where one of two copies differs, not where another copy was the first with the next window."""
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(400)]
    rows = []
    for d in range(40):
        w, at = list(base), rng.choice(400, 4, replace=False)
        for p in at:
            w[p] = f"d{d}p{p}"
        rows.append((d, " ".join(w), "x"))
    found = s.duplicate_factors(spark.createDataFrame(rows, SCHEMA).coalesce(1), 12).collect()
    texts = {d: t.split() for d, t, _ in rows}
    assert all(texts[f["doc_id"]][f["start"]:f["start"] + f["windows"] + 11] == texts[f["ref_id"]][f["ref_start"]:f["ref_start"] + f["windows"] + 11] for f in found)
    assert len(found) <= 39 * 9  # a piece ends at an edit of either copy
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in s.removal_digests(spark.createDataFrame(rows, SCHEMA), 12).collect())
    assert got == brute(rows, 12)


def test_no_documents(spark):
    assert s.removal_digests(spark.createDataFrame([], SCHEMA)).collect() == []


def test_clashing_column_names(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    rows = [(1, passage, 7, "m", 1), (2, f"other {passage} end", 8, "n", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id long, __mark string, __FACTORS int")
    got = s.remove_duplicates(df, 50)
    assert got.columns == df.columns and sorted(map(tuple, got.collect())) == [rows[0], (2, "other end", 8, "n", 2)]


def test_a_task_sends_at_most_one_row_to_each_task_after_it(spark, monkeypatch):
    held, keep = {}, s.stored
    monkeypatch.setattr(s, "stored", lambda df, name, *rest: held.setdefault(name, keep(df, name, *rest)))
    rows = corpus(3)
    s.duplicate_factors(spark.createDataFrame([(*r[:2], "z") for r in rows], SCHEMA), window=12).collect()
    asked = held["windows"].filter("block IS NOT NULL")
    per_task = asked.groupBy(F.input_file_name()).count().collect()
    assert per_task and all(r["count"] <= s.partitions(spark) for r in per_task)
