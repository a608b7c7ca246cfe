"""Embedding near duplicates and sharding against brute force."""

import zlib

import numpy as np
import pytest

from scorewatch.llm import embedding_dedup as e
from scorewatch.llm import sharding as s
from test_near import roots


def vectors(seed, dim=24):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, dim))
    rows = [b for b in base]
    for b in base[:40]:
        rows += [b + rng.normal(size=dim) * rng.choice([0.02, 0.2, 0.4]) for _ in range(3)]
    rows += [base[0] + rng.normal(size=dim) * 0.05 for _ in range(80)] + [base[1]] * 30 + [base[2] * 3.0]
    out = [(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows)]
    n = len(out)
    bad = [None, [], [0.0] * dim, [float("nan")] * dim, [1.0, None] * (dim // 2), [float("inf")] * dim, [1.0] * (dim - 1)]
    return out + [(n + i, v, None) for i, v in enumerate(bad)] + [(None, out[0][1], 1), (3, out[3][1], 1)]


@pytest.mark.parametrize("seed,changes", [(1, {}), (2, {"BLOCK": 16, "PER_CELL": 20}), (3, {"SAMPLE": 30})])
def test_links_against_brute_force(spark, monkeypatch, seed, changes):
    for name, value in changes.items():
        monkeypatch.setattr(e, name, value)
    rows = vectors(seed)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, unit int").repartition(5)
    got = e.near_duplicates(df, per_cell=changes.get("PER_CELL", e.PER_CELL)).collect()
    assert len(got) == len(rows)
    unit = {}
    for i, (d, v, _) in enumerate(rows):
        if d is not None and v and len(v) == 24 and None not in v and np.isfinite(v).all() and any(v):
            unit[i] = np.array(v) / np.linalg.norm(v)
    at = list(unit)
    cosine = np.array([unit[i] for i in at]) @ np.array([unit[i] for i in at]).T
    want = {(i, j) for x, i in enumerate(at) for y, j in enumerate(at) if x != y and cosine[x, y] >= 0.9}
    degree = sum(r["n_links"] for r in got)
    assert 0.98 * len(want) <= degree <= len(want)  # never a pair below, nearly all of the others
    if not changes:
        assert degree == len(want)
        root = roots({d for d, *_ in rows if d is not None}, [(rows[i][0], rows[j][0]) for i, j in want])
        assert {r["vec_id"]: r["component_id"] for r in got if r["vec_id"] is not None} == root
        links = {}
        for i, _ in want:
            links[i] = links.get(i, 0) + 1
        assert sorted((r["vec_id"], r["n_links"]) for r in got if r["vec_id"] is not None) == sorted(
            (d, links.get(i, 0)) for i, (d, *_) in enumerate(rows) if d is not None)
    for r in got:
        assert r["kept"] == (r["vec_id"] == r["component_id"])


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(11)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    n = rng.normal(size=a.shape)
    n -= (n * a).sum(1, keepdims=True) * a
    n /= np.linalg.norm(n, axis=1, keepdims=True)
    b = 0.91 * a + np.sqrt(1 - 0.91**2) * n
    rows = [(i, v.tolist()) for i, v in enumerate(np.concatenate([a, b]))]
    got = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_cell=100)
    assert sum(r["n_links"] for r in got.collect()) >= 0.97 * 6000


def test_vectors_of_any_length_link(spark, monkeypatch):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 1.0, 0.0]), (5, [0.0, 3.0, 0.1]), (6, [0.1])]
    for sample in (100, 1):  # with one vector sampled, most lengths have no centroids
        monkeypatch.setattr(e, "SAMPLE", sample)
        got = e.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), per_cell=2).collect()
        assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4), 6: (0, 6)}


def test_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert e.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    assert [r["n_links"] for r in e.near_duplicates(spark.createDataFrame([(1, None)], schema)).collect()] == [0]


def plain_best_fit(sizes, capacity):
    room, out = [], {}
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        fit = [(r, b) for b, r in enumerate(room) if r >= sizes[i]]
        b = min(fit)[1] if fit else len(room)
        if not fit:
            room.append(max(capacity, sizes[i]))
        room[b] -= sizes[i]
        out[i] = b
    return [out[i] for i in range(len(sizes))]


def test_tree_finds_the_tightest_bin():
    rng = np.random.default_rng(4)
    for capacity in (10, 50, 100):
        sizes = [int(x) for x in rng.integers(1, 60, 300)]
        assert s.best_fit_decreasing(sizes, capacity) == plain_best_fit(sizes, capacity)
    assert s.best_fit_decreasing([], 5) == []


def test_shards(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "t" * int(rng.integers(1, 300)) + str(i), 1) for i in range(900)]
    rows += [(1000 + i, "copy é" * (i % 7 + 1), 2) for i in range(400)]
    rows += [(2000 + i, "hot group of text " * 12, 2) for i in range(700)] + [(5000, None, 3), (5000, None, 3), (None, "", None)]
    got = s.shard(spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5), 8).collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == sorted(
        (str(d), len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    loads, places, slots = {}, {}, {}
    text = {d: t for d, t, _ in rows}
    for r in got:
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        places.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert set(loads) == set(range(8)) and max(loads.values()) <= 1.05 * min(loads.values())
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert all(len(p) == 1 for t, p in places.items() if t is None or not t.startswith("hot"))


def test_shards_of_few_or_no_documents(spark):
    schema = "doc_id long, text string"
    assert s.shard(spark.createDataFrame([], schema), 8).collect() == []
    got = s.shard(spark.createDataFrame([(1, "a"), (2, "bb")], schema), 8).collect()
    assert sorted((r["shard"], r["slot"]) for r in got) == [(0, 0), (1, 0)]
