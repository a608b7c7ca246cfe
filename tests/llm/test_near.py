"""Similarity join and components against brute force."""

import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from scorewatch.llm import components as parts
from scorewatch.llm import ngram_join as j
from scorewatch.llm.common import stored
from scorewatch.llm.components import components

SCHEMA = "doc_id long, text string, component string, n long"


def roots(nodes, links):
    parent = {x: x for x in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


def shingles(text, k):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, percent):
    sets = [(d, shingles(t, k)) for d, t, *_ in rows]
    links = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and a is not None and b is not None and 100 * len(x & y) >= percent * len(x | y):
                links.append((a, b))
    root = roots({d for d, _ in sets}, links) if None not in {d for d, _ in sets} else {None: None, **roots({d for d, _ in sets if d is not None}, links)}
    return sorted(map(str, ((d, len(s), root[d]) for d, s in sets)))


def corpus(seed):
    rng = np.random.default_rng(seed)
    vocabulary = [f"v{i}É" for i in range(3000)]
    rows, hot = [], list(rng.choice(vocabulary, 30))
    for family in range(25):
        base = list(rng.choice(vocabulary, rng.integers(3, 160)))
        if family % 3 == 0:
            base[0:0] = hot
        for _ in range(int(rng.choice([1, 2, 5, 40 if family == 4 else 3]))):
            w = list(base)
            for _ in range(rng.integers(0, 1 + max(1, len(w) // 25))):
                w[rng.integers(len(w))] = str(rng.choice(vocabulary))
            rows.append(" ".join(w))
    base = list(rng.choice(vocabulary, 80))
    for i in range(60):  # a dense family, some of it apart
        w = list(base)
        for p in rng.choice(80, rng.integers(0, 6), replace=False):
            w[p] = str(rng.choice(vocabulary))
        rows.append(" ".join(w))
    rows += [rows[5]] * 50 + [rows[6].upper().replace("É", "É"), "a b", "A  b", "a b c", "b a", "", " \n", None, None, "x"]
    order = rng.permutation(len(rows))
    out = [(int(i), rows[p], "c", 1) for i, p in enumerate(order)]
    return out + [out[7], (None, rows[5], None, None), (None, None, None, None)]


@pytest.mark.parametrize("seed,changes", [(1, {}), (2, {"FLUSH": 300, "DENSE": 3, "BLOCK": 16, "COLUMNS": 64, "LOCAL_COMMON": 2}), (3, {"FLUSH": 2000, "DENSE": 8, "LOCAL_COMMON": 10**9}), (4, {"DENSE": 4, "TIED": 12, "LOCAL_COMMON": 10**9}), (5, {"TIED": 4, "DENSE": 2, "BLOCK": 5, "PIVOTS": 1, "LOCAL_COMMON": 10**9}), (6, {"TIED": 4, "DENSE": 2, "BLOCK_SHINGLES": 300, "LOCAL_COMMON": 10**9})])
def test_join_against_brute_force(spark, monkeypatch, seed, changes):
    for name, value in changes.items():
        monkeypatch.setattr(j, name, value)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_join(df).collect()]
    want = brute(rows, 5, 75)
    assert sorted(set(map(str, got))) == sorted(set(want))
    assert len(got) >= len(set(want))
    if seed == 1:
        kept = j.keep_one(df).collect()
        root = {d: c for d, _, c in got}
        assert sorted(str(r["doc_id"]) for r in kept) == sorted(str(d) for d, *_ in rows if d is None or root[d] == d)
        assert j.keep_one(df).columns == df.columns


def test_a_cluster_of_several_groups_in_blocks(spark, monkeypatch):
    """Three families tied by one passage, and chains between documents of different blocks."""
    monkeypatch.setattr(j, "BLOCK", 4)
    monkeypatch.setattr(j, "TIED", 3)
    monkeypatch.setattr(j, "DENSE", 2)
    rng = np.random.default_rng(9)
    passage = [f"p{i}" for i in range(40)]
    rows = []
    for family in range(3):
        w = passage + [f"f{family}w{i}" for i in range(60)]
        for step in range(12):  # each differs a little from the one before: only neighbours link
            w = list(w)
            for p in range(40 + 5 * step, 44 + 5 * step):
                w[p] = f"f{family}s{step}x{p}"
            rows.append((int(rng.integers(10 ** 6)), " ".join(w), "c", 1))
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_join(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert sorted(set(map(str, got))) == sorted(set(brute(rows, 5, 75)))


@pytest.mark.parametrize("tied", [4096, 4])
def test_long_documents_that_share_a_few_common_shingles_are_no_cluster(spark, monkeypatch, tied):
    """Bitmaps of sets this large are full of ones; the other shingles tell that no two link."""
    for name, value in {"DENSE": 3, "TIED": tied, "LOCAL_COMMON": 10**9}.items():
        monkeypatch.setattr(j, name, value)
    sizes, links = [], j._links
    monkeypatch.setattr(j, "_links", lambda texts, clusters, *rest: sizes.append(clusters.count()) or links(texts, clusters, *rest))
    rows = [[f"d{d}w{i}" for i in range(2400 + 10 * d)] for d in range(20)]
    for r in rows:
        r[300:300] = [f"p{i}" for i in range(12)]
    rows += [[*rows[3][:-240], *[f"x{i}" for i in range(240)]], rows[4][:2000]]  # links with 3; links with 4 and has fewer
    rows = [(d, " ".join(w), "c", 1) for d, w in enumerate(rows)]
    got = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_join(spark.createDataFrame(spark.sparkContext.parallelize(rows, 22), SCHEMA)).collect()]
    assert sorted(map(str, got)) == brute(rows, 5, 75)
    assert {d: c for d, _, c in got}[20] == 3 and {d: c for d, _, c in got}[21] == 4
    assert sizes == [4]


def test_prefixes_share_what_is_needed():
    """The numbers of shingles that prefixes share at least are those of the worst two sets."""
    for percent in (10, 50, 75, 90, 100):
        for n in range(1, 260, 7):
            least = -(-percent * n // 100)
            for m in range(least, n + 1):
                overlap = -(-percent * (n + m) // (100 + percent))
                rest = max(n - j.prefix_length(n, percent), m - j.prefix_length(m, percent))
                assert 1 <= overlap - rest and 1 <= j.prefix_length(m, percent) <= m
                small = -(-percent * least // 100) - (least - j.prefix_length(least, percent))
                assert overlap - rest >= small


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(1, "a b c d e f", 5), (2, "a b c d e f", 6)], "doc_id long, text string, late long")
    assert [tuple(r) for r in j.keep_one(df).collect()] == [(1, "a b c d e f", 5)]


def test_join_of_no_documents(spark):
    assert j.jaccard_join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (170, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(50)]
    edges += [(9, 9), edges[0]]
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    got = components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == roots(nodes, [e for e in edges if e[0] != e[1]])
    assert len(got) == len(nodes)
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_few_edges_are_written_by_few_tasks(spark, monkeypatch):
    """Each table of each round had a file for every shuffle partition."""
    kept = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in kept}
    files = []

    def counted(df, name):
        out = stored(df, name)
        files.append(len(out.inputFiles()))
        return out

    monkeypatch.setattr(parts, "stored", counted)
    edges = [(i, i + 1) for i in range(400)] + [(1000, 1001 + i) for i in range(400)]
    try:
        for k, v in kept.items():
            spark.conf.set(k, v)
        got = components(spark.createDataFrame(edges, "a long, b long"))
        assert {r["node"]: r["component"] for r in got.collect()} == roots({x for e in edges for x in e}, edges)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files[1:]) <= spark.sparkContext.defaultParallelism


def test_memory_of_counting_common_shingles(spark, monkeypatch):
    """The shingles of a task were held three times over; which are common does not change."""
    monkeypatch.setattr(j, "FLUSH", 1 << 19)

    class Docs:
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):
            self.run = run
            raise StopIteration

    docs, rng = Docs(), np.random.default_rng(8)
    with pytest.raises(StopIteration):
        j.common_shingles(docs, 5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**5, 400)) for _ in range(4800)]
    texts = [t + " one two three four five six" if i % 3 == 0 else t for i, t in enumerate(texts)]
    batches = [pa.record_batch([pa.array(texts[i:i + 100])], names=["text"]) for i in range(0, 4800, 100)]
    tracemalloc.start()
    found = [x for b in docs.run(iter(batches)) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(x["n"] for x in found) == [1600, 1600] and peak < 60e6  # 31 MB of them are given back at once


def test_batches_of_stored_tables_are_small(spark):
    """2,000 rows with packed entries made a batch of up to 64 MB."""
    def run(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])

    rows = spark.range(0, 400, 1, 1).selectExpr("repeat(cast(id AS string), 20000) AS text")
    got = stored(rows.mapInArrow(run, "size long, n long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 400 and max(r["size"] for r in got) < 6e6
