"""Exact top-k search against brute force."""

import math

import numpy as np
import pytest

from scorewatch.llm import exact_search as s

SCHEMA = "vec_id long, embedding array<float>, vector string, size int"


def brute(rows, k=20):
    """Rows as the contract defines them; equal rows count once."""
    kept = {(i, tuple(math.floor(64 * float(np.float32(x))) for x in v)) for i, v, *_ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for i, q in kept:
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(q, x)), j) for j, x in kept if j != i and len(x) == len(q))
            out += [(i, r + 1, j, -score) for r, (score, j) in enumerate(scores[:k])]
    return sorted(out)


def found(spark, rows, **options):
    return sorted(map(tuple, s.top_products(spark.createDataFrame(rows, SCHEMA), **options).collect()))


def vectors(seed, n, size=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, size))
    points = centres[rng.integers(5, size=n)] + rng.normal(scale=0.2, size=(n, size))
    return [(i, [float(x) for x in p], "x", 1) for i, p in enumerate(points)]


@pytest.mark.parametrize("annulus, region", [(1024, 16384), (16, 64), (1, 5)])
def test_equals_brute_force(spark, annulus, region):
    rows = vectors(1, 400)
    # a third of all rows is one vector; some are zero, empty, of other lengths, null, not finite or repeated
    rows += [(1000 + i, rows[3][1], None, None) for i in range(200)]
    rows += [(2000, [0.0] * 8, "z", 0), (2001, [-0.0] * 8, "z", 0), (2020, [], "", 0), (2021, [], "", 0), (2040, [1.0, 2.0], "", 0), (2041, [3.0, -2.0], "", 0)]
    rows += [(3000, None, "", 0), (3020, [1.0] * 7 + [None], "", 0), (3040, [math.nan] * 8, "", 0), (3060, [math.inf] + [0.0] * 7, "", 0), (None, [1.0] * 8, "", 0)]
    rows += rows[20:30] + rows[20:25]
    assert found(spark, rows, annulus=annulus, region=region) == brute(rows)


def test_fewer_partners_and_ties(spark):
    rows = [(i, [1.0, 1.0], "", 0) for i in range(5)] + [(20, [2.0, 0.0], "", 0)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows, k=2) == brute(rows, 2)
    assert found(spark, [(20, [1.0], "", 0)]) == []


def test_empty_table(spark):
    assert found(spark, []) == []


def test_large_components_stay_exact(spark):
    rows = [(i, [float(2 ** (16 + i % 7)) + i, float(i) * 1e5], "", 0) for i in range(60)]
    assert found(spark, rows) == brute(rows)
    huge = [(i, [1e30, 1.0], "", 0) for i in range(3)]
    assert {r[3] for r in found(spark, huge)} == {2 ** 63 - 1}


def test_bounds_spare_annuli(monkeypatch):
    """A query near its pivot does not look at annuli out of its reach."""
    rng = np.random.default_rng(2)
    near, far = np.floor(rng.normal(scale=3, size=(50, 4))), np.floor(1000 + rng.normal(scale=3, size=(50, 4)))
    most = float(max((near ** 2).sum(1).max(), (far ** 2).sum(1).max()))
    pivots = s.Pivots({4: np.vstack([np.zeros((1, 4)), far[:1]])}, {4: np.array([most ** 0.5, 0.0])}, most)
    ids = [[i] for i in range(50)]
    d = pivots.distances(far, pivots.lift((far ** 2).sum(1)))[:, 1]
    e = pivots.distances(near, pivots.lift((near ** 2).sum(1)))[:, 1]
    annuli = [(1, 4, 1, e.min(), e.max(), near, ids), (2, 4, 1, d.min(), d.max(), far, ids)]
    looked = []
    whole = s.exact_products
    monkeypatch.setattr(s, "exact_products", lambda q, x: looked.append(len(x)) or whole(q, x))
    row = {"block": 2, "size": 4, "places": [0], "reach": [np.inf]}
    list(s._look_up(row, far[:1], annuli, pivots, 5))
    assert looked == [50]
