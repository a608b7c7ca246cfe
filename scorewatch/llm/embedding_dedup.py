"""Near duplicates of embeddings: spherical k-means cells, blocked cosine products inside cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import partitions, record, stored
from scorewatch.llm.components import components

SAMPLE = 8192
PER_CELL = 500
# A vector goes to so many cells, those with the closest centroids.
NEAREST = 3
BLOCK = 1024
ROUNDS = 10


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``unit``: the vector at length one in double precision, as bytes.

    ``unit`` is null for vectors that are null, empty, zero or hold a null or non-finite component.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            units = []
            for x in b.column("embedding").to_pylist():
                v = np.array(x, float) if x and None not in x else np.zeros(0)
                top = np.abs(v).max(initial=0)
                if top > 0 and np.isfinite(top):
                    v = v / top  # so that squares neither vanish nor overflow
                    units.append((v / np.sqrt((v * v).sum())).tobytes())
                else:
                    units.append(None)
            yield record({"vec_id": (b.column("vec_id"), pa.int64()), "unit": (units, pa.binary())})

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "vec_id long, unit binary")


def fit_cells(units: np.ndarray, cells: int) -> np.ndarray:
    """Spherical k-means on a sample: unit centroids."""
    c = units[:cells].copy()
    for _ in range(ROUNDS):
        own = np.argmax(units @ c.T, axis=1)
        total = np.zeros_like(c)
        np.add.at(total, own, units)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def _cells(distinct: DataFrame, centroids: dict[int, np.ndarray], nearest: int) -> DataFrame:
    """Each vector's cells, by length in bytes; those of a length without centroids are one cell."""
    shared = distinct.sparkSession.sparkContext.broadcast(centroids)
    first, n = {}, 0
    for size, c in centroids.items():
        first[size], n = n, n + len(c)

    def run(batches):
        for b in batches:
            units = b.column("unit").to_pylist()
            sizes = np.array([len(u) for u in units])
            cells: list[list[int]] = [[]] * len(units)
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                c = shared.value.get(int(size))
                if c is None:
                    own = np.full((len(rows), 1), -size)
                else:
                    cosine = np.frombuffer(b"".join([units[i] for i in rows]), "<f8").reshape(len(rows), -1) @ c.T
                    m = min(nearest, len(c))
                    own = np.sort(np.argpartition(-cosine, m - 1, axis=1)[:, :m], axis=1) + first[int(size)]
                for i, x in zip(rows, own.tolist(), strict=True):
                    cells[i] = x
            yield pa.record_batch([*b.columns, pa.array(cells, pa.list_(pa.int32()))], names=["rep", "weight", "unit", "cells"])

    return distinct.mapInArrow(run, "rep long, weight long, unit binary, cells array<int>")


def _compare(spread: DataFrame, threshold: float) -> DataFrame:
    """Links inside each (cell, block, block), by matrix products: per vector the weight linked and one vector of its group.

    A pair with several cells in common counts in the first of them only.
    """
    def compared(rows):
        cell, within = rows[0]["cell"], rows[0]["left"] == rows[0]["right"]
        units = np.frombuffer(b"".join(r["unit"] for r in rows), "<f8").reshape(len(rows), -1)
        ids, weight = np.array([r["rep"] for r in rows]), np.array([r["weight"] for r in rows], float)
        linked = units @ units.T >= threshold
        np.fill_diagonal(linked, False)
        if not within:
            side = np.array([r["mine"] for r in rows])
            linked &= side[:, None] != side
        earlier: dict[int, np.ndarray] = {}
        for i, r in enumerate(rows):
            for c in r["cells"]:
                if c < cell:
                    earlier.setdefault(c, np.zeros(len(rows), bool))[i] = True
        counted = linked.copy()
        for has in earlier.values():
            counted &= ~(has[:, None] & has)
        root, seen = ids.copy(), np.zeros(len(rows), bool)
        for i in range(len(rows)):
            wave = np.zeros(len(rows), bool)
            wave[i] = not seen[i]
            while wave.any():
                seen |= wave
                root[wave] = ids[i]
                wave = linked[wave].any(axis=0) & ~seen
        links = counted @ weight
        some = (links > 0) | (root != ids)
        return record({"id": (ids[some], pa.int64()), "links": (links[some].astype(np.int64), pa.int64()), "root": (root[some], pa.int64())})

    def run(batches):
        group, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                key = (r["cell"], r["left"], r["right"])
                if key != group:
                    if len(rows) > 1:
                        yield compared(rows)
                    group, rows = key, []
                rows.append(r)
        if len(rows) > 1:
            yield compared(rows)

    return spread.mapInArrow(run, "id long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, nearest: int = NEAREST, per_cell: int = PER_CELL) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` (the representative) of every row.

    Equal vectors are compared once and count as often as they occur, and only vectors of equal length are compared. Centroids
    are fitted on up to ``SAMPLE`` distinct vectors, in a fixed random order: one for every ``per_cell`` vectors, as far as the
    sample goes. Every vector is assigned, to its ``nearest`` cells. No pair below
    ``threshold`` links; a pair at it is found if it shares a cell (measured on random vectors: 0.995 of the pairs at a
    cosine of 0.905 and more above). Large cells are compared in blocks, so no task holds more than two blocks. Vectors without
    a unit vector have no links, as have rows with a null ``vec_id``. Rows with equal
    ``vec_id`` are vectors of their own that share a component. An empty table gives no rows.
    """
    rows = stored(unit_vectors(vectors), "units")
    valid = rows.filter("vec_id IS NOT NULL AND unit IS NOT NULL")
    distinct = stored(valid.groupBy("unit").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).select("rep", "weight", "unit"), "distinct")
    count = distinct.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    drawn = distinct.orderBy(F.xxhash64("unit"), "rep").limit(SAMPLE).select("unit").toArrow().column("unit").to_pylist()
    centroids = {}
    for size in sorted({len(u) for u in drawn}):
        sample = np.frombuffer(b"".join(u for u in drawn if len(u) == size), "<f8").reshape(-1, size // 8)
        share = count * len(sample) / len(drawn)
        centroids[size] = fit_cells(sample, int(min(len(sample), max(1, share // per_cell))))
    placed = stored(_cells(distinct, centroids, nearest), "cells")
    each = placed.withColumn("cell", F.explode("cells"))
    blocks = each.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    spread = each.join(blocks, "cell").withColumn("mine", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "cell", F.least("mine", "__other").alias("left"), F.greatest("mine", "__other").alias("right"), "mine", "rep", "weight", "unit", "cells")
    group = ["cell", "left", "right"]
    met = spread.repartition(partitions(rows.sparkSession), *group).sortWithinPartitions(*group, "rep")
    found = stored(_compare(met, threshold), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_rep = stored(
        distinct.join(links, distinct.rep == links.id, "left").join(roots, distinct.rep == roots.node, "left").select(
            "unit", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")),
        "groups")
    linked = valid.join(of_rep, "unit").select("vec_id", "n_links", F.col("component").alias("component_id"))
    alone = rows.filter(F.col("vec_id").isNull() | F.col("unit").isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
