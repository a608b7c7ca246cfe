"""Exact search for the largest inner products by a pivot-distance index.

With one more coordinate, the root of what a vector's squared norm lacks to the largest one, all
vectors have equal norms; then a larger inner product with a query (which has 0 there) is a smaller
distance. Each distinct vector is keyed by its nearest pivot and its distance from it and sorted by
that; runs of the order are annuli around a pivot. For a query at distance D from the pivot no
vector of an annulus [low, high] is nearer than max(D - high, low - D, 0).

The vectors of an annulus that are queries form a batch. What they find in their own annulus
limits how far they must look: a batch goes to the regions (runs of annuli) that hold an annulus
within reach, and there takes the annuli in the order of their bounds until none can improve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scorewatch.llm.common import partitions, record, stored

#: Vectors of an annulus and of a region at most, vectors from which pivots are chosen, pivots at most.
ANNULUS = 1024
REGION = 16_384
SAMPLE = 4096
MOST_PIVOTS = 1024
#: Copies of a region at most, so that few regions still keep many tasks busy.
MOST_COPIES = 8
_EXACT = 2.0 ** 53
_LONG = 2 ** 63
_SQUARES = 1e300


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vec_id``, ``size``, ``vector``: components ``floor(scale * x)`` as binary doubles.

    Rows without an id, or whose vector is null or holds a null or non-finite component, go (also one whose product
    with ``scale`` is not finite). Rows that repeat both id and vector are left to ``distinct_vectors``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                lists = part.column("embedding")
                lengths = np.array(lists.value_lengths().fill_null(-1))
                values = lists.flatten()
                missing = np.array(values.is_null())
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * values.fill_null(0).to_numpy(zero_copy_only=False)) + 0.0
                bad = missing | ~np.isfinite(x)
                ends = np.cumsum(np.maximum(lengths, 0))
                faults = np.concatenate([[0], np.cumsum(bad)])
                starts = ends - np.maximum(lengths, 0)
                good = np.flatnonzero((lengths >= 0) & (faults[ends] == faults[starts]))
                raw = x.tobytes()
                yield record({
                    "vec_id": (part.column("vec_id").take(pa.array(good)), pa.int64()), "size": (lengths[good], pa.int32()),
                    "vector": ([raw[8 * starts[i]:8 * ends[i]] for i in good], pa.binary())})

    rows = vectors.filter("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, size int, vector binary")


def distinct_vectors(rows: DataFrame, is_query: str, k: int) -> DataFrame:
    """``size``, ``vector``, ``asked``, ``ids``: each vector once, with its ``k + 1`` smallest ids, and whether a query has it.

    A query drops its own id only, so of equal vectors no more ids can be among its first ``k``.
    Each task passes at most that many rows of a vector on.
    """
    flagged = rows.withColumn("asked", F.expr(is_query))
    first = Window.partitionBy("size", "vector", "asked").orderBy("vec_id")
    few = flagged.withColumn("__n", F.dense_rank().over(first)).filter(F.col("__n") <= k + 1)
    ids = F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1)
    return few.groupBy("size", "vector").agg(F.bool_or("asked").alias("asked"), ids.alias("ids"))


def _matrix(vectors: list[bytes], size: int) -> np.ndarray:
    return _rows(b"".join(vectors), len(vectors), size)


def _rows(raw: bytes, n: int, size: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(n, size)


@dataclass
class Pivots:
    """Pivots by vector length and the largest squared norm. Pivot 0 of each length is the origin.

    Where squares of components do not fit a double, all distances are 0 and nothing is skipped.
    """

    points: dict[int, np.ndarray]
    lifted: dict[int, np.ndarray]
    most: float

    def lift(self, norms: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.most - norms, 0))

    def distances(self, x: np.ndarray, lifted: np.ndarray) -> np.ndarray:
        size = x.shape[1]
        points = self.points.get(size, np.zeros((1, size)))
        if not self.most < _SQUARES:
            return np.zeros((len(x), len(points)))
        up = self.lifted.get(size, np.array([np.sqrt(self.most)]))
        squares = (x * x).sum(1)[:, None] + (points * points).sum(1)[None] - 2 * x @ points.T + (lifted[:, None] - up[None]) ** 2
        return np.sqrt(np.maximum(squares, 0))


def choose_pivots(vectors: DataFrame, sample: int = SAMPLE, most: int = MOST_PIVOTS) -> tuple[Pivots, int]:
    """Pivots far from each other, from ``sample`` vectors with the lowest hashes; and the number of vectors.

    About a quarter of the root of the number of vectors, at most ``most``. They shape the index, not the result.
    """
    total = vectors.agg(F.count("*").alias("n")).first()["n"]
    lowest = vectors.select("size", "vector", F.xxhash64("vector").alias("h")).orderBy("h", "vector").limit(sample).collect()
    largest = _largest_norm(vectors)
    if not largest < _SQUARES:
        return Pivots({}, {}, largest), total
    want = max(1, min(most, ceil(total ** 0.5 / 4)))
    pivots = Pivots({}, {}, largest)
    for size in sorted({r["size"] for r in lowest}):
        x = _matrix([r["vector"] for r in lowest if r["size"] == size], size)
        up = pivots.lift((x * x).sum(1))
        points = np.column_stack([x, up])
        chosen = [0]
        gap = ((points - points[0]) ** 2).sum(1)
        while len(chosen) < min(want, len(x)) and gap.max() > 0:
            chosen.append(int(gap.argmax()))
            gap = np.minimum(gap, ((points - points[chosen[-1]]) ** 2).sum(1))
        pivots.points[size] = np.vstack([np.zeros((1, size)), x[chosen]])
        pivots.lifted[size] = np.append(np.sqrt(largest), up[chosen])
    return pivots, total


def _largest_norm(vectors: DataFrame) -> float:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for batch in batches:
            for v in batch.column("vector"):
                x = np.frombuffer(v.as_py(), np.float64)
                with np.errstate(over="ignore"):
                    most = max(most, float(x @ x))
        yield record({"norm": ([most], pa.float64())})

    return vectors.select("vector").mapInArrow(run, "norm double").agg(F.max("norm").alias("m")).first()["m"] or 0.0


def exact_products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of whole-valued doubles: in doubles where every partial sum is exact, else in Python integers."""
    bound = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * queries.shape[1]
    if bound < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = [[[int(c) for c in row] for row in m] for m in (queries, vectors)]
    return np.array([[sum(a * b for a, b in zip(q, v, strict=True)) for v in whole[1]] for q in whole[0]], object).reshape(len(queries), len(vectors))


class Best:
    """The best ``k`` (score, id) of each query so far; equal scores go to smaller ids."""

    def __init__(self, n: int, k: int) -> None:
        self.k = k
        self.found: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def least(self, i: int) -> int | None:
        """The score that a further vector must have, once there are ``k``."""
        return -self.found[i][-1][0] if len(self.found[i]) == self.k else None

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: list[list[int]]) -> None:
        """Scores of the queries ``rows`` against vectors with the given ids."""
        for j, (i, top) in enumerate(zip(rows, scores.max(1), strict=True)):
            floor = self.least(i)
            if floor is not None and top < floor:
                continue
            near = np.arange(scores.shape[1]) if floor is None else np.flatnonzero(scores[j] >= floor)
            if len(near) > self.k:  # each vector has an id at least, so only the first k scores and their ties matter
                limit = np.sort(scores[j][near])[-self.k]
                near = near[scores[j][near] >= limit]
            new = [(-int(scores[j][v]), x) for v in near for x in ids[v]]
            self.found[i] = sorted({*self.found[i], *new})[:self.k]

    def reach(self, norms: np.ndarray, most: float) -> np.ndarray:
        """The largest distance at which a vector can still count, with some slack for rounding."""
        least = np.array([np.nan if (x := self.least(i)) is None else float(x) for i in range(len(norms))])
        squares = np.maximum(norms + most - 2 * least, 0) + 1e-9 * (norms + most) + 1e-6
        return np.where(np.isnan(least) | (not most < _SQUARES), np.inf, np.sqrt(squares) * (1 + 1e-9))


def _lower_bound(distance: np.ndarray, low: float, high: float) -> np.ndarray:
    return np.maximum(np.maximum(distance - high, low - distance), 0)


_ANNULI = "block long, region long, size int, pivot int, low double, high double, vectors binary, ids array<array<long>>, queries binary, places array<int>, reach array<double>"


def build_index(vectors: DataFrame, pivots: Pivots, total: int, k: int, annulus: int, region: int) -> DataFrame:
    """One row per annulus: its vectors and ids, which of them are queries, and how far each of these must look."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                sizes = np.array(part.column("size"))
                raw = part.column("vector").to_pylist()
                pivot, distance = np.zeros(len(sizes), np.int32), np.zeros(len(sizes))
                for size in np.unique(sizes):
                    rows = np.flatnonzero(sizes == size)
                    x = _matrix([raw[i] for i in rows], size)
                    d = own.distances(x, own.lift((x * x).sum(1)))
                    pivot[rows] = d.argmin(1)
                    distance[rows] = d.min(1)
                columns = {name: (part.column(name), part.column(name).type) for name in part.schema.names}
                yield record(columns | {"pivot": (pivot, pa.int32()), "distance": (distance, pa.float64())})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, numbers = shared.value, _Numbers(region)
        held: list[dict] = []
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for row in batch.slice(start, 256).to_pylist():
                    if held and (len(held) == annulus or (held[0]["size"], held[0]["pivot"]) != (row["size"], row["pivot"])):
                        yield _annulus(held, own, k, *numbers.next(len(held)))
                        held = []
                    held.append(row)
        if held:
            yield _annulus(held, own, k, *numbers.next(len(held)))

    keyed = vectors.mapInArrow(assign, "size int, vector binary, asked boolean, ids array<long>, pivot int, distance double")
    keys = ["size", "pivot", "distance", "vector"]
    ordered = keyed.repartitionByRange(max(1, ceil(total / region)), *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(cut, _ANNULI)


class _Numbers:
    """Numbers of annuli and of the regions they fill, unique over all tasks."""

    def __init__(self, region: int) -> None:
        self.start = TaskContext.get().partitionId() << 32
        self.count = self.room = self.region = 0
        self.size = region

    def next(self, n: int) -> tuple[int, int]:
        if self.room < n:
            self.region, self.room = self.start + self.count, self.size
        self.room -= n
        self.count += 1
        return self.start + self.count - 1, self.region


def _annulus(rows: list[dict], pivots: Pivots, k: int, block: int, region: int) -> pa.RecordBatch:
    size = rows[0]["size"]
    x = _matrix([r["vector"] for r in rows], size)
    places = np.array([i for i, r in enumerate(rows) if r["asked"]], np.int64)
    best = Best(len(places), k + 1)
    if len(places):
        best.add(np.arange(len(places)), exact_products(x[places], x), [r["ids"] for r in rows])
    with np.errstate(over="ignore", invalid="ignore"):
        reach = best.reach((x[places] ** 2).sum(1), pivots.most)
    return record({
        "block": ([block], pa.int64()), "region": ([region], pa.int64()), "size": ([size], pa.int32()), "pivot": ([rows[0]["pivot"]], pa.int32()),
        "low": ([rows[0]["distance"]], pa.float64()), "high": ([rows[-1]["distance"]], pa.float64()), "vectors": ([x.tobytes()], pa.binary()),
        "ids": ([[r["ids"] for r in rows]], pa.list_(pa.list_(pa.int64()))), "queries": ([x[places].tobytes()], pa.binary()), "places": ([places.astype(np.int32)], pa.list_(pa.int32())),
        "reach": ([reach], pa.list_(pa.float64()))})


def _batches(index: DataFrame, pivots: Pivots) -> DataFrame:
    """One row per annulus with queries and pivot, with the range of distances from that pivot that the queries reach."""
    shared = index.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in (r for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
                x = _rows(row["queries"], len(row["places"]), row["size"])
                d = shared.value.distances(x, np.zeros(len(x)))
                reach = np.array(row["reach"])[:, None]
                low, high = (d - reach).min(0), (d + reach).max(0)
                n = len(low)
                yield record({
                    "batch": ([row["block"]] * n, pa.int64()), "size": ([row["size"]] * n, pa.int32()), "pivot": (np.arange(n, dtype=np.int32), pa.int32()),
                    "from": (low, pa.float64()), "to": (high, pa.float64())})

    return index.select("block", "size", "queries", "places", "reach").mapInArrow(run, "batch long, size int, pivot int, from double, to double")


def _search(shared: Broadcast, k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each cell: keep its annuli, then look up one batch of queries after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, annuli = None, []
        for row in (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()):
            if (row["region"], row["copy"]) != cell:
                cell, annuli = (row["region"], row["copy"]), []
            x = _rows(row["vectors"], len(row["places" if row["kind"] else "ids"]), row["size"])
            if row["kind"] == 0:
                annuli.append((row["block"], row["size"], row["pivot"], row["low"], row["high"], x, row["ids"]))
            else:
                yield from _look_up(row, x, annuli, shared.value, k)

    return run


def _look_up(row: dict, queries: np.ndarray, annuli: list[tuple], pivots: Pivots, k: int) -> Iterator[pa.RecordBatch]:
    n = len(queries)
    with np.errstate(over="ignore"):
        norms = (queries ** 2).sum(1)
    distances = pivots.distances(queries, np.zeros(n))
    reach = np.array(row["reach"])
    best = Best(n, k + 1)
    mine = [a for a in annuli if a[1] == row["size"]]
    bounds = [_lower_bound(distances[:, a[2]], a[3], a[4]) for a in mine]
    for j in sorted(range(len(mine)), key=lambda j: bounds[j].min()):
        rows = np.flatnonzero(bounds[j] <= reach)
        if len(rows):
            _, _, _, _, _, x, ids = mine[j]
            best.add(rows, exact_products(queries[rows], x), ids)
            with np.errstate(invalid="ignore"):
                reach = np.minimum(reach, best.reach(norms, pivots.most))
        elif bounds[j].min() > reach.max():
            break
    pairs = [(i, -s, v) for i in range(n) for s, v in best.found[i]]
    yield record({
        "batch": ([row["block"]] * len(pairs), pa.int64()), "place": ([row["places"][i] for i, _, _ in pairs], pa.int32()),
        "score": ([max(-_LONG, min(_LONG - 1, s)) for _, s, _ in pairs], pa.int64()), "vec_id": ([v for _, _, v in pairs], pa.int64())})


def top_products(
    vectors: DataFrame, is_query: str = "pmod(vec_id, 20) = 0", k: int = 20, scale: int = 64, annulus: int = ANNULUS, region: int = REGION,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: the ``k`` largest integer inner products of each query with all other vectors.

    ``vectors`` has ``vec_id`` and ``embedding``; other columns are ignored. ``is_query`` is a condition
    on ``vec_id``. Ties go to the smaller id; a query with fewer partners gets all of them. Rows without id, null vectors and
    vectors with null or non-finite components take no part, empty and zero vectors do. Only vectors of equal length
    have a product. Rows that repeat id and vector count once; an id with several vectors is as many queries and
    candidates, never its own candidate. A product beyond a long counts as the nearest long. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = stored(quantise(vectors, scale), "quantised")
    distinct = stored(distinct_vectors(rows, is_query, k), "distinct-vectors")
    pivots, total = choose_pivots(distinct)
    index = stored(build_index(distinct, pivots, total, k, annulus, region), "annuli")
    asked = index.filter("size(places) > 0")
    shared = spark.sparkContext.broadcast(pivots)

    copies = max(1, min(MOST_COPIES, ceil(2 * partitions(spark) * region / max(1, total))))
    copy = F.pmod(F.xxhash64("block"), F.lit(copies)).cast("int")
    ranges = index.groupBy("region", "size", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    reached = _batches(asked, pivots).join(ranges, ["size", "pivot"]).filter((F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low")))
    query = F.struct("block", "size", F.col("queries").alias("vectors"), "places", "reach").alias("q")
    sent = asked.select(query, F.col("block").alias("batch")).join(reached.select("batch", "region").distinct(), "batch")
    nothing = {"pivot": "int", "low": "double", "high": "double", "ids": "array<array<long>>"}
    questions = sent.select("q.*", "region", F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in nothing.items())).withColumn("copy", copy)
    answers = index.select(
        "block", "size", "vectors", F.lit(None).cast("array<int>").alias("places"), F.lit(None).cast("array<double>").alias("reach"),
        "region", F.lit(0).alias("kind"), *nothing, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    cells = answers.unionByName(questions).repartition("region", "copy").sortWithinPartitions("region", "copy", "kind", "block")
    found = cells.mapInArrow(_search(shared, k), "batch long, place int, score long, vec_id long")
    order = Window.partitionBy("batch", "place").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("__n", F.row_number().over(order)).filter(F.col("__n") <= k + 1).drop("__n")

    width = F.col("size") * 8
    own = F.transform(F.sequence(F.lit(0), F.size("places") - 1), lambda i: F.substring(F.col("queries"), i * width + 1, width))
    named = asked.select(F.col("block").alias("batch"), "size", F.explode(F.arrays_zip(F.col("places").alias("place"), own.alias("vector"))).alias("x"))
    named = named.select("batch", "size", "x.place", "x.vector")
    query_rows = rows.filter(is_query).select(F.col("vec_id").alias("query_id"), "size", "vector").distinct()
    mine = query_rows.join(named, ["size", "vector"]).join(best, ["batch", "place"]).filter("query_id <> vec_id")
    last = Window.partitionBy("query_id", "batch", "place").orderBy(F.desc("score"), "vec_id")
    return mine.withColumn("rank", F.row_number().over(last)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
