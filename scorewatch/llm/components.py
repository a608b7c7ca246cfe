"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.llm.common import partitions, stored

# Tables of a round are written by one task for so many edges, but by no fewer than the cluster has cores.
TASK_EDGES = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) for every node of ``edges`` (``a``, ``b``).

    Each round every node moves to the neighbour, or itself, that is first in a random but
    fixed order, and edges are taken between the places moved to. Long chains shrink by a
    constant factor a round, stars in one. Every table of a round is written out, so joins
    read plain tables and nodes with many edges can be split. The number of tasks that write
    falls with the edges that are left, as late rounds have few. Null ends and loops are
    ignored; repeated edges count once. No edges give no rows.
    """
    spark = edges.sparkSession
    own = F.col("a") != F.col("b")
    now = stored(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter(own).distinct(), "edges")
    moves, tasks = [], []
    while n := now.count():
        tasks.append(min(partitions(spark), max(spark.sparkContext.defaultParallelism, -(-n // TASK_EDGES))))
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.xxhash64(F.col("b"), F.lit(len(moves))).alias("h"), F.col("b").alias("node"))
        best = both.groupBy(F.col("a").alias("node")).agg(F.min(rank).alias("__best"))
        mine = F.struct(F.xxhash64(F.col("node"), F.lit(len(moves))).alias("h"), F.col("node"))
        first = F.struct(F.col("__best.h"), F.col("__best.node"))
        moved = best.select("node", F.when(first < mine, F.col("__best.node")).otherwise(F.col("node")).alias("to"))
        moves.append(stored(moved.coalesce(tasks[-1]), "moves"))
        to = moves[-1]
        left = now.join(to.select(F.col("node").alias("a"), F.col("to").alias("__a")), "a").select("__a", "b")
        right = left.join(to.select(F.col("node").alias("b"), F.col("to").alias("__b")), "b")
        ends = right.filter("__a <> __b").select(F.greatest("__a", "__b").alias("a"), F.least("__a", "__b").alias("b"))
        now = stored(ends.distinct().coalesce(tasks[-1]), "edges")
    if not moves:
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = moves[-1].select("node", F.col("to").alias("root"))
    for earlier, n in zip(reversed(moves[:-1]), reversed(tasks[:-1])):
        ahead = roots.select(F.col("node").alias("to"), "root")
        roots = stored(earlier.join(ahead, "to", "left").select("node", F.coalesce("root", "to").alias("root")).coalesce(n), "roots")
    least = stored(roots.groupBy("root").agg(F.min("node").alias("component")).coalesce(tasks[0]), "least")
    return stored(roots.join(least, "root").select("node", "component").coalesce(tasks[0]), "components")
