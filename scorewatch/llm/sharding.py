"""Shards of nearly equal size by best-fit-decreasing bin packing of indivisible groups."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewatch.llm.common import partitions, stored

ITEMS_PER_SHARD = 256
SEARCH_STEPS = 12


class CapacityTree:
    """A balanced search tree (treap with fixed seeds) of bins by remaining capacity."""

    def __init__(self):
        self._root, self._random = None, random.Random(7)

    def add(self, key: tuple) -> None:
        left, right = self._split(self._root, key)
        self._root = self._merge(self._merge(left, [key, self._random.random(), None, None]), right)

    def take_at_least(self, key: tuple) -> tuple | None:
        """Remove and return the least key that is not below ``key``."""
        left, right = self._split(self._root, key)
        if right is None:
            self._root = left
            return None
        parent, node = None, right
        while node[2] is not None:
            parent, node = node, node[2]
        if parent is None:
            right = node[3]
        else:
            parent[2] = node[3]
        self._root = self._merge(left, right)
        return node[0]

    def _split(self, node, key):
        """Nodes below ``key``, and the others."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], rest = self._split(node[3], key)
            return node, rest
        rest, node[2] = self._split(node[2], key)
        return rest, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item: from large to small, the fullest bin with room, else a new one.

    An item larger than the capacity gets a bin of its own.
    """
    bins, tree, out = 0, CapacityTree(), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take_at_least((sizes[i], -1))
        room, own = found if found else (max(capacity, sizes[i]), bins)
        bins += found is None
        out[i] = own
        tree.add((room - sizes[i], own))
    return out


def fit_into(sizes: list[int], shards: int) -> list[int]:
    """Best fit decreasing at about the least capacity that needs no more than ``shards`` bins."""
    total, largest = sum(sizes), max(sizes, default=0)
    low = max(-(-total // shards), largest)
    best = best_fit_decreasing(sizes, low)
    if max(best, default=-1) < shards:
        return best
    high = max(2 * low, 1)
    best = best_fit_decreasing(sizes, high)
    for _ in range(SEARCH_STEPS):
        middle = (low + high) // 2
        tried = best_fit_decreasing(sizes, middle)
        if max(tried) < shards:
            best, high = tried, middle
        else:
            low = middle + 1
    return best


def shard(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard`` and ``slot`` of every row; shards are near equal in bytes.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Equal texts are one group and stay
    together, unless they are more than a shard's fair part; such a group is dealt by document into
    parts of about that size. Groups larger than one in ``ITEMS_PER_SHARD`` of a shard are packed one by one,
    smaller ones in bundles by a hash of the text; so there are at most some ``2 * shards * ITEMS_PER_SHARD``
    items for the packing, however many documents there are. Slots run from 0 in ``doc_id`` order.
    A null ``doc_id`` comes first, repeated rows get slots of their own; an empty table has no rows.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(
        F.col("doc_id").cast("long"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")).alias("__group"),
    ), "sizes")
    groups = stored(rows.groupBy("__group").agg(F.sum("size").alias("bytes")), "groups")
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("n")).first()["n"]
    fair, small = max(1, -(-total // shards)), max(1, total // (shards * ITEMS_PER_SHARD))
    bundle = F.pmod(F.xxhash64("__group"), F.lit(shards * ITEMS_PER_SHARD))
    # at most shards * ITEMS_PER_SHARD groups are larger than ``small``
    large = groups.filter(F.col("bytes") > small).select("__group", F.ceil(F.col("bytes") / fair).alias("__parts"))
    named = rows.join(F.broadcast(large), "__group", "left")
    part = F.when(F.col("__parts") > 1, F.pmod(F.xxhash64("doc_id"), F.col("__parts") * 4)).otherwise(0)
    item = F.when(F.col("__parts").isNull(), F.concat(F.lit("b"), bundle)).otherwise(F.concat(F.lit("g"), F.hex("__group"), F.lit("/"), part))
    named = named.select("doc_id", "size", "text_crc32", item.alias("__item"))
    items = named.groupBy("__item").agg(F.sum("size").alias("n")).orderBy(F.desc("n"), "__item").collect()
    bins = fit_into([r["n"] for r in items], shards)
    where = spark.createDataFrame([(r["__item"], b) for r, b in zip(items, bins)], "__item string, shard int")
    placed = named.join(F.broadcast(where), "__item").drop("__item")
    ordered = stored(
        placed.repartitionByRange(partitions(spark), "doc_id", "text_crc32", "size").withColumn("__part", F.spark_partition_id()), "placed")
    # rows of a shard are numbered part by part
    before = Window.partitionBy("shard").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ordered.groupBy("shard", "__part").agg(F.count("*").alias("__n")).select(
        "shard", "__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("shard", "__part").orderBy("doc_id", "text_crc32", "size")
    return ordered.withColumn("__own", F.row_number().over(inside) - 1).join(F.broadcast(counts), ["shard", "__part"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("__own") + F.col("__before")).alias("slot"))
