"""Joining a large table with one that is usually, but not surely, small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.text import quoted
from scorewatch.session import table_bytes

BROADCAST_BYTES = 64 * 1024 * 1024
# A key with more than this share of the rows is hot; at most 1 / share such keys exist.
HOT_SHARE = 0.005
SALTS = 256
LEFT_JOINS = ("left", "inner", "left_semi", "left_anti")


def lookup_join(
    big: DataFrame,
    small: DataFrame,
    on: list[str],
    how: str = "left",
    *,
    small_bytes: int | None = None,
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Join ``big`` with ``small`` on equal columns, keeping the rows of ``big``.

    ``small`` is measured (unless the caller has done so) and broadcast when it
    fits, so ``big`` is not shuffled. Otherwise both sides are shuffled, with the
    rows of hot keys spread over many tasks.
    """
    if how not in LEFT_JOINS:
        raise ValueError(f"lookup_join cannot do a '{how}' join")
    size = table_bytes(small) if small_bytes is None else small_bytes
    if size <= limit:
        return big.join(F.broadcast(small), on, how)
    return _spread_join(big, small, on, how)


def _spread_join(big: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """Shuffle join in which the rows of each hot key go to many tasks.

    Hot keys are counted exactly. There are at most ``1 / HOT_SHARE`` of them, so
    their list is safe to broadcast and only their rows of ``small`` are copied.
    """
    total = big.agg(F.count("*").alias("n")).first()["n"]
    hot = (
        big.groupBy(*on).agg(F.count("*").alias("__n"))
        .filter(F.col("__n") > total * HOT_SHARE)
        .select(*on, F.lit(True).alias("__hot"))
    )
    # the hash tells rows of a key apart, the partition id tells copies apart;
    # both stay the same when a lost task runs again
    payload = [quoted(f.name) for f in big.schema.fields if not _has_map(f.dataType.simpleString())]
    salt = F.pmod(F.xxhash64(*payload, F.spark_partition_id()), F.lit(SALTS)).cast("int")
    left = big.join(F.broadcast(hot), on, "left").withColumn("__salt", F.when(F.col("__hot"), salt).otherwise(0))
    right = small.join(F.broadcast(hot), on, "left").withColumn(
        "__salt", F.explode(F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    )
    return left.drop("__hot").join(right.drop("__hot"), [*on, "__salt"], how).drop("__salt")


def _has_map(type_name: str) -> bool:
    return "map<" in type_name or "variant" in type_name
