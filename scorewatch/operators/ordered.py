"""Ordered look-back over keys that may each hold a large part of all rows.

A window over a whole key is one task per key. Here every key is cut into
slices of time. Each slice is sorted on its own; what a slice hands on to later
ones is a single row, and those rows are combined per key. The result equals
that of the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SLICE = "__slice"


def _sliced(df: DataFrame, ts: str, width: str) -> DataFrame:
    return df.withColumn(_SLICE, F.date_trunc(width, F.col(ts)))


def with_last(
    df: DataFrame,
    keys: list[str],
    ts: str,
    values: dict[str, Column],
    *,
    ties: list[str] = (),
    inclusive: bool = False,
    width: str = "day",
) -> DataFrame:
    """Add, for every row, the last non-null value of each expression before it.

    Rows of a key are ordered by ``ts`` and then ``ties``, which should make the
    order unique. ``inclusive`` lets the row itself count. Wrap an expression in
    ``F.struct`` when its own NULLs should be seen. ``keys`` must not be NULL.
    """
    order = [ts, *ties]
    sliced = _sliced(df, ts, width)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)

    local = sliced.select("*", *[F.last(v, True).over(inside).alias(f"__in_{n}") for n, v in values.items()])
    ends = sliced.groupBy(*keys, _SLICE).agg(
        *[F.max_by(v, F.when(v.isNotNull(), F.struct(*order))).alias(n) for n, v in values.items()]
    )
    carried = ends.select(*keys, _SLICE, *[F.last(n, True).over(across).alias(f"__up_{n}") for n in values])
    joined = local.join(carried, [*keys, _SLICE], "left")
    return joined.select(*df.columns, *[F.coalesce(f"__in_{n}", f"__up_{n}").alias(n) for n in values])


def with_sequence(
    df: DataFrame, keys: list[str], ts: str, *, ties: list[str] = (), width: str = "day"
) -> DataFrame:
    """Add ``seq`` (1 for the first row of a key) and ``total`` (rows of the key)."""
    sliced = _sliced(df, ts, width)
    inside = Window.partitionBy(*keys, _SLICE).orderBy(ts, *ties)
    across = Window.partitionBy(*keys).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)

    counts = (
        sliced.groupBy(*keys, _SLICE).agg(F.count("*").alias("__n"))
        .select(
            *keys, _SLICE,
            F.coalesce(F.sum("__n").over(across), F.lit(0)).alias("__before"),
            F.sum("__n").over(whole).alias("total"),
        )
    )
    local = sliced.withColumn("__seq", F.row_number().over(inside))
    return local.join(counts, [*keys, _SLICE], "inner").select(
        *df.columns, (F.col("__before") + F.col("__seq")).alias("seq"), "total"
    )
