"""The stored snapshots: appended once per run, never changed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.functions.text import quoted
from scorewatch.operators.snapshots import first_write_wins, new_snapshots
from scorewatch.sources.runs import read_or_none


def read_snapshots(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored snapshots, or None before the first write."""
    return read_or_none(spark, path)


def record_snapshots(incoming: DataFrame, path: str) -> None:
    """Append the snapshots of runs that have none yet.

    Replaying the same runs adds nothing. One writer at a time: two at once need a
    table format with transactions.
    """
    stored = read_snapshots(incoming.sparkSession, path)
    # equal times: the rest of the row decides, the same way whenever a task is repeated
    ties = [F.xxhash64(*[F.to_json(F.struct(F.col(quoted(c)))) for c in sorted(incoming.columns)])]
    fresh = first_write_wins(incoming, ties=ties) if stored is None else new_snapshots(incoming, stored, ties=ties)
    fresh.write.mode("append").partitionBy("tenant_id").parquet(path)
