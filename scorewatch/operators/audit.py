"""The append-only audit log and its views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def audit_rows(events: DataFrame) -> DataFrame:
    """Events with the date and the entity key they are stored under."""
    return events.withColumn("event_date", F.to_date("ts")).withColumn(
        "entity_key", F.concat_ws("#", "entity_type", "entity_id")
    )


def append_audit(events: DataFrame, path: str) -> None:
    """Append events to the log, one folder per date."""
    audit_rows(events).write.mode("append").partitionBy("event_date").parquet(path)


def _newest(audit: DataFrame, condition: Column) -> DataFrame:
    return audit.filter(condition).orderBy(F.desc("ts"), "event_id")


def audit_by_tenant(audit: DataFrame, tenant: str) -> DataFrame:
    return _newest(audit, F.col("tenant_id") == tenant)


def audit_by_date(audit: DataFrame, day: str) -> DataFrame:
    """All tenants, one date; only that date's folder is read."""
    return _newest(audit, F.col("event_date") == F.lit(day).cast("date"))


def audit_by_actor(audit: DataFrame, actor: str) -> DataFrame:
    return _newest(audit, F.col("actor") == actor)


def audit_by_entity(audit: DataFrame, entity_type: str, entity_id: str) -> DataFrame:
    return _newest(audit, (F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id))
