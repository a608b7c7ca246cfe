"""Monitoring snapshots: one row per scored run, and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.status import derive_status, failure_reason, gate, resolve_thresholds
from scorewatch.operators.lookup import lookup_join
from scorewatch.operators.ordered import with_last
from scorewatch.values import MODEL_KEYS, RUN_KEYS


def with_thresholds(runs: DataFrame, models: DataFrame) -> DataFrame:
    """Add each run's limits; a model nobody registered gets the global ones."""
    limits = models.select(
        *[F.col(k).cast("string").alias(k) for k in MODEL_KEYS], "psi_fail_override", "err_fail_override",
        F.lit(True).alias("model_known"),
    )
    joined = lookup_join(runs, limits, MODEL_KEYS)
    return (
        joined.withColumn("thresholds", resolve_thresholds(F.col("psi_fail_override"), F.col("err_fail_override")))
        .withColumn("model_known", F.coalesce("model_known", F.lit(False)))
        .drop("psi_fail_override", "err_fail_override")
    )


def build_snapshots(reports: DataFrame, models: DataFrame) -> DataFrame:
    """Snapshots from the rows of ``dq_report``: limits and derived status added."""
    evidence = [F.col("max_psi"), F.col("error_rate"), F.col("dq_passed"), F.col("thresholds")]
    return with_thresholds(reports, models).withColumn("derived_status", derive_status(*evidence))


def with_gate(snapshots: DataFrame) -> DataFrame:
    """Add ``gate_passed`` and, where it is false, ``gate_reason``."""
    evidence = [F.col("max_psi"), F.col("error_rate"), F.col("dq_passed"), F.col("thresholds")]
    passed = gate(F.col("derived_status"), F.col("dq_passed"))
    reason = (
        F.when(F.col("derived_status").isNull(), "Data quality checks failed").otherwise(failure_reason(*evidence))
    )
    return snapshots.withColumn("gate_passed", passed).withColumn("gate_reason", F.when(~passed, reason))


def first_write_wins(snapshots: DataFrame, keys: list[str] = RUN_KEYS, ties: list[str] = ()) -> DataFrame:
    """One snapshot per run: the earliest; later ones for the same run are dropped."""
    rest = [c for c in snapshots.columns if c not in keys]
    kept = snapshots.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("recorded_at", *ties)).alias("s"))
    return kept.select(*keys, "s.*").select(*snapshots.columns)


def new_snapshots(incoming: DataFrame, stored: DataFrame, ties: list[str] = ()) -> DataFrame:
    """The incoming snapshots that may be appended: first of their run, not stored yet."""
    return first_write_wins(incoming, ties=ties).join(stored.select(*RUN_KEYS), RUN_KEYS, "left_anti")


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each model version."""
    rest = [c for c in snapshots.columns if c not in MODEL_KEYS]
    newest = F.max_by(F.struct(*rest), F.struct("recorded_at", "job_id", "run_id"))
    return snapshots.groupBy(*MODEL_KEYS).agg(newest.alias("s")).select(*MODEL_KEYS, "s.*").select(*snapshots.columns)


def current_status(models: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Models with the status and time of their newest snapshot, NotStarted without one."""
    newest = F.max_by(F.struct("derived_status", "recorded_at"), F.struct("recorded_at", "job_id", "run_id"))
    states = snapshots.groupBy(*MODEL_KEYS).agg(newest.alias("s"))
    joined = models.drop("monitoring_status", "last_snapshot_at").join(states, MODEL_KEYS, "left")
    return joined.select(
        *[c for c in joined.columns if c != "s"],
        F.coalesce("s.derived_status", F.lit("NotStarted")).alias("monitoring_status"),
        F.col("s.recorded_at").alias("last_snapshot_at"),
    )


def missing_snapshot_models(models: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Models that never had a snapshot."""
    return models.join(snapshots.select(*MODEL_KEYS).distinct(), MODEL_KEYS, "left_anti")


def previous_row_count(snapshots: DataFrame, width: str = "month") -> DataFrame:
    """Add the row count of the model's snapshot before; none, or 0 rows, gives NULL."""
    count = {"__prev": F.struct("request_count")}
    seen = with_last(snapshots, MODEL_KEYS, "recorded_at", count, ties=["job_id", "run_id"], width=width)
    return seen.withColumn("previous_row_count", F.nullif(F.col("__prev")["request_count"], F.lit(0))).drop("__prev")


def row_count_delta(rows: Column, previous: Column) -> Column:
    """Relative change of the row count; 0 for a first run."""
    return F.when(previous.isNull() | (previous == 0), 0.0).otherwise(F.abs(rows - previous) / previous)


def publishable_runs(runs: DataFrame, snapshots: DataFrame, approvals: DataFrame) -> DataFrame:
    """Runs that may be loaded: past the gate, and approved where approval is asked for.

    ``runs`` has the run keys and ``requires_approval``; ``approvals`` the run keys
    and ``approved``. A run's first snapshot counts.
    """
    passed = with_gate(first_write_wins(snapshots)).filter("gate_passed").select(*RUN_KEYS)
    approved = approvals.filter("approved").select(*RUN_KEYS).distinct().withColumn("__ok", F.lit(True))
    return (
        runs.join(passed, RUN_KEYS, "left_semi").join(approved, RUN_KEYS, "left")
        .filter(~F.col("requires_approval") | F.col("__ok")).drop("__ok")
    )
