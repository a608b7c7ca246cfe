"""Numbering and history of the runs of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.operators.ordered import with_sequence

JOB_KEYS = ["tenant_id", "job_id"]


def number_runs(runs: DataFrame, ts: str, ties: list[str] = (), width: str = "day") -> DataFrame:
    """Add ``run_id``: RUN-0001, RUN-0002 and so on within each job."""
    numbered = with_sequence(runs, JOB_KEYS, ts, ties=ties, width=width)
    return numbered.withColumn("run_id", F.format_string("RUN-%04d", "seq")).drop("seq", "total")


def trim_history(
    runs: DataFrame, ts: str, detail: list[str], keep: int, ties: list[str] = (), width: str = "day"
) -> DataFrame:
    """Blank the ``detail`` columns of all but the newest ``keep`` runs of each job."""
    numbered = with_sequence(runs, JOB_KEYS, ts, ties=ties, width=width)
    kept = F.col("total") - F.col("seq") < keep
    return numbered.withColumns({c: F.when(kept, F.col(c)) for c in detail}).drop("seq", "total")


def trim_nested_history(jobs: DataFrame, keep: int) -> DataFrame:
    """The same for jobs that carry their history as an array, oldest run first."""
    fields = [f.name for f in jobs.schema["run_history"].dataType.elementType.fields]
    trimmed = F.transform("run_history", lambda r, i: F.struct(*[
        F.when(F.size("run_history") - i <= keep, r[f]).alias(f) if f == "steps" else r[f].alias(f) for f in fields
    ]))
    return jobs.withColumn("run_history", trimmed)
