"""Column expressions over a job's or a definition's ordered array of steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorewatch.values import RUNNABLE_STEP_TYPES, STEP_ORDER, TERMINAL_JOB_STATUSES


def execute_ref(steps: Column) -> Column:
    """struct<model_name, model_version> of the first execute step, NULL if incomplete."""
    config = F.get(F.filter(steps, lambda s: s["type"] == "execute_model"), F.lit(0))["config"]
    name, version = config["model_name"], config["model_version"]
    return F.when(
        (F.coalesce(name, F.lit("")) != "") & version.isNotNull(),
        F.struct(name.alias("model_name"), version.cast("string").alias("model_version")),
    )


def derive_job_status(status: Column, steps: Column) -> Column:
    """The status a job should have, given its steps in order.

    Only a started job moves on: pending and ended ones keep their status. The first step
    that is not done decides; when all are done the job has succeeded unless it waits for approval.
    """
    def known(s: Column) -> Column:
        return s["type"].isin([*RUNNABLE_STEP_TYPES, "approval"])

    # an idle step of unknown type is passed over
    def unfinished(s: Column) -> Column:
        done = s["status"].isin("succeeded", "approved") | ((s["status"] == "idle") & ~known(s))
        return ~done

    first = F.get(F.filter(steps, unfinished), F.lit(0))
    waits = (first["status"] == "idle") & (first["type"] == "approval")
    starts = (first["status"] == "idle") & (first["type"] != "approval")
    return (
        F.when(status.isin("pending", *TERMINAL_JOB_STATUSES), status)
        .when(first.isNull() & (status == "awaiting_approval"), status)
        .when(first.isNull(), "success")
        .when(waits, "awaiting_approval")
        .when(starts, "running")
        .otherwise(status)
    )


def step_shape_errors(steps: Column) -> Column:
    """What is wrong with the shape of a step list, as an array of messages."""
    def repeated(field: str) -> Column:
        names = F.transform(steps, lambda s: s[field])
        return F.size(F.array_distinct(names)) < F.size(names)

    ranks = F.transform(steps, lambda s: F.array_position(F.array(*map(F.lit, STEP_ORDER)), s["type"]))

    def points_forward(step: Column, i: Column) -> Column:
        earlier = F.transform(F.slice(steps, F.lit(1), i), lambda s: s["step_id"])
        return F.size(F.array_except(step["depends_on"], earlier)) > 0

    return F.filter(
        F.array(
            F.when(F.size(steps) == 0, "no steps"),
            F.when(repeated("type"), "repeated step type"),
            F.when(F.array_sort(ranks) != ranks, "steps out of order"),
            F.when(repeated("step_id"), "repeated step id"),
            F.when(F.exists(F.transform(steps, points_forward), lambda x: x), "depends on a later step"),
        ),
        lambda e: e.isNotNull(),
    )
