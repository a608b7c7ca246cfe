"""Launch, promotion and review rules checked over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.steps import execute_ref
from scorewatch.operators.lookup import lookup_join
from scorewatch.operators.ordered import with_last
from scorewatch.values import LEGAL_STAGE_MOVES, MODEL_KEYS, STEP_TIMEOUT_SECONDS, TENANT_URI_FIELDS


def _with_model_ref(pipelines: DataFrame) -> DataFrame:
    return pipelines.withColumn("__ref", execute_ref(F.col("steps"))).select(
        *pipelines.columns, F.col("__ref.model_name").alias("model_name"), F.col("__ref.model_version").alias("model_version")
    )


def triggerable(pipelines: DataFrame, models: DataFrame, tenants: DataFrame) -> DataFrame:
    """Add ``reason``: why a pipeline cannot be launched, NULL when it can."""
    stages = models.select(
        "tenant_id", "model_name", F.col("version").cast("string").alias("model_version"), "stage",
        F.lit(True).alias("__model"),
    )
    states = tenants.select("tenant_id", F.col("status").alias("__tenant"))
    joined = lookup_join(_with_model_ref(pipelines), stages, ["tenant_id", "model_name", "model_version"])
    joined = lookup_join(joined, states, ["tenant_id"])
    reason = (
        F.when(F.col("__tenant") == "suspended", "tenant suspended")
        .when(~F.col("status").eqNullSafe("active"), "pipeline not active")
        .when(F.coalesce("environment", F.lit("staging")) != "production", "pipeline not in production")
        .when(F.col("__model").isNull(), "model not registered")
        .when(~F.col("stage").eqNullSafe("Production"), "model not in production")
    )
    return joined.withColumn("reason", reason).drop("__model", "__tenant")


def promotable_pipelines(pipelines: DataFrame, jobs: DataFrame) -> DataFrame:
    """Pipelines that may go to production: one good run, not archived, not there yet."""
    key = ["tenant_id", "pipeline_id"]
    succeeded = jobs.filter(F.col("status") == "success").select(*key).distinct().withColumn("__ran", F.lit(True))
    ready = F.col("last_success_at").isNotNull() | F.col("__ran").isNotNull()
    open_ = ~F.col("status").eqNullSafe("archived") & (F.coalesce("environment", F.lit("staging")) != "production")
    return pipelines.filter(open_).join(succeeded, key, "left").filter(ready).drop("__ran")


def unregistered_model_refs(pipelines: DataFrame, models: DataFrame) -> DataFrame:
    """Pipelines whose execute step names a model the tenant has not registered."""
    known = models.select("tenant_id", "model_name", F.col("version").cast("string").alias("model_version"))
    refs = _with_model_ref(pipelines).filter("model_name IS NOT NULL")
    return lookup_join(refs, known, ["tenant_id", "model_name", "model_version"], "left_anti")


def outside_tenant_prefix(pipelines: DataFrame, tenants: DataFrame) -> DataFrame:
    """Step URIs outside their tenant's data prefix; without a prefix nothing is checked."""
    uris = F.flatten(F.transform("steps", lambda s: F.array(*[
        F.struct(s["step_id"].alias("step_id"), s["type"].alias("type"), F.lit(field).alias("field"),
                 F.when(s["type"] == kind, s["config"][field]).alias("uri"))
        for kind, fields in TENANT_URI_FIELDS.items() for field in fields
    ])))
    used = pipelines.select("tenant_id", "pipeline_id", F.inline(uris)).filter(F.coalesce("uri", F.lit("")) != "")
    prefixes = tenants.filter(F.coalesce("data_prefix", F.lit("")) != "").select("tenant_id", "data_prefix")
    return lookup_join(used, prefixes, ["tenant_id"], "inner").filter(~F.col("uri").startswith(F.col("data_prefix")))


def overdue_steps(jobs: DataFrame, as_of: Column, timeout: int = STEP_TIMEOUT_SECONDS) -> DataFrame:
    """Running steps that have run for ``timeout`` seconds or longer at ``as_of``."""
    elapsed = (F.unix_micros(as_of) - F.unix_micros("started_at")) / 1e6
    steps = jobs.select("tenant_id", "job_id", F.inline(F.transform("steps", lambda s: F.struct(
        s["step_id"].alias("step_id"), s["type"].alias("type"), s["status"].alias("status"), s["started_at"].alias("started_at"),
    ))))
    return (
        steps.filter((F.col("status") == "running") & F.col("started_at").isNotNull())
        .withColumn("elapsed_seconds", elapsed).filter(F.col("elapsed_seconds") >= timeout).drop("status")
    )


def promotions_asof(promotions: DataFrame, snapshots: DataFrame, width: str = "day") -> DataFrame:
    """Promotions judged by the monitoring status of that moment.

    A snapshot taken at the same instant counts as earlier. Both tables have the
    model keys; ``promotions`` adds ``event_id`` and ``ts``, ``snapshots`` adds
    ``recorded_at`` and ``derived_status``.
    """
    states = snapshots.select(
        *MODEL_KEYS, F.lit(None).cast("long").alias("event_id"), F.col("recorded_at").alias("ts"),
        F.lit(0).alias("__rank"), F.col("derived_status").alias("__status"),
    )
    moves = promotions.select(
        *MODEL_KEYS, F.col("event_id").cast("long"), "ts", F.lit(1).alias("__rank"), F.lit(None).cast("string").alias("__status")
    )
    seen = with_last(
        states.unionByName(moves), MODEL_KEYS, "ts", {"status": F.col("__status")}, ties=["__rank", "event_id"], width=width
    )
    status = F.coalesce("status", F.lit("NotStarted"))
    return seen.filter("__rank = 1").select(
        *MODEL_KEYS, "event_id", "ts", status.alias("status"), status.isin("Failed", "InReview").alias("blocked")
    )


def review_history(events: DataFrame, width: str = "day") -> DataFrame:
    """Status history of every model from its snapshots, gates and reviews.

    ``events`` has the model keys, ``event_id``, ``ts``, ``kind`` (snapshot, gate or
    review), ``run_status`` (derived status of the event's run) and ``approved``.
    A snapshot sets the status. A Rework run at its gate puts the model InReview.
    A review of a Rework run closes it, but only while the model is still InReview:
    whatever came last before it must be such a gate. Other reviews change nothing.
    """
    rework = F.col("run_status") == "Rework"
    sets = (
        F.when(F.col("kind") == "snapshot", F.col("run_status"))
        .when((F.col("kind") == "gate") & rework, "InReview")
    )
    verdict = F.when((F.col("kind") == "review") & rework, F.when(F.col("approved"), "Passed").otherwise("Rework"))
    rank = F.when(F.col("kind") == "snapshot", 0).when(F.col("kind") == "gate", 1).otherwise(2)
    marked = events.withColumn("__rank", rank).withColumn("__sets", sets).withColumn("__verdict", verdict)

    # NULL status marks a review: after one the model is no longer InReview
    relevant = F.when(F.col("__sets").isNotNull() | F.col("__verdict").isNotNull(), F.struct("__sets"))
    seen = with_last(
        marked, MODEL_KEYS, "ts", {"__before": relevant}, ties=["__rank", "event_id"], width=width
    )
    closes = F.col("__verdict").isNotNull() & F.col("__before.__sets").eqNullSafe("InReview")
    status = F.coalesce("__sets", F.when(closes, F.col("__verdict")))
    return seen.withColumn("status", status).filter("status IS NOT NULL").drop("__sets", "__verdict", "__before").withColumnRenamed(
        "__rank", "kind_rank"
    )


def status_changes(history: DataFrame, ties: list[str] = ("kind_rank", "event_id"), width: str = "day") -> DataFrame:
    """The rows of a status history at which the value changes, with the value before."""
    seen = with_last(history, MODEL_KEYS, "ts", {"previous": F.col("status")}, ties=list(ties), width=width)
    return seen.filter(~F.col("previous").eqNullSafe(F.col("status")))


def illegal_transitions(stage_events: DataFrame, width: str = "day") -> DataFrame:
    """Stage moves that the rules do not allow; a model starts out in stage None."""
    seen = with_last(stage_events, MODEL_KEYS, "ts", {"__from": F.col("stage")}, ties=["event_id"], width=width)
    move = F.struct(F.coalesce("__from", F.lit("None")).alias("a"), F.col("stage").alias("b"))
    legal = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in LEGAL_STAGE_MOVES]
    return seen.withColumn("from_stage", F.coalesce("__from", F.lit("None"))).filter(~move.isin(legal)).drop("__from")
