"""Counts, load and totals for overview pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.functions.text import parse_vcpu
from scorewatch.operators.listing import recent
from scorewatch.values import (
    JOB_STATUSES,
    MODEL_STAGES,
    MONITORING_STATUSES,
    PIPELINE_STATUSES,
    STEP_STATUSES,
    VCPU_PER_WORKER,
)


def _zeros(spark: SparkSession, buckets: dict[str, list[str]]) -> DataFrame:
    """A row with n = 0 for every known (section, key)."""
    pairs = [F.struct(F.lit(s).alias("section"), F.lit(k).alias("key")) for s, keys in buckets.items() for k in keys]
    return spark.range(1).select(F.inline(F.array(*pairs))).withColumn("n", F.lit(0).cast("long"))


def _fill(counts: DataFrame, buckets: dict[str, list[str]]) -> DataFrame:
    zeros = _zeros(counts.sparkSession, buckets)
    return counts.unionByName(zeros).groupBy("section", "key").agg(F.sum("n").alias("n"))


def _section(df: DataFrame, name: str, key: Column) -> DataFrame:
    keyed = df.select(F.lit(name).alias("section"), key.cast("string").alias("key")).filter("key IS NOT NULL")
    return keyed.groupBy("section", "key").agg(F.count("*").alias("n"))


def count_by(df: DataFrame, key: str, buckets: list[str]) -> DataFrame:
    """Rows per value of ``key``: known values always shown, others too, NULL not."""
    filled = _fill(_section(df, "", F.col(key)), {"": buckets})
    return filled.select(F.col("key").alias(key), "n")


def monitoring_dashboard(models: DataFrame) -> DataFrame:
    """Models per monitoring status, no status being NotStarted, with their total."""
    status = F.coalesce("monitoring_status", F.lit("NotStarted"))
    counts = _fill(_section(models, "", status), {"": MONITORING_STATUSES})
    total = models.agg(F.count("*").alias("total")).scalar()
    return counts.select(F.col("key").alias("monitoring_status"), "n", total.alias("total_models"))


def execute_steps(jobs: DataFrame) -> DataFrame:
    """One row per execute step of every job."""
    wanted = F.transform(F.filter("steps", lambda s: s["type"] == "execute_model"), lambda s: s["status"])
    return jobs.select("tenant_id", "job_id", F.col("status").alias("job_status"), F.explode(wanted).alias("status"))


def step_status_counts(jobs: DataFrame) -> DataFrame:
    """Execute steps per status."""
    return count_by(execute_steps(jobs), "status", STEP_STATUSES)


def tenant_load(jobs: DataFrame, tenants: DataFrame) -> DataFrame:
    """Running and queued execute steps of every tenant, tenants without any included."""
    waits = (F.col("status") == "idle") & F.col("job_status").isin("pending", "running")
    load = execute_steps(jobs).groupBy("tenant_id").agg(
        F.count_if(F.col("status") == "running").alias("running"), F.count_if(waits).alias("queued")
    )
    joined = tenants.join(load, "tenant_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("running", "queued")})


def utilization(load: DataFrame, capacity: str = "max_cpu") -> DataFrame:
    """Add capacity, estimated allocation and its share in percent, NULL without capacity."""
    allocated = F.col("running") * VCPU_PER_WORKER
    vcpu = parse_vcpu(F.col(capacity))
    # halves go to the even number
    percent = F.least(F.lit(100), F.bround(allocated / F.nullif(vcpu, F.lit(0)) * 100).cast("int"))
    return load.withColumns({
        "max_vcpu": vcpu,
        "allocated_vcpu": allocated,
        "utilization_pct": F.when(vcpu > 0, percent),
    })


def last_success(jobs: DataFrame) -> DataFrame:
    """When the newest successful run of each pipeline was completed (``completed_at``)."""
    return jobs.filter(F.col("status") == "success").groupBy("tenant_id", "pipeline_id").agg(
        F.max("completed_at").alias("last_success_at")
    )


def jobs_by_status(jobs: DataFrame) -> DataFrame:
    """Jobs per status that occurs, with no row for others; no status is counted too."""
    return jobs.groupBy("status").agg(F.count("*").alias("n"))


def tenant_count(tenants: DataFrame, tenant: str | None = None) -> DataFrame:
    """Number of tenants for a view over all of them, NULL for that of one tenant."""
    counted = F.count("*") if tenant is None else F.lit(None).cast("long")
    return tenants.agg(counted.alias("tenant_count"))


def dashboard_summary(pipelines: DataFrame, jobs: DataFrame, models: DataFrame) -> DataFrame:
    """All counts of the overview as (section, key, n); jobs are read once."""
    def pair(section: str, key: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), key.cast("string").alias("key"))

    def counted(df: DataFrame, pairs: Column) -> DataFrame:
        return df.select(F.inline(pairs)).filter("key IS NOT NULL").groupBy("section", "key").agg(F.count("*").alias("n"))

    compute = F.transform(
        F.filter("steps", lambda s: s["type"] == "execute_model"), lambda s: pair("compute_by_status", s["status"])
    )
    total = F.lit("total")
    parts = [
        counted(pipelines, F.array(pair("pipelines_by_status", F.col("status")), pair("pipelines", total))),
        counted(jobs, F.concat(
            F.array(pair("jobs_by_status", F.col("status")), pair("jobs", total)), compute,
            F.transform(compute, lambda _: pair("compute", total)),
        )),
        counted(models, F.array(
            pair("models_by_stage", F.col("stage")), pair("models_by_monitoring", F.col("monitoring_status")),
            pair("models", total),
        )),
    ]
    return _fill(reduce(DataFrame.unionByName, parts), {
        "pipelines_by_status": PIPELINE_STATUSES,
        "jobs_by_status": JOB_STATUSES,
        "compute_by_status": STEP_STATUSES,
        "models_by_stage": MODEL_STAGES,
        "models_by_monitoring": MONITORING_STATUSES,
        "pipelines": ["total"], "jobs": ["total"], "compute": ["total"], "models": ["total"],
    })


def dashboard(
    pipelines: DataFrame, jobs: DataFrame, models: DataFrame, tenants: DataFrame, events: DataFrame, tenant: str | None = None
) -> dict[str, DataFrame]:
    """All parts of the overview, of every tenant or of one.

    ``counts`` (see ``dashboard_summary``), ``tenants`` (their number, NULL in a view of one), ``load`` with
    utilization per tenant, and the newest ``jobs`` and audit ``events``.
    """
    if tenant is not None:
        pipelines, jobs, models, tenants, events = (
            df.filter(F.col("tenant_id") == tenant) for df in (pipelines, jobs, models, tenants, events))
    return {
        "counts": dashboard_summary(pipelines, jobs, models),
        "tenants": tenant_count(tenants, tenant),
        "load": utilization(tenant_load(jobs, tenants)),
        "jobs": recent(jobs, "submitted_at", "job_id"),
        "events": recent(events, "ts", "event_id"),
    }


def share_of_max(counts: DataFrame, n: str = "n") -> DataFrame:
    """Add each count as a share of the largest, for bar widths."""
    largest = counts.agg(F.greatest(F.lit(1), F.max(n)).alias("largest")).scalar()
    return counts.withColumn("share", F.col(n) / largest)
