"""Filters, lists, lookups, newest-k and pages over the record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.text import version_key
from scorewatch.operators.lookup import lookup_join
from scorewatch.values import RECENT_LIMIT, SEARCH_LIMIT


def tenant_scope(df: DataFrame, tenant: str | None) -> DataFrame:
    """Rows of one tenant, or of all when no tenant is given."""
    return df if tenant is None else df.filter(F.col("tenant_id") == tenant)


def by_status(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.filter(F.col("status") == status)


def by_monitoring_status(models: DataFrame, status: str) -> DataFrame:
    return models.filter(F.col("monitoring_status") == status)


def audit_filter(audit: DataFrame, action: str | None = None, entity_type: str | None = None) -> DataFrame:
    if action is not None:
        audit = audit.filter(F.col("action") == action)
    if entity_type is not None:
        audit = audit.filter(F.col("entity_type") == entity_type)
    return audit


def snapshot_filter(snapshots: DataFrame, model_name: str | None = None, version: str | None = None) -> DataFrame:
    if model_name is not None:
        snapshots = snapshots.filter(F.col("model_name") == model_name)
    if version is not None:
        snapshots = snapshots.filter(F.col("version").cast("string") == version)
    return snapshots


def search_models(models: DataFrame, query: str, limit: int = SEARCH_LIMIT) -> DataFrame:
    """First models whose name contains the text, ignoring case; all match a blank text."""
    hits = models.filter(F.contains(F.lower("model_name"), F.lower(F.trim(F.lit(query)))))
    return hits.orderBy("model_name", "version", "tenant_id").limit(limit)


def jobs_with_pipeline(jobs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Jobs with their pipeline's name and environment of now, NULL when it is gone."""
    current = pipelines.select(
        "tenant_id", "pipeline_id", F.col("name").alias("pipeline_name"), F.col("environment").alias("pipeline_environment"),
        F.lit(True).alias("pipeline_found"),
    )
    return lookup_join(jobs, current, ["tenant_id", "pipeline_id"]).withColumn(
        "pipeline_found", F.coalesce("pipeline_found", F.lit(False))
    )


def current_environment(jobs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """Add the environment a job belongs to now: its pipeline's, else that of its run."""
    now = F.when(F.col("pipeline_found"), F.coalesce("pipeline_environment", F.lit("staging"))).otherwise(
        F.coalesce("run_environment", F.lit("staging"))
    )
    return jobs_with_pipeline(jobs, pipelines).withColumn("current_environment", now)


def _newest_first(df: DataFrame, ts: str, tie: str, tenant: str | None) -> DataFrame:
    if tenant is None:
        return df.orderBy(F.desc("tenant_id"), F.desc(ts), tie)
    return tenant_scope(df, tenant).orderBy(F.desc(ts), tie)


def list_jobs(jobs: DataFrame, tenant: str | None = None) -> DataFrame:
    """Newest first; over all tenants grouped by tenant, descending."""
    return _newest_first(jobs, "submitted_at", "job_id", tenant)


def list_pipelines(pipelines: DataFrame, tenant: str | None = None) -> DataFrame:
    """Last changed first; over all tenants grouped by tenant, descending."""
    return _newest_first(pipelines, "updated_at", "pipeline_id", tenant)


def list_models(models: DataFrame, tenant: str | None = None) -> DataFrame:
    """By name and version as text: ascending for one tenant, descending by key for all."""
    version = F.col("version").cast("string")
    if tenant is None:
        return models.orderBy(F.desc("tenant_id"), F.desc("model_name"), version.desc())
    return tenant_scope(models, tenant).orderBy("model_name", version)


def list_snapshots(snapshots: DataFrame, tenant: str | None = None) -> DataFrame:
    """Newest first."""
    return tenant_scope(snapshots, tenant).orderBy(F.desc("recorded_at"), "tenant_id", "model_name", "version", "job_id", "run_id")


def model_trend(snapshots: DataFrame, tenant: str, model_name: str, version: str) -> DataFrame:
    """Snapshots of one model version, newest first."""
    mine = snapshot_filter(tenant_scope(snapshots, tenant), model_name, version)
    return mine.orderBy(F.desc("recorded_at"), "job_id", "run_id")


def list_tenants(tenants: DataFrame) -> DataFrame:
    """Oldest first."""
    return tenants.orderBy("created_at", "tenant_id")


def recent(df: DataFrame, ts: str, tie: str, k: int = RECENT_LIMIT) -> DataFrame:
    """The newest ``k`` rows."""
    return df.orderBy(F.desc(ts), tie).limit(k)


def paginate(df: DataFrame, order: list[Column], page: int = 1, size: int = 20) -> DataFrame:
    """One page of an ordered table, with ``total``, ``page`` and ``page_size`` columns.

    ``order`` must be unique. A page past the end is empty. All rows up to the page are sorted:
    for shallow pages only; ``page_after`` goes on from a row at the same cost for any depth.
    """
    page, size = max(page, 1), max(size, 1)
    total = df.agg(F.count("*").alias("total")).scalar()
    part = df.orderBy(*order).offset((page - 1) * size).limit(size)
    return part.select("*", total.alias("total"), F.lit(page).alias("page"), F.lit(size).alias("page_size"))


def page_after(df: DataFrame, order: list[str], last: dict | None = None, size: int = 20) -> DataFrame:
    """The next ``size`` rows in ascending order of unique, non-null ``order`` columns, after the row ``last``.

    Only ``size`` rows per task are kept; without ``last`` it is the first page.
    """
    if last is not None:
        here, there = F.struct(*order), F.struct(*[F.lit(last[c]).cast(df.schema[c].dataType).alias(c) for c in order])
        df = df.filter(here > there)
    return df.orderBy(*order).limit(max(size, 1))


def versions(df: DataFrame, descending: bool = False) -> DataFrame:
    """Distinct model versions by name, with 2 before 10; or newest version first."""
    known = df.select("model_name", F.col("version").cast("string").alias("version")).distinct()
    keyed = known.withColumn("version_key", version_key(F.col("version")))
    by_key = [F.desc("version_key"), F.desc("version")] if descending else ["version_key", "version"]
    return keyed.orderBy("model_name", *by_key)
