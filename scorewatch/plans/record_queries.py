"""Registered queries: lists, lookups, counts, rules and histories over the record tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.functions import steps, text
from scorewatch.operators import audit, dashboards, governance, listing, runs
from scorewatch.plans import views as v
from scorewatch.plans.registry import iso, joined, query
from scorewatch.plans.views import Tables
from scorewatch.values import JOB_STATUSES, MODEL_STAGES

JOB = ["tenant_id", "job_id"]
STAMP = "'%Y-%m-%d %H:%M:%S.%f'"


# --- filters -------------------------------------------------------------------------------------

@query("b1_by_status", views="jobs", sql=f"""
    SELECT tenant_id, job_id, strftime(submitted_at, {STAMP}) AS submitted_at FROM jobs WHERE status = 'awaiting_approval'""")
def _(t: Tables) -> DataFrame:
    return listing.by_status(v.jobs(t), "awaiting_approval").select(*JOB, iso("submitted_at").alias("submitted_at"))


@query("b2_by_monitoring_status", views="models", sql="""
    SELECT tenant_id, model_name, version FROM models WHERE monitoring_status = 'Rework'""")
def _(t: Tables) -> DataFrame:
    return listing.by_monitoring_status(v.models(t), "Rework").select("tenant_id", "model_name", "version")


@query("b3_audit_filter", views="audit", sql="""
    SELECT tenant_id, event_id, actor FROM audit WHERE action = 'click' AND entity_type = 'model'""")
def _(t: Tables) -> DataFrame:
    return listing.audit_filter(v.audit(t), "click", "model").select("tenant_id", "event_id", "actor")


@query("b4_snapshot_filter", views="snapshots", sql="""
    SELECT tenant_id, run_id, request_count FROM snapshots WHERE model_name = 'BUILDING' AND version = '1'""")
def _(t: Tables) -> DataFrame:
    return listing.snapshot_filter(v.snapshots(t), "BUILDING", "1").select("tenant_id", "run_id", "request_count")


@query("b5_tenant_scope", views="jobs", sql="SELECT tenant_id, job_id, status FROM jobs WHERE tenant_id = 'ASIA'")
def _(t: Tables) -> DataFrame:
    return listing.tenant_scope(v.jobs(t), "ASIA").select(*JOB, "status")


@query("b6_search_models", views="part_models", sql="""
    SELECT tenant_id, model_name, version FROM part_models WHERE contains(lower(model_name), 'gizmo 1')
    ORDER BY model_name, version::INTEGER, tenant_id LIMIT 8""")
def _(t: Tables) -> DataFrame:
    hits = listing.search_models(v.part_models(t), " GIZMO 1 ")
    return hits.select("tenant_id", "model_name", F.col("version").cast("string").alias("version"))


@query("b7_overdue_steps", views="job_steps", sql="""
    SELECT tenant_id, job_id, step_id, type, epoch(TIMESTAMP '2001-01-01 06:00:00' - started_at) AS elapsed_seconds
    FROM job_steps WHERE state = 'running' AND TIMESTAMP '2001-01-01 06:00:00' - started_at >= INTERVAL 6 HOUR""")
def _(t: Tables) -> DataFrame:
    late = governance.overdue_steps(v.jobs(t), F.lit("2001-01-01 06:00:00").cast("timestamp"))
    return late.select(*JOB, "step_id", "type", "elapsed_seconds")


@query("b8_outside_tenant_prefix", views="definitions tenants", sql="""
    SELECT tenant_id, pipeline_id, step_id, field, uri
    FROM (SELECT tenant_id, pipeline_id, d, n, 's1' AS step_id, 'destination_uri' AS field, 's3://data/' || lower(tenant_id) || '/dest' AS uri FROM definitions
          UNION ALL SELECT tenant_id, pipeline_id, d, n, 's1', 'script_uri', CASE WHEN n % 2 = 0 THEN 's3://code/extract.py' ELSE '' END FROM definitions
          UNION ALL SELECT tenant_id, pipeline_id, d, n, s, 'input_uri',
            's3://' || CASE WHEN d = 3 THEN 'other/' ELSE 'data/' END || lower(tenant_id) || '/in'
            FROM definitions, (VALUES ('s2'), ('s3')) x(s)
          UNION ALL SELECT tenant_id, pipeline_id, d, n, 's2', 'output_uri', 's3://data/' || lower(tenant_id) || '/out' FROM definitions)
    JOIN tenants USING (tenant_id) WHERE data_prefix IS NOT NULL AND uri <> '' AND NOT starts_with(uri, data_prefix)""")
def _(t: Tables) -> DataFrame:
    found = governance.outside_tenant_prefix(v.pipelines(t), v.tenants(t))
    return found.select("tenant_id", "pipeline_id", "step_id", "field", "uri")


# --- joins ---------------------------------------------------------------------------------------

@query("c1_jobs_with_definition", views="jobs definitions", sql="""
    SELECT j.tenant_id, job_id, d.name AS pipeline_name, d.environment AS pipeline_environment
    FROM jobs j LEFT JOIN definitions d USING (tenant_id, pipeline_id)""")
def _(t: Tables) -> DataFrame:
    return listing.jobs_with_pipeline(v.jobs(t), v.pipelines(t)).select(*JOB, "pipeline_name", "pipeline_environment")


@query("c2_current_environment", views="jobs definitions", sql="""
    SELECT j.tenant_id, job_id, CASE WHEN d.pipeline_id IS NOT NULL THEN coalesce(d.environment, 'staging')
                                     ELSE coalesce(run_environment, 'staging') END AS current_environment
    FROM jobs j LEFT JOIN definitions d USING (tenant_id, pipeline_id)""")
def _(t: Tables) -> DataFrame:
    return listing.current_environment(v.jobs(t), v.pipelines(t)).select(*JOB, "current_environment")


@query("c5_triggerable", views="definitions models tenants", sql="""
    SELECT d.tenant_id, pipeline_id,
           CASE WHEN t.status = 'suspended' THEN 'tenant suspended'
                WHEN d.status <> 'active' THEN 'pipeline not active'
                WHEN coalesce(environment, 'staging') <> 'production' THEN 'pipeline not in production'
                WHEN m.model_name IS NULL THEN 'model not registered'
                WHEN m.stage <> 'Production' THEN 'model not in production' END AS reason
    FROM definitions d LEFT JOIN tenants t USING (tenant_id)
    LEFT JOIN models m ON m.tenant_id = d.tenant_id AND m.model_name = d.model_name AND m.version = d.model_version""")
def _(t: Tables) -> DataFrame:
    return governance.triggerable(v.pipelines(t), v.models(t), v.tenants(t)).select("tenant_id", "pipeline_id", "reason")


@query("c6_promotable", views="definitions jobs", sql="""
    SELECT tenant_id, pipeline_id FROM definitions d
    WHERE status <> 'archived' AND coalesce(environment, 'staging') <> 'production'
      AND (last_success_at IS NOT NULL OR EXISTS (
        FROM jobs j WHERE j.tenant_id = d.tenant_id AND j.pipeline_id = d.pipeline_id AND j.status = 'success'))""")
def _(t: Tables) -> DataFrame:
    return governance.promotable_pipelines(v.pipelines(t), v.jobs(t)).select("tenant_id", "pipeline_id")


@query("c7_unregistered_model_refs", views="definitions models", sql="""
    SELECT tenant_id, pipeline_id, model_name, model_version FROM definitions d
    WHERE NOT EXISTS (FROM models m WHERE m.tenant_id = d.tenant_id AND m.model_name = d.model_name AND m.version = d.model_version)""")
def _(t: Tables) -> DataFrame:
    found = governance.unregistered_model_refs(v.pipelines(t), v.models(t))
    return found.select("tenant_id", "pipeline_id", "model_name", "model_version")


@query("c9_promotions_asof", views="event_models", sql="""
    SELECT tenant_id, model_name, event_id, coalesce(status, 'NotStarted') AS status, coalesce(status IN ('Failed', 'InReview'), false) AS blocked
    FROM (SELECT p.tenant_id, p.model_name, p.event_id, s.status FROM (FROM event_models WHERE event_type = 'purchase') p
          ASOF LEFT JOIN (SELECT tenant_id, model_name, ts, ['Passed', 'Failed', 'Rework', 'InReview'][event_id % 4 + 1] AS status
                          FROM event_models WHERE event_type IN ('view', 'error')) s
          ON p.tenant_id = s.tenant_id AND p.model_name = s.model_name AND p.ts >= s.ts)""")
def _(t: Tables) -> DataFrame:
    moves = v.stage_events(t).filter("stage = 'Production'")
    return governance.promotions_asof(moves, v.event_statuses(t)).select("tenant_id", "model_name", "event_id", "status", "blocked")


# --- counts --------------------------------------------------------------------------------------

@query("d13_count_by", views="jobs", sql="""
    SELECT status, sum(n)::BIGINT AS n FROM (
      SELECT status, count(*) AS n FROM jobs WHERE status IS NOT NULL GROUP BY ALL
      UNION ALL SELECT unnest(['pending', 'running', 'awaiting_approval', 'success', 'failed', 'cancelled']), 0) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return dashboards.count_by(v.jobs(t), "status", JOB_STATUSES)


@query("d14_monitoring_dashboard", views="models", sql="""
    SELECT monitoring_status, sum(n)::BIGINT AS n, (SELECT count(*) FROM models) AS total_models FROM (
      SELECT coalesce(monitoring_status, 'NotStarted') AS monitoring_status, count(*) AS n FROM models GROUP BY ALL
      UNION ALL SELECT unnest(['Passed', 'Failed', 'Rework', 'InReview', 'NotStarted']), 0) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return dashboards.monitoring_dashboard(v.models(t))


@query("d15_step_status_counts", views="job_steps", sql="""
    SELECT status, sum(n)::BIGINT AS n FROM (
      SELECT state AS status, count(*) AS n FROM job_steps WHERE type = 'execute_model' GROUP BY ALL
      UNION ALL SELECT unnest(['idle', 'running', 'succeeded', 'failed', 'awaiting_approval', 'approved', 'rejected']), 0) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return dashboards.step_status_counts(v.jobs(t))


LOAD = """
    SELECT t.tenant_id, max_cpu, count(*) FILTER (state = 'running') AS running,
           count(*) FILTER (state = 'idle' AND s.status IN ('pending', 'running')) AS queued
    FROM tenants t LEFT JOIN (FROM job_steps WHERE type = 'execute_model') s USING (tenant_id) GROUP BY ALL"""


@query("d16_tenant_load", views="tenants job_steps", sql=f"SELECT tenant_id, running, queued FROM ({LOAD})")
def _(t: Tables) -> DataFrame:
    return dashboards.tenant_load(v.jobs(t), v.tenants(t)).select("tenant_id", "running", "queued")


@query("d17_utilization", views="customer_runs supplier_tenants", sql="""
    SELECT tenant_id, running, max_vcpu, running * 4 AS allocated_vcpu,
           CASE WHEN max_vcpu > 0 THEN least(100, round_even(running * 4 / max_vcpu * 100, 0)::INTEGER) END AS utilization_pct
    FROM (SELECT tenant_id, max_cpu::INTEGER AS max_vcpu, max_cpu::BIGINT % 37 AS running FROM supplier_tenants)""")
def _(t: Tables) -> DataFrame:
    load = v.supplier_tenants(t).withColumn("running", F.col("max_cpu").cast("long") % 37)
    used = dashboards.utilization(load.withColumn("max_cpu", F.concat("max_cpu", F.lit(" vCPU"))))
    return used.select("tenant_id", "running", "max_vcpu", "allocated_vcpu", "utilization_pct")


@query("d18_last_success", views="job_steps", sql=f"""
    SELECT tenant_id, pipeline_id, strftime(max(started_at), {STAMP}) AS last_success_at FROM job_steps WHERE status = 'success' GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    # the example jobs are completed when their last step starts
    done = v.jobs(t).withColumn("completed_at", F.array_max(F.transform("steps", lambda s: s["started_at"])))
    return dashboards.last_success(done).withColumn("last_success_at", iso("last_success_at"))


@query("d19_tenant_count", views="supplier_tenants", sql="SELECT count(*) AS tenant_count FROM supplier_tenants")
def _(t: Tables) -> DataFrame:
    return dashboards.tenant_count(v.supplier_tenants(t))


@query("d19_one_tenant", views="supplier_tenants", sql="SELECT DISTINCT NULL::BIGINT AS tenant_count FROM supplier_tenants")
def _(t: Tables) -> DataFrame:
    return dashboards.tenant_count(v.supplier_tenants(t), "supplier-000000001")


@query("d20_dashboard_summary", views="definitions job_steps models", sql="""
    SELECT section, key, sum(n)::BIGINT AS n FROM (
      SELECT 'pipelines_by_status' AS section, status AS key, count(*) AS n FROM definitions GROUP BY ALL
      UNION ALL SELECT 'pipelines', 'total', count(*) FROM definitions
      UNION ALL SELECT 'jobs_by_status', status, count(*) FROM jobs WHERE status IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'jobs', 'total', count(*) FROM jobs
      UNION ALL SELECT 'compute_by_status', state, count(*) FROM job_steps WHERE type = 'execute_model' GROUP BY ALL
      UNION ALL SELECT 'compute', 'total', count(*) FROM job_steps WHERE type = 'execute_model'
      UNION ALL SELECT 'models_by_stage', stage, count(*) FROM models GROUP BY ALL
      UNION ALL SELECT 'models_by_monitoring', monitoring_status, count(*) FROM models WHERE monitoring_status IS NOT NULL GROUP BY ALL
      UNION ALL SELECT 'models', 'total', count(*) FROM models
      UNION ALL SELECT 'pipelines_by_status', unnest(['draft', 'active', 'archived']), 0
      UNION ALL SELECT 'jobs_by_status', unnest(['pending', 'running', 'awaiting_approval', 'success', 'failed', 'cancelled']), 0
      UNION ALL SELECT 'compute_by_status', unnest(['idle', 'running', 'succeeded', 'failed', 'awaiting_approval', 'approved', 'rejected']), 0
      UNION ALL SELECT 'models_by_stage', unnest(['None', 'Staging', 'Production', 'Archived']), 0
      UNION ALL SELECT 'models_by_monitoring', unnest(['Passed', 'Failed', 'Rework', 'InReview', 'NotStarted']), 0) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return dashboards.dashboard_summary(v.pipelines(t), v.jobs(t), v.models(t))


@query("d21_jobs_by_status", views="jobs", sql="SELECT status, count(*) AS n FROM jobs GROUP BY ALL")
def _(t: Tables) -> DataFrame:
    return dashboards.jobs_by_status(v.jobs(t))


def _dashboard(t: Tables, tenant: str | None) -> dict[str, DataFrame]:
    return dashboards.dashboard(v.pipelines(t), v.jobs(t), v.models(t), v.tenants(t), v.audit(t), tenant)


@query("d20_dashboard_load", views="tenants job_steps", sql="""
    SELECT tenant_id, coalesce(running, 0) AS running, coalesce(queued, 0) AS queued
    FROM tenants LEFT JOIN (
      SELECT tenant_id, count(*) FILTER (state = 'running') AS running, count(*) FILTER (state = 'idle' AND status IN ('pending', 'running')) AS queued
      FROM job_steps WHERE type = 'execute_model' GROUP BY ALL) USING (tenant_id)""")
def _(t: Tables) -> DataFrame:
    return _dashboard(t, None)["load"].select("tenant_id", "running", "queued")


@query("d20_dashboard_recent_jobs", views="jobs", sql="SELECT tenant_id, job_id FROM jobs WHERE tenant_id = 'ASIA' ORDER BY submitted_at DESC, job_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return _dashboard(t, "ASIA")["jobs"].select(*JOB)


@query("d20_dashboard_recent_events", views="audit", sql="SELECT event_id, action FROM audit ORDER BY ts DESC, event_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return _dashboard(t, None)["events"].select("event_id", "action")


@query("d20_dashboard_tenants", views="tenants", sql="SELECT count(*) AS tenant_count FROM tenants")
def _(t: Tables) -> DataFrame:
    return _dashboard(t, None)["tenants"]


@query("d20_dashboard_of_one_tenant", views="jobs", sql="""
    SELECT 'jobs_by_status' AS section, key, sum(n)::BIGINT AS n FROM (
      SELECT status AS key, count(*) AS n FROM jobs WHERE tenant_id = 'ASIA' AND status IS NOT NULL GROUP BY ALL
      UNION ALL SELECT unnest(['pending', 'running', 'awaiting_approval', 'success', 'failed', 'cancelled']), 0) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    return _dashboard(t, "ASIA")["counts"].filter("section = 'jobs_by_status'")


@query("d22_share_of_max", views="models", sql="""
    SELECT stage, n, round(n / greatest(1, max(n) OVER ()), 6) AS share FROM (SELECT stage, count(*) AS n FROM models GROUP BY ALL)""")
def _(t: Tables) -> DataFrame:
    shares = dashboards.share_of_max(dashboards.count_by(v.models(t), "stage", MODEL_STAGES))
    return shares.select("stage", "n", F.round("share", 6).alias("share"))


# --- order within a key --------------------------------------------------------------------------

@query("e4_number_runs", views="customer_runs", sql="""
    SELECT tenant_id, job_id, o_orderkey,
           'RUN-' || printf('%04d', row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY started_at, o_orderkey)) AS run_id
    FROM customer_runs""")
def _(t: Tables) -> DataFrame:
    numbered = runs.number_runs(v.customer_runs(t), "started_at", ["o_orderkey"], width="month")
    return numbered.select(*JOB, "o_orderkey", "run_id")


@query("e5_trim_history", views="customer_runs", sql="""
    SELECT tenant_id, job_id, o_orderkey, final_status,
           CASE WHEN row_number() OVER (PARTITION BY tenant_id, job_id ORDER BY started_at DESC, o_orderkey DESC) <= 10 THEN detail END AS detail
    FROM customer_runs""")
def _(t: Tables) -> DataFrame:
    trimmed = runs.trim_history(v.customer_runs(t), "started_at", ["detail"], keep=10, ties=["o_orderkey"], width="month")
    return trimmed.select(*JOB, "o_orderkey", "final_status", "detail")


@query("e6_review_overlay", views="replay", sql="""
    SELECT tenant_id, model_name, event_id, state AS status FROM replay WHERE changed""")
def _(t: Tables) -> DataFrame:
    return governance.review_history(v.review_events(t)).select("tenant_id", "model_name", "event_id", "status")


@query("e7_illegal_transitions", views="stage_events", sql="""
    SELECT tenant_id, model_name, event_id, from_stage, stage
    FROM (SELECT *, coalesce(lag(stage) OVER (PARTITION BY tenant_id, model_name ORDER BY ts, event_id), 'None') AS from_stage FROM stage_events)
    WHERE (from_stage, stage) NOT IN (('None', 'Staging'), ('Staging', 'Production'), ('Staging', 'Archived'), ('Production', 'Archived'))""")
def _(t: Tables) -> DataFrame:
    return governance.illegal_transitions(v.stage_events(t)).select("tenant_id", "model_name", "event_id", "from_stage", "stage")


@query("e8_status_changes", views="replay", sql="""
    SELECT tenant_id, model_name, event_id, previous, state AS status
    FROM (SELECT *, lag(state) OVER (PARTITION BY tenant_id, model_name ORDER BY nr) AS previous FROM replay WHERE changed)
    WHERE previous IS DISTINCT FROM state""")
def _(t: Tables) -> DataFrame:
    history = governance.review_history(v.review_events(t))
    return governance.status_changes(history).select("tenant_id", "model_name", "event_id", "previous", "status")


# --- lists ---------------------------------------------------------------------------------------

@query("f1_list_jobs_of_tenant", views="jobs", sql=f"""
    SELECT tenant_id, job_id, strftime(submitted_at, {STAMP}) AS submitted_at FROM jobs WHERE tenant_id = 'AFRICA' ORDER BY submitted_at DESC""")
def _(t: Tables) -> DataFrame:
    return listing.list_jobs(v.jobs(t), "AFRICA").select(*JOB, iso("submitted_at").alias("submitted_at"))


@query("f2_list_jobs", views="jobs", sql=f"SELECT tenant_id, job_id, strftime(submitted_at, {STAMP}) AS submitted_at FROM jobs")
def _(t: Tables) -> DataFrame:
    return listing.list_jobs(v.jobs(t)).select(*JOB, iso("submitted_at").alias("submitted_at"))


@query("f3_list_definitions", views="definitions", sql=f"""
    SELECT tenant_id, pipeline_id, name, strftime(updated_at, {STAMP}) AS updated_at FROM definitions""")
def _(t: Tables) -> DataFrame:
    return listing.list_pipelines(v.pipelines(t)).select("tenant_id", "pipeline_id", "name", iso("updated_at").alias("updated_at"))


@query("f3_definitions_of_one_tenant", views="definitions", sql=f"""
    SELECT pipeline_id, strftime(updated_at, {STAMP}) AS updated_at FROM definitions WHERE tenant_id = 'ASIA'""")
def _(t: Tables) -> DataFrame:
    return listing.list_pipelines(v.pipelines(t), "ASIA").select("pipeline_id", iso("updated_at").alias("updated_at"))


@query("f4_models_of_one_tenant", views="part_models", sql="SELECT model_name, version FROM part_models WHERE tenant_id = 'Brand#13'")
def _(t: Tables) -> DataFrame:
    return listing.list_models(v.part_models(t), "Brand#13").select("model_name", F.col("version").cast("string").alias("version"))


@query("f4_list_models", views="part_models", sql="SELECT tenant_id, model_name, version FROM part_models")
def _(t: Tables) -> DataFrame:
    listed = listing.list_models(v.part_models(t))
    return listed.select("tenant_id", "model_name", F.col("version").cast("string").alias("version"))


@query("f5_list_snapshots", views="snapshots", sql=f"""
    SELECT tenant_id, model_name, run_id, strftime(recorded_at, {STAMP}) AS recorded_at FROM snapshots""")
def _(t: Tables) -> DataFrame:
    return listing.list_snapshots(v.snapshots(t)).select("tenant_id", "model_name", "run_id", iso("recorded_at").alias("recorded_at"))


@query("f6_model_trend", views="snapshots", sql=f"""
    SELECT run_id, strftime(recorded_at, {STAMP}) AS recorded_at, max_psi FROM snapshots
    WHERE tenant_id = 'ASIA' AND model_name = 'MACHINERY' AND version = '1'""")
def _(t: Tables) -> DataFrame:
    trend = listing.model_trend(v.snapshots(t), "ASIA", "MACHINERY", "1")
    return trend.select("run_id", iso("recorded_at").alias("recorded_at"), "max_psi")


@query("f7_list_tenants", views="supplier_tenants", sql=f"""
    SELECT tenant_id, name, strftime(created_at, {STAMP}) AS created_at FROM supplier_tenants""")
def _(t: Tables) -> DataFrame:
    return listing.list_tenants(v.supplier_tenants(t)).select("tenant_id", "name", iso("created_at").alias("created_at"))


@query("f8_recent_jobs", views="jobs", sql="SELECT tenant_id, job_id FROM jobs ORDER BY submitted_at DESC, job_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return listing.recent(v.jobs(t), "submitted_at", "job_id").select(*JOB)


@query("f8_recent_audit", views="audit", sql="SELECT event_id, action FROM audit ORDER BY ts DESC, event_id LIMIT 5")
def _(t: Tables) -> DataFrame:
    return listing.recent(v.audit(t), "ts", "event_id").select("event_id", "action")


@query("f9_paginate", views="audit", sql="""
    SELECT event_id, actor, total, 3::INTEGER AS page, 20::INTEGER AS page_size
    FROM (SELECT *, count(*) OVER () AS total FROM audit) ORDER BY ts DESC, event_id LIMIT 20 OFFSET 40""")
def _(t: Tables) -> DataFrame:
    page = listing.paginate(v.audit(t), [F.desc("ts"), F.col("event_id")], page=3)
    return page.select("event_id", "actor", "total", "page", "page_size")


@query("f9_page_after", views="audit", sql="""
    SELECT event_id, actor FROM audit WHERE event_id > 100 ORDER BY event_id LIMIT 20""")
def _(t: Tables) -> DataFrame:
    return listing.page_after(v.audit(t), ["event_id"], {"event_id": 100}).select("event_id", "actor")


@query("f10_versions", views="part_models", sql="""
    SELECT DISTINCT family AS model_name, version, printf('%04d', length(version)) || version AS version_key FROM part_models""")
def _(t: Tables) -> DataFrame:
    return listing.versions(v.part_models(t).drop("model_name").withColumnRenamed("family", "model_name"))


# --- scalar functions ----------------------------------------------------------------------------

@query("h4_derive_job_status", views="jobs", sql="""
    SELECT tenant_id, job_id, status, CASE
             WHEN status IN ('pending', 'success', 'failed', 'cancelled') THEN status
             WHEN o % 6 = 5 THEN CASE WHEN status = 'awaiting_approval' THEN status ELSE 'success' END
             WHEN o % 4 = 2 THEN CASE WHEN o % 6 = 3 THEN 'awaiting_approval' ELSE 'running' END
             ELSE status END AS derived
    FROM jobs""")
def _(t: Tables) -> DataFrame:
    derived = steps.derive_job_status(F.col("status"), F.col("steps"))
    return v.jobs(t).select(*JOB, "status", derived.alias("derived"))


@query("h5_flags", views="jobs", sql="""
    SELECT tenant_id, job_id, status IN ('failed', 'cancelled') AS resumable, status IN ('failed', 'cancelled', 'success') AS rerunnable,
           status IN ('running', 'awaiting_approval', 'pending') AS stoppable
    FROM jobs""")
def _(t: Tables) -> DataFrame:
    s = F.col("status")
    return v.jobs(t).select(
        *JOB, text.resumable(s).alias("resumable"), text.rerunnable(s).alias("rerunnable"), text.stoppable(s).alias("stoppable")
    )


@query("h6_deterministic_id", views="audit", sql="""
    SELECT job_id, count(*) AS triggers, min(event_id) AS first_event
    FROM (SELECT 'job-' || left(sha256(tenant_id || ':' || entity_id), 12) AS job_id, event_id FROM audit) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    job = text.deterministic_id(F.col("tenant_id"), F.col("entity_id"))
    return v.audit(t).groupBy(job.alias("job_id")).agg(F.count("*").alias("triggers"), F.min("event_id").alias("first_event"))


@query("h7_parse_vcpu", sql="""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 1 THEN NULL ELSE p_size::INTEGER END AS max_vcpu FROM part""")
def _(t: Tables) -> DataFrame:
    label = F.when(F.col("p_partkey") % 3 == 0, F.concat("p_size", F.lit(" vCPU, 2 TB"))).when(
        F.col("p_partkey") % 3 == 1, "no limit").otherwise(F.concat(F.lit("up to "), "p_size"))
    return t["part"].select("p_partkey", text.parse_vcpu(label).alias("max_vcpu"))


@query("h8_slugify", sql="""
    SELECT doc_id, coalesce(nullif(trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'tenant') AS slug FROM documents""")
def _(t: Tables) -> DataFrame:
    return t["documents"].select("doc_id", text.slugify(F.col("text")).alias("slug"))


@query("h9_safe_filename", sql=r"""
    SELECT page_id, coalesce(nullif(trim(regexp_replace(regexp_extract(replace(url, '\', '/'), '[^/]*$'), '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'artifact') AS file_name
    FROM pages""")
def _(t: Tables) -> DataFrame:
    return t["pages"].select("page_id", text.safe_filename(F.col("url")).alias("file_name"))


@query("h10_valid", sql=r"""
    SELECT page_id, regexp_matches(word, '^[A-Za-z_][A-Za-z0-9_$]*$') AS identifier,
           regexp_matches(uri, '^s3://[A-Za-z0-9._\-]+(/[A-Za-z0-9._\-/=]*)?$') AS uri,
           regexp_matches(word, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS version,
           regexp_matches(ticket, '^(CHG|RITM|INC|REQ|TASK)[0-9]{6,10}$', 'i') AS ticket
    FROM (SELECT page_id, regexp_extract(url, '[^/]*$') AS word, regexp_replace(url, '^https?', 's3') AS uri,
                 CASE WHEN page_id % 2 = 0 THEN 'chg' ELSE 'CH' END || (page_id * 7919 + 12345) AS ticket FROM pages)""")
def _(t: Tables) -> DataFrame:
    ticket = F.concat(F.when(F.col("page_id") % 2 == 0, "chg").otherwise("CH"), F.col("page_id") * 7919 + 12345)
    word, uri = F.substring_index("url", "/", -1), F.regexp_replace("url", "^https?", "s3")
    return t["pages"].select(
        "page_id", text.valid_identifier(word).alias("identifier"), text.valid_uri(uri).alias("uri"),
        text.valid_version(word).alias("version"), text.valid_ticket(ticket).alias("ticket"),
    )


@query("h11_split_uri", sql=r"""
    SELECT page_id, split_part(substr(uri, 6), '/', 1) AS bucket, regexp_replace(substr(uri, 6), '^[^/]*/?', '') AS prefix
    FROM (SELECT page_id, CASE WHEN starts_with(url, 'https') THEN replace(url, 'https', 's3') END AS uri FROM pages)""")
def _(t: Tables) -> DataFrame:
    part = text.split_uri(F.regexp_replace("url", "^https", "s3"))
    return t["pages"].select("page_id", part["bucket"].alias("bucket"), part["prefix"].alias("prefix"))


@query("h12_relative_time", sql="""
    SELECT event_id, floor(s / size + 0.5)::BIGINT AS amount, unit
    FROM (SELECT event_id, s, CASE WHEN abs(s) >= 604800 THEN 'week' WHEN abs(s) >= 86400 THEN 'day' WHEN abs(s) >= 3600 THEN 'hour'
                                   WHEN abs(s) >= 60 THEN 'minute' ELSE 'second' END AS unit,
                 CASE WHEN abs(s) >= 604800 THEN 604800 WHEN abs(s) >= 86400 THEN 86400 WHEN abs(s) >= 3600 THEN 3600
                      WHEN abs(s) >= 60 THEN 60 ELSE 1 END AS size
          FROM (SELECT event_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')) / 1e6 + 0.5) AS s FROM events))""")
def _(t: Tables) -> DataFrame:
    when = text.relative_time(F.col("ts"), F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return t["events"].select("event_id", when["amount"].alias("amount"), when["unit"].alias("unit"))


@query("h13_execute_ref", views="jobs", sql="""
    SELECT tenant_id, job_id, CASE WHEN o % 9 <> 0 THEN c_mktsegment END AS model_name,
           CASE WHEN o % 9 <> 0 THEN (o % 3)::VARCHAR END AS model_version
    FROM jobs""")
def _(t: Tables) -> DataFrame:
    ref = steps.execute_ref(F.col("steps"))
    return v.jobs(t).select(*JOB, ref["model_name"].alias("model_name"), ref["model_version"].alias("model_version"))


@query("h14_step_shape_errors", views="step_lists", sql="""
    SELECT o_orderkey AS definition, CASE WHEN o_orderkey % 50 = 0 THEN 'no steps' ELSE concat_ws(',',
             CASE WHEN types < 3 THEN 'repeated step type' END, CASE WHEN unordered THEN 'steps out of order' END,
             CASE WHEN ids < 3 THEN 'repeated step id' END, CASE WHEN forward THEN 'depends on a later step' END) END AS errors
    FROM orders LEFT JOIN (
      SELECT o, count(DISTINCT type) AS types, count(DISTINCT step_id) AS ids,
             bool_or(rank < before) AS unordered, bool_or(depends IS NOT NULL AND NOT list_contains(earlier, depends)) AS forward
      FROM (SELECT *, lag(rank) OVER w AS before,
                   coalesce(list(step_id) OVER (PARTITION BY o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS earlier
            FROM (SELECT *, list_position(['data_pipeline', 'execute_model', 'data_quality_check', 'approval', 'load_to_snowflake'], type) AS rank
                  FROM step_lists) WINDOW w AS (PARTITION BY o ORDER BY i)) GROUP BY o) ON o = o_orderkey""")
def _(t: Tables) -> DataFrame:
    return v.step_lists(t).select("definition", joined(steps.step_shape_errors(F.col("steps"))).alias("errors"))


# --- audit views ---------------------------------------------------------------------------------

@query("j2_audit_by_tenant", views="audit", sql="SELECT event_id, actor, action FROM audit WHERE tenant_id = 'tenant-1'")
def _(t: Tables) -> DataFrame:
    return audit.audit_by_tenant(audit.audit_rows(v.audit(t)), "tenant-1").select("event_id", "actor", "action")


@query("j3_audit_by_date", views="audit", sql="SELECT tenant_id, event_id FROM audit WHERE ts::DATE = DATE '2024-01-09'")
def _(t: Tables) -> DataFrame:
    return audit.audit_by_date(audit.audit_rows(v.audit(t)), "2024-01-09").select("tenant_id", "event_id")


@query("j4_audit_by_actor", views="audit", sql="SELECT tenant_id, event_id, action FROM audit WHERE actor = 'user-7'")
def _(t: Tables) -> DataFrame:
    return audit.audit_by_actor(audit.audit_rows(v.audit(t)), "user-7").select("tenant_id", "event_id", "action")


@query("j5_audit_by_entity", views="audit", sql="""
    SELECT tenant_id, event_id, entity_type || '#' || entity_id AS entity_key FROM audit WHERE entity_type = 'model' AND entity_id = '22'""")
def _(t: Tables) -> DataFrame:
    found = audit.audit_by_entity(audit.audit_rows(v.audit(t)), "model", "22")
    return found.select("tenant_id", "event_id", "entity_key")
