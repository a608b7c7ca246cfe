"""The example tables of ``views`` as SQL, written independently of the Spark plans."""

from __future__ import annotations

from scorewatch.plans.views import BASELINES, CHECKS, DEFAULT_CHECKS

ISO = "'%Y-%m-%d %H:%M:%S.%f'"


def _baseline_values() -> str:
    return ", ".join(
        f"('{f}', {[float(x) for x in bins]}::DOUBLE[], {[float(x) for x in props]}::DOUBLE[], {regions})"
        for f, bins, props, regions in BASELINES
    )


def _check_values() -> str:
    per_model = {"AUTOMOBILE": DEFAULT_CHECKS, "MACHINERY": DEFAULT_CHECKS, **CHECKS}
    return ", ".join(
        f"('{m}', {i}, '{n}', '{k}', {x}::DOUBLE)" for m, items in per_model.items() for i, (n, k, x) in enumerate(items, 1)
    )


# name -> (views it needs, SQL)
VIEWS: dict[str, tuple[str, str]] = {
    "cust": ("", """
        SELECT c_custkey, c_mktsegment, n_nationkey, n_name, r_regionkey, r_name
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""),
    "scored": ("cust", """
        SELECT r_name AS tenant_id, c_mktsegment AS model_name, '1' AS version,
               'job-' || r_name || '-' || c_mktsegment AS job_id,
               year(l_shipdate)::VARCHAR || '-Q' || quarter(l_shipdate)::VARCHAR AS run_id,
               l_quantity, l_extendedprice, l_discount, l_linenumber, l_returnflag, l_shipdate,
               CASE WHEN l_partkey % 19 <> 0 THEN l_discount * l_quantity END AS prediction
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cust ON o_custkey = c_custkey"""),
    "baseline": ("cust", f"""
        SELECT DISTINCT r_name AS tenant_id, c_mktsegment AS model_name, '1' AS version, feature, bins, proportions
        FROM cust JOIN (VALUES {_baseline_values()}) b(feature, bins, proportions, regions)
          ON list_contains(regions, r_regionkey)
        WHERE NOT (r_regionkey = 4 AND c_mktsegment = 'MACHINERY')"""),
    "manifest": ("cust scored", """
        SELECT tenant_id, model_name, version, job_id, run_id,
               max(date_trunc('quarter', l_shipdate)) + INTERVAL 3 MONTH AS recorded_at
        FROM scored GROUP BY ALL
        UNION ALL
        SELECT DISTINCT r_name, c_mktsegment, '1', 'job-' || r_name || '-' || c_mktsegment, 'EMPTY', TIMESTAMP '1998-06-15'
        FROM cust"""),
    "checks": ("", f"""
        SELECT * FROM (VALUES {_check_values()}) c(model_name, pos, name, type, threshold)"""),
    # columns a run does not have
    "absent": ("manifest", """
        SELECT tenant_id, run_id, 'l_discount' AS col FROM manifest WHERE tenant_id = 'ASIA' AND run_id LIKE '%Q4'
        UNION SELECT tenant_id, run_id, 'prediction' FROM manifest WHERE tenant_id = 'EUROPE' AND run_id LIKE '%Q2'"""),
    "feature_values": ("scored", """
        SELECT tenant_id, model_name, version, run_id, 'l_quantity' AS feature, l_quantity AS v FROM scored
        UNION ALL SELECT tenant_id, model_name, version, run_id, 'l_extendedprice', l_extendedprice FROM scored
        UNION ALL SELECT tenant_id, model_name, version, run_id, 'l_discount', l_discount FROM scored"""),
    "bucket_counts": ("feature_values baseline", """
        SELECT tenant_id, model_name, version, run_id, feature,
               greatest(0, least(len(bins) - 2, len(list_filter(bins, lambda b: b <= v)) - 1)) AS bucket, count(*) AS n
        FROM feature_values JOIN baseline USING (tenant_id, model_name, version, feature)
        WHERE v IS NOT NULL GROUP BY ALL"""),
    "bucket_shares": ("bucket_counts baseline", """
        SELECT t.tenant_id, t.model_name, t.version, t.run_id, t.feature, t.bucket, coalesce(c.n, 0) AS n,
               coalesce(c.n, 0) / t.total AS share, t.expected
        FROM (SELECT *, unnest(range(len(proportions))) AS bucket, unnest(proportions) AS expected
              FROM (SELECT tenant_id, model_name, version, run_id, feature, sum(n) AS total FROM bucket_counts GROUP BY ALL)
              JOIN baseline USING (tenant_id, model_name, version, feature)) t
        LEFT JOIN bucket_counts c USING (tenant_id, model_name, version, run_id, feature, bucket)"""),
    "psi": ("bucket_shares", """
        SELECT tenant_id, model_name, version, run_id, feature, round(list_sum(list(
                 (greatest(share, 1e-4) - greatest(expected, 1e-4)) * ln(greatest(share, 1e-4) / greatest(expected, 1e-4))
                 ORDER BY bucket)), 4) AS psi
        FROM bucket_shares GROUP BY ALL"""),
    # drift as a report sees it: only columns the run has
    "run_psi": ("psi absent", """
        SELECT p.* FROM psi p LEFT JOIN absent a ON p.tenant_id = a.tenant_id AND p.run_id = a.run_id AND p.feature = a.col
        WHERE a.col IS NULL"""),
    "runs": ("manifest scored absent", """
        SELECT *, nullif(lag(request_count) OVER (PARTITION BY tenant_id, model_name ORDER BY recorded_at, job_id, run_id), 0)
                    AS previous_row_count
        FROM (SELECT m.*, coalesce(n, 0) AS request_count, coalesce(null_predictions, 0) AS null_predictions,
                     CASE WHEN m.model_name <> 'BUILDING' THEN 'prediction' END AS prediction_col,
                     EXISTS (FROM absent a WHERE a.tenant_id = m.tenant_id AND a.run_id = m.run_id AND a.col = 'prediction') AS no_prediction
              FROM manifest m LEFT JOIN (
                SELECT tenant_id, model_name, run_id, count(*) AS n, count(*) FILTER (prediction IS NULL) AS null_predictions
                FROM scored GROUP BY ALL) USING (tenant_id, model_name, run_id))"""),
    "error_rates": ("runs", """
        SELECT *, CASE WHEN prediction_col IS NULL THEN 0.0 WHEN no_prediction THEN 1.0 WHEN request_count = 0 THEN 0.0
                       ELSE round(null_predictions / request_count, 4) END AS error_rate
        FROM runs"""),
    # baseline features against the columns of a run
    "expected_columns": ("runs baseline absent", """
        SELECT r.tenant_id, r.model_name, r.run_id, b.feature, b.feature = 'annual_income' OR EXISTS (
                 FROM absent a WHERE a.tenant_id = r.tenant_id AND a.run_id = r.run_id AND a.col = b.feature) AS missing
        FROM runs r JOIN baseline b USING (tenant_id, model_name)"""),
    "schema_gaps": ("expected_columns", """
        SELECT tenant_id, model_name, run_id, count(*) AS expected, count(*) FILTER (missing) AS missing,
               string_agg(feature, ', ' ORDER BY feature) FILTER (missing) AS names
        FROM expected_columns GROUP BY ALL"""),
    "check_results": ("error_rates checks schema_gaps absent", """
        SELECT *, round(raw, 4) AS observed, raw <= threshold AS passed,
               CASE WHEN gone THEN 'column ''' || shown || ''' not found in scoring output — check fails'
                    WHEN type = 'row_count_delta' AND previous_row_count IS NULL THEN 'first run — no previous row count to compare'
                    WHEN type = 'schema_match' AND expected IS NULL THEN 'no drift baseline registered — no expected schema to compare'
                    WHEN type = 'schema_match' AND missing > 0 THEN 'missing expected columns: [''' || replace(names, ', ', ''', ''') || ''']' END AS note
        FROM (SELECT *, CASE WHEN gone THEN 1.0
                             WHEN type = 'null_rate' AND request_count = 0 THEN 0.0
                             WHEN type = 'null_rate' AND shown = 'prediction' THEN null_predictions / request_count
                             WHEN type = 'null_rate' THEN 0.0
                             WHEN type = 'row_count_delta' AND previous_row_count IS NULL THEN 0.0
                             WHEN type = 'row_count_delta' THEN abs(request_count - previous_row_count) / previous_row_count
                             WHEN expected IS NULL THEN 0.0 ELSE missing / expected END AS raw
              FROM (SELECT r.*, c.pos, c.type, c.threshold, g.expected, g.missing, g.names,
                           CASE WHEN trim(c.name) = '' THEN c.type || '_' || c.pos ELSE trim(c.name) END AS shown,
                           c.type = 'null_rate' AND (trim(c.name) = 'no_such_column' OR EXISTS (
                             FROM absent a WHERE a.tenant_id = r.tenant_id AND a.run_id = r.run_id AND a.col = trim(c.name))) AS gone
                    FROM error_rates r JOIN checks c USING (model_name) LEFT JOIN schema_gaps g USING (tenant_id, model_name, run_id)))"""),
    "reports": ("error_rates check_results run_psi baseline", """
        SELECT r.*, coalesce(p.max_psi, 0.0) AS max_psi, coalesce(p.metrics, 0) AS metrics, coalesce(c.dq_passed, true) AS dq_passed,
               coalesce(c.failed, '') AS failed, coalesce(s.skipped, '') AS skipped,
               CASE WHEN b.model_name IS NULL THEN 'none' ELSE 'psi_vs_baseline' END AS drift_computation
        FROM error_rates r
        LEFT JOIN (SELECT tenant_id, model_name, run_id, max(psi) AS max_psi, count(*) AS metrics FROM run_psi GROUP BY ALL) p
          USING (tenant_id, model_name, run_id)
        LEFT JOIN (SELECT tenant_id, model_name, run_id, bool_and(passed) AS dq_passed,
                          string_agg(shown, ',' ORDER BY pos) FILTER (NOT passed AND last) AS failed
                   FROM (SELECT *, pos = max(pos) OVER (PARTITION BY tenant_id, model_name, run_id, shown) AS last FROM check_results)
                   GROUP BY ALL) c USING (tenant_id, model_name, run_id)
        LEFT JOIN (SELECT m.tenant_id, m.model_name, m.run_id, string_agg(feature, ',' ORDER BY feature) AS skipped
                   FROM manifest m JOIN baseline b USING (tenant_id, model_name)
                   LEFT JOIN run_psi q USING (tenant_id, model_name, run_id, feature)
                   WHERE q.psi IS NULL GROUP BY ALL) s USING (tenant_id, model_name, run_id)
        LEFT JOIN (SELECT DISTINCT tenant_id, model_name FROM baseline) b USING (tenant_id, model_name)"""),
    "models": ("cust", """
        SELECT r_name AS tenant_id, c_mktsegment AS model_name, version,
               ['None', 'Staging', 'Production', 'Archived'][n % 4 + 1] AS stage,
               CASE WHEN c_mktsegment = 'BUILDING' THEN 0.5::DOUBLE END AS psi_fail_override,
               CASE WHEN r_name = 'ASIA' THEN 0.3::DOUBLE END AS err_fail_override,
               ['Passed', 'Failed', 'Rework', 'InReview', NULL, 'Legacy'][n % 6 + 1] AS monitoring_status
        FROM (SELECT DISTINCT r_name, c_mktsegment, version, length(r_name) + length(c_mktsegment) + i AS n
              FROM cust, (VALUES (0, '1'), (1, '2'), (2, '10')) v(i, version))"""),
    "snapshots": ("cust", """
        SELECT tenant_id, model_name, '1' AS version, 'job-' || tenant_id || '-' || model_name AS job_id,
               year(q)::VARCHAR || '-Q' || quarter(q)::VARCHAR AS run_id, q::TIMESTAMP + INTERVAL 3 MONTH AS recorded_at,
               request_count, round(errors / request_count, 4) AS error_rate,
               round(psi_sum / (request_count * 487), 4) AS max_psi, dq_passed
        FROM (SELECT r_name AS tenant_id, c_mktsegment AS model_name, date_trunc('quarter', o_orderdate) AS q,
                     count(*) AS request_count, count(*) FILTER (o_orderkey % 11 = 0) AS errors,
                     sum(o_orderkey % 97) AS psi_sum, sum(o_orderkey) % 13 <> 0 AS dq_passed
              FROM orders JOIN cust ON o_custkey = c_custkey GROUP BY ALL)"""),
    "limits": ("snapshots models", """
        SELECT s.*, 0.10 AS psi_warn, coalesce(psi_fail_override, 0.25) AS psi_fail, 0.05 AS error_rate_warn,
               coalesce(err_fail_override, 0.15) AS error_rate_fail, m.model_name IS NOT NULL AS model_known
        FROM snapshots s LEFT JOIN models m USING (tenant_id, model_name, version)"""),
    "statuses": ("limits", """
        SELECT *, CASE WHEN max_psi >= psi_fail OR error_rate >= error_rate_fail OR NOT dq_passed THEN 'Failed'
                       WHEN max_psi >= psi_warn OR error_rate >= error_rate_warn THEN 'Rework' ELSE 'Passed' END AS derived_status
        FROM limits"""),
    "duplicated": ("snapshots", """
        SELECT * FROM snapshots
        UNION ALL SELECT * REPLACE (recorded_at + INTERVAL 1 HOUR AS recorded_at, NOT dq_passed AS dq_passed)
        FROM snapshots"""),
    "definitions": ("cust", """
        SELECT r_name AS tenant_id, 'pl-' || n || '-' || d AS pipeline_id, n_name || ' ' || d AS name,
               ['draft', 'active', 'archived'][(n + d) % 3 + 1] AS status,
               CASE d WHEN 2 THEN 'staging' WHEN 4 THEN NULL ELSE 'production' END AS environment,
               TIMESTAMP '2024-01-01' + to_hours(n * 5 + d) AS updated_at,
               CASE WHEN n % 2 = 0 THEN TIMESTAMP '2024-02-01' END AS last_success_at,
               CASE WHEN n % 11 = 0 THEN 'UNREGISTERED'
                    ELSE ['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'][n % 5 + 1] END AS model_name,
               ['1', '2', '10', '3'][d % 4 + 1] AS model_version, n, d
        FROM (SELECT DISTINCT r_name, n_nationkey::INTEGER AS n, n_name, left(o_orderpriority, 1)::INTEGER AS d
              FROM orders JOIN cust ON o_custkey = c_custkey)"""),
    "jobs": ("cust", """
        SELECT r_name AS tenant_id, 'job-' || o_orderkey AS job_id, CASE WHEN o_orderkey % 7 = 0 THEN 'pl-gone-' || o_orderkey ELSE 'pl-' || n_nationkey || '-' || left(o_orderpriority, 1) END AS pipeline_id,
               CASE WHEN o_orderkey % 20 < 4 THEN ['pending', 'awaiting_approval', 'cancelled', 'legacy'][o_orderkey % 20 + 1]
                    WHEN o_orderkey % 20 > 4 THEN CASE o_orderstatus WHEN 'F' THEN 'success' WHEN 'O' THEN 'running' ELSE 'failed' END
               END AS status,
               ['production', 'staging', NULL][o_orderkey % 3 + 1] AS run_environment,
               o_orderdate + to_seconds(o_orderkey % 86400) AS submitted_at, o_orderkey AS o, c_mktsegment
        FROM orders JOIN cust ON o_custkey = c_custkey"""),
    "job_steps": ("jobs", """
        SELECT *, CASE WHEN state <> 'idle' THEN submitted_at + to_hours(i) END AS started_at
        FROM (SELECT j.*, i, 's' || (i + 1) AS step_id, type,
                     CASE WHEN i < o % 6 THEN CASE WHEN type = 'approval' THEN 'approved' ELSE 'succeeded' END
                          WHEN i = o % 6 THEN ['running', 'failed', 'idle', 'awaiting_approval'][o % 4 + 1] ELSE 'idle' END AS state
              FROM jobs j, (VALUES (0, 'data_pipeline'), (1, 'execute_model'), (2, 'data_quality_check'), (3, 'approval'),
                                   (4, 'load_to_snowflake')) s(i, type))"""),
    "tenants": ("cust", """
        SELECT DISTINCT r_name AS tenant_id, CASE WHEN r_regionkey = 3 THEN 'suspended' ELSE 'active' END AS status,
               CASE WHEN r_regionkey <> 1 THEN 's3://data/' || lower(r_name) || '/' END AS data_prefix,
               ['400 vCPU', 'no limit', NULL, '0 vCPU'][r_regionkey + 1] AS max_cpu
        FROM cust WHERE r_regionkey <> 4"""),
    "audit": ("", """
        SELECT 'tenant-' || user_id % 3 AS tenant_id, event_id, 'user-' || user_id AS actor, event_type AS action,
               ['job', 'model', 'pipeline'][k::INTEGER % 3 + 1] AS entity_type, k AS entity_id, ts
        FROM (SELECT *, regexp_extract(props, '[0-9]+') AS k FROM events)"""),
    "event_models": ("", """
        SELECT 'tenant-' || user_id % 3 AS tenant_id, 'm-' || user_id AS model_name, event_id, ts, event_type FROM events"""),
    "stage_events": ("event_models", """
        SELECT * EXCLUDE event_type, CASE event_type WHEN 'click' THEN 'Staging' WHEN 'purchase' THEN 'Production' ELSE 'Archived' END AS stage
        FROM event_models WHERE event_type IN ('click', 'purchase', 'signup')"""),
    "review_events": ("event_models", """
        SELECT *, CASE event_type WHEN 'view' THEN 'snapshot' WHEN 'error' THEN 'gate' ELSE 'review' END AS kind,
               CASE event_type WHEN 'view' THEN 0 WHEN 'error' THEN 1 ELSE 2 END AS kind_rank,
               CASE WHEN event_id % 2 = 0 THEN 'Rework' WHEN event_id % 3 = 0 THEN 'Failed' ELSE 'Passed' END AS run_status,
               event_id % 5 < 3 AS approved
        FROM event_models"""),
    # the state machine replayed event by event
    "numbered_events": ("review_events", """
        SELECT *, row_number() OVER (PARTITION BY tenant_id, model_name ORDER BY ts, kind_rank, event_id) AS nr FROM review_events"""),
    "replay": ("numbered_events", """
        SELECT tenant_id, model_name, event_id, ts, kind_rank, nr, state, changed FROM (
          WITH RECURSIVE r AS (
            SELECT e.*, CASE WHEN kind = 'snapshot' THEN run_status WHEN kind = 'gate' AND run_status = 'Rework' THEN 'InReview' END AS state,
                   kind = 'snapshot' OR (kind = 'gate' AND run_status = 'Rework') AS changed
            FROM numbered_events e WHERE nr = 1
            UNION ALL
            SELECT e.*, CASE WHEN e.kind = 'snapshot' THEN e.run_status
                             WHEN e.kind = 'gate' AND e.run_status = 'Rework' THEN 'InReview'
                             WHEN e.kind = 'review' AND e.run_status = 'Rework' AND r.state = 'InReview'
                               THEN CASE WHEN e.approved THEN 'Passed' ELSE 'Rework' END
                             ELSE r.state END,
                   e.kind = 'snapshot' OR (e.kind = 'gate' AND e.run_status = 'Rework')
                     OR (e.kind = 'review' AND e.run_status = 'Rework' AND coalesce(r.state = 'InReview', false))
            FROM r JOIN numbered_events e ON e.tenant_id = r.tenant_id AND e.model_name = r.model_name AND e.nr = r.nr + 1)
          SELECT * FROM r)"""),
    "customer_runs": ("", """
        SELECT 'tenant-' || o_custkey % 3 AS tenant_id, 'job-' || o_custkey AS job_id, o_orderkey, o_orderdate AS started_at,
               o_orderstatus AS final_status, o_totalprice AS detail
        FROM orders"""),
    "part_models": ("", """
        SELECT p_brand AS tenant_id, p_name || ' ' || p_partkey AS model_name, p_size::VARCHAR AS version, p_name AS family FROM part"""),
    "supplier_tenants": ("", """
        SELECT replace(lower(s_name), '#', '-') AS tenant_id, s_name AS name,
               TIMESTAMP '2020-01-01' + to_days(((s_suppkey * 7919) % 1000)::INTEGER) AS created_at, (s_suppkey % 500)::VARCHAR AS max_cpu
        FROM supplier"""),
    "step_lists": ("", """
        SELECT o_orderkey AS o, i, step_id, types[pos] AS type, depends FROM (
          SELECT o_orderkey, i, CASE WHEN o_orderkey % 7 = 0 THEN 's1' ELSE 's' || (i + 1) END AS step_id,
                 (o_orderkey + i * (o_orderkey % 3)) % 5 + 1 AS pos,
                 CASE WHEN i = 1 THEN 's1' WHEN i = 2 THEN 's2' WHEN o_orderkey % 4 = 0 THEN 's3' END AS depends,
                 ['data_pipeline', 'execute_model', 'data_quality_check', 'approval', 'load_to_snowflake'] AS types
          FROM orders, (VALUES (0), (1), (2)) s(i) WHERE o_orderkey % 50 <> 0)"""),
}


def with_views(names: list[str], body: str) -> str:
    """``body`` preceded by the views it needs, each once, in order of need."""
    order: list[str] = []

    def add(name: str) -> None:
        if name not in order:
            for needed in VIEWS[name][0].split():
                add(needed)
            order.append(name)

    for name in names:
        add(name)
    if not order:
        return body.strip()
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in order) + "\n" + body.strip()
