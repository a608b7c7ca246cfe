"""Registered queries: scoring, quality, drift and snapshots."""

from __future__ import annotations

import io
import tarfile

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewatch.functions.drift import bucketize
from scorewatch.functions.status import derive_status, failure_reason, resolve_thresholds
from scorewatch.operators import quality, scoring, snapshots
from scorewatch.plans import views as v
from scorewatch.plans.registry import iso, joined, query
from scorewatch.plans.views import Tables
from scorewatch.session import scratch_path, write_bytes
from scorewatch.sources import cells, runs
from scorewatch.values import MODEL_KEYS, RUN_KEYS

RUN = ["tenant_id", "model_name", "run_id"]


def _report(t: Tables) -> DataFrame:
    return quality.report_from_cells(*v.measured(t), v.baselines(t))


def drift_status(summary: DataFrame, models: DataFrame) -> DataFrame:
    """Every run of a drift summary with its monitoring status."""
    limited = snapshots.with_thresholds(summary, models)
    status = derive_status(F.col("max_psi"), F.lit(0.0), F.lit(True), F.col("thresholds"))
    return limited.select(*RUN, "request_count", "features", "max_psi", status.alias("status"))


@query("drift_status", views="runs psi models", sql="""
    SELECT tenant_id, model_name, run_id, request_count, coalesce(features, 0) AS features, coalesce(max_psi, 0.0) AS max_psi,
           CASE WHEN max_psi >= coalesce(psi_fail_override, 0.25) THEN 'Failed' WHEN max_psi >= 0.10 THEN 'Rework' ELSE 'Passed' END AS status
    FROM runs
    LEFT JOIN (SELECT tenant_id, model_name, run_id, max(psi) AS max_psi, count(*) AS features FROM psi GROUP BY ALL)
      USING (tenant_id, model_name, run_id)
    LEFT JOIN models USING (tenant_id, model_name, version)""")
def _(t: Tables) -> DataFrame:
    cells, manifest = v.measured(t)
    return drift_status(quality.drift_summary_from_cells(cells, manifest, v.baselines(t), v.scored(t).columns), v.models(t))


@query("c4_features_with_baseline", views="psi scored", sql="""
    SELECT tenant_id, model_name, run_id, feature, n AS request_count, psi
    FROM psi JOIN (SELECT tenant_id, model_name, run_id, count(*) AS n FROM scored GROUP BY ALL) USING (tenant_id, model_name, run_id)""")
def _(t: Tables) -> DataFrame:
    return quality.drift_by_run(v.scored(t), v.baselines(t)).select(*RUN, "feature", "request_count", "psi")


@query("d1_request_count", views="runs", sql="SELECT tenant_id, model_name, run_id, request_count FROM runs")
def _(t: Tables) -> DataFrame:
    counted = v.run_manifest(t).select(*RUN_KEYS).join(quality.run_counts(v.scored(t)), RUN_KEYS, "left")
    return counted.select(*RUN, F.coalesce("request_count", F.lit(0)).alias("request_count"))


@query("d2_error_rate", views="error_rates", sql="""
    SELECT tenant_id, model_name, run_id, error_rate FROM error_rates""")
def _(t: Tables) -> DataFrame:
    return _report(t).select(*RUN, "error_rate")


@query("d3_null_rate", views="check_results", sql="""
    SELECT tenant_id, model_name, run_id, shown AS name, observed FROM check_results WHERE type = 'null_rate'
    QUALIFY pos = max(pos) OVER (PARTITION BY tenant_id, model_name, run_id, shown)""")
def _(t: Tables) -> DataFrame:
    return _details(t).filter("type = 'null_rate'").select(*RUN, "name", "observed")


@query("d4_row_count_delta", views="runs", sql="""
    SELECT tenant_id, model_name, run_id, request_count, previous_row_count,
           CASE WHEN previous_row_count IS NULL THEN 0.0
                ELSE round(abs(request_count - previous_row_count) / previous_row_count, 4) END AS delta
    FROM runs""")
def _(t: Tables) -> DataFrame:
    runs = v.run_manifest(t).join(quality.run_counts(v.scored(t)), RUN_KEYS, "left")
    runs = quality.with_previous_count(runs.withColumn("request_count", F.coalesce("request_count", F.lit(0))))
    delta = snapshots.row_count_delta(F.col("request_count"), F.col("previous_row_count"))
    return runs.select(*RUN, "request_count", "previous_row_count", F.round(delta, 4).alias("delta"))


def _details(t: Tables) -> DataFrame:
    return _report(t).select(*RUN, F.inline("dq_details"))


@query("d5_schema_match", views="runs checks schema_gaps", sql="""
    SELECT tenant_id, model_name, run_id, round(coalesce(missing / expected, 0.0), 4) AS observed,
           CASE WHEN expected IS NULL THEN 'no drift baseline registered — no expected schema to compare'
                WHEN missing > 0 THEN 'missing expected columns: [''' || replace(names, ', ', ''', ''') || ''']' ELSE '' END AS note
    FROM runs JOIN checks USING (model_name) LEFT JOIN schema_gaps USING (tenant_id, model_name, run_id) WHERE type = 'schema_match'""")
def _(t: Tables) -> DataFrame:
    return _details(t).filter("type = 'schema_match'").select(*RUN, "observed", F.coalesce("note", F.lit("")).alias("note"))


@query("d6_evaluate_checks", views="check_results", sql="""
    SELECT tenant_id, model_name, run_id, shown AS name, type, threshold, observed, passed, coalesce(note, '') AS note
    FROM check_results QUALIFY pos = max(pos) OVER (PARTITION BY tenant_id, model_name, run_id, shown)""")
def _(t: Tables) -> DataFrame:
    return _details(t).withColumn("note", F.coalesce("note", F.lit("")))


@query("d7_check_names", views="runs check_results", sql="""
    SELECT tenant_id, model_name, run_id, coalesce(names, '') AS names, coalesce(verdict, true) AS verdict
    FROM runs LEFT JOIN (
      SELECT tenant_id, model_name, run_id, string_agg(DISTINCT shown, ',' ORDER BY shown) AS names, bool_and(passed) AS verdict
      FROM check_results GROUP BY ALL) USING (tenant_id, model_name, run_id)""")
def _(t: Tables) -> DataFrame:
    names = F.array_sort(F.transform("dq_details", lambda d: d["name"]))
    return _report(t).select(*RUN, joined(names).alias("names"), F.col("dq_passed").alias("verdict"))


@query("d8_bucketize", views="scored feature_values baseline", sql="""
    SELECT tenant_id, feature, v, greatest(0, least(len(bins) - 2, len(list_filter(bins, lambda b: b <= v)) - 1))::INTEGER AS bucket,
           count(*) AS n
    FROM (SELECT tenant_id, model_name, version, feature, v FROM feature_values
          UNION ALL SELECT tenant_id, model_name, version, 'l_linenumber', l_linenumber FROM scored)
    JOIN baseline USING (tenant_id, model_name, version, feature)
    GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    # every baseline feature whose values are numbers
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_linenumber"]
    wide = v.baselines(t).filter(F.col("feature").isin(names))
    values = v.scored(t).select(*MODEL_KEYS, F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("v")) for f in names
    ])))
    facts = quality.baseline_facts(wide, names)
    pairs = quality.lookup_join(values, wide, [*MODEL_KEYS, "feature"], "inner", small_bytes=facts.wide_bytes)
    return pairs.groupBy("tenant_id", "feature", "v", bucketize(F.col("v"), F.col("bins"), facts.max_edges).alias("bucket")).agg(
        F.count("*").alias("n")
    )


@query("d9_bucket_proportions", views="bucket_shares", sql="""
    SELECT tenant_id, model_name, run_id, feature, bucket::INTEGER AS bucket, n::BIGINT AS n, round(share, 6) AS share FROM bucket_shares""")
def _(t: Tables) -> DataFrame:
    shares = quality.bucket_shares(v.scored(t), v.baselines(t))
    return shares.select(*RUN, "feature", "bucket", "n", F.round("share", 6).alias("share"))


@query("d10_psi", views="runs psi", sql="""
    SELECT tenant_id, model_name, run_id, round(coalesce(total_psi, 0.0), 6) AS total_psi, coalesce(max_psi, 0.0) AS max_psi
    FROM runs LEFT JOIN (SELECT tenant_id, model_name, run_id, sum(psi) AS total_psi, max(psi) AS max_psi FROM psi GROUP BY ALL)
      USING (tenant_id, model_name, run_id)""")
def _(t: Tables) -> DataFrame:
    scores = quality.drift_summary(v.scored(t), v.run_manifest(t), v.baselines(t))
    return scores.select(*RUN, F.round("total_psi", 6).alias("total_psi"), "max_psi")


@query("d11_drift_metrics", views="run_psi", sql="""
    SELECT tenant_id, model_name, run_id, feature, psi FROM run_psi""")
def _(t: Tables) -> DataFrame:
    return _report(t).select(*RUN, F.explode("drift_metrics").alias("feature", "psi"))


@query("d11_drift_skipped", views="reports", sql="""
    SELECT tenant_id, model_name, run_id, drift_computation, skipped FROM reports""")
def _(t: Tables) -> DataFrame:
    return _report(t).select(*RUN, "drift_computation", joined("drift_skipped").alias("skipped"))


@query("d12_max_psi", views="reports", sql="SELECT tenant_id, model_name, run_id, max_psi FROM reports")
def _(t: Tables) -> DataFrame:
    return _report(t).select(*RUN, "max_psi")


@query("d24_inspected_columns", views="check_results", sql="""
    SELECT tenant_id, model_name, count(*) AS runs, min(error_rate) AS lowest, max(error_rate) AS highest
    FROM error_rates GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    # here the columns to look at are found in the manifest itself
    report = quality.dq_report(v.scored(t), v.kept_manifest(t), v.baselines(t))
    return report.groupBy("tenant_id", "model_name").agg(
        F.count("*").alias("runs"), F.min("error_rate").alias("lowest"), F.max("error_rate").alias("highest")
    )


@query("d24_add_cells", views="reports", sql="""
    SELECT tenant_id, model_name, run_id, request_count, error_rate, drift_computation, skipped, max_psi, dq_passed FROM reports""")
def _(t: Tables) -> DataFrame:
    # counted anew in two parts that share every run; the second is written twice, as after a failure
    path, rows, manifest = scratch_path(t.spark, "cells"), v.scored(t), v.kept_manifest(t)
    odd = F.col("l_linenumber") % 2 == 1
    for part, some in (("odd", odd), ("even", ~odd), ("even", ~odd)):
        cells.add_cells(quality.run_cells(rows.filter(some), manifest, v.baselines(t), inspect=v.inspected()), path, part)
    report = quality.report_from_cells(cells.read_cells(t.spark, path), manifest, v.baselines(t))
    return report.select(
        *RUN, "request_count", "error_rate", "drift_computation", joined("drift_skipped").alias("skipped"), "max_psi", "dq_passed")


@query("d24_from_rows", views="reports", sql="""
    SELECT tenant_id, model_name, run_id, request_count, error_rate, max_psi, dq_passed FROM reports""")
def _(t: Tables) -> DataFrame:
    # straight from the scored rows, nothing stored
    report = quality.dq_report(v.scored(t), v.kept_manifest(t), v.baselines(t), inspect=v.inspected())
    return report.select(*RUN, "request_count", "error_rate", "max_psi", "dq_passed")


@query("d24_dq_report", views="reports", sql=r"""
    SELECT tenant_id, model_name, run_id, strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at, request_count, previous_row_count,
           0.0::DOUBLE AS avg_latency_ms, error_rate, drift_computation, metrics AS features, skipped, max_psi, dq_passed, failed
    FROM reports""")
def _(t: Tables) -> DataFrame:
    failed = F.transform(F.filter("dq_details", lambda d: ~d["passed"]), lambda d: d["name"])
    return _report(t).select(
        *RUN, iso("recorded_at").alias("recorded_at"), "request_count", "previous_row_count", "avg_latency_ms", "error_rate",
        "drift_computation", F.size("drift_metrics").cast("long").alias("features"), joined("drift_skipped").alias("skipped"),
        "max_psi", "dq_passed", joined(failed).alias("failed"),
    )


@query("d25_validate_baselines", views="baseline", sql="""
    SELECT tenant_id, model_name, feature, concat_ws('; ',
             CASE WHEN len(bins) < 3 THEN 'needs at least 3 bin edges' END,
             CASE WHEN len(proportions) <> len(bins) - 1 THEN 'needs one proportion per bucket' END,
             CASE WHEN list_min(proportions) < 0 THEN 'has a negative proportion' END,
             CASE WHEN NOT list_sum(proportions) BETWEEN 0.99 AND 1.01 THEN 'proportions do not sum to 1' END,
             CASE WHEN list_sort(bins) <> bins THEN 'edges are not in ascending order' END) AS errors
    FROM (SELECT tenant_id, model_name, feature,
                 CASE WHEN tenant_id = 'ASIA' THEN list_reverse(bins) ELSE bins END AS bins,
                 CASE WHEN model_name = 'FURNITURE' THEN list_transform(proportions, lambda p: p - 0.27) ELSE proportions END AS proportions
          FROM baseline)""")
def _(t: Tables) -> DataFrame:
    rows = v.baselines(t).withColumns({
        "bins": F.when(F.col("tenant_id") == "ASIA", F.reverse("bins")).otherwise(F.col("bins")),
        "proportions": F.when(F.col("model_name") == "FURNITURE", F.transform("proportions", lambda p: p - 0.27)).otherwise(
            F.col("proportions")),
    })
    return quality.validate_baselines(rows).select("tenant_id", "model_name", "feature", F.array_join("errors", "; ").alias("errors"))


@query("fit_baseline", views="feature_values scored", sql="""
    SELECT tenant_id, model_name, feature, bucket::INTEGER AS bucket, round(coalesce(n, 0) / total, 6) AS share
    FROM (SELECT *, unnest(range(len(bins) - 1)) AS bucket
          FROM (SELECT tenant_id, model_name, feature, count(*) AS total FROM feature_values GROUP BY ALL)
          JOIN (VALUES ('l_quantity', [1, 10, 20, 30, 40, 50]::DOUBLE[]), ('l_discount', [0, 0.03, 0.07, 0.1]::DOUBLE[])) e(feature, bins) USING (feature))
    LEFT JOIN (SELECT tenant_id, model_name, feature, greatest(0, least(len(bins) - 2, len(list_filter(bins, lambda b: b <= v)) - 1)) AS bucket, count(*) AS n
               FROM feature_values
               JOIN (VALUES ('l_quantity', [1, 10, 20, 30, 40, 50]::DOUBLE[]), ('l_discount', [0, 0.03, 0.07, 0.1]::DOUBLE[])) e(feature, bins) USING (feature)
               GROUP BY ALL) USING (tenant_id, model_name, feature, bucket)""")
def _(t: Tables) -> DataFrame:
    fitted = quality.fit_baseline(v.scored(t), {"l_quantity": [1, 10, 20, 30, 40, 50], "l_discount": [0, 0.03, 0.07, 0.1]})
    return fitted.select("tenant_id", "model_name", "feature", F.posexplode("proportions").alias("bucket", "share")).withColumn(
        "share", F.round("share", 6)
    )


@query("c3_snapshot_thresholds", views="limits", sql="""
    SELECT tenant_id, model_name, run_id, model_known, psi_warn::DOUBLE AS psi_warn, psi_fail::DOUBLE AS psi_fail,
           error_rate_warn::DOUBLE AS error_rate_warn, error_rate_fail::DOUBLE AS error_rate_fail FROM limits""")
def _(t: Tables) -> DataFrame:
    return snapshots.with_thresholds(v.snapshots(t), v.models(t)).select(*RUN, "model_known", "thresholds.*")


@query("c8_missing_snapshot_models", views="models snapshots", sql="""
    SELECT tenant_id, model_name, version FROM models m
    WHERE NOT EXISTS (FROM snapshots s WHERE s.tenant_id = m.tenant_id AND s.model_name = m.model_name AND s.version = m.version)""")
def _(t: Tables) -> DataFrame:
    return snapshots.missing_snapshot_models(v.models(t), v.snapshots(t)).select(*MODEL_KEYS)


@query("e1_latest_snapshot", views="statuses", sql=r"""
    SELECT tenant_id, model_name, run_id, strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at, derived_status
    FROM statuses QUALIFY row_number() OVER (PARTITION BY tenant_id, model_name, version ORDER BY recorded_at DESC, run_id DESC) = 1""")
def _(t: Tables) -> DataFrame:
    newest = snapshots.latest_snapshot(v.snapshots_with_status(t))
    return newest.select(*RUN, iso("recorded_at").alias("recorded_at"), "derived_status")


@query("e1_current_status", views="models statuses", sql=r"""
    SELECT m.tenant_id, m.model_name, m.version, coalesce(derived_status, 'NotStarted') AS monitoring_status,
           strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS last_snapshot_at
    FROM models m LEFT JOIN (
      FROM statuses QUALIFY row_number() OVER (PARTITION BY tenant_id, model_name, version ORDER BY recorded_at DESC) = 1) s
      USING (tenant_id, model_name, version)""")
def _(t: Tables) -> DataFrame:
    now = snapshots.current_status(v.models(t), v.snapshots_with_status(t))
    return now.select(*MODEL_KEYS, "monitoring_status", iso("last_snapshot_at").alias("last_snapshot_at"))


@query("e2_first_write_wins", views="duplicated", sql=r"""
    SELECT tenant_id, model_name, run_id, strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at, dq_passed, max_psi
    FROM duplicated QUALIFY row_number() OVER (PARTITION BY tenant_id, model_name, version, job_id, run_id ORDER BY recorded_at) = 1""")
def _(t: Tables) -> DataFrame:
    first = snapshots.first_write_wins(v.duplicated_snapshots(t))
    return first.select(*RUN, iso("recorded_at").alias("recorded_at"), "dq_passed", "max_psi")


@query("e3_previous_row_count", views="snapshots", sql="""
    SELECT tenant_id, model_name, run_id, request_count,
           nullif(lag(request_count) OVER (PARTITION BY tenant_id, model_name, version ORDER BY recorded_at), 0) AS previous_row_count
    FROM snapshots""")
def _(t: Tables) -> DataFrame:
    return snapshots.previous_row_count(v.snapshots(t)).select(*RUN, "request_count", "previous_row_count")


@query("h1_derive_status", views="statuses", sql="""
    SELECT tenant_id, model_name, run_id, max_psi, error_rate, dq_passed, derived_status FROM statuses""")
def _(t: Tables) -> DataFrame:
    return v.snapshots_with_status(t).select(*RUN, "max_psi", "error_rate", "dq_passed", "derived_status")


@query("h2_resolve_thresholds", views="models", sql="""
    SELECT tenant_id, model_name, version, 0.1::DOUBLE AS psi_warn, coalesce(psi_fail_override, 0.25)::DOUBLE AS psi_fail,
           0.05::DOUBLE AS error_rate_warn, coalesce(err_fail_override, 0.15)::DOUBLE AS error_rate_fail FROM models""")
def _(t: Tables) -> DataFrame:
    limits = resolve_thresholds(F.col("psi_fail_override"), F.col("err_fail_override"))
    return v.models(t).select(*MODEL_KEYS, limits.alias("l")).select(*MODEL_KEYS, "l.*")


@query("h3_failure_reason", views="statuses", sql="""
    SELECT tenant_id, model_name, run_id, 'Monitoring failed: ' || concat_ws('; ',
             CASE WHEN NOT dq_passed THEN 'data quality checks failed' END,
             CASE WHEN max_psi >= psi_fail THEN 'max PSI ' || max_psi || ' >= ' || psi_fail::DOUBLE END,
             CASE WHEN error_rate >= error_rate_fail THEN 'error rate ' || error_rate || ' >= ' || error_rate_fail::DOUBLE END) AS reason
    FROM statuses WHERE derived_status = 'Failed'""")
def _(t: Tables) -> DataFrame:
    failed = v.snapshots_with_status(t).filter("derived_status = 'Failed'")
    reason = failure_reason(F.col("max_psi"), F.col("error_rate"), F.col("dq_passed"), F.col("thresholds"))
    return failed.select(*RUN, reason.alias("reason"))


@query("k1_build_snapshots", views="reports models", sql="""
    SELECT *, CASE WHEN max_psi >= psi_fail OR error_rate >= error_rate_fail OR NOT dq_passed THEN 'Failed'
                   WHEN max_psi >= 0.10 OR error_rate >= 0.05 THEN 'Rework' ELSE 'Passed' END AS derived_status
    FROM (SELECT r.tenant_id, r.model_name, r.run_id, request_count, error_rate, max_psi, dq_passed,
                 coalesce(psi_fail_override, 0.25) AS psi_fail, coalesce(err_fail_override, 0.15) AS error_rate_fail
          FROM reports r LEFT JOIN models m USING (tenant_id, model_name, version))""")
def _(t: Tables) -> DataFrame:
    built = snapshots.build_snapshots(_report(t), v.models(t))
    return built.select(
        *RUN, "request_count", "error_rate", "max_psi", "dq_passed", "thresholds.psi_fail", "thresholds.error_rate_fail", "derived_status"
    )


@query("k2_record_snapshots", views="duplicated snapshots", sql=r"""
    SELECT tenant_id, model_name, run_id, strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at, dq_passed
    FROM (FROM duplicated WHERE tenant_id <> 'ASIA' QUALIFY row_number() OVER (PARTITION BY tenant_id, model_name, job_id, run_id ORDER BY recorded_at) = 1)""")
def _(t: Tables) -> DataFrame:
    stored = v.snapshots(t).filter("tenant_id = 'ASIA'")
    fresh = snapshots.new_snapshots(v.duplicated_snapshots(t), stored)
    return fresh.select(*RUN, iso("recorded_at").alias("recorded_at"), "dq_passed")


@query("k3_gate", views="statuses", sql="""
    SELECT tenant_id, model_name, run_id, CASE WHEN model_name = 'MACHINERY' THEN dq_passed ELSE derived_status <> 'Failed' END AS gate_passed
    FROM statuses""")
def _(t: Tables) -> DataFrame:
    status = F.when(F.col("model_name") != "MACHINERY", F.col("derived_status"))
    return snapshots.with_gate(v.snapshots_with_status(t).withColumn("derived_status", status)).select(*RUN, "gate_passed")


@query("k4_publishable_runs", views="statuses", sql="""
    SELECT tenant_id, model_name, run_id FROM statuses
    WHERE derived_status <> 'Failed' AND (model_name IN ('BUILDING', 'MACHINERY') OR request_count % 2 = 0)""")
def _(t: Tables) -> DataFrame:
    done = v.snapshots_with_status(t)
    runs = done.select(*RUN_KEYS, (~F.col("model_name").isin("BUILDING", "MACHINERY")).alias("requires_approval"))
    approvals = done.select(*RUN_KEYS, (F.col("request_count") % 2 == 0).alias("approved"))
    return snapshots.publishable_runs(runs, done, approvals).select(*RUN)


def _example_model() -> bytes:
    """A model that cannot score some rows; pickled with its code."""
    class PriceModel:
        def predict(self, rows):
            if (rows["l_partkey"] % 1009 == 0).any():
                raise ValueError("no such part")
            return (rows["l_quantity"] * rows["l_discount"]).where(rows["l_partkey"] % 19 != 0)

    return cloudpickle.dumps(PriceModel())


def _lines(t: Tables) -> DataFrame:
    return t["lineitem"].select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_shipdate")


FEATURES = ["l_partkey", "l_quantity", "l_discount"]


def _dealt_lines(t: Tables) -> DataFrame:
    # the file has one row group; scoring is dearer than dealing its rows to all tasks
    return _lines(t).repartition(t.spark.sparkContext.defaultParallelism)


def _scored_lines(t: Tables) -> DataFrame:
    return scoring.score(_dealt_lines(t), _example_model(), features=FEATURES, on_error="row")


@query("i1_score", sql=r"""
    SELECT l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y-%m-%d') AS shipdate,
           round(CASE WHEN l_partkey % 19 <> 0 AND l_partkey % 1009 <> 0 THEN l_quantity * l_discount END, 6) AS prediction, count(*) AS n
    FROM lineitem GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    keys = ["l_orderkey", "l_linenumber", "l_partkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipdate")]
    return _scored_lines(t).groupBy(*keys, F.round("prediction", 6).alias("prediction")).agg(F.count("*").alias("n"))


@query("d23_reconcile", sql="""
    SELECT count(*) AS rows_read, count(*) AS rows_written,
           count(*) FILTER (l_partkey % 19 = 0 OR l_partkey % 1009 = 0) AS null_predictions, true AS complete
    FROM lineitem""")
def _(t: Tables) -> DataFrame:
    return scoring.write_scored(_dealt_lines(t), scratch_path(t.spark, "scored"), _example_model(), features=FEATURES, on_error="row")


@query("i2_assert_scored", sql="""
    SELECT l_orderkey, count(*) AS n, count(CASE WHEN l_partkey % 19 <> 0 AND l_partkey % 1009 <> 0 THEN 1 END) AS scored
    FROM lineitem GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    out = _scored_lines(t)
    scoring.assert_scored(_lines(t), out)
    return out.groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count("prediction").alias("scored"))


@query("i3_read_model", sql="""
    SELECT l_linenumber, round(sum(CASE WHEN l_partkey % 19 <> 0 AND l_partkey % 1009 <> 0 THEN l_quantity * l_discount END), 2) AS total
    FROM lineitem GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    # an archive in the shared folder, fetched once by every executor
    body, packed = _example_model(), io.BytesIO()
    with tarfile.open(fileobj=packed, mode="w:gz") as archive:
        member = tarfile.TarInfo("deep/model.pkl")
        member.size = len(body)
        archive.addfile(member, io.BytesIO(body))
    path = scratch_path(t.spark, "model") + ".tar.gz"
    write_bytes(t.spark, path, packed.getvalue())
    out = scoring.score(_dealt_lines(t), runs.model_at(t.spark, path), features=FEATURES, on_error="row")
    return out.groupBy("l_linenumber").agg(F.round(F.sum("prediction"), 2).alias("total"))
