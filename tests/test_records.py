"""Snapshots, rules, lists, counts and audit on hand cases."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scorewatch.operators import audit, dashboards, governance, listing, runs, snapshots
from scorewatch.values import MONITORING_STATUSES, RUN_KEYS

T0 = dt.datetime(2024, 1, 1)
SNAP = ", ".join(f"{k} string" for k in RUN_KEYS) + (
    ", recorded_at timestamp, request_count long, error_rate double, max_psi double, dq_passed boolean, derived_status string"
)


def snap(hours=0, status="Passed", run="r1", version="1", rows=10):
    return ("acme", "m", version, "j", run, T0 + dt.timedelta(hours=hours), rows, 0.01, 0.0, status != "Failed", status)


def snaps(spark, *rows):
    return spark.createDataFrame(list(rows), SNAP)


def test_first_snapshot_of_a_run_wins(spark):
    df = snaps(spark, snap(1, "Failed"), snap(0, "Passed"))
    assert [r["derived_status"] for r in snapshots.first_write_wins(df).collect()] == ["Passed"]
    assert snapshots.new_snapshots(df, snaps(spark, snap(5))).count() == 0


def test_latest_snapshot_sets_the_status(spark):
    models = spark.createDataFrame([("acme", "m", "1"), ("acme", "m", "2")], "tenant_id string, model_name string, version string")
    df = snaps(spark, snap(0, "Passed"), snap(2, "Rework", "r3"), snap(1, "Failed", "r2"))
    got = {r["version"]: r["monitoring_status"] for r in snapshots.current_status(models, df).collect()}
    assert got == {"1": "Rework", "2": "NotStarted"}
    assert [r["run_id"] for r in snapshots.latest_snapshot(df).collect()] == ["r3"]
    assert [r["version"] for r in snapshots.missing_snapshot_models(models, df).collect()] == ["2"]


def test_previous_row_count(spark):
    df = snaps(spark, snap(0, rows=7), snap(1, run="r2", rows=0), snap(900, run="r3", rows=5))
    got = {r["run_id"]: r["previous_row_count"] for r in snapshots.previous_row_count(df).collect()}
    assert got == {"r1": None, "r2": 7, "r3": None}


def test_unknown_model_gets_global_limits(spark):
    models = spark.createDataFrame([("acme", "m", 1, 0.5, None)], "tenant_id string, model_name string, version int, psi_fail_override double, err_fail_override double")
    df = snaps(spark, snap(), snap(version="2"))
    got = {r["version"]: (r["model_known"], r["thresholds"]["psi_fail"]) for r in snapshots.with_thresholds(df, models).collect()}
    assert got == {"1": (True, 0.5), "2": (False, 0.25)}


def test_only_gated_and_approved_runs_are_publishable(spark):
    df = snaps(spark, *[snap(i, "Failed" if i == 0 else "Passed", f"r{i}") for i in range(4)])
    df = df.withColumn("thresholds", F.struct(*[F.lit(1.0).alias(n) for n in ("psi_warn", "psi_fail", "error_rate_warn", "error_rate_fail")]))
    todo = df.select(*RUN_KEYS, (F.col("run_id") != "r3").alias("requires_approval"))
    approvals = df.filter("run_id IN ('r0', 'r1')").select(*RUN_KEYS, F.lit(True).alias("approved")).unionByName(
        df.filter("run_id = 'r2'").select(*RUN_KEYS, F.lit(False).alias("approved")))
    got = snapshots.publishable_runs(todo, df, approvals)
    assert sorted(r["run_id"] for r in got.collect()) == ["r1", "r3"]


EVENTS = "tenant_id string, model_name string, version string, event_id long, ts timestamp, kind string, run_status string, approved boolean"


def replayed(rows):
    """The rules applied one event at a time."""
    rank, out, state = {"snapshot": 0, "gate": 1, "review": 2}, [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[4], rank[r[5]], r[3])):
        model, kind, status, ok = r[1], r[5], r[6], r[7]
        if kind == "snapshot":
            state[model] = status
        elif kind == "gate" and status == "Rework":
            state[model] = "InReview"
        elif kind == "review" and status == "Rework" and state.get(model) == "InReview":
            state[model] = "Passed" if ok else "Rework"
        else:
            continue
        out.append((model, r[3], state[model]))
    return out


@pytest.mark.parametrize("approved,expected", [(True, "Passed"), (False, "Rework")])
def test_review_closes_once(spark, approved, expected):
    at = [T0 + dt.timedelta(hours=30 * i) for i in range(4)]
    rows = [("a", "m", "1", 0, at[0], "snapshot", "Rework", None), ("a", "m", "1", 1, at[1], "gate", "Rework", None),
            ("a", "m", "1", 2, at[2], "review", "Rework", approved), ("a", "m", "1", 3, at[3], "review", "Rework", not approved)]
    got = governance.review_history(spark.createDataFrame(rows, EVENTS)).orderBy("ts").collect()
    assert [r["status"] for r in got] == ["Rework", "InReview", expected]


def test_review_history_equals_a_replay(spark):
    rng = random.Random(5)
    rows = []
    for i in range(2500):
        kind = rng.choice(["snapshot", "gate", "review"])
        ts = T0 + dt.timedelta(hours=rng.randrange(400))
        model = "hot" if i % 3 == 0 else f"m{rng.randrange(20)}"
        rows.append(("a", model, "1", i, ts, kind, rng.choice(["Rework", "Rework", "Failed", "Passed"]), rng.random() < 0.5))
    history = governance.review_history(spark.createDataFrame(rows, EVENTS))
    assert sorted((r["model_name"], r["event_id"], r["status"]) for r in history.collect()) == sorted(replayed(rows))
    changes, last = [], {}
    for model, event, status in replayed(rows):
        if last.get(model) != status:
            changes.append((model, event, last.get(model), status))
        last[model] = status
    got = governance.status_changes(history).collect()
    assert sorted((r["model_name"], r["event_id"], str(r["previous"]), r["status"]) for r in got) == sorted((m, e, str(p), s) for m, e, p, s in changes)


def test_promotion_sees_a_snapshot_of_the_same_instant(spark):
    moves = spark.createDataFrame([("acme", "m", "1", 1, T0), ("acme", "x", "1", 2, T0)], "tenant_id string, model_name string, version string, event_id long, ts timestamp")
    got = {r["event_id"]: (r["status"], r["blocked"]) for r in governance.promotions_asof(moves, snaps(spark, snap(0, "Failed"))).collect()}
    assert got == {1: ("Failed", True), 2: ("NotStarted", False)}


def test_illegal_transitions(spark):
    stages = ["Staging", "Production", "Archived", "Staging"]
    rows = [("a", "m", "1", i, T0 + dt.timedelta(days=i), s) for i, s in enumerate(stages)] + [("a", "n", "1", 9, T0, "Production")]
    df = spark.createDataFrame(rows, "tenant_id string, model_name string, version string, event_id long, ts timestamp, stage string")
    got = governance.illegal_transitions(df).collect()
    assert sorted((r["from_stage"], r["stage"]) for r in got) == [("Archived", "Staging"), ("None", "Production")]


def test_overdue_is_inclusive(spark):
    step = "array<struct<step_id:string,type:string,status:string,started_at:timestamp>>"
    at = [("s1", "execute_model", "running", T0), ("s2", "approval", "running", T0 + dt.timedelta(seconds=1)), ("s3", "x", "idle", T0)]
    df = spark.createDataFrame([("a", "j", at)], f"tenant_id string, job_id string, steps {step}")
    got = governance.overdue_steps(df, F.lit(T0 + dt.timedelta(hours=6))).collect()
    assert [(r["step_id"], r["elapsed_seconds"]) for r in got] == [("s1", 21600.0)]


def test_run_numbers_and_trimmed_history(spark):
    rows = [("a", "j", T0 + dt.timedelta(days=i), i, f"d{i}") for i in range(12)]
    df = spark.createDataFrame(rows, "tenant_id string, job_id string, at timestamp, n long, detail string")
    got = runs.number_runs(df, "at").orderBy("n").collect()
    assert [got[0]["run_id"], got[11]["run_id"]] == ["RUN-0001", "RUN-0012"]
    kept = runs.trim_history(df, "at", ["detail"], 10).orderBy("n").collect()
    assert [r["detail"] for r in kept][:3] == [None, None, "d2"]


def test_trimmed_nested_history(spark):
    history = [(f"r{i}", [("s",)]) for i in range(12)]
    df = spark.createDataFrame([("j", history)], "job_id string, run_history array<struct<run_id:string,steps:array<struct<step_id:string>>>>")
    got = runs.trim_nested_history(df, 10).first()["run_history"]
    assert [h["steps"] is None for h in got] == [True, True] + [False] * 10 and got[0]["run_id"] == "r0"


def test_counts_show_known_and_unknown_values(spark):
    df = spark.createDataFrame([("Passed",), ("Odd",), (None,), ("Passed",)], "monitoring_status string")
    got = {r[0]: r[1] for r in dashboards.count_by(df, "monitoring_status", MONITORING_STATUSES).collect()}
    assert got == {"Passed": 2, "Failed": 0, "Rework": 0, "InReview": 0, "NotStarted": 0, "Odd": 1}
    got = {r["monitoring_status"]: (r["n"], r["total_models"]) for r in dashboards.monitoring_dashboard(df).collect()}
    assert got["NotStarted"] == (1, 4) and got["Passed"] == (2, 4)


def test_load_and_utilization(spark):
    step = "array<struct<type:string,status:string>>"
    work = [("acme", "1", "running", [("execute_model", "running"), ("approval", "running")]), ("acme", "2", "pending", [("execute_model", "idle")]),
            ("acme", "3", "failed", [("execute_model", "idle")])]
    jobs = spark.createDataFrame(work, f"tenant_id string, job_id string, status string, steps {step}")
    tenants = spark.createDataFrame([("acme", "400 vCPU"), ("idle", None)], "tenant_id string, max_cpu string")
    got = {r["tenant_id"]: r for r in dashboards.utilization(dashboards.tenant_load(jobs, tenants)).collect()}
    assert [got["acme"][c] for c in ("running", "queued", "allocated_vcpu", "utilization_pct")] == [1, 1, 4, 1]
    assert [got["idle"][c] for c in ("running", "queued", "utilization_pct")] == [0, 0, None]


def test_utilization_rounds_halves_to_even_and_stops_at_100(spark):
    df = spark.createDataFrame([(1, "160"), (1, "32"), (3, "160"), (99, "8"), (1, "0")], "running long, max_cpu string")
    assert [r["utilization_pct"] for r in dashboards.utilization(df).collect()] == [2, 12, 8, 100, None]


def test_lists_are_in_order(spark):
    rows = [("a", "j1", T0), ("b", "j2", T0), ("a", "j3", T0 + dt.timedelta(days=1)), ("b", "j4", T0 - dt.timedelta(days=1))]
    jobs = spark.createDataFrame(rows, "tenant_id string, job_id string, submitted_at timestamp")
    assert [r["job_id"] for r in listing.list_jobs(jobs).collect()] == ["j2", "j4", "j3", "j1"]
    assert [r["job_id"] for r in listing.list_jobs(jobs, "a").collect()] == ["j3", "j1"]
    assert [r["job_id"] for r in listing.recent(jobs, "submitted_at", "job_id", 2).collect()] == ["j3", "j1"]
    models = spark.createDataFrame([("a", "m", v) for v in ("2", "10", "1")], "tenant_id string, model_name string, version string")
    assert [r["version"] for r in listing.list_models(models, "a").collect()] == ["1", "10", "2"]
    assert [r["version"] for r in listing.list_models(models).collect()] == ["2", "10", "1"]
    assert [r["version"] for r in listing.versions(models).collect()] == ["1", "2", "10"]
    assert [r["version"] for r in listing.versions(models, descending=True).collect()] == ["10", "2", "1"]


def test_search(spark):
    models = spark.createDataFrame([("a", f"Fraud {i:02d}", "1") for i in range(12)] + [("a", "other", "1")], "tenant_id string, model_name string, version string")
    assert [r["model_name"] for r in listing.search_models(models, "  FRAUD ").collect()] == [f"Fraud {i:02d}" for i in range(8)]
    assert listing.search_models(models, "OTHER").count() == 1 and listing.search_models(models, " ").count() == 8


def test_pages(spark):
    df = spark.range(45)
    page = listing.paginate(df, [F.desc("id")], 3, 20).collect()
    assert [r["id"] for r in page] == [4, 3, 2, 1, 0] and {r["total"] for r in page} == {45}
    assert listing.paginate(df, [F.desc("id")], 4, 20).count() == 0
    first = listing.paginate(df, [F.col("id")], 0, 0).collect()
    assert [(r["id"], r["page"], r["page_size"]) for r in first] == [(0, 1, 1)]


def test_audit_log(spark, tmp_path):
    path = str(tmp_path / "audit")
    schema = "tenant_id string, event_id long, actor string, action string, entity_type string, entity_id string, ts timestamp"
    rows = [("a", i, "u", "x", "job", "1", T0 + dt.timedelta(hours=13 * i)) for i in range(4)]
    audit.append_audit(spark.createDataFrame(rows[:2], schema), path)
    audit.append_audit(spark.createDataFrame(rows[2:], schema), path)
    log = spark.read.parquet(path)
    assert [r["event_id"] for r in audit.audit_by_tenant(log, "a").collect()] == [3, 2, 1, 0]
    day = audit.audit_by_date(log, "2024-01-02")
    assert [r["event_id"] for r in day.collect()] == [3, 2]
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()
    assert audit.audit_by_entity(log, "job", "1").count() == 4 and audit.audit_by_actor(log, "v").count() == 0
