"""Column expressions on hand cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from scorewatch.functions import status, steps, text


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.fixture(scope="module")
def limits():
    return status.resolve_thresholds(F.lit(None), F.lit(None))


def test_status_matrix(spark, limits):
    rows = [(0.01, 0.01, True), (0.10, 0.01, True), (0.01, 0.05, True), (0.25, 0.01, True), (0.01, 0.15, True), (0.01, 0.01, False)]
    got = values(spark, status.derive_status(F.col("p"), F.col("e"), F.col("d"), limits), rows, "p double, e double, d boolean")
    assert got == ["Passed", "Rework", "Rework", "Failed", "Failed", "Failed"]


def test_overrides_replace_fail_limits_only(spark):
    rows = [(0.5, None), (None, 0.3)]
    got = values(spark, status.resolve_thresholds(F.col("p"), F.col("e")), rows, "p double, e double")
    assert [tuple(g) for g in got] == [(0.1, 0.5, 0.05, 0.15), (0.1, 0.25, 0.05, 0.3)]


def test_failure_reason(spark, limits):
    rows = [(0.3, 0.2, False), (0.01, 0.2, True), (0.01, 0.01, True)]
    got = values(spark, status.failure_reason(F.col("p"), F.col("e"), F.col("d"), limits), rows, "p double, e double, d boolean")
    assert got == [
        "Monitoring failed: data quality checks failed; max PSI 0.3 >= 0.25; error rate 0.2 >= 0.15",
        "Monitoring failed: error rate 0.2 >= 0.15", "Monitoring failed: thresholds breached",
    ]


def test_gate_falls_back_to_checks_without_a_model(spark):
    rows = [("Failed", True), ("Rework", False), (None, True), (None, False)]
    assert values(spark, status.gate(F.col("s"), F.col("d")), rows, "s string, d boolean") == [False, True, True, False]


@pytest.mark.parametrize("fn,cases", [
    (text.parse_vcpu, {"400 vCPU": 400, "up to 16/32": 16, "none": None, None: None}),
    (text.slugify, {"Acme Capital!": "acme-capital", "--": "tenant", "A  b": "a-b"}),
    (text.safe_filename, {"a/b\\my model (1).pkl": "my_model_1_.pkl", "..": "artifact", None: "artifact", "x/": "artifact"}),
    (text.valid_identifier, {"A_b$1": True, "1a": False, "a b": False, "": False}),
    (text.valid_uri, {"s3://b/a=1/": True, "s3://b": True, "s3://b/a'b": False, "http://b": False}),
    (text.valid_version, {"2.1.0": True, " 1 ": True, "a#b": False, "": False, ".1": False}),
    (text.valid_ticket, {"CHG0031245": True, "ritm0012003": True, "CHG123": False, "X1234567": False}),
])
def test_text_rules(spark, fn, cases):
    assert values(spark, fn(F.col("x")), [(k,) for k in cases], "x string") == list(cases.values())


def test_split_uri(spark):
    got = values(spark, text.split_uri(F.col("x")), [("s3://b/p/q",), ("s3://b",), ("s3:///p",), ("file://b",)], "x string")
    assert [g and tuple(g) for g in got] == [("b", "p/q"), ("b", ""), None, None]


def test_deterministic_id(spark):
    got = values(spark, text.deterministic_id(F.col("t"), F.col("k")), [("acme", "key-1"), ("acme", "key-1"), ("acme", "key-2")], "t string, k string")
    assert got[0] == got[1] != got[2] and len(got[0]) == 16 and got[0].startswith("job-")


def test_relative_time(spark):
    now = dt.datetime(2026, 1, 15, 12)
    cases = {
        now: (0, "second"), now - dt.timedelta(seconds=30): (-30, "second"), now - dt.timedelta(minutes=5): (-5, "minute"),
        now - dt.timedelta(hours=3): (-3, "hour"), now - dt.timedelta(days=3): (-3, "day"), now + dt.timedelta(hours=2): (2, "hour"),
        dt.datetime(2026, 1, 1, 12): (-2, "week"), dt.datetime(2025, 11, 15, 12): (-2, "month"),
    }
    got = values(spark, text.relative_time(F.col("x"), F.lit(now)), [(k,) for k in cases], "x timestamp")
    assert [tuple(g) for g in got] == list(cases.values())


def test_version_key_orders_numbers(spark):
    order = ["1", "1.2", "1.10", "2", "10", "12345678901", "rc2", "rc10"]
    df = spark.createDataFrame([(x,) for x in reversed(order)], "x string")
    assert [r[0] for r in df.orderBy(text.version_key(F.col("x"))).collect()] == order


STEP = "array<struct<step_id:string,type:string,status:string,config:struct<model_name:string,model_version:string>>>"


def job(*states, kinds=("data_pipeline", "execute_model", "approval")):
    return [(f"s{i}", k, s, ("m", "1")) for i, (k, s) in enumerate(zip(kinds, states))]


@pytest.mark.parametrize("now,states,expected", [
    ("running", ("succeeded", "succeeded", "approved"), "success"),
    ("failed", ("succeeded", "succeeded", "approved"), "failed"),
    ("pending", ("idle", "idle", "idle"), "pending"),
    ("running", ("succeeded", "succeeded", "idle"), "awaiting_approval"),
    ("running", ("succeeded", "running", "idle"), "running"),
    ("failed", ("succeeded", "failed", "idle"), "failed"),
])
def test_derive_job_status(spark, now, states, expected):
    assert values(spark, steps.derive_job_status(F.col("s"), F.col("x")), [(now, job(*states))], f"s string, x {STEP}") == [expected]


def test_unknown_idle_steps_are_passed_over(spark):
    rows = [("running", job("succeeded", "idle", kinds=("data_pipeline", "odd")))]
    assert values(spark, steps.derive_job_status(F.col("s"), F.col("x")), rows, f"s string, x {STEP}") == ["success"]


def test_execute_ref(spark):
    rows = [(job("idle", "idle"),), ([("s", "execute_model", "idle", ("", "1"))],), ([("s", "approval", "idle", ("m", "1"))],)]
    got = values(spark, steps.execute_ref(F.col("x")), rows, f"x {STEP}")
    assert [g and tuple(g) for g in got] == [("m", "1"), None, None]


@pytest.mark.parametrize("shape,expected", [
    ([("a", "data_pipeline", []), ("b", "execute_model", ["a"])], []),
    ([("a", "execute_model", []), ("b", "data_pipeline", [])], ["steps out of order"]),
    ([("a", "approval", []), ("b", "approval", [])], ["repeated step type"]),
    ([("a", "data_pipeline", []), ("a", "approval", [])], ["repeated step id"]),
    ([("a", "data_pipeline", ["b"]), ("b", "approval", [])], ["depends on a later step"]),
    ([("a", "data_pipeline", ["a"])], ["depends on a later step"]),
    ([], ["no steps"]),
])
def test_step_shape_errors(spark, shape, expected):
    schema = "x array<struct<step_id:string,type:string,depends_on:array<string>>>"
    assert values(spark, steps.step_shape_errors(F.col("x")), [(shape,)], schema) == [expected]
