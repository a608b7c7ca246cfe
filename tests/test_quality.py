"""Hand-computed cases for counts, checks, drift and whole reports."""

import bisect
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from scorewatch.functions.drift import as_number, bucketize, psi
from scorewatch.operators import quality
from scorewatch.plans.catalog import QUERIES
from scorewatch.values import RUN_KEYS

RUN = ("t", "m", "1", "j", "r1")
BASE_SCHEMA = "tenant_id string, model_name string, version string, feature string, bins array<double>, proportions array<double>"
CHECK = "array<struct<name:string,type:string,threshold:double>>"
HALVES = [("credit_score", [0.0, 5.0, 10.0], [0.5, 0.5])]


def scored(spark, schema, rows, run=RUN):
    keys = ", ".join(f"{k} string" for k in RUN_KEYS)
    return spark.createDataFrame([(*run, *r) for r in rows], f"{keys}, {schema}")


def manifest(spark, columns, checks=(), prediction=None, run=RUN, at=dt.datetime(2024, 1, 1)):
    keys = ", ".join(f"{k} string" for k in RUN_KEYS)
    return spark.createDataFrame(
        [(*run, at, list(columns), prediction, list(checks))],
        f"{keys}, recorded_at timestamp, columns array<string>, prediction_col string, checks {CHECK}",
    )


def baselines(spark, specs=()):
    return spark.createDataFrame([("t", "m", "1", *s) for s in specs], BASE_SCHEMA)


def report(spark, df, checks=(), prediction=None, specs=(), columns=None, stored=None):
    names = columns or [c for c in df.columns if c not in RUN_KEYS]
    m = manifest(spark, names, checks, prediction)
    rows = quality.dq_report(df, m, baselines(spark, specs), stored=stored).collect()
    assert len(rows) == 1
    return rows[0]


def details(row):
    return {d["name"]: d for d in row["dq_details"]}


def test_counts_rows_and_passes_without_checks(spark):
    r = report(spark, scored(spark, "prediction double, credit_score long", [(0.1, 650), (0.9, 700), (0.4, 720)]))
    assert (r["request_count"], r["avg_latency_ms"], r["dq_passed"], r["drift_computation"]) == (3, 0.0, True, "none")


@pytest.mark.parametrize("column,prediction,expected", [
    ("prediction", "prediction", 0.5), ("score", "prediction", 1.0), ("score", None, 0.0), ("score", "", 0.0),
])
def test_error_rate(spark, column, prediction, expected):
    df = scored(spark, f"{column} double", [(0.1,), (None,), (0.4,), (None,)])
    assert report(spark, df, prediction=prediction)["error_rate"] == expected


def test_nan_predictions_are_not_nulls(spark):
    df = scored(spark, "prediction double", [(float("nan"),), (1.0,)])
    assert report(spark, df, prediction="prediction")["error_rate"] == 0.0


def test_null_rate_check(spark):
    df = scored(spark, "credit_score long", [(650,), (None,), (720,), (700,)])
    d = details(report(spark, df, [("credit_score", "null_rate", 0.3)]))["credit_score"]
    assert (d["observed"], d["passed"], d["note"]) == (0.25, True, None)
    df = scored(spark, "credit_score long", [(650,), (None,), (None,), (None,)])
    r = report(spark, df, [("credit_score", "null_rate", 0.3)])
    assert not details(r)["credit_score"]["passed"] and not r["dq_passed"]


def test_null_rate_of_an_absent_column_fails(spark):
    r = report(spark, scored(spark, "other long", [(1,), (2,)]), [("credit_score", "null_rate", 0.99)])
    d = details(r)["credit_score"]
    assert (d["observed"], d["passed"]) == (1.0, False) and "not found" in d["note"]


def test_row_count_delta(spark):
    df = scored(spark, "prediction double", [(0.1,)] * 80)
    before = manifest(spark, ["prediction"], run=("t", "m", "1", "j", "r0"), at=dt.datetime(2023, 1, 1))
    stored = before.withColumn("request_count", F.lit(100).cast("long"))
    d = details(report(spark, df, [("rows", "row_count_delta", 0.1)], stored=stored))["rows"]
    assert (d["observed"], d["passed"]) == (0.2, False)
    for none in (None, stored.withColumn("request_count", F.lit(0).cast("long"))):
        d = details(report(spark, df, [("rows", "row_count_delta", 0.1)], stored=none))["rows"]
        assert (d["observed"], d["passed"]) == (0.0, True) and "first run" in d["note"]


def test_schema_match(spark):
    df = scored(spark, "credit_score long, prediction double", [(650, 0.1)])
    specs = [("credit_score", [0.0, 1.0], [1.0]), ("annual_income", [0.0, 1.0], [1.0])]
    d = details(report(spark, df, [("schema", "schema_match", 0.0)], specs=specs))["schema"]
    assert (d["observed"], d["passed"]) == (0.5, False) and "annual_income" in d["note"]
    assert d["note"] == "missing expected columns: ['annual_income']"
    d = details(report(spark, df, [("schema", "schema_match", 0.0)]))["schema"]
    assert d["passed"] and "no drift baseline" in d["note"]


def test_column_names_are_case_sensitive(spark):
    df = scored(spark, "Credit_Score long", [(650,)])
    assert details(report(spark, df, [("credit_score", "null_rate", 0.9)]))["credit_score"]["observed"] == 1.0


def test_blank_and_repeated_check_names(spark):
    df = scored(spark, "a long", [(1,), (None,)])
    r = report(spark, df, [("a", "null_rate", 0.1), ("  ", "row_count_delta", 0.1), ("a", "null_rate", 0.9)])
    assert [d["name"] for d in r["dq_details"]] == ["row_count_delta_2", "a"]
    assert details(r)["a"]["passed"] and not r["dq_passed"]


def test_checks_compare_before_rounding(spark):
    df = scored(spark, "a long", [(None,)] + [(1,)] * 2)
    d = details(report(spark, df, [("a", "null_rate", 0.3333)]))["a"]
    assert (d["observed"], d["passed"]) == (0.3333, False)


@pytest.mark.parametrize("values,check", [
    ([1, 2, 3, 4, 6, 7, 8, 9], lambda p: p < 0.01), ([6, 7, 8, 9] * 2, lambda p: p > 0.25), ([-100, -50, 999, 888], lambda p: p < 0.01),
])
def test_psi_of_a_feature(spark, values, check):
    r = report(spark, scored(spark, "credit_score long", [(x,) for x in values]), specs=HALVES)
    assert r["drift_computation"] == "psi_vs_baseline" and check(r["drift_metrics"]["credit_score"])
    assert r["max_psi"] == r["drift_metrics"]["credit_score"]


@pytest.mark.parametrize("schema,rows", [
    ("other long", [(1,)]), ("credit_score string", [("1",), ("x",)]), ("credit_score string", [("1d",)]),
    ("credit_score string", [("0x1p3",)]), ("credit_score date", [(dt.date(2024, 1, 1),)]), ("credit_score timestamp", [(dt.datetime(2024, 1, 1),)]),
    ("credit_score long", [(None,)]),
])
def test_features_that_are_skipped(spark, schema, rows):
    r = report(spark, scored(spark, schema, rows), specs=HALVES)
    assert r["drift_metrics"] == {} and r["drift_skipped"] == ["credit_score"] and r["max_psi"] == 0.0


def test_baselines_of_the_wrong_shape_are_skipped(spark):
    specs = [("a", [0.0, 1.0], [0.5, 0.5]), ("b", [0.0, 1.0], []), ("c", [0.0, 5.0, 10.0], [0.5, 0.5])]
    r = report(spark, scored(spark, "a long, b long, c long", [(1, 1, 1), (7, 7, 7)]), specs=specs)
    assert r["drift_skipped"] == ["a", "b"] and list(r["drift_metrics"]) == ["c"]


def test_number_texts_booleans_and_nan(spark):
    rows = [("1_0", True), (" 7 ", False), ("-inf", True), ("nan", True)]
    df = spark.createDataFrame(rows, "s string, b boolean")
    got = df.select(as_number(F.col("s"), df.schema["s"].dataType).alias("s"), as_number(F.col("b"), df.schema["b"].dataType).alias("b")).collect()
    assert [r["s"] for r in got][:3] == [10.0, 7.0, float("-inf")] and got[3]["s"] != got[3]["s"]
    assert [r["b"] for r in got] == [1.0, 0.0, 1.0, 1.0]


@pytest.mark.parametrize("edges", [3, None])
def test_bucketize(spark, edges):
    df = spark.createDataFrame([(x,) for x in (-1.0, 0.0, 4.9, 5.0, 10.0, 11.0, float("nan"), None)], "v double")
    bins = F.array(F.lit(0.0), F.lit(5.0), F.lit(10.0))
    assert [r[0] for r in df.select(bucketize(F.col("v"), bins, edges)).collect()] == [0, 0, 0, 1, 1, 1, 1, None]


def test_bucketize_with_shorter_edge_lists(spark):
    df = spark.createDataFrame([(9.0, [0.0, 1.0]), (9.0, [0.0, 1.0, 2.0, 3.0, 4.0]), (1.5, [0.0, 1.0, 2.0])], "v double, b array<double>")
    for edges in (5, None):
        assert [r[0] for r in df.select(bucketize(F.col("v"), F.col("b"), edges)).collect()] == [0, 3, 1]


def test_psi_values(spark):
    def value(e, a):
        arrays = [F.array(*map(F.lit, x)) for x in (e, a)]
        return spark.range(1).select(psi(*arrays)).first()[0]

    assert value([0.25] * 4, [0.25] * 4) == 0.0
    assert value([0.5, 0.5], [0.9, 0.1]) == 0.8789
    with pytest.raises(Exception, match="same number of buckets"):
        value([0.5, 0.5], [1.0])


def test_runs_without_rows_and_with_differing_columns_stay_apart(spark):
    full = scored(spark, "a long, b long", [(1, 2), (None, 3)])
    lacking = scored(spark, "a long", [(5,), (6,)], run=("t", "m", "1", "j", "r2"))
    both = full.unionByName(lacking, allowMissingColumns=True)
    checks = [("b", "null_rate", 0.5)]
    runs = manifest(spark, ["a", "b"], checks, "b").unionByName(
        manifest(spark, ["a"], checks, "b", ("t", "m", "1", "j", "r2"), dt.datetime(2024, 1, 2))
    ).unionByName(manifest(spark, ["a", "b"], checks, "b", ("t", "m", "1", "j", "r3"), dt.datetime(2024, 1, 3)))
    specs = [("b", [0.0, 2.5, 9.0], [0.5, 0.5])]
    got = {r["run_id"]: r for r in quality.dq_report(both, runs, baselines(spark, specs)).collect()}
    assert [got[r]["request_count"] for r in ("r1", "r2", "r3")] == [2, 2, 0]
    assert [got[r]["error_rate"] for r in ("r1", "r2", "r3")] == [0.0, 1.0, 0.0]
    assert [got[r]["previous_row_count"] for r in ("r1", "r2", "r3")] == [None, 2, 2]
    assert [got[r]["drift_skipped"] for r in ("r1", "r2", "r3")] == [[], ["b"], ["b"]]
    assert got["r2"]["dq_details"][0]["note"] is not None and got["r3"]["dq_passed"]


def test_fit_baseline_gives_zero_drift_on_its_own_rows(spark):
    df = scored(spark, "x double, s string", [(float(i % 10), str(i % 4)) for i in range(100)] + [(None, None)])
    fitted = quality.fit_baseline(df, {"x": [0, 3, 6, 9], "s": [0, 1, 2, 3]})
    assert all(not r["errors"] for r in quality.validate_baselines(fitted).collect())
    assert {r["psi"] for r in quality.drift_by_run(df, fitted).collect()} == {0.0}


def test_validate_baselines(spark):
    specs = [("ok", [0.0, 1.0, 2.0], [0.5, 0.5]), ("short", [0.0, 1.0], [1.0]), ("size", [0.0, 1.0, 2.0], [1.0]),
             ("sign", [0.0, 1.0, 2.0], [-0.5, 1.5]), ("sum", [0.0, 1.0, 2.0], [0.5, 0.6]), ("order", [0.0, 2.0, 1.0], [0.5, 0.5])]
    got = {r["feature"]: r["errors"] for r in quality.validate_baselines(baselines(spark, specs)).collect()}
    assert got["ok"] == [] and all(len(e) == 1 for f, e in got.items() if f != "ok")


@pytest.mark.parametrize("features,edges", [(1, 3), (7, 5), (23, 11), (3, 40), (9, 2)])
def test_cells_equal_a_count_by_hand(spark, features, edges):
    """Both ways of counting, with several chunks of items, ends, NULLs and NaN."""
    rng = random.Random(features)
    cuts = {f"f{i}": sorted(rng.sample(range(100), edges - i % 2 if edges > 3 else edges)) for i in range(features)}
    odd = [None, float("nan"), -5.0, 500.0]
    rows = [tuple(rng.choice(odd) if rng.random() < 0.2 else float(rng.randrange(100)) for _ in cuts) for _ in range(200)]
    df = scored(spark, ", ".join(f"{f} double" for f in cuts), rows)
    base = baselines(spark, [(f, [float(x) for x in c], [1 / (len(c) - 1)] * (len(c) - 1)) for f, c in cuts.items()])
    want = {}
    for row in rows:
        for (f, c), x in zip(cuts.items(), row):
            if x is not None:
                bucket = min(max(bisect.bisect_right(c, x) - 1, 0), len(c) - 2)
                want[f, bucket] = want.get((f, bucket), 0) + 1
    got = {(r["feature"], r["bucket"]): r["n"] for r in quality.bucket_shares(df, base).collect()}
    assert {k: n for k, n in got.items() if n} == want
    assert len(got) == sum(len(c) - 1 for c in cuts.values())


def test_baselines_too_large_to_broadcast_give_the_same_report(spark, monkeypatch):
    df = scored(spark, "a double, s string", [(float(i % 7), str(i % 5)) for i in range(300)] + [(None, "x")])
    specs = [("a", [0.0, 2.0, 4.0, 7.0], [0.3, 0.3, 0.4]), ("s", [0.0, 2.0, 5.0], [0.5, 0.5])]
    checks = [("s", "null_rate", 0.5), ("schema", "schema_match", 0.0)]
    want = report(spark, df, checks, "a", specs)
    monkeypatch.setitem(quality.lookup_join.__kwdefaults__, "limit", 0)
    assert report(spark, df, checks, "a", specs) == want
    assert want["drift_skipped"] == ["s"] and want["error_rate"] == round(1 / 301, 4)


def test_cells_of_parts_add_up_to_the_report_of_the_rows(spark, tmp_path):
    from scorewatch.sources.cells import add_cells, read_cells

    rows = [("t", "m", "1", "j", f"r{i % 2}", float(i), None if i % 5 == 0 else 1.0, "x" if i == 7 else str(i)) for i in range(60)]
    scored = spark.createDataFrame(rows, "tenant_id string, model_name string, version string, job_id string, run_id string, a double, p double, s string")
    manifest = spark.createDataFrame(
        [("t", "m", "1", "j", r, dt.datetime(2024, 1, 1 + i), ["a", "p", "s"], "p", [("p", "null_rate", 0.5)]) for i, r in enumerate(("r0", "r1", "none"))],
        "tenant_id string, model_name string, version string, job_id string, run_id string, recorded_at timestamp, columns array<string>, "
        "prediction_col string, checks array<struct<name:string,type:string,threshold:double>>")
    baselines = spark.createDataFrame(
        [("t", "m", "1", f, [0.0, 20.0, 40.0, 60.0], [0.3, 0.3, 0.4]) for f in ("a", "s")],
        "tenant_id string, model_name string, version string, feature string, bins array<double>, proportions array<double>")
    path = str(tmp_path / "cells")
    assert read_cells(spark, path) is None
    early = F.col("a") < 25
    for part, some in (("one", early), ("two", ~early), ("two", ~early)):  # the last is a repeated job
        add_cells(quality.run_cells(scored.filter(some), manifest, baselines), path, part)
    got = quality.report_from_cells(read_cells(spark, path), manifest, baselines)
    want = quality.dq_report(scored, manifest, baselines)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count() == 3
    with pytest.raises(ValueError, match="name a part"):
        add_cells(read_cells(spark, path), path, "a/b")


def test_registered_reports_make_the_manifest_once(spark, tmp_path):
    """The example manifest joins all scored rows; a report looks at it several times."""
    tables = {
        "region": ("r_regionkey int, r_name string", [(0, "AFRICA"), (4, "ASIA")]),
        "nation": ("n_nationkey int, n_name string, n_regionkey int", [(1, "N1", 0), (2, "N2", 4)]),
        "customer": ("c_custkey long, c_nationkey int, c_mktsegment string", [(1, 1, "BUILDING"), (2, 2, "MACHINERY")]),
        "orders": ("o_orderkey long, o_custkey long", [(10, 1), (11, 2)]),
        "lineitem": (
            "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
            "l_returnflag string, l_shipdate timestamp",
            [(o, p, p % 7, float(p), 1000.0 * p, 0.05, "A", dt.datetime(1995, 1 + p % 6, 3)) for o in (10, 11) for p in range(1, 25)]),
    }
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, reads, rows in (("d24_inspected_columns", 1, 2), ("d24_from_rows", 2, 6), ("d24_add_cells", 0, 6)):
        df = QUERIES[name](spark, str(tmp_path))
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        # joins that are left for the report itself; in one of them both sides of a look-back have it
        assert plan.count("Relation [l_orderkey") <= reads, name
        got = df.collect()
        assert len(got) == rows
        if name == "d24_add_cells":
            assert sum(r["request_count"] for r in got) == 48
