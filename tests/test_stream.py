"""Streaming records the same snapshots as the batch plan, and a restart adds none."""

import datetime as dt

from scorewatch.operators.quality import dq_report
from scorewatch.operators.snapshots import build_snapshots
from scorewatch.plans import views as v
from scorewatch.plans.views import Tables
from scorewatch.streaming import snapshots as streaming
from scorewatch.streaming.snapshots import read_stream_snapshots, stream_snapshots


def test_stream_equals_batch(spark, tmp_path):
    t = Tables(spark, "/root/testdata/sf0.001")
    base = str(tmp_path)
    scored, manifest = v.scored(t).filter("tenant_id = 'ASIA'"), v.run_manifest(t).filter("tenant_id = 'ASIA'")
    manifest.write.parquet(f"{base}/manifest")

    def run():
        stream_snapshots(
            spark, f"{base}/manifest", lambda batch: scored, v.baselines(t), v.models(t), f"{base}/store", f"{base}/checkpoint"
        ).awaitTermination()
        return read_stream_snapshots(spark, f"{base}/store")

    def rows(df):
        return sorted(map(str, df.select("model_name", "run_id", "request_count", "error_rate", "max_psi", "derived_status").collect()))

    want = rows(build_snapshots(dq_report(scored, manifest, v.baselines(t)), v.models(t)))
    assert rows(run()) == want
    # the same manifest rows again, as after a producer's retry
    manifest.write.mode("append").parquet(f"{base}/manifest")
    assert rows(run()) == want


def tiny(spark, base, runs):
    """Manifest rows and scored rows of runs of one model: (run, day, rows)."""
    keys = "tenant_id string, model_name string, version string, job_id string, run_id string"
    manifest = spark.createDataFrame(
        [("t", "m", "1", "j", r, dt.datetime(2024, 1, day, 1, 2, 3, 4), ["x"], None, []) for r, day, _ in runs],
        f"{keys}, recorded_at timestamp, columns array<string>, prediction_col string, checks array<struct<name:string,type:string,threshold:double>>")
    manifest.write.mode("append").parquet(f"{base}/manifest")
    return spark.createDataFrame([("t", "m", "1", "j", r, 1.0) for r, _, n in runs for _ in range(n)], f"{keys}, x double")


def take_in(spark, base, scored, checkpoint="checkpoint"):
    baselines = spark.createDataFrame([], "tenant_id string, model_name string, version string, feature string, bins array<double>, proportions array<double>")
    models = spark.createDataFrame(
        [], "tenant_id string, model_name string, version string, psi_fail_override double, err_fail_override double")
    stream_snapshots(spark, f"{base}/manifest", lambda runs: scored, baselines, models, f"{base}/store", f"{base}/{checkpoint}").awaitTermination()
    rows = read_stream_snapshots(spark, f"{base}/store").collect()
    return sorted((r["run_id"], r["request_count"], r["previous_row_count"]) for r in rows)


def test_batches_do_not_look_at_the_store_but_for_late_runs(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    scored = tiny(spark, base, [("r1", 1, 10), ("r3", 3, 30)])
    assert take_in(spark, base, scored) == [("r1", 10, None), ("r3", 30, 10)]
    looked = []
    whole = streaming.read_stream_snapshots
    monkeypatch.setattr(streaming, "read_stream_snapshots", lambda *a: looked.append(1) or whole(*a))
    scored = scored.unionByName(tiny(spark, base, [("r4", 4, 40)]))
    assert take_in(spark, base, scored)[-1] == ("r4", 40, 30) and not looked
    scored = scored.unionByName(tiny(spark, base, [("r2", 2, 20)]))  # later than r3 and r4, but recorded before
    assert take_in(spark, base, scored)[1] == ("r2", 20, 10) and looked
    before = take_in(spark, base, scored)
    assert len(before) == 4
    # a checkpoint that is lost or new finds the same manifest rows again
    assert take_in(spark, base, scored, "another") == before
    scored = scored.unionByName(tiny(spark, base, [("r5", 5, 50)]))
    assert take_in(spark, base, scored, "another")[-1] == ("r5", 50, 40)
