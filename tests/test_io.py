"""Reading, writing, loading, scoring and streaming on small files."""

import datetime as dt
import io
import tarfile

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.operators import audit as audit_log
from scorewatch.operators import scoring
from scorewatch.sources import runs, sinks

DAY = dt.date(2026, 7, 8)


def write(spark, path, rows, schema, parts=1):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("append").parquet(str(path))


def test_nested_files_are_united(spark, tmp_path):
    write(spark, tmp_path / "a", [(0.1,), (0.2,)], "prediction double")
    write(spark, tmp_path / "deep" / "b", [(1,)], "other long")
    df = runs.read_run_output(spark, str(tmp_path))
    assert df.count() == 3 and df.filter("prediction IS NULL").count() == 1
    given = runs.read_run_output(spark, str(tmp_path), df.schema)
    assert given.count() == 3


def test_no_files_is_an_error(spark, tmp_path):
    (tmp_path / "_SUCCESS").write_text("")
    for read in (runs.read_run_output, lambda s, p: runs.sample_run_output(s, p, 1), runs.output_columns):
        with pytest.raises(ValueError, match="No parquet files"):
            read(spark, str(tmp_path))
    with pytest.raises(ValueError, match="No parquet files"):
        runs.read_run_output(spark, str(tmp_path / "absent"))


def sized_files(spark, tmp_path, rows):
    """One folder per wanted row count, in name order; returns the file sizes."""
    for i, n in enumerate(rows):
        write(spark, tmp_path / f"p{i}", [(j * 7919 % 1000003,) for j in range(n)], "x long")
    return [r["bytes"] for r in runs.list_files(spark, str(tmp_path)).orderBy("path").collect()]


def test_budget_skips_but_keeps_trying(spark, tmp_path):
    sizes = sized_files(spark, tmp_path, [10, 5000, 10, 10])
    df, stats = runs.sample_run_output(spark, str(tmp_path), sizes[0] + sizes[2] + 1)
    assert stats == {"files_read": 2, "files_skipped": 2, "bytes_read": sizes[0] + sizes[2], "sampled": True}
    assert df.count() == 20
    assert runs.sample_run_output(spark, str(tmp_path), sum(sizes))[1]["sampled"] is False
    with pytest.raises(ValueError, match="exceeds the budget"):
        runs.sample_run_output(spark, str(tmp_path), 10)


def test_budget_goes_on_after_files_that_do_not_fit(spark, tmp_path):
    sizes = sized_files(spark, tmp_path, [10, 3000, 10, 10, 3000, 10])
    want = 3 * max(sizes[0], sizes[2], sizes[3]) + 5
    assert runs.sample_run_output(spark, str(tmp_path), want)[1]["files_read"] == 3


def test_runs_have_their_own_folders(spark, tmp_path):
    assert sinks.run_prefix("s3://b/out/", DAY, "RUN-0001") == "s3://b/out/2026-07-08/RUN-0001/"
    df = spark.range(10)
    one = sinks.unload_table(df, str(tmp_path), DAY, "RUN-0001")
    two = sinks.unload_table(df.limit(4), str(tmp_path), DAY, "RUN-0002")
    again = sinks.unload_table(df.limit(3), str(tmp_path), DAY, "RUN-0002")
    assert (one[1], two[1], again[1]) == (10, 4, 3) and spark.read.parquet(one[0]).count() == 10
    made = sinks.extract(lambda s, p: s.range(p["n"]), spark, {"n": 6}, str(tmp_path), DAY, "RUN-0003")
    assert made[1] == 6 and runs.output_columns(spark, made[0]) == ["id"]


def test_loads_append_with_lineage(spark, tmp_path):
    target = str(tmp_path / "t")
    df = spark.createDataFrame([(650, 0.2)], "credit_score long, prediction double")
    assert sinks.load_append(df, target, "RUN-0007", "2026-07-08") == 1
    assert sinks.load_append(df.withColumnRenamed("prediction", "PREDICTION"), target, "RUN-0008", "2026-07-09") == 1
    out = spark.read.parquet(target)
    assert out.columns == ["credit_score", "prediction", "_source_file", "_run_id", "_load_date"] and out.count() == 2
    assert sinks.load_append(df, target, "RUN-0008", "2026-07-09") == 1
    with pytest.raises(ValueError, match="no column 'extra'"):
        sinks.load_append(df.withColumn("extra", F.lit(1)), target, "RUN-0009", "2026-07-09")


def test_lineage_names_are_reserved(spark):
    with pytest.raises(ValueError, match="reserved"):
        sinks.with_lineage(spark.range(1).withColumnRenamed("id", "_RUN_ID"), "r", "2026-07-08")


def test_alignment_of_names(spark):
    target = T.StructType([T.StructField("Score", T.DoubleType()), T.StructField("credit score", T.LongType())])
    df = spark.createDataFrame([(1, 2)], "`credit score` long, SCORE long")
    assert sinks.align_to_target(df, target).columns == ["Score", "credit score"]
    with pytest.raises(ValueError):
        sinks.align_to_target(spark.createDataFrame([(1,)], "`Credit Score` long"), target)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        with pytest.raises(ValueError, match="more than one"):
            sinks.align_to_target(spark.createDataFrame([(1, 2)], "score long, SCORE long"), target)
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_a_replayed_load_adds_nothing(spark, tmp_path):
    uri, _ = sinks.unload_table(spark.range(100).repartition(3), str(tmp_path / "out"), DAY, "RUN-0001")
    args = (str(tmp_path / "t"), str(tmp_path / "l"), "RUN-0001", "2026-07-08")
    assert sinks.load_files(spark, uri, *args) == 100
    assert sinks.load_files(spark, uri, *args) == 0
    assert spark.read.parquet(args[0]).count() == 100
    assert sinks.load_row_total(spark.read.parquet(args[1])).first()["rows_loaded"] == 100


def test_a_load_that_stopped_before_its_ledger_is_completed(spark, tmp_path):
    uri, _ = sinks.unload_table(spark.range(100).repartition(2), str(tmp_path / "out"), DAY, "RUN-0001")
    args = (str(tmp_path / "t"), str(tmp_path / "l"), "RUN-0001", "2026-07-08")
    one = sorted(r["path"] for r in runs.list_files(spark, uri).collect())[0]
    n = sinks._append(spark.read.parquet(one), F.col("_metadata.file_path"), args[0], "RUN-0001", "2026-07-08")
    assert sinks.load_files(spark, uri, *args) == 100 - n
    assert spark.read.parquet(args[0]).count() == 100
    assert sinks.load_row_total(spark.read.parquet(args[1])).first()["rows_loaded"] == 100


def test_rows_of_another_folder_are_not_taken_for_a_load(spark, tmp_path):
    args = (str(tmp_path / "t"), str(tmp_path / "l"), "RUN-0001")
    sinks.load_append(spark.range(100), args[0], "RUN-0001", "2026-07-08")
    uri, _ = sinks.unload_table(spark.range(50), str(tmp_path / "out"), DAY, "RUN-0001")
    assert sinks.load_files(spark, uri, *args, "2026-07-08") == 50
    assert sinks.load_files(spark, uri, *args, "2026-10-30") == 0
    assert spark.read.parquet(args[0]).count() == 150


def test_a_run_without_rows_may_come_first(spark, tmp_path):
    target, ledger = str(tmp_path / "t"), str(tmp_path / "l")
    assert sinks.load_append(spark.range(0), target, "RUN-0001", "2026-07-08") == 0
    uri, rows = sinks.unload_table(spark.range(0), str(tmp_path / "out"), DAY, "RUN-0002")
    assert rows == 0 and sinks.load_files(spark, uri, target, ledger, "RUN-0002", "2026-07-08") == 0
    assert spark.read.parquet(ledger).agg(F.sum("rows_loaded")).first()[0] == 0
    uri, _ = sinks.unload_table(spark.range(7), str(tmp_path / "out"), DAY, "RUN-0003")
    assert sinks.load_files(spark, uri, target, ledger, "RUN-0003", "2026-07-08") == 7
    assert sinks.load_files(spark, uri, target, ledger, "RUN-0003", "2026-07-09") == 0


def test_a_ledger_that_cannot_be_read_is_an_error(spark, tmp_path):
    uri, _ = sinks.unload_table(spark.range(3), str(tmp_path / "out"), DAY, "RUN-0001")
    (tmp_path / "l").mkdir()
    (tmp_path / "l" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception, match="(?i)footer|parquet"):
        sinks.load_files(spark, uri, str(tmp_path / "t"), str(tmp_path / "l"), "RUN-0001", "2026-07-08")
    assert not (tmp_path / "t").exists()


def test_a_load_looks_at_its_own_run_only(spark, tmp_path):
    target = str(tmp_path / "t")
    for run, n in (("0042", 5), ("42", 7), ("43", 1)):  # ids of digits stay text
        uri, _ = sinks.unload_table(spark.range(n), str(tmp_path / "out"), DAY, run)
        assert sinks.load_files(spark, uri, target, str(tmp_path / "l"), run, "2026-07-08") == n
    loaded = sinks.read_loaded(spark, target)
    assert {r["_run_id"]: r["count"] for r in loaded.groupBy("_run_id").count().collect()} == {"0042": 5, "42": 7, "43": 1}
    rows = sinks._rows_per_file(loaded, "42")
    assert sum(r["rows_loaded"] for r in rows.collect()) == 7
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_run_id" in plan and "= 42)" in plan


def test_paths_stay_in_the_cluster(spark, tmp_path, monkeypatch):
    uri, _ = sinks.unload_table(spark.range(100).repartition(5), str(tmp_path / "out"), DAY, "RUN-0001")
    args = (str(tmp_path / "t"), str(tmp_path / "l"), "RUN-0001", "2026-07-08")
    whole = type(spark.range(1)).collect
    def few(df):
        rows = whole(df)
        assert len(rows) <= 1, "rows come to the driver"
        return rows
    monkeypatch.setattr(type(spark.range(1)), "collect", few)
    assert sinks.load_files(spark, uri, *args) == 100
    assert sinks.load_files(spark, uri, *args) == 0


def test_names_with_back_ticks(spark, tmp_path):
    df = spark.range(3).withColumnRenamed("id", "a`b")
    assert sinks.load_append(df, str(tmp_path / "t"), "RUN-0001", "2026-07-08") == 3
    assert sinks.load_append(df, str(tmp_path / "t"), "RUN-0002", "2026-07-08") == 3


def test_the_ledger_never_forgets(spark):
    files = spark.createDataFrame([("a",), ("b",), ("b",), ("c",)], "path string")
    ledger = spark.createDataFrame([("a", dt.datetime(1999, 1, 1)), ("c", dt.datetime(2024, 1, 1))], "path string, loaded_at timestamp")
    assert [r["path"] for r in sinks.not_yet_loaded(files, ledger).collect()] == ["b"]


def test_retention(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),)], "run_date date")
    assert sinks.retain(df, F.lit("2024-04-01").cast("date")).count() == 1


def partitions_read(df):
    """Folders that the scan of a collected frame has read."""
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.executedPlan().collectLeaves() if plan.nodeName() == "AdaptiveSparkPlan" else plan.collectLeaves()
    leaves = [leaves.apply(i) for i in range(leaves.size())]
    scans = [x.plan().collectLeaves().apply(0) if "QueryStage" in x.nodeName() else x for x in leaves]
    return [s.metrics().apply("numPartitions").value() for s in scans if s.metrics().contains("numPartitions")]


def test_stored_dates_are_pruned(spark, tmp_path):
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(40)]
    spark.createDataFrame([(d, i) for i, d in enumerate(days)], "run_date date, x long").write.partitionBy("run_date").parquet(str(tmp_path / "runs"))
    stored = spark.read.parquet(str(tmp_path / "runs"))
    fixed = sinks.retain(stored, F.lit("2024-02-09").cast("date"), 4)
    assert len(fixed.collect()) == 5 and partitions_read(fixed) == [5]
    newest = spark.createDataFrame([(days[-1],)], "d date").agg(F.max("d")).scalar()
    asof = sinks.retain(stored, newest, 2)  # known only when the query runs
    assert len(asof.collect()) == 3 and 3 in partitions_read(asof)
    events = spark.createDataFrame([(i, dt.datetime(2024, 1, 1 + i % 5), "a", "b") for i in range(20)], "event_id long, ts timestamp, entity_type string, entity_id string")
    audit_log.append_audit(events, str(tmp_path / "audit"))
    day = audit_log.audit_by_date(spark.read.parquet(str(tmp_path / "audit")), "2024-01-03")
    assert len(day.collect()) == 4
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "= 2024-01-03)]" in plan


def model(kind):
    class Doubles:
        def predict(self, rows):
            return rows["x"] * 2.0

    class Fails:
        def predict(self, rows):
            if (rows["x"] == 13).any():
                raise ValueError("unlucky")
            return rows["x"] * 2.0

    class Nans:
        def predict(self, rows):
            return [float("nan") if x % 2 else 1.0 for x in rows["x"]]

    class Short:
        def predict(self, rows):
            return [1.0]

    return cloudpickle.dumps({"doubles": Doubles, "fails": Fails, "nans": Nans, "short": Short}[kind]())


def test_scoring_keeps_every_column_exactly(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(big, 1, [1], None), (None, 2, None, dt.date(2024, 1, 1))], "key long, x long, a array<long>, d date")
    out = scoring.score(df, model("doubles"), features=["x"])
    scoring.assert_scored(df, out)
    rows = sorted(out.collect(), key=lambda r: r["x"])
    assert (rows[0]["key"], rows[0]["a"], rows[0]["prediction"], rows[1]["key"]) == (big, [1], 2.0, None)
    with pytest.raises(ValueError):
        scoring.score(out, model("doubles"))


def test_a_failing_batch_keeps_its_rows(spark):
    df = spark.range(100).withColumnRenamed("id", "x").coalesce(1)
    by_batch = scoring.score(df, model("fails"))
    assert scoring.reconcile(df, by_batch).first().asDict() == {"rows_read": 100, "rows_written": 100, "null_predictions": 100, "complete": True}
    by_row = scoring.score(df, model("fails"), on_error="row")
    assert [r["x"] for r in by_row.filter("prediction IS NULL").collect()] == [13]


def test_counts_come_from_the_job_that_writes(spark, tmp_path):
    df = spark.range(100).withColumnRenamed("id", "x").repartition(4)
    row = scoring.write_scored(df, str(tmp_path / "s"), model("fails"), on_error="row").first().asDict()
    assert row == {"rows_read": 100, "rows_written": 100, "null_predictions": 1, "complete": True}
    assert spark.read.parquet(str(tmp_path / "s")).count() == 100


def test_nan_and_misshapen_predictions_are_null(spark):
    df = spark.range(10).withColumnRenamed("id", "x").coalesce(1)
    assert scoring.score(df, model("nans")).filter("prediction IS NULL").count() == 5
    assert scoring.score(df, model("short")).filter("prediction IS NULL").count() == 10


def test_models_from_files_and_loaders(spark, tmp_path):
    body = model("doubles")
    (tmp_path / "m.pkl").write_bytes(body)
    with tarfile.open(tmp_path / "m.tar.gz", "w:gz") as archive:
        info = tarfile.TarInfo("deep/model.pkl")
        info.size = len(body)
        archive.addfile(info, io.BytesIO(body))
    with tarfile.open(tmp_path / "empty.tgz", "w:gz"):
        pass
    assert runs.read_model(spark, str(tmp_path / "m.pkl")) == runs.read_model(spark, str(tmp_path / "m.tar.gz")) == body
    with pytest.raises(FileNotFoundError):
        runs.read_model(spark, str(tmp_path / "empty.tgz"))
    df = spark.range(3).withColumnRenamed("id", "x")
    for name in ("m.pkl", "m.tar.gz"):
        assert scoring.score(df, runs.model_at(spark, str(tmp_path / name))).agg(F.sum("prediction")).first()[0] == 6.0
    with pytest.raises(Exception, match="0 members named model.pkl"):
        scoring.score(df, runs.model_at(spark, str(tmp_path / "empty.tgz"))).count()

    def load():
        import pickle

        return pickle.loads(body)

    assert scoring.score(df, load).agg(F.sum("prediction")).first()[0] == 6.0
