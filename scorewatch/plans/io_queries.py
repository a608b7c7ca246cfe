"""Registered queries: reading, writing, loading and streaming.

These write to new folders under the shared scratch folder and read back.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.operators import audit as audit_log
from scorewatch.operators.lookup import lookup_join
from scorewatch.plans import views as v
from scorewatch.plans.registry import iso, query
from scorewatch.plans.views import Tables
from scorewatch.session import scratch_path
from scorewatch.sources import runs, sinks, store
from scorewatch.streaming.snapshots import read_stream_snapshots, stream_snapshots
from scorewatch.values import LOAD_DATE_COLUMN, RUN_ID_COLUMN, RUN_KEYS

DAY = dt.date(2024, 3, 1)


@query("a1_read_run_output", sql="""
    SELECT l_orderkey, count(*) AS n, count(q) AS quantities, count(t) AS taxes, sum(q) AS quantity
    FROM (SELECT l_orderkey, l_quantity AS q, NULL AS t FROM lineitem UNION ALL SELECT l_orderkey, NULL, l_tax FROM lineitem) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    prefix = scratch_path(t.spark, "output")
    t["lineitem"].select("l_orderkey", "l_quantity").write.parquet(f"{prefix}/a")
    t["lineitem"].select("l_orderkey", "l_tax").write.parquet(f"{prefix}/deeper/b")
    return runs.read_run_output(t.spark, prefix).groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count("l_quantity").alias("quantities"), F.count("l_tax").alias("taxes"),
        F.sum("l_quantity").alias("quantity"),
    )


@query("a2_sample_files_by_budget", sql="""
    SELECT l_returnflag, count(*) AS n, true AS sampled FROM lineitem WHERE l_orderkey % 3 = 0 GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    # the budget is the caller's; this one holds a third of the orders and skips the files of the others
    prefix, rows = scratch_path(t.spark, "output"), t["lineitem"].select("l_orderkey", "l_returnflag")
    some = F.col("l_orderkey") % 3 == 0
    rows.filter(some).write.parquet(f"{prefix}/a")
    budget = runs.list_files(t.spark, prefix).agg(F.sum("bytes")).first()[0]
    rows.filter(~some).write.parquet(f"{prefix}/b")
    df, stats = runs.sample_run_output(t.spark, prefix, budget)
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.lit(stats["sampled"]).alias("sampled"))


@query("a3_unload_table", sql="""
    SELECT o_orderstatus, count(*) AS n, (SELECT count(*) FROM orders) AS rows_unloaded FROM orders GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    uri, rows = sinks.unload_table(t["orders"], scratch_path(t.spark, "unload"), DAY, "RUN-0001")
    return t.spark.read.parquet(uri).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.lit(rows).cast("long").alias("rows_unloaded")
    )


@query("a4_run_prefix", views="customer_runs", sql="""
    SELECT o_orderkey, 's3://data/out/' || strftime(started_at, '%Y-%m-%d') || '/' || job_id || '/' AS prefix FROM customer_runs""")
def _(t: Tables) -> DataFrame:
    jobs = v.customer_runs(t).withColumn("run_id", F.col("job_id"))
    return sinks.with_run_prefix(jobs, F.lit("s3://data/out//"), "started_at").select("o_orderkey", "prefix")


@query("a5_extract", sql="""
    SELECT c_mktsegment, count(*) AS n, (SELECT count(*) FROM customer WHERE c_acctbal > 1000) AS rows_unloaded
    FROM customer WHERE c_acctbal > 1000 GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    def rich(spark: SparkSession, params: dict) -> DataFrame:
        return t["customer"].filter(F.col("c_acctbal") > params["over"])

    uri, rows = sinks.extract(rich, t.spark, {"over": 1000}, scratch_path(t.spark, "extract"), DAY, "RUN-0002")
    return t.spark.read.parquet(uri).groupBy("c_mktsegment").agg(
        F.count("*").alias("n"), F.lit(rows).cast("long").alias("rows_unloaded")
    )


@query("a6_load_append", sql="""
    SELECT run AS _run_id, day AS _load_date, o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key
    FROM orders, (VALUES ('RUN-0001', '2024-03-01'), ('RUN-0002', '2024-03-02')) r(run, day) GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    target = scratch_path(t.spark, "loaded")
    orders = t["orders"].select("o_orderkey", "o_orderstatus", "o_totalprice")
    sinks.load_append(orders, target, "RUN-0001", "2024-03-01")
    sinks.load_append(orders.select("o_totalprice", "o_orderstatus", F.col("o_orderkey").alias("O_ORDERKEY")), target, "RUN-0002", "2024-03-02")
    day = F.col(LOAD_DATE_COLUMN).cast("string").alias(LOAD_DATE_COLUMN)
    return t.spark.read.parquet(target).groupBy(RUN_ID_COLUMN, day, "o_orderstatus").agg(
        F.count("*").alias("n"), F.max("o_orderkey").alias("last_key")
    )


@query("a9_align_to_target", sql="""
    SELECT o_orderkey::VARCHAR AS "O_OrderKey", o_totalprice AS "TOTAL", o_orderstatus AS "order status" FROM orders""")
def _(t: Tables) -> DataFrame:
    target = T.StructType([
        T.StructField("order status", T.StringType()), T.StructField("O_OrderKey", T.StringType()),
        T.StructField("TOTAL", T.DoubleType()), T.StructField("unused", T.DateType()),
    ])
    source = t["orders"].select(
        "o_orderkey", F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("order status")
    )
    return sinks.align_to_target(source, target)


@query("a7_output_columns", sql="""
    SELECT column_name AS name FROM (DESCRIBE SELECT l_orderkey, l_tax FROM lineitem)""")
def _(t: Tables) -> DataFrame:
    prefix = scratch_path(t.spark, "output")
    t["lineitem"].select("l_orderkey", "l_tax").write.parquet(f"{prefix}/a")
    names = runs.output_columns(t.spark, prefix)
    return t.spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("name"))


@query("a8_lineage", sql="""
    SELECT o_orderstatus, 'RUN-0005' AS run, '2024-03-05' AS day, count(*) AS n FROM orders GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    sinks.assert_no_lineage_collision(t["orders"])
    rows = sinks.with_lineage(t["orders"], "RUN-0005", "2024-03-05")
    return rows.groupBy("o_orderstatus", F.col(RUN_ID_COLUMN).alias("run"), F.col(LOAD_DATE_COLUMN).cast("string").alias("day")).agg(
        F.count("*").alias("n"))


@query("a10_load_ledger", views="audit", sql="""
    SELECT DISTINCT path FROM (SELECT *, actor || '/' || entity_id AS path FROM audit)
    WHERE path NOT IN (SELECT actor || '/' || entity_id FROM audit WHERE action = 'view')""")
def _(t: Tables) -> DataFrame:
    files = v.audit(t).select(F.concat("actor", F.lit("/"), "entity_id").alias("path"), "action")
    return sinks.not_yet_loaded(files.select("path"), files.filter("action = 'view'"))


def _loaded(t: Tables, table: str, results: list[int]) -> DataFrame:
    loads = F.array(*[F.lit(n).cast("long") for n in results])
    return t.spark.read.parquet(table).groupBy(RUN_ID_COLUMN).agg(
        F.count("*").alias("n"), F.count_distinct("event_id").alias("events"), F.array_join(loads.cast("array<string>"), ",").alias("added"))


@query("a10_load_files", sql="""
    SELECT 'RUN-0001' AS _run_id, count(*) AS n, count(DISTINCT event_id) AS events, count(*) || ',0' AS added FROM events""")
def _(t: Tables) -> DataFrame:
    # the same files again 100 days later add nothing
    base = scratch_path(t.spark, "staged")
    uri, _ = sinks.unload_table(t["events"], base, DAY, "RUN-0001")
    args = (f"{base}/table", f"{base}/ledger", "RUN-0001")
    return _loaded(t, args[0], [sinks.load_files(t.spark, uri, *args, day) for day in ("2024-03-01", "2024-06-09")])


@query("a10_load_two_folders", sql="""
    SELECT 'RUN-0001' AS _run_id, count(*) AS n, count(DISTINCT event_id) AS events,
           count(*) FILTER (event_type = 'click') || ',' || count(*) FILTER (event_type <> 'click') AS added FROM events""")
def _(t: Tables) -> DataFrame:
    base, click = scratch_path(t.spark, "staged"), F.col("event_type") == "click"
    folders = [sinks.unload_table(t["events"].filter(x), f"{base}/{i}", DAY, "RUN-0001")[0] for i, x in enumerate((click, ~click))]
    args = (f"{base}/table", f"{base}/ledger", "RUN-0001", "2024-03-01")
    return _loaded(t, args[0], [sinks.load_files(t.spark, uri, *args) for uri in folders])


@query("a10_load_half_done", sql="""
    SELECT 'RUN-0001' AS _run_id, count(*) AS n, count(DISTINCT event_id) AS events, count(*) || ',0' AS added FROM events""")
def _(t: Tables) -> DataFrame:
    # the ledger of the first load is lost: its files are found in the table and only noted
    base = scratch_path(t.spark, "staged")
    uri, _ = sinks.unload_table(t["events"], base, DAY, "RUN-0001")
    first = sinks.load_files(t.spark, uri, f"{base}/table", f"{base}/lost", "RUN-0001", "2024-03-01")
    again = sinks.load_files(t.spark, uri, f"{base}/table", f"{base}/ledger", "RUN-0001", "2024-03-02")
    return _loaded(t, f"{base}/table", [first, again])


@query("a10_load_empty_run", sql="""
    SELECT 'RUN-0002' AS _run_id, count(*) AS n, count(DISTINCT event_id) AS events, '0,' || count(*) AS added FROM events""")
def _(t: Tables) -> DataFrame:
    # the first run has no rows; its file is noted and the next run loads as usual
    base = scratch_path(t.spark, "staged")
    args = (f"{base}/table", f"{base}/ledger")
    added = []
    for run, rows in (("RUN-0001", t["events"].filter("event_id < 0")), ("RUN-0002", t["events"])):
        uri, _ = sinks.unload_table(rows, base, DAY, run)
        added.append(sinks.load_files(t.spark, uri, *args, run, "2024-03-01"))
    return _loaded(t, args[0], added)


@query("a11_load_row_total", views="audit", sql="""
    SELECT tenant_id, coalesce(sum(CASE WHEN action <> 'error' THEN entity_id::BIGINT END), 0)::BIGINT AS rows_loaded FROM audit GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    ledger = v.audit(t).withColumn("rows_loaded", F.when(F.col("action") != "error", F.col("entity_id").cast("long")))
    return sinks.load_row_total(ledger, ["tenant_id"])


@query("a12_retain", views="customer_runs", sql="""
    SELECT tenant_id, job_id, o_orderkey FROM customer_runs WHERE started_at::DATE >= DATE '2001-08-01' - 90""")
def _(t: Tables) -> DataFrame:
    jobs = v.customer_runs(t).withColumn("run_date", F.to_date("started_at"))
    return sinks.retain(jobs, F.lit("2001-08-01").cast("date")).select("tenant_id", "job_id", "o_orderkey")


@query("a12_retain_stored", views="customer_runs", sql="""
    SELECT tenant_id, job_id, o_orderkey FROM customer_runs
    WHERE date_trunc('month', started_at)::DATE >= (SELECT max(started_at)::DATE FROM customer_runs) - 90""")
def _(t: Tables) -> DataFrame:
    # a stored layout of one folder per month; the day to count back from is known only when the query runs
    path, jobs = scratch_path(t.spark, "runs"), v.customer_runs(t)
    jobs.withColumn("run_date", F.trunc("started_at", "MM")).repartition("run_date").write.partitionBy("run_date").parquet(path)
    newest = jobs.agg(F.max(F.to_date("started_at"))).scalar()
    return sinks.retain(t.spark.read.parquet(path), newest).select("tenant_id", "job_id", "o_orderkey")


@query("j3_stored_audit_by_date", views="audit", sql="SELECT tenant_id, event_id FROM audit WHERE ts::DATE = DATE '2024-01-09'")
def _(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "audit")
    audit_log.append_audit(v.audit(t), path)
    return audit_log.audit_by_date(t.spark.read.parquet(path), "2024-01-09").select("tenant_id", "event_id")


@query("g1_union_outputs", sql="""
    SELECT key, price, balance FROM (
      SELECT o_orderkey AS key, o_totalprice AS price, NULL AS balance FROM orders UNION ALL SELECT c_custkey, NULL, c_acctbal FROM customer)""")
def _(t: Tables) -> DataFrame:
    return runs.union_outputs([
        t["orders"].select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price")),
        t["customer"].select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")),
    ])


@query("j1_append_audit", views="audit", sql="""
    SELECT ts::DATE::VARCHAR AS event_date, tenant_id, count(*) AS n, count(DISTINCT entity_type || '#' || entity_id) AS entities
    FROM audit GROUP BY ALL""")
def _(t: Tables) -> DataFrame:
    path, events = scratch_path(t.spark, "audit"), v.audit(t)
    click = F.col("action").eqNullSafe("click")
    audit_log.append_audit(events.filter(click), path)
    audit_log.append_audit(events.filter(~click), path)
    return t.spark.read.parquet(path).groupBy(F.col("event_date").cast("string").alias("event_date"), "tenant_id").agg(
        F.count("*").alias("n"), F.count_distinct("entity_key").alias("entities")
    )


@query("k2_record_twice", views="duplicated", sql=r"""
    SELECT tenant_id, model_name, run_id, strftime(recorded_at, '%Y-%m-%d %H:%M:%S.%f') AS recorded_at, dq_passed
    FROM duplicated QUALIFY row_number() OVER (PARTITION BY tenant_id, model_name, job_id, run_id ORDER BY recorded_at) = 1""")
def _(t: Tables) -> DataFrame:
    path, rows = scratch_path(t.spark, "snapshots"), v.duplicated_snapshots(t)
    store.record_snapshots(rows, path)
    store.record_snapshots(rows, path)
    return store.read_snapshots(t.spark, path).select(
        "tenant_id", "model_name", "run_id", iso("recorded_at").alias("recorded_at"), "dq_passed"
    )


@query("l1_stream_snapshots", views="reports models", sql="""
    SELECT r.tenant_id, r.model_name, r.run_id, request_count, previous_row_count, error_rate, max_psi,
           CASE WHEN max_psi >= coalesce(psi_fail_override, 0.25) OR error_rate >= coalesce(err_fail_override, 0.15) OR NOT dq_passed THEN 'Failed'
                WHEN max_psi >= 0.10 OR error_rate >= 0.05 THEN 'Rework' ELSE 'Passed' END AS derived_status
    FROM reports r LEFT JOIN models m USING (tenant_id, model_name, version)""")
def _(t: Tables) -> DataFrame:
    base = scratch_path(t.spark, "stream")
    manifest_path, scored_path = f"{base}/manifest", f"{base}/scored"
    v.scored(t).repartition("tenant_id", "run_id").write.partitionBy("tenant_id", "run_id").parquet(scored_path)
    manifest = v.run_manifest(t)
    for early in (True, False):
        late = F.col("recorded_at") >= F.lit("1999-01-01").cast("timestamp")
        manifest.filter(~late if early else late).write.mode("append").parquet(manifest_path)
        stream_snapshots(
            t.spark, manifest_path, lambda batch: _scored_of(t.spark, scored_path, batch), v.baselines(t), v.models(t),
            f"{base}/snapshots", f"{base}/checkpoint",
        ).awaitTermination()
    return read_stream_snapshots(t.spark, f"{base}/snapshots").select(
        "tenant_id", "model_name", "run_id", "request_count", "previous_row_count", "error_rate", "max_psi", "derived_status"
    )


def _scored_of(spark: SparkSession, path: str, batch: DataFrame) -> DataFrame:
    """The scored rows of a batch's runs: the join on the folder columns leaves only their folders to read."""
    rows = spark.read.option("basePath", path).parquet(path)
    return lookup_join(rows, batch.select(*RUN_KEYS), RUN_KEYS, "left_semi")
