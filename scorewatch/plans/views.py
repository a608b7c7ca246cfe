"""Example tables in the library's shapes, derived from a star schema plus events.

Each function takes a ``Tables`` reader. They stand in for a platform's own
tables in the registered queries and the benchmark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.operators.quality import run_cells
from scorewatch.session import scratch_path
from scorewatch.sources.cells import add_cells, read_cells
from scorewatch.values import RUN_KEYS, STEP_ORDER


class Tables:
    """Reads the tables of one data folder, timestamps as UTC instants."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._opened: dict[str, DataFrame] = {}
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self._open(name)
        return self._opened[name]

    def _open(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        stamps = {f.name: F.col(f.name).cast("timestamp") for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"}
        return df.withColumns(stamps) if stamps else df


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _pick(index: Column, *values: str | None) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def customers(t: Tables) -> DataFrame:
    """Customers with nation and region.

    Nations and regions are 25 and 5 rows at every scale, so they are broadcast.
    """
    places = t["nation"].join(F.broadcast(t["region"]), F.col("n_regionkey") == F.col("r_regionkey"))
    return t["customer"].join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey")).select(
        "c_custkey", "c_mktsegment", "n_nationkey", "n_name", "r_regionkey", "r_name"
    )


def placed_orders(t: Tables) -> DataFrame:
    """Orders with their customer; both sides grow with the data, so neither is broadcast."""
    return t["orders"].hint("merge").join(customers(t), F.col("o_custkey") == F.col("c_custkey"))


def scored(t: Tables) -> DataFrame:
    """Scored rows: one run per region, segment and ship quarter."""
    orders = placed_orders(t).select("o_orderkey", "r_name", "c_mktsegment")
    quarter = _text(F.year("l_shipdate"), "-Q", F.quarter("l_shipdate"))
    return t["lineitem"].hint("merge").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("r_name").alias("tenant_id"), F.col("c_mktsegment").alias("model_name"), F.lit("1").alias("version"),
        _text("job-", F.col("r_name"), "-", F.col("c_mktsegment")).alias("job_id"), quarter.alias("run_id"),
        "l_quantity", "l_extendedprice", "l_discount", "l_linenumber", "l_returnflag", "l_shipdate",
        F.when(F.col("l_partkey") % 19 != 0, F.col("l_discount") * F.col("l_quantity")).alias("prediction"),
    )


# Example baselines (feature, edges, proportions, regions that have it).
BASELINES = [
    ("l_quantity", [1, 13, 26, 38, 50], [0.24, 0.26, 0.24, 0.26], [0, 1, 2, 3, 4]),
    ("l_extendedprice", [900, 25000, 50000, 75000, 105000], [0.23, 0.25, 0.24, 0.28], [0, 1, 2, 3, 4]),
    ("l_discount", [0, 0.02, 0.05, 0.08, 0.1], [0.15, 0.3, 0.3, 0.25], [0, 1, 2, 3]),
    ("l_returnflag", [0, 1, 2], [0.5, 0.5], [0, 2]),
    ("annual_income", [0, 1, 2], [0.5, 0.5], [1]),
    ("l_shipdate", [0, 1, 2], [0.5, 0.5], [2]),
    ("l_linenumber", [0, 1], [0.5, 0.5], [3]),
]


def baselines(t: Tables) -> DataFrame:
    """Baseline rows per region, segment and feature; one model has none."""
    specs = F.array(*[
        F.struct(
            F.lit(f).alias("feature"), F.array(*[F.lit(float(x)) for x in bins]).alias("bins"),
            F.array(*[F.lit(float(x)) for x in props]).alias("proportions"), F.array(*map(F.lit, regions)).alias("regions"),
        ) for f, bins, props, regions in BASELINES
    ])
    keys = customers(t).select("r_regionkey", "r_name", "c_mktsegment").distinct()
    return keys.select("r_regionkey", "r_name", "c_mktsegment", F.inline(specs)).filter(
        F.array_contains("regions", F.col("r_regionkey")) & ~((F.col("r_regionkey") == 4) & (F.col("c_mktsegment") == "MACHINERY"))
    ).select(
        F.col("r_name").alias("tenant_id"), F.col("c_mktsegment").alias("model_name"), F.lit("1").alias("version"),
        "feature", "bins", "proportions",
    )


# Example checks per segment (name, type, threshold); others have the default.
CHECKS = {
    "HOUSEHOLD": [],
    "BUILDING": [("prediction", "null_rate", 0.01), ("prediction", "null_rate", 0.99)],
    "FURNITURE": [("no_such_column", "null_rate", 0.99), ("  ", "row_count_delta", 0.5)],
}
DEFAULT_CHECKS = [
    ("prediction", "null_rate", 0.06), ("rows", "row_count_delta", 0.1), ("schema", "schema_match", 0.0),
    ("l_discount", "null_rate", 0.5),
]


def inspected() -> list[str]:
    """Columns the example checks and prediction settings name."""
    named = {n for items in [*CHECKS.values(), DEFAULT_CHECKS] for n, kind, _ in items if kind == "null_rate"}
    return sorted(named | {"prediction"})


def _checks(items: list[tuple[str, str, float]]) -> Column:
    structs = [F.struct(F.lit(n).alias("name"), F.lit(k).alias("type"), F.lit(x).alias("threshold")) for n, k, x in items]
    return F.array(*structs) if structs else F.array().cast("array<struct<name:string,type:string,threshold:double>>")


def run_manifest(t: Tables) -> DataFrame:
    """One row per run, and one run without rows per model; some runs lack columns."""
    base = scored(t)
    names = [c for c in base.columns if c not in RUN_KEYS]
    # a run is a quarter and recorded at its end
    start = F.make_date(F.substring("run_id", 1, 4).cast("int"), F.substring("run_id", 7, 1).cast("int") * 3 - 2, F.lit(1))
    runs = base.select(*RUN_KEYS).distinct().withColumn("recorded_at", F.add_months(start, 3).cast("timestamp"))
    models = customers(t).select("r_name", "c_mktsegment").distinct()
    empty = models.select(
        F.col("r_name").alias("tenant_id"), F.col("c_mktsegment").alias("model_name"), F.lit("1").alias("version"),
        _text("job-", F.col("r_name"), "-", F.col("c_mktsegment")).alias("job_id"), F.lit("EMPTY").alias("run_id"),
        F.lit("1998-06-15").cast("timestamp").alias("recorded_at"),
    )
    model, run = F.col("model_name"), F.col("run_id")
    absent = F.array_compact(F.array(
        F.when((F.col("tenant_id") == "ASIA") & run.endswith("Q4"), "l_discount"),
        F.when((F.col("tenant_id") == "EUROPE") & run.endswith("Q2"), "prediction"),
    ))
    checks = F.when(model == "HOUSEHOLD", _checks(CHECKS["HOUSEHOLD"]))
    for name in ("BUILDING", "FURNITURE"):
        checks = checks.when(model == name, _checks(CHECKS[name]))
    return runs.unionByName(empty).select(
        "*", F.array_except(F.array(*map(F.lit, names)), absent).alias("columns"),
        F.when(model != "BUILDING", "prediction").alias("prediction_col"),
        checks.otherwise(_checks(DEFAULT_CHECKS)).alias("checks"),
    )


def kept_manifest(t: Tables) -> DataFrame:
    """The manifest as a platform keeps it: written once, anew by every call, then read; each look at the plain view joins all rows."""
    path, manifest = scratch_path(t.spark, "manifest"), run_manifest(t)
    manifest.write.parquet(path)
    return t.spark.read.schema(manifest.schema).parquet(path)


_measured: dict[tuple[str, str], str] = {}


def measured(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Cells and manifest of all runs, as a platform keeps them: counted once a session and folder, then read."""
    key = (t.spark.sparkContext.applicationId, t.folder)
    if key not in _measured:
        _measured[key] = store_measured(t)
    path = _measured[key]
    return read_cells(t.spark, f"{path}/cells"), t.spark.read.parquet(f"{path}/manifest")


def store_measured(t: Tables) -> str:
    """Count the cells of all scored rows into a new store and write the manifest; returns the folder."""
    path = scratch_path(t.spark, "measured")
    manifest = run_manifest(t)
    manifest.write.parquet(f"{path}/manifest")
    add_cells(run_cells(scored(t), manifest, baselines(t), inspect=inspected()), f"{path}/cells", "all")
    return path


def models(t: Tables) -> DataFrame:
    """Three versions per region and segment."""
    keys = customers(t).select("r_regionkey", "r_name", "c_mktsegment").distinct()
    n = F.length("r_name") + F.length("c_mktsegment") + F.col("i")
    return keys.select("*", F.posexplode(F.array(F.lit("1"), F.lit("2"), F.lit("10"))).alias("i", "version")).select(
        F.col("r_name").alias("tenant_id"), F.col("c_mktsegment").alias("model_name"), "version",
        _pick(n % 4, "None", "Staging", "Production", "Archived").alias("stage"),
        F.when(F.col("c_mktsegment") == "BUILDING", 0.5).alias("psi_fail_override"),
        F.when(F.col("r_name") == "ASIA", 0.3).alias("err_fail_override"),
        _pick(n % 6, "Passed", "Failed", "Rework", "InReview", None, "Legacy").alias("monitoring_status"),
    )


def _snapshot_keys() -> list[Column]:
    return [
        F.col("tenant_id"), F.col("model_name"), F.lit("1").alias("version"),
        _text("job-", F.col("tenant_id"), "-", F.col("model_name")).alias("job_id"),
        _text(F.year("q"), "-Q", F.quarter("q")).alias("run_id"),
    ]


def snapshots(t: Tables) -> DataFrame:
    """Snapshots per region, segment and order quarter, from plain sums."""
    orders = placed_orders(t).select(
        F.col("r_name").alias("tenant_id"), F.col("c_mktsegment").alias("model_name"), "o_orderkey",
        F.date_trunc("quarter", "o_orderdate").alias("q"),
    )
    sums = orders.groupBy("tenant_id", "model_name", "q").agg(
        F.count("*").alias("request_count"), F.count_if(F.col("o_orderkey") % 11 == 0).alias("errors"),
        F.sum(F.col("o_orderkey") % 97).alias("psi_sum"), (F.sum("o_orderkey") % 13 != 0).alias("dq_passed"),
    )
    return sums.select(
        *_snapshot_keys(), (F.col("q") + F.expr("INTERVAL 3 MONTHS")).alias("recorded_at"), "request_count",
        F.round(F.col("errors") / F.col("request_count"), 4).alias("error_rate"),
        F.round(F.col("psi_sum") / (F.col("request_count") * 487), 4).alias("max_psi"), "dq_passed",
    )


def snapshots_with_status(t: Tables) -> DataFrame:
    """The same with thresholds and derived status."""
    from scorewatch.operators.snapshots import build_snapshots

    return build_snapshots(snapshots(t), models(t))


def duplicated_snapshots(t: Tables) -> DataFrame:
    """Snapshots and, an hour later, a second one of each run with the opposite verdict."""
    first = snapshots(t)
    second = first.withColumns({
        "recorded_at": F.col("recorded_at") + F.expr("INTERVAL 1 HOUR"), "dq_passed": ~F.col("dq_passed"),
    })
    return first.unionByName(second)


def pipelines(t: Tables) -> DataFrame:
    """One definition per nation and order priority."""
    digit = F.substring("o_orderpriority", 1, 1).cast("int")
    base = placed_orders(t).select(
        "r_name", "n_nationkey", "n_name", digit.alias("d")
    ).distinct()
    n, d = F.col("n_nationkey"), F.col("d")
    model = F.when(n % 11 == 0, "UNREGISTERED").otherwise(
        _pick(n % 5, "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    home = _text("s3://data/", F.lower("r_name"), "/")
    config = F.struct(
        model.alias("model_name"), _pick(d % 4, "1", "2", "10", "3").alias("model_version"),
        F.when(d == 3, _text("s3://other/", F.lower("r_name"), "/in")).otherwise(_text(home, "in")).alias("input_uri"),
        _text(home, "out").alias("output_uri"), _text(home, "dest").alias("destination_uri"),
        F.when(n % 2 == 0, "s3://code/extract.py").otherwise("").alias("script_uri"),
    )
    steps = [
        F.struct(F.lit(f"s{i}").alias("step_id"), F.lit(kind).alias("type"), config.alias("config"))
        for i, kind in enumerate(STEP_ORDER, 1)
    ]
    return base.select(
        F.col("r_name").alias("tenant_id"), _text("pl-", n, "-", d).alias("pipeline_id"), _text(F.col("n_name"), " ", d).alias("name"),
        _pick((n + d) % 3, "draft", "active", "archived").alias("status"),
        _pick(d - 1, "production", "staging", "production", None, "production").alias("environment"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=n * 5 + d)).alias("updated_at"),
        F.when(n % 2 == 0, F.lit("2024-02-01").cast("timestamp")).alias("last_success_at"), F.array(*steps).alias("steps"),
    )


def jobs(t: Tables) -> DataFrame:
    """One job per order with its five steps, the first ``k`` done; some definitions are gone."""
    o, k = F.col("o_orderkey"), F.col("o_orderkey") % 6
    plain = F.col("o_orderstatus")
    by_order = F.when(plain == "F", "success").when(plain == "O", "running").otherwise("failed")
    special = _pick(o % 20, "pending", "awaiting_approval", "cancelled", "legacy")
    status = F.when(o % 20 < 4, special).when(o % 20 > 4, by_order)
    submitted = F.col("o_orderdate") + F.make_interval(secs=o % 86400)
    steps = []
    for i, kind in enumerate(STEP_ORDER):
        done = "approved" if kind == "approval" else "succeeded"
        at_work = _pick(o % 4, "running", "failed", "idle", "awaiting_approval")
        state = F.when(F.lit(i) < k, done).when(F.lit(i) == k, at_work).otherwise("idle")
        started = F.when(state != "idle", submitted + F.make_interval(hours=F.lit(i)))
        steps.append(F.struct(
            F.lit(f"s{i + 1}").alias("step_id"), F.lit(kind).alias("type"), state.alias("status"), started.alias("started_at"),
            F.struct(
                F.when(o % 9 != 0, F.col("c_mktsegment")).alias("model_name"), (o % 3).cast("string").alias("model_version")
            ).alias("config"),
        ))
    return placed_orders(t).select(
        F.col("r_name").alias("tenant_id"), _text("job-", o).alias("job_id"),
        F.when(o % 7 == 0, _text("pl-gone-", o)).otherwise(
            _text("pl-", F.col("n_nationkey"), "-", F.substring("o_orderpriority", 1, 1))
        ).alias("pipeline_id"),
        status.alias("status"), _pick(o % 3, "production", "staging", None).alias("run_environment"),
        submitted.alias("submitted_at"), F.array(*steps).alias("steps"),
    )


def tenants(t: Tables) -> DataFrame:
    """Regions that have customers, as tenants; one is suspended and one is not on record."""
    keys = customers(t).select("r_regionkey", "r_name").distinct().filter("r_regionkey <> 4")
    r = F.col("r_regionkey")
    return keys.select(
        F.col("r_name").alias("tenant_id"), F.when(r == 3, "suspended").otherwise("active").alias("status"),
        F.when(r != 1, _text("s3://data/", F.lower("r_name"), "/")).alias("data_prefix"),
        _pick(r, "400 vCPU", "no limit", None, "0 vCPU").alias("max_cpu"),
    )


def supplier_tenants(t: Tables) -> DataFrame:
    """One tenant per supplier."""
    day = F.lit("2020-01-01").cast("timestamp") + F.make_interval(days=(F.col("s_suppkey") * 7919) % 1000)
    return t["supplier"].select(
        F.regexp_replace(F.lower("s_name"), "#", "-").alias("tenant_id"), F.col("s_name").alias("name"), day.alias("created_at"),
        (F.col("s_suppkey") % 500).cast("string").alias("max_cpu"),
    )


def part_models(t: Tables) -> DataFrame:
    """One model per part; sizes serve as versions."""
    return t["part"].select(
        F.col("p_brand").alias("tenant_id"), _text(F.col("p_name"), " ", F.col("p_partkey")).alias("model_name"),
        F.col("p_size").alias("version"), F.col("p_name").alias("family"),
    )


def audit(t: Tables) -> DataFrame:
    """One audit event per event."""
    k = F.regexp_extract("props", r"\d+", 0)
    return t["events"].select(
        _text("tenant-", F.col("user_id") % 3).alias("tenant_id"), "event_id", _text("user-", F.col("user_id")).alias("actor"),
        F.col("event_type").alias("action"), _pick(k.cast("int") % 3, "job", "model", "pipeline").alias("entity_type"),
        k.alias("entity_id"), "ts",
    )


def _event_models(t: Tables) -> DataFrame:
    return t["events"].select(
        _text("tenant-", F.col("user_id") % 3).alias("tenant_id"), _text("m-", F.col("user_id")).alias("model_name"),
        F.lit("1").alias("version"), "event_id", "ts", "event_type",
    )


def stage_events(t: Tables) -> DataFrame:
    """Stage moves of models named after users."""
    kind = F.col("event_type")
    stage = F.when(kind == "click", "Staging").when(kind == "purchase", "Production").when(kind == "signup", "Archived")
    return _event_models(t).withColumn("stage", stage).filter("stage IS NOT NULL").drop("event_type")


def event_statuses(t: Tables) -> DataFrame:
    """Snapshots of models named after users."""
    status = _pick(F.col("event_id") % 4, "Passed", "Failed", "Rework", "InReview")
    return _event_models(t).filter("event_type IN ('view', 'error')").select(
        "tenant_id", "model_name", "version", F.col("ts").alias("recorded_at"), status.alias("derived_status")
    )


def review_events(t: Tables) -> DataFrame:
    """Snapshots, gates and reviews of models named after users."""
    kind, e = F.col("event_type"), F.col("event_id")
    return _event_models(t).select(
        "tenant_id", "model_name", "version", "event_id", "ts",
        F.when(kind == "view", "snapshot").when(kind == "error", "gate").otherwise("review").alias("kind"),
        F.when(e % 2 == 0, "Rework").when(e % 3 == 0, "Failed").otherwise("Passed").alias("run_status"),
        F.when(kind.isin("click", "signup", "purchase"), e % 5 < 3).alias("approved"),
    )


def customer_runs(t: Tables) -> DataFrame:
    """One job per customer whose orders are its runs."""
    return t["orders"].select(
        _text("tenant-", F.col("o_custkey") % 3).alias("tenant_id"), _text("job-", F.col("o_custkey")).alias("job_id"),
        "o_orderkey", F.col("o_orderdate").alias("started_at"), F.col("o_orderstatus").alias("final_status"),
        F.col("o_totalprice").alias("detail"),
    )


def step_lists(t: Tables) -> DataFrame:
    """One definition per order, many of them misshapen."""
    o = F.col("o_orderkey")
    kinds = [_pick((o + i * (o % 3)) % 5, *STEP_ORDER) for i in range(3)]
    steps = F.array(*[
        F.struct(
            F.when(o % 7 == 0, "s1").otherwise(f"s{i + 1}").alias("step_id"), kinds[i].alias("type"),
            F.array(F.lit(f"s{i if i else 3}")).alias("depends_on") if i else F.when(
                o % 4 == 0, F.array(F.lit("s3"))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
        ) for i in range(3)
    ])
    return t["orders"].select(o.alias("definition"), F.when(o % 50 == 0, F.slice(steps, 1, 0)).otherwise(steps).alias("steps"))
