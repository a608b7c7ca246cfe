"""Quality and drift of scoring runs: all runs of all tenants in one plan.

The scored table is read once and turned into counts per cell: (run, column,
bucket). Cells are counted before they are shuffled, so a run or tenant with a
large part of all rows costs no more than any other. Everything after that works
on one row per run.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.drift import (
    UNROLL_EDGES,
    as_number,
    baseline_errors,
    bucketize,
    may_be_number,
    proportions,
    psi,
)
from scorewatch.functions.text import quoted, stripped
from scorewatch.operators.lookup import BROADCAST_BYTES, lookup_join
from scorewatch.operators.ordered import with_last
from scorewatch.values import (
    MODEL_KEYS,
    NOTE_COLUMN_ABSENT,
    NOTE_COLUMNS_MISSING,
    NOTE_FIRST_RUN,
    NOTE_NO_BASELINE,
    RUN_KEYS,
)

_NULL = -1
# Counts kept in one aggregation; measured, see README.
COUNTERS = 40


@dataclass(frozen=True)
class BaselineFacts:
    """What a plan needs to know about a baseline table before it is built."""

    features: list[str]
    max_edges: int
    wide_bytes: int


def baseline_facts(baselines: DataFrame, columns: list[str]) -> BaselineFacts:
    """Features among ``columns``, longest edge list and size, by one aggregation."""
    known = F.col("feature").isin(list(columns))
    per_row = (F.size("bins") * 8 + F.size("proportions") * 8 + F.octet_length("feature") + 256).cast("long")
    row = baselines.agg(
        F.collect_set(F.when(known, F.col("feature"))).alias("features"),
        F.coalesce(F.max(F.size("bins")), F.lit(0)).alias("edges"),
        F.coalesce(F.sum(per_row), F.lit(0)).alias("bytes"),
    ).first()
    return BaselineFacts(sorted(row["features"]), row["edges"], row["bytes"])


def _baselines_of(runs: DataFrame, baselines: DataFrame, columns: list[str]) -> tuple[DataFrame, BaselineFacts]:
    """The baselines and their facts; a table too large to broadcast is first cut to the models that have runs."""
    facts = baseline_facts(baselines, columns)
    if facts.wide_bytes <= BROADCAST_BYTES:
        return baselines, facts
    cut = baselines.join(runs.select(*MODEL_KEYS).distinct(), MODEL_KEYS, "left_semi")
    return cut, baseline_facts(cut, columns)


def inspected_columns(manifest: DataFrame, columns: list[str]) -> list[str]:
    """Columns that a null-rate check or a prediction setting names, by one aggregation.

    ``columns`` are those of the scored table. A run that claims such a column which the table lacks
    is an error: the schemas were not merged, or names differ in case.
    """
    named = F.transform(
        F.filter(F.coalesce("checks", F.array()), lambda c: c["type"] == "null_rate"), lambda c: stripped(c["name"])
    )
    claimed = F.array_intersect(F.array_append(named, F.col("prediction_col")), F.col("columns"))
    found = sorted(r["c"] for r in manifest.select(F.explode(claimed).alias("c")).distinct().collect())
    if lost := sorted(set(found) - set(columns)):
        raise ValueError(f"runs have the columns {lost}, the scored table does not")
    return found


def run_counts(scored: DataFrame, columns: list[str] = (), keys: list[str] = RUN_KEYS) -> DataFrame:
    """Rows per run, and NULLs per run of each named column, in one pass."""
    nulls = [F.count_if(F.col(quoted(c)).isNull()).alias(f"nulls_{c}") for c in columns]
    return scored.groupBy(*keys).agg(F.count("*").alias("request_count"), *nulls)


def null_fraction(nulls: Column, rows: Column) -> Column:
    """Share of NULLs; 0 for an empty run."""
    return F.when(rows == 0, 0.0).otherwise(nulls / rows)


@dataclass(frozen=True)
class Item:
    """One value per row that is put in a bucket: a feature's number, or presence only."""

    column: str
    feature: bool
    presence: bool


def _items(features: list[str], others: list[str], types: dict[str, T.DataType]) -> list[Item]:
    """What to count: numbers of features, and presence where a number does not tell."""
    items = [Item(f, True, False) for f in features]
    # text may be there without being a number
    items += [Item(f, False, True) for f in features if isinstance(types[f], T.StringType)]
    return items + [Item(c, False, False) for c in others if c not in features]


def _cells(
    scored: DataFrame, baselines: DataFrame | None, facts: BaselineFacts | None, others: list[str], keys: list[str]
) -> tuple[DataFrame, list[Item]]:
    """Counts per (run, item, bucket) and the numbered items.

    All items of a row become one array of doubles, next to an array with the
    inner edges of each item, so code and plan do not grow with the columns.
    """
    types = {f.name: f.dataType for f in scored.schema.fields}
    # types that never count as numbers need not be read: the report skips them anyway
    features = [f for f in facts.features if may_be_number(types[f])] if facts else []
    items = _items(features, others, types)
    inner = max(facts.max_edges - 2, 0) if features else 0

    def value(item: Item) -> Column:
        column = F.col(quoted(item.column))
        return as_number(column, types[item.column]) if item.feature else F.when(column.isNotNull(), 0.0)

    def edges(item: Item) -> Column:
        if not item.feature:
            return F.lit(None).cast("array<double>")
        bins = F.array_sort(F.get(F.filter("baseline", lambda b: b["feature"] == item.column), F.lit(0))["bins"])
        return F.when(F.size(bins) > 2, F.slice(bins, F.lit(2), F.size(bins) - 2))

    rows = scored.select(*keys, F.array(*[value(i) for i in items] or [F.lit(0.0)]).alias("__values"))
    if features:
        wide = baseline_specs(baselines).select(*MODEL_KEYS, F.array(*[edges(i) for i in items]).alias("__edges"))
        rows = lookup_join(rows, wide, MODEL_KEYS, small_bytes=facts.wide_bytes)
    else:
        rows = rows.withColumn("__edges", F.lit(None).cast("array<array<double>>"))
    count = _count_side_by_side if inner < UNROLL_EDGES else _count_one_by_one
    return count(rows, keys, max(len(items), 1), inner), items


def _count_side_by_side(rows: DataFrame, keys: list[str], items: int, inner: int) -> DataFrame:
    """Cells by counting, for several items at once, the values that reach each inner edge.

    One group update per row and about ``COUNTERS`` counts, instead of one per cell.
    More counts in one aggregation exceed what the JVM compiles well, so the items
    are dealt out in equal chunks and a row is repeated once per chunk.
    """
    slots = max(1, min(items, COUNTERS // (inner + 1)))
    chunks = -(-items // slots)
    chunk = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))) if chunks > 1 else F.lit(0)
    dealt = rows.withColumn("chunk", chunk).select(
        *keys, "chunk",
        *[F.get("__values", F.col("chunk") * slots + s).alias(f"v{s}") for s in range(slots)],
        *[F.get("__edges", F.col("chunk") * slots + s).alias(f"e{s}") for s in range(slots)],
    )
    reached = {
        f"r{s}_{b}": F.count(F.when(F.get(f"e{s}", F.lit(b - 1)) <= F.col(f"v{s}"), True) if b else F.col(f"v{s}"))
        for s in range(slots) for b in range(inner + 1)
    }
    counts = dealt.groupBy(*keys, "chunk").agg(F.count("*").alias("rows"), *[c.alias(n) for n, c in reached.items()])

    def cell(s: int, bucket: int, n: Column) -> Column:
        return F.struct((F.col("chunk") * slots + s).alias("item"), F.lit(bucket).alias("bucket"), n.alias("n"))

    cells = []
    for s in range(slots):
        above = [F.col(f"r{s}_{b}") for b in range(inner + 1)] + [F.lit(0)]
        cells.append(cell(s, _NULL, F.col("rows") - above[0]))
        cells += [cell(s, b, above[b] - above[b + 1]) for b in range(inner + 1)]
    return counts.select(*keys, F.inline(F.array(*cells))).filter((F.col("n") > 0) & (F.col("item") < items))


def _count_one_by_one(rows: DataFrame, keys: list[str], items: int, inner: int) -> DataFrame:
    """Cells by giving every value its bucket first; for baselines with many edges."""
    edges, value = F.get("__edges", F.col("item")), F.col("value")
    bucket = F.coalesce(F.size(F.filter(edges, lambda e: e <= value)), F.lit(0))
    return (
        rows.select("*", F.posexplode("__values").alias("item", "value"))
        .select(*keys, "item", F.when(value.isNull(), _NULL).otherwise(bucket).alias("bucket"))
        .groupBy(*keys, "item", "bucket").agg(F.count("*").alias("n"))
    )


def run_stats(
    scored: DataFrame,
    baselines: DataFrame | None = None,
    others: list[str] = (),
    keys: list[str] = RUN_KEYS,
) -> DataFrame:
    """One row per run that has rows: ``request_count`` and a map of column statistics.

    ``stats`` maps each inspected column to its rows, NULLs, values that are not
    numbers, and counts per baseline bucket.
    """
    facts = None
    if baselines is not None:
        baselines, facts = _baselines_of(scored, baselines, scored.columns)
    return _run_stats(scored, baselines, facts, list(others), keys)


def _run_stats(
    scored: DataFrame, baselines: DataFrame | None, facts: BaselineFacts | None, others: list[str], keys: list[str]
) -> DataFrame:
    return stats_of_cells(_named_cells(scored, baselines, facts, others, keys), keys)


def _named_cells(
    scored: DataFrame, baselines: DataFrame | None, facts: BaselineFacts | None, others: list[str], keys: list[str]
) -> DataFrame:
    cells, items = _cells(scored, baselines, facts, others, keys)
    presence = F.get(F.array(*[F.lit(i.presence) for i in items] or [F.lit(False)]), F.col("item"))
    column = F.get(F.array(*[F.lit(i.column) for i in items] or [F.lit("")]), F.col("item"))
    return cells.select(*keys, column.alias("column"), presence.alias("presence"), "bucket", "n")


def run_cells(
    scored: DataFrame, manifest: DataFrame, baselines: DataFrame, *, inspect: list[str] | None = None, keys: list[str] = RUN_KEYS
) -> DataFrame:
    """Counts per (run, column, bucket) from which every report on the runs of ``manifest`` can be made.

    Columns: the run keys, ``column``, ``presence``, ``bucket`` (-1 counts values without a number) and ``n``. Cells of parts of
    a run add up, so they may be kept and added to (``sources.cells``). They hold for the baseline they
    were counted with; a model version's baseline does not change. ``inspect`` as in ``dq_report``.
    """
    baselines, facts = _baselines_of(manifest, baselines, scored.columns)
    if inspect is None:
        inspect = inspected_columns(manifest, scored.columns)
    return _named_cells(scored, baselines, facts, [c for c in inspect if c in scored.columns], keys)


def stats_of_cells(cells: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """One row per run from its cells, see ``run_stats``."""
    main, empty = ~F.col("presence"), F.col("bucket") == _NULL

    def counted(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0))

    # from here on everything about a run stays in one partition: a run has few cells
    summed = cells.repartition(*keys).groupBy(*keys, "column", "presence", "bucket").agg(F.sum("n").alias("n"))
    per_column = summed.groupBy(*keys, "column").agg(
        counted(main).alias("rows"),
        counted(main & empty).alias("without_number"),
        F.max("presence").alias("text"),
        counted(~main & empty).alias("absent"),
        F.map_from_entries(F.collect_list(F.when(main & ~empty, F.struct("bucket", "n")))).alias("buckets"),
    )
    nulls = F.when(F.col("text"), F.col("absent")).otherwise(F.col("without_number"))
    entry = F.struct("column", F.struct(
        "rows", nulls.alias("nulls"), (F.col("without_number") - nulls).alias("not_numbers"), "buckets"
    ))
    return per_column.groupBy(*keys).agg(
        F.max("rows").alias("request_count"), F.map_from_entries(F.collect_list(entry)).alias("stats")
    )


def baseline_specs(baselines: DataFrame) -> DataFrame:
    """One row per model version with its features as a sorted array of structs."""
    return baselines.groupBy(*MODEL_KEYS).agg(
        F.array_sort(F.collect_list(F.struct("feature", "bins", "proportions"))).alias("baseline")
    )


def _feature_drift(spec: Column, stats: Column, columns: Column) -> Column:
    """struct<feature, psi> of one baseline feature; psi is NULL when it is skipped."""
    seen = F.try_element_at(stats, spec["feature"])
    props, values = spec["proportions"], seen["rows"] - seen["nulls"]
    usable = (
        (F.size(props) > 0)
        & (F.size(spec["bins"]) == F.size(props) + 1)
        & F.array_contains(columns, spec["feature"])
        & (seen["not_numbers"] == 0)
        & (values > 0)
    )
    score = psi(props, proportions(seen["buckets"], F.size(props), values))
    return F.struct(spec["feature"].alias("feature"), F.when(usable, score).alias("psi"))


def _check_result(check: Column, i: Column) -> Column:
    """One evaluated check; the columns it needs are those of ``dq_report``."""
    columns, expected = F.col("columns"), F.transform("baseline", lambda b: b["feature"])
    name = F.coalesce(
        F.nullif(stripped(check["name"]), F.lit("")), F.concat(check["type"], F.lit("_"), (i + 1).cast("string"))
    )
    seen = F.try_element_at("stats", name)
    present = F.array_contains(columns, name)
    missing = F.array_sort(F.array_except(expected, columns))
    previous, rows = F.col("previous_row_count"), F.col("request_count")
    is_null_rate, is_delta = check["type"] == "null_rate", check["type"] == "row_count_delta"

    observed = (
        F.when(is_null_rate & ~present, 1.0)
        .when(is_null_rate, null_fraction(seen["nulls"], rows))
        .when(is_delta & previous.isNull(), 0.0)
        .when(is_delta, F.abs(rows - previous) / previous)
        .when(F.size(expected) == 0, 0.0)
        .otherwise(F.size(missing) / F.size(expected))
    )
    note = (
        F.when(is_null_rate & ~present, F.format_string(NOTE_COLUMN_ABSENT, name))
        .when(is_delta & previous.isNull(), NOTE_FIRST_RUN)
        .when(is_null_rate | is_delta, F.lit(None).cast("string"))
        .when(F.size(expected) == 0, NOTE_NO_BASELINE)
        .when(F.size(missing) > 0, F.format_string(NOTE_COLUMNS_MISSING, F.array_join(missing, "', '")))
    )
    return F.struct(
        name.alias("name"),
        check["type"].alias("type"),
        check["threshold"].cast("double").alias("threshold"),
        F.round(observed, 4).alias("observed"),
        F.coalesce(observed <= check["threshold"], F.lit(False)).alias("passed"),
        note.alias("note"),
    )


def _newest_per_name(details: Column) -> Column:
    """Of checks that share a name, only the last one is shown."""
    return F.filter(
        details, lambda d, i: ~F.exists(F.slice(details, i + 2, F.size(details)), lambda later: later["name"] == d["name"])
    )


def dq_report(
    scored: DataFrame,
    manifest: DataFrame,
    baselines: DataFrame,
    *,
    stored: DataFrame | None = None,
    inspect: list[str] | None = None,
    keys: list[str] = RUN_KEYS,
    width: str = "month",
) -> DataFrame:
    """Quality and drift of every run in ``manifest``, one row each.

    ``manifest`` has the run keys, ``recorded_at``, ``columns`` (the names in the
    run's own files), ``prediction_col`` (or NULL) and ``checks``. Which columns a
    run has is read from there, never from the merged schema, and runs without
    rows stay in. ``baselines`` has one row per model version and feature.
    ``stored`` are snapshots from earlier on, looked at for previous row counts.

    When this is called, ``baselines`` is looked at once, and so is ``manifest``
    unless ``inspect`` names the columns that checks and prediction settings use. A check on a
    column that ``inspect`` leaves out fails, and the error rate of such a prediction is NULL, which
    ``derive_status`` takes as failed.
    """
    baselines, facts = _baselines_of(manifest, baselines, scored.columns)
    if inspect is None:
        inspect = inspected_columns(manifest, scored.columns)
    stats = _run_stats(scored, baselines, facts, [c for c in inspect if c in scored.columns], keys)
    return _report(stats, manifest, baselines, facts, stored, keys, width)


def report_from_cells(
    cells: DataFrame,
    manifest: DataFrame,
    baselines: DataFrame,
    *,
    stored: DataFrame | None = None,
    keys: list[str] = RUN_KEYS,
    width: str = "month",
) -> DataFrame:
    """The rows of ``dq_report`` from stored cells (``run_cells``) instead of the scored rows.

    A run without cells has no rows. A check on a column that was not counted fails, as there.
    """
    baselines, facts = _baselines_of(manifest, baselines, [])
    return _report(stats_of_cells(cells, keys), manifest, baselines, facts, stored, keys, width)


def _report(
    stats: DataFrame, manifest: DataFrame, baselines: DataFrame, facts: BaselineFacts, stored: DataFrame | None, keys: list[str], width: str
) -> DataFrame:
    runs = manifest.select(
        *keys, "recorded_at", "columns", "prediction_col", F.coalesce("checks", F.array()).alias("checks")
    )
    runs = runs.join(stats, keys, "left").withColumn("request_count", F.coalesce("request_count", F.lit(0)))
    runs = with_previous_count(runs, stored=stored, width=width)
    runs = lookup_join(runs, baseline_specs(baselines), MODEL_KEYS, small_bytes=facts.wide_bytes)
    runs = runs.withColumn("baseline", F.coalesce("baseline", F.array()))

    prediction = F.col("prediction_col")
    error_rate = (
        F.when(F.coalesce(prediction, F.lit("")) == "", 0.0)
        .when(~F.array_contains("columns", prediction), 1.0)
        .otherwise(null_fraction(F.try_element_at("stats", prediction)["nulls"], F.col("request_count")))
    )
    drift = F.transform("baseline", lambda b: _feature_drift(b, F.col("stats"), F.col("columns")))
    measured = runs.select(
        *keys, "recorded_at", "request_count", "previous_row_count",
        F.lit(0.0).alias("avg_latency_ms"),
        F.round(error_rate, 4).alias("error_rate"),
        F.when(F.size("baseline") > 0, "psi_vs_baseline").otherwise("none").alias("drift_computation"),
        drift.alias("drift"),
        F.transform("checks", _check_result).alias("results"),
    )
    scores = F.filter("drift", lambda d: d["psi"].isNotNull())
    return measured.select(
        *keys, "recorded_at", "request_count", "previous_row_count", "avg_latency_ms", "error_rate", "drift_computation",
        F.map_from_entries(scores).alias("drift_metrics"),
        F.transform(F.filter("drift", lambda d: d["psi"].isNull()), lambda d: d["feature"]).alias("drift_skipped"),
        max_psi(F.transform(scores, lambda d: d["psi"])).alias("max_psi"),
        F.forall("results", lambda r: r["passed"]).alias("dq_passed"),
        _newest_per_name(F.col("results")).alias("dq_details"),
    )


def max_psi(scores: Column) -> Column:
    """Largest score, 0 when there is none."""
    return F.coalesce(F.array_max(scores), F.lit(0.0))


def with_previous_count(runs: DataFrame, *, stored: DataFrame | None = None, width: str = "month") -> DataFrame:
    """Add the row count of the model's run before; 0 rows count as no earlier run."""
    count = F.struct("request_count")
    if stored is None:
        seen = with_last(runs, MODEL_KEYS, "recorded_at", {"__prev": count}, ties=["job_id", "run_id"], width=width)
    else:
        # rows already stored take part in the order but are not returned
        slim = stored.select(*RUN_KEYS, "recorded_at", "request_count", F.lit(True).alias("__stored"))
        both = runs.withColumn("__stored", F.lit(False)).unionByName(slim, allowMissingColumns=True)
        seen = with_last(both, MODEL_KEYS, "recorded_at", {"__prev": count}, ties=["job_id", "run_id"], width=width)
        seen = seen.filter(~F.col("__stored")).drop("__stored")
    previous = F.nullif(F.col("__prev")["request_count"], F.lit(0))
    return seen.withColumn("previous_row_count", previous).drop("__prev")


def drift_by_run(scored: DataFrame, baselines: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """PSI of every run and baseline feature that can be scored, one row each."""
    baselines, facts = _baselines_of(scored, baselines, scored.columns)
    stats = _run_stats(scored, baselines, facts, [], keys)
    runs = lookup_join(stats, baseline_specs(baselines), MODEL_KEYS, "inner", small_bytes=facts.wide_bytes)
    here = F.array(*[F.lit(c) for c in scored.columns])
    scores = F.transform("baseline", lambda b: _feature_drift(b, F.col("stats"), here))
    return runs.select(*keys, "request_count", F.inline(scores)).filter("psi IS NOT NULL")


def drift_summary(scored: DataFrame, manifest: DataFrame, baselines: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Rows, scored features and largest PSI of every run in ``manifest``; 0 without rows or a usable baseline."""
    baselines, facts = _baselines_of(manifest, baselines, scored.columns)
    stats = _run_stats(scored, baselines, facts, [], keys)
    return _drift_summary(stats, manifest, baselines, facts, F.array(*[F.lit(c) for c in scored.columns]), keys)


def drift_summary_from_cells(
    cells: DataFrame, manifest: DataFrame, baselines: DataFrame, columns: list[str], keys: list[str] = RUN_KEYS
) -> DataFrame:
    """The rows of ``drift_summary`` from stored cells; ``columns`` are those of the scored table."""
    baselines, facts = _baselines_of(manifest, baselines, [])
    return _drift_summary(stats_of_cells(cells, keys), manifest, baselines, facts, F.array(*[F.lit(c) for c in columns]), keys)


def _drift_summary(
    stats: DataFrame, manifest: DataFrame, baselines: DataFrame, facts: BaselineFacts, here: Column, keys: list[str]
) -> DataFrame:
    runs = manifest.select(*keys).join(stats, keys, "left")
    runs = lookup_join(runs, baseline_specs(baselines), MODEL_KEYS, small_bytes=facts.wide_bytes)
    drift = F.transform(F.coalesce("baseline", F.array()), lambda b: _feature_drift(b, F.col("stats"), here))
    scores = F.transform(F.filter(drift, lambda d: d["psi"].isNotNull()), lambda d: d["psi"])
    return runs.select(
        *keys, F.coalesce("request_count", F.lit(0)).alias("request_count"), F.size(scores).cast("long").alias("features"),
        F.aggregate(scores, F.lit(0.0), lambda a, x: a + x).alias("total_psi"), max_psi(scores).alias("max_psi"))


def bucket_shares(scored: DataFrame, baselines: DataFrame, keys: list[str] = RUN_KEYS) -> DataFrame:
    """Count and share of every bucket of a usable baseline per run and feature, empty ones included."""
    baselines, facts = _baselines_of(scored, baselines, scored.columns)
    stats = _run_stats(scored, baselines, facts, [], keys)
    runs = lookup_join(stats, baseline_specs(baselines), MODEL_KEYS, "inner", small_bytes=facts.wide_bytes)

    def shares(b: Column) -> Column:
        seen = F.try_element_at("stats", b["feature"])
        usable = (seen["not_numbers"] == 0) & (seen["rows"] > seen["nulls"]) & (F.size(b["bins"]) == F.size(b["proportions"]) + 1)
        share = proportions(seen["buckets"], F.size(b["bins"]) - 1, seen["rows"] - seen["nulls"])
        return F.when(usable, F.transform(share, lambda s, i: F.struct(
            b["feature"].alias("feature"), i.alias("bucket"),
            F.coalesce(F.try_element_at(seen["buckets"], i), F.lit(0)).alias("n"), s.alias("share"),
        ))).otherwise(F.array())

    return runs.select(*keys, F.inline(F.flatten(F.transform("baseline", shares))))


def fit_baseline(training: DataFrame, edges: dict[str, list[float]], keys: list[str] = MODEL_KEYS) -> DataFrame:
    """Baseline rows from training data: share of each bucket between given edges."""
    types = {f.name: f.dataType for f in training.schema.fields}
    values = F.array(*[
        F.struct(F.lit(f).alias("feature"), bucketize(
            as_number(F.col(quoted(f)), types[f]), F.array(*[F.lit(float(e)) for e in cuts]), len(cuts)
        ).alias("bucket"))
        for f, cuts in edges.items()
    ])
    counts = (
        training.select(*keys, F.inline(values)).filter("bucket IS NOT NULL")
        .groupBy(*keys, "feature", "bucket").agg(F.count("*").alias("n"))
        .groupBy(*keys, "feature").agg(
            F.sum("n").alias("total"), F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("counts")
        )
    )
    bins = F.create_map(*[x for f, cuts in edges.items() for x in (F.lit(f), F.array(*[F.lit(float(e)) for e in cuts]))])
    return counts.select(*keys, "feature", F.element_at(bins, F.col("feature")).alias("bins"), "counts", "total").select(
        *keys, "feature", "bins", proportions(F.col("counts"), F.size("bins") - 1, F.col("total")).alias("proportions")
    )


def validate_baselines(baselines: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with each baseline row, empty when nothing is."""
    return baselines.withColumn("errors", baseline_errors(F.col("bins"), F.col("proportions")))

