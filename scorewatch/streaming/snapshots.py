"""Taking in finished runs as they arrive."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from scorewatch.operators.quality import dq_report
from scorewatch.operators.snapshots import build_snapshots
from scorewatch.sources.runs import read_or_none
from scorewatch.values import MODEL_KEYS, RUN_KEYS

_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
_BATCH = ["_writer", "_batch"]
_LAST = [*RUN_KEYS, "recorded_at", "request_count"]


def _first_of_run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The earliest row of a run that the stream has not met before; of equally early ones the first by content."""
    best = min((row for frame in frames for row in zip(frame["at"], frame["body"])), default=None)
    if best is not None and not state.exists:
        state.update((True,))
        yield pd.DataFrame({"body": [best[1]]})


def _new_runs(manifests: DataFrame) -> DataFrame:
    """The manifest rows of runs met for the first time; Spark's state store keeps the runs met."""
    rows = manifests.select(*RUN_KEYS, F.unix_micros("recorded_at").alias("at"), F.to_json(F.struct(*manifests.columns), _JSON).alias("body"))
    first = rows.groupBy(*RUN_KEYS).applyInPandasWithState(_first_of_run, "body string", "met boolean", "append", GroupStateTimeout.NoTimeout)
    return first.select(F.from_json("body", manifests.schema, _JSON).alias("r")).select("r.*")


def _writer_of(spark: SparkSession, checkpoint: str) -> str:
    """A name that belongs to a checkpoint and goes with it."""
    path = f"{checkpoint}/writer"
    try:
        return spark.read.text(path).first()[0]
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    spark.range(1).select(F.lit(uuid.uuid4().hex).alias("value")).coalesce(1).write.text(path)
    return spark.read.text(path).first()[0]


def read_stream_snapshots(spark: SparkSession, store: str) -> DataFrame | None:
    """The snapshots that streams have recorded in ``store``, or None before the first ones."""
    found = read_or_none(spark, store)
    return None if found is None else found.drop(*_BATCH)


def stream_snapshots(
    spark: SparkSession,
    manifest_path: str,
    read_scored: Callable[[DataFrame], DataFrame],
    baselines: DataFrame,
    models: DataFrame,
    store: str,
    checkpoint: str,
) -> StreamingQuery:
    """Record one snapshot for every run whose manifest row has arrived.

    A manifest row is written when its run is complete, so no run is measured half
    written. ``read_scored`` gets the manifest rows of a batch and returns the
    scored rows of those runs. The query takes in what is there and ends; start it
    again with the same ``checkpoint`` for later runs.

    Which runs have been met is kept by the stream's state, and each batch hands on the newest row count of every model, so
    a batch costs what its own runs cost, however many are stored. A batch has a folder of its own in ``store``: repeated after
    a failure it writes the same again. A new checkpoint starts from what ``store`` holds. A run that arrives
    after a later one of its model is compared with the stored runs of that model.
    """
    writer, schema = _writer_of(spark, checkpoint), spark.read.parquet(manifest_path).schema
    runs = _new_runs(spark.readStream.schema(schema).parquet(manifest_path))
    earlier = read_or_none(spark, store)
    others = None if earlier is None else earlier.filter(F.col("_writer") != writer)
    if others is not None and not others.isEmpty():  # snapshots of another checkpoint
        runs = runs.join(others.select(*RUN_KEYS).distinct(), RUN_KEYS, "left_anti")
    else:
        others = None

    def take_in(batch: DataFrame, number: int) -> None:
        session, last = batch.sparkSession, f"{checkpoint}/last"
        before = read_or_none(session, f"{last}/batch={number - 1}") if number else _last_counts(others)
        rows = batch.select(*schema.names).persist()
        try:
            stored = _looked_at(session, rows, before, store)
            report = dq_report(read_scored(rows), rows, baselines, stored=stored)
            made = build_snapshots(report, models).withColumns({"_writer": F.lit(writer), "_batch": F.lit(number)})
            made.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*_BATCH, "tenant_id").parquet(store)
        finally:
            rows.unpersist()
        own = read_or_none(session, f"{store}/_writer={writer}/_batch={number}")
        known = [x.select(*_LAST) for x in (own, before) if x is not None]
        if known:
            _last_counts(reduce(DataFrame.unionByName, known)).write.mode("overwrite").parquet(f"{last}/batch={number}")

    options: dict[str, Any] = {"checkpointLocation": f"{checkpoint}/stream"}
    return runs.writeStream.foreachBatch(take_in).options(**options).trigger(availableNow=True).start()


def _last_counts(snapshots: DataFrame | None) -> DataFrame | None:
    """The newest run of each model with its row count."""
    if snapshots is None:
        return None
    newest = F.max_by(F.struct(*[c for c in _LAST if c not in MODEL_KEYS]), F.struct("recorded_at", "job_id", "run_id")).alias("s")
    return snapshots.groupBy(*MODEL_KEYS).agg(newest).select(*MODEL_KEYS, "s.*")


def _looked_at(spark: SparkSession, runs: DataFrame, last: DataFrame | None, store: str) -> DataFrame | None:
    """Stored runs that the previous row counts of ``runs`` depend on: the last ones, for models with a late run all of theirs."""
    if last is None:
        return None
    newest = last.select(*MODEL_KEYS, F.col("recorded_at").alias("__newest"))
    late = runs.join(newest, MODEL_KEYS).filter(F.col("recorded_at") < F.col("__newest")).select(*MODEL_KEYS).distinct()
    if late.isEmpty():
        return last.join(runs.select(*MODEL_KEYS).distinct(), MODEL_KEYS, "left_semi")
    own = runs.select(*RUN_KEYS)
    stored = read_stream_snapshots(spark, store).join(own, RUN_KEYS, "left_anti")  # a repeated batch may have written before
    whole = stored.join(late, MODEL_KEYS, "left_semi").select(*_LAST)
    rest = last.select(*_LAST).join(runs.select(*MODEL_KEYS).distinct(), MODEL_KEYS, "left_semi").join(late, MODEL_KEYS, "left_anti")
    return whole.unionByName(rest)
