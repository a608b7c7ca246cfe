"""Scoring a table with a user's model, and checking what was written."""

from __future__ import annotations

import logging
import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.text import quoted

_log = logging.getLogger(__name__)


def score(
    df: DataFrame,
    model: bytes | Callable[[], Any],
    prediction_col: str = "prediction",
    features: list[str] | None = None,
    on_error: str = "batch",
) -> DataFrame:
    """Add a nullable prediction column; every input row and column is kept as it is.

    ``model`` is a pickled object with ``predict(DataFrame)``, or a function that
    returns such an object and runs once per task; give a function that reads the model from
    its place where it is too large to be sent around. Pickles run code: use trusted ones only. Only the feature columns
    go through pandas. Rows of a batch that fails get NULL; with
    ``on_error="row"`` a failing batch is halved until only the rows that
    cannot be scored are left, so the result does not depend on batching. What fails is logged
    in its task with its number of rows. A NaN
    prediction is stored as NULL.
    """
    if prediction_col in df.columns:
        raise ValueError(f"the input already has a column '{prediction_col}'")
    if on_error not in ("batch", "row"):
        raise ValueError("on_error must be 'batch' or 'row'")
    if callable(model):
        load = model
    else:
        shared = df.sparkSession.sparkContext.broadcast(model)
        load = lambda: pickle.loads(shared.value)
    used = list(features or df.columns)
    schema = T.StructType([*df.schema.fields, T.StructField(prediction_col, T.DoubleType(), True)])

    def predict(loaded: Any, rows: Any) -> np.ndarray:
        if len(rows) == 0:
            return np.empty(0)
        try:
            values = np.asarray(loaded.predict(rows), dtype="float64")
            if values.shape != (len(rows),):
                raise ValueError("predictions do not match the rows")
            return values
        except Exception:
            if on_error == "batch" or len(rows) == 1:
                _log.exception("%d rows could not be scored", len(rows))
                return np.full(len(rows), np.nan)
            half = len(rows) // 2
            return np.concatenate([predict(loaded, rows.iloc[:half]), predict(loaded, rows.iloc[half:])])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = load()
        for batch in batches:
            values = predict(loaded, batch.select(used).to_pandas())
            column = pa.array(values, type=pa.float64(), mask=np.isnan(values))
            names = [*batch.schema.names, prediction_col]
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=names)

    return df.mapInArrow(run, schema)


def assert_scored(source: DataFrame, scored: DataFrame, prediction_col: str = "prediction") -> None:
    """Check by schema that scoring kept every column and added only the prediction."""
    before = [(f.name, f.dataType) for f in source.schema.fields]
    after = [(f.name, f.dataType) for f in scored.schema.fields]
    if after != [*before, (prediction_col, T.DoubleType())]:
        raise ValueError("scored output must have the input columns and one prediction column")


def reconcile(source: DataFrame, written: DataFrame, prediction_col: str = "prediction") -> DataFrame:
    """One row: rows read, rows written, NULL predictions, and whether the counts agree.

    Counting parquet input reads file footers only; the output side reads one column.
    """
    out = written.agg(
        F.count("*").alias("rows_written"),
        F.count_if(F.col(quoted(prediction_col)).isNull()).alias("null_predictions"),
    )
    rows_read = source.agg(F.count("*").alias("n")).scalar()
    return out.select(
        rows_read.alias("rows_read"), "rows_written", "null_predictions", (rows_read == F.col("rows_written")).alias("complete")
    )


def write_scored(
    df: DataFrame, path: str, model: bytes | Callable[[], Any], prediction_col: str = "prediction", **options: Any
) -> DataFrame:
    """Score a table to ``path``; returns the row of ``reconcile`` from what the writing job itself has seen.

    ``options`` are those of ``score``. Neither side is read again. Shuffles above ``df`` do not disturb the counts.
    """
    read, written = Observation(), Observation()
    scored = score(df.observe(read, F.count(F.lit(1)).alias("n")), model, prediction_col, **options)
    assert_scored(df, scored, prediction_col)
    empty = F.count_if(F.col(quoted(prediction_col)).isNull())
    scored.observe(written, F.count(F.lit(1)).alias("n"), empty.alias("empty")).write.parquet(path)
    counts = {"rows_read": read.get["n"], "rows_written": written.get["n"], "null_predictions": written.get["empty"]}
    row = [F.lit(n).cast("long").alias(name) for name, n in counts.items()]
    return df.sparkSession.range(1).select(*row, F.lit(counts["rows_read"] == counts["rows_written"]).alias("complete"))
