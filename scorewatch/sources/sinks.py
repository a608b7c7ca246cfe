"""Writing run inputs and scored output, with lineage and without repeats."""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorewatch.functions.text import quoted
from scorewatch.functions.text import run_prefix as run_prefix_column
from scorewatch.operators.lookup import lookup_join
from scorewatch.sources.runs import list_files, read_or_none, read_run_output
from scorewatch.values import IDENTIFIER, LOAD_DATE_COLUMN, RETENTION_DAYS, RUN_ID_COLUMN, SOURCE_FILE_COLUMN


def run_prefix(base: str, run_date: dt.date, run_id: str) -> str:
    """``<base>/<YYYY-MM-DD>/<run id>/``: every run has a folder of its own."""
    return f"{base.rstrip('/')}/{run_date.isoformat()}/{run_id}/"


def with_run_prefix(runs: DataFrame, base: Column, run_date: str = "run_date") -> DataFrame:
    """The same for a table of runs."""
    return runs.withColumn("prefix", run_prefix_column(base, F.col(run_date), F.col("run_id")))


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, Observation]:
    """``df`` with metrics that the job which writes it collects on the way."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in metrics.items()]), seen


def unload_table(df: DataFrame, base: str, run_date: dt.date, run_id: str) -> tuple[str, int]:
    """Copy a table to its run's folder, replacing what is there; returns folder and rows.

    The rows are counted by the job that writes them.
    """
    uri = run_prefix(base, run_date, run_id)
    rows, seen = observed(df, n=F.count(F.lit(1)))
    rows.write.mode("overwrite").parquet(uri)
    return uri, seen.get["n"]


def extract(
    fn: Callable[[SparkSession, dict], DataFrame], spark: SparkSession, params: dict, base: str, run_date: dt.date, run_id: str
) -> tuple[str, int]:
    """Let a user's function make the run's input instead of copying a table."""
    return unload_table(fn(spark, params), base, run_date, run_id)


def assert_no_lineage_collision(df: DataFrame) -> None:
    """Refuse a table with a column named like a lineage column, in any case."""
    reserved = {RUN_ID_COLUMN.upper(), LOAD_DATE_COLUMN.upper()}
    taken = [c for c in df.columns if c.upper() in reserved]
    if taken:
        raise ValueError(f"column(s) {taken} collide with the reserved lineage columns")


def with_lineage(df: DataFrame, run_id: str | Column, load_date: str | Column) -> DataFrame:
    """Add the two lineage columns."""
    assert_no_lineage_collision(df)
    run, day = (F.lit(x) if isinstance(x, str) else x for x in (run_id, load_date))
    return df.withColumn(RUN_ID_COLUMN, run.cast("string")).withColumn(LOAD_DATE_COLUMN, day.cast("date"))


def align_to_target(df: DataFrame, target: T.StructType) -> DataFrame:
    """Rename and cast columns to those of a target table.

    A plain name matches in any case, any other name exactly. A column the target
    does not have is an error, as are two columns that would become one.
    """
    plain = {f.name.upper(): f for f in target.fields if re.match(IDENTIFIER, f.name)}
    exact = {f.name: f for f in target.fields}
    chosen: dict[str, Column] = {}
    for name in df.columns:
        field = plain.get(name.upper()) if re.match(IDENTIFIER, name) else exact.get(name)
        if field is None:
            raise ValueError(f"the target table has no column '{name}'")
        if field.name in chosen:
            raise ValueError(f"more than one column would be written to '{field.name}'")
        chosen[field.name] = F.col(quoted(name)).cast(field.dataType).alias(field.name)
    return df.select(*[chosen[f.name] for f in target.fields if f.name in chosen])


def read_loaded(spark: SparkSession, target: str) -> DataFrame | None:
    """The rows loaded so far, or None before the first ones; run ids stay text even where all are digits."""
    found = read_or_none(spark, target)
    if found is None:
        return None
    kinds = {RUN_ID_COLUMN: T.StringType(), LOAD_DATE_COLUMN: T.DateType()}
    schema = T.StructType([T.StructField(f.name, kinds.get(f.name, f.dataType), True) for f in found.schema.fields])
    return spark.read.schema(schema).parquet(target)


def load_append(df: DataFrame, target: str, run_id: str, load_date: str) -> int:
    """Append scored rows with lineage columns to a parquet table; returns the rows this call added.

    Nothing is ever overwritten. The table has a folder per run and load date. The rows are counted by the job
    that writes them; a run without rows adds none. Safe for one writer at a time. The target must have the lineage
    columns once it exists; rows that come from no file have a NULL ``_source_file``.
    """
    _assert_no_source_column(df)
    return _append(df, F.lit(None).cast("string"), target, run_id, load_date)


def _assert_no_source_column(df: DataFrame) -> None:
    if SOURCE_FILE_COLUMN.upper() in {c.upper() for c in df.columns}:
        raise ValueError(f"a column collides with the reserved lineage column {SOURCE_FILE_COLUMN}")


def _append(df: DataFrame, source: Column, target: str, run_id: str, load_date: str) -> int:
    existing = read_loaded(df.sparkSession, target)
    rows = with_lineage(df.withColumn(SOURCE_FILE_COLUMN, source), run_id, load_date)
    if existing is not None:
        rows = align_to_target(rows, existing.schema)
    rows, seen = observed(rows, n=F.count(F.lit(1)))
    rows.write.mode("append").partitionBy(RUN_ID_COLUMN, LOAD_DATE_COLUMN).parquet(target)
    return seen.get["n"]


def not_yet_loaded(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files the ledger does not know, each once. The ledger never forgets."""
    return files.dropDuplicates(["path"]).join(ledger.select("path").distinct(), "path", "left_anti")


def load_files(spark: SparkSession, prefix: str, target: str, ledger_path: str, run_id: str, load_date: str) -> int:
    """Load a finished run's files that the ledger does not know, then note them there; returns the rows added.

    Listing, ledger and the run's own folders of the target are joined on the file path, so no list of files comes to the
    driver; where nothing is missing, no file is read. Every row keeps the file it came from:
    where an earlier load stopped between its two writes, files that are in the target
    already are noted and the others are loaded. Safe for one writer at a time.
    """
    listed, ledger, loaded = list_files(spark, prefix), read_or_none(spark, ledger_path), read_loaded(spark, target)
    fresh = listed.dropDuplicates(["path"]) if ledger is None else not_yet_loaded(listed, ledger)
    there = None if loaded is None else _rows_per_file(loaded, run_id)
    state = fresh.withColumn("rows_loaded", F.lit(None).cast("long")) if there is None else fresh.join(there, "path", "left")
    missing = state.filter("rows_loaded IS NULL").select(F.col("path").alias(SOURCE_FILE_COLUMN))
    absent = F.col("rows_loaded").isNull()
    size = F.octet_length("path") + 64
    known = state.agg(
        F.count("*").alias("fresh"), F.count_if(absent).alias("missing"), F.coalesce(F.sum(F.when(absent, size)), F.lit(0)).alias("bytes")
    ).first()
    if not known["fresh"]:
        return 0
    added = 0
    if known["missing"]:
        output = read_run_output(spark, prefix)
        _assert_no_source_column(output)
        staged = output.withColumn(SOURCE_FILE_COLUMN, F.col("_metadata.file_path"))
        if known["missing"] < listed.count():
            staged = lookup_join(staged, missing, [SOURCE_FILE_COLUMN], "left_semi", small_bytes=known["bytes"])
        added = _append(staged, F.col(SOURCE_FILE_COLUMN), target, run_id, load_date)
    now = read_loaded(spark, target)
    noted = fresh.withColumn("rows_loaded", F.lit(0).cast("long")) if now is None else fresh.join(_rows_per_file(now, run_id), "path", "left")
    noted.select(
        "path", F.coalesce("rows_loaded", F.lit(0)).alias("rows_loaded"), F.lit(run_id).alias("run_id"),
        F.lit(load_date).cast("timestamp").alias("loaded_at")).write.mode("append").parquet(ledger_path)
    return added


def _rows_per_file(loaded: DataFrame, run_id: str) -> DataFrame:
    """Rows of a run in the target by the file they came from; only that run's folders are read."""
    rows = loaded.filter((F.col(RUN_ID_COLUMN) == run_id) & F.col(SOURCE_FILE_COLUMN).isNotNull())
    return rows.groupBy(F.col(SOURCE_FILE_COLUMN).alias("path")).agg(F.count("*").alias("rows_loaded"))


def load_row_total(ledger: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Rows loaded over all files, unknown counts left out."""
    return ledger.groupBy(*keys).agg(F.coalesce(F.sum("rows_loaded"), F.lit(0)).alias("rows_loaded"))


def retain(df: DataFrame, as_of: Column, days: int = RETENTION_DAYS) -> DataFrame:
    """Rows whose ``run_date`` is at most ``days`` days old; old date folders are not read."""
    return df.filter(F.col("run_date") >= F.date_sub(as_of, days))
