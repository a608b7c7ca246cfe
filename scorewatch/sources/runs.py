"""Reading the output files of scoring runs."""

from __future__ import annotations

import io
import pickle
import posixpath
import tarfile
from collections.abc import Callable
from functools import reduce
from typing import Any, BinaryIO

from pyspark import SparkFiles
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NOTHING_THERE = ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")


def read_run_output(spark: SparkSession, prefix: str, schema: T.StructType | None = None) -> DataFrame:
    """All parquet files under a prefix, nested ones too, as one table.

    Columns missing from some files are NULL there. With ``schema`` no file
    footers are read up front. No file at all is an error.
    """
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True)
    if schema is not None:
        if list_files(spark, prefix).isEmpty():
            raise ValueError(f"No parquet files found under {prefix}")
        return reader.schema(schema).parquet(prefix)
    try:
        return reader.parquet(prefix)
    except AnalysisException as e:
        if e.getCondition() in _NOTHING_THERE:
            raise ValueError(f"No parquet files found under {prefix}") from e
        raise


def read_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table, or None where nothing has been written yet. One that is there but cannot be read is an error."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in _NOTHING_THERE:
            return None
        raise


def list_files(spark: SparkSession, prefix: str) -> DataFrame:
    """Path and size of every parquet file under a prefix; file contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    return reader.load(prefix).select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("bytes"))


def sample_run_output(spark: SparkSession, prefix: str, max_bytes: int) -> tuple[DataFrame, dict]:
    """The files of a run that fit a byte budget, and what was read and skipped.

    Files are taken in path order; one that does not fit is skipped and later ones
    are still tried. A first file over the budget is an error. The cluster goes through the listing in one
    ordered fold; the paths taken come back once, as the reader needs them to leave the other files alone.
    """
    fits = F.when(F.col("bytes") <= max_bytes, F.struct("path", "bytes"))
    nothing = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("taken"))

    def take(state: Column, file: Column) -> Column:
        used = state["used"] + file["bytes"]
        more = F.struct(used.alias("used"), F.array_append(state["taken"], file["path"]).alias("taken"))
        return F.when(used <= max_bytes, more).otherwise(state)

    listed = list_files(spark, prefix).agg(
        F.count("*").alias("n"), F.min(F.struct("path", "bytes")).alias("first"), F.array_sort(F.collect_list(fits)).alias("files"))
    found = listed.select("n", "first", F.aggregate("files", nothing, take).alias("s")).first()
    if not found["n"]:
        raise ValueError(f"No parquet files found under {prefix}")
    if found["first"]["bytes"] > max_bytes:
        raise ValueError(f"file {found['first']['path']} ({found['first']['bytes']} bytes) exceeds the budget of {max_bytes}")
    taken = found["s"]["taken"]
    skipped = found["n"] - len(taken)
    stats = {"files_read": len(taken), "files_skipped": skipped, "bytes_read": found["s"]["used"], "sampled": skipped > 0}
    return spark.read.option("mergeSchema", True).parquet(*taken), stats


def output_columns(spark: SparkSession, prefix: str) -> list[str]:
    """Column names of a run's output, from one file footer."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    try:
        return reader.parquet(prefix).columns
    except AnalysisException as e:
        raise ValueError(f"No parquet files found under {prefix}") from e


def union_outputs(outputs: list[DataFrame]) -> DataFrame:
    """Tables with different columns, one below the other; missing columns are NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), outputs)


def _pickle_in(file: BinaryIO, path: str) -> bytes:
    """The pickle in a file, or in the one member named ``model.pkl`` of a ``.tar.gz`` or ``.tgz``."""
    if not path.lower().endswith((".tar.gz", ".tgz")):
        return file.read()
    with tarfile.open(fileobj=file) as archive:
        models = [m for m in archive if m.isfile() and posixpath.basename(m.name) == "model.pkl"]
        if len(models) != 1:
            raise FileNotFoundError(f"{path}: {len(models)} members named model.pkl instead of one")
        return archive.extractfile(models[0]).read()


def read_model(spark: SparkSession, path: str) -> bytes:
    """The pickle at ``path``, see ``model_at``; for models that are small enough to be sent around."""
    files = spark.read.format("binaryFile").load(path).select("content").head(2)
    if len(files) != 1:
        raise FileNotFoundError(f"{path}: {len(files)} files instead of one")
    return _pickle_in(io.BytesIO(bytes(files[0]["content"])), path)


def model_at(spark: SparkSession, path: str) -> Callable[[], Any]:
    """A loader for ``scoring.score`` of the model at ``path``: a pickle, or an archive with one ``model.pkl``.

    Every executor fetches the file once from its place and each task opens it there, so its content never
    passes through the driver's memory or a table. File names must differ between models of a session. Pickles run code.
    """
    spark.sparkContext.addFile(path)
    name = posixpath.basename(path)

    def load() -> Any:
        with open(SparkFiles.get(name), "rb") as file:
            return pickle.loads(_pickle_in(file, path))

    return load
