"""Session helpers: local sessions for tests, shared scratch space, size checks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", app: str = "scorewatch") -> SparkSession:
    """A small session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix=f"{app}-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # do not look up the calling line for every column expression
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder path under the shared folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting (not one of ``local_session``) gets a folder on this machine.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder all executors share")
        base = tempfile.mkdtemp(prefix="scorewatch-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """Write one small file to any store that Spark reaches."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
    try:
        out.write(bytearray(content))
    finally:
        out.close()


def table_bytes(df: DataFrame) -> int:
    """Size of a table's rows, taken from their JSON text, by one distributed aggregation."""
    fixed = 16 + 8 * len(df.columns)
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long") + fixed)
    return df.agg(F.coalesce(size, F.lit(0)).alias("n")).first()["n"]
