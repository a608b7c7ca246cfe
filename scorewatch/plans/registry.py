"""Registry of queries: a Spark plan over the given tables and SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewatch.plans.sql_views import with_views
from scorewatch.plans.views import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register ``fn(tables)`` under ``name``; ``views`` names the SQL views ``sql`` uses."""
    def register(fn: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = with_views(views.split(), sql)
        return fn
    return register


def iso(ts: str | Column) -> Column:
    """A timestamp as text, for results only."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def joined(items: str | Column) -> Column:
    """An array of texts as one text."""
    return F.array_join(items, ",")
