"""Stored counts of scored runs, from which reports are made without the rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from scorewatch.sources.runs import read_or_none

_PART = r"[A-Za-z0-9_.-]+"


def add_cells(cells: DataFrame, path: str, part: str) -> None:
    """Keep the cells of a part of the scored rows, say a run or a day.

    Adding a part again replaces it, so a job that is repeated counts nothing twice. Parts may
    hold different rows of the same run. Different parts may be written at the same time.
    """
    if not re.fullmatch(_PART, part):
        raise ValueError(f"'{part}' cannot name a part")
    cells.write.mode("overwrite").parquet(f"{path}/part={part}")


def read_cells(spark: SparkSession, path: str) -> DataFrame | None:
    """All cells kept so far, or None before the first ones."""
    found = read_or_none(spark, path)
    return None if found is None else found.drop("part")
