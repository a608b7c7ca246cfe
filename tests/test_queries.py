"""Every registered query against its SQL at the smallest scale, and facts about plans."""

import pytest

import __spark_entry__ as entry
from compare import difference
from scorewatch.operators import quality
from scorewatch.plans import catalog
from scorewatch.plans import views as v
from scorewatch.plans.views import Tables

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, name):
    assert difference(spark, SMALL, name) is None


def test_every_query_has_sql():
    assert set(catalog.ORACLE) == set(catalog.QUERIES)
    assert set(catalog.QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_a_report_reads_the_scored_rows_once(spark, tmp_path):
    t = Tables(spark, SMALL)
    tables = {"scored": v.scored(t), "manifest": v.run_manifest(t), "base": v.baselines(t)}
    for name, df in tables.items():
        df.write.parquet(str(tmp_path / name))
    stored = [spark.read.parquet(str(tmp_path / name)) for name in tables]
    report = quality.dq_report(*stored, inspect=v.inspected())
    report.collect()
    # the plan text cuts paths, but not the columns read: only the scored table has l_quantity
    final = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    read = [line.split("ReadSchema")[1] for line in final.splitlines() if "FileScan" in line and "ReadSchema" in line]
    scored = [columns for columns in read if "l_quantity" in columns]
    assert len(scored) == 1 and "l_shipdate" not in scored[0]
