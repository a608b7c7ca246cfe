"""Run registered queries next to their SQL and compare the rows.

    python tests/compare.py [folder] [name-prefix ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402
from scorewatch.session import local_session  # noqa: E402


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return repr(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def sql_rows(folder: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], [str(d[1]) for d in cur.description], cur.fetchall()


def difference(spark, folder: str, name: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = entry.queries()[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name not in entry.oracle_sql():
        return None if got else "no rows"
    columns, types, want = sql_rows(folder, entry.oracle_sql()[name])
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    kinds = {"long": "BIGINT", "integer": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    by_name = dict(zip(columns, types))
    wrong = [f"{f.name}: {f.dataType.typeName()} / {by_name[f.name]}" for f in df.schema.fields
             if kinds.get(f.dataType.typeName(), by_name[f.name]) != by_name[f.name]]
    a, b = rows_of(df.columns, got), rows_of(columns, want)
    if not got:
        return "no rows"
    if a != b:
        only_a, only_b = [r for r in a if r not in set(b)][:3], [r for r in b if r not in set(a)][:3]
        return f"{len(a)} / {len(b)} rows; spark only {only_a}; sql only {only_b}"
    return f"types {wrong}" if wrong else None


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session(8)
    bad = 0
    for name in entry.queries():
        if len(sys.argv) > 2 and not any(name.startswith(p) for p in sys.argv[2:]):
            continue
        start = time.time()
        try:
            problem = difference(spark, folder, name)
        except Exception as e:
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}", flush=True)
    print("bad:", bad)
