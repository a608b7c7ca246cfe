"""Run this subpackage's queries on a folder: python tests/llm/run.py [folder] [name-prefix ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]

from compare import rows_of, sql_rows  # noqa: E402
from scorewatch.llm.queries import ORACLE, QUERIES  # noqa: E402
from scorewatch.session import local_session  # noqa: E402

if __name__ == "__main__":
    folder = sys.argv[1]
    spark = local_session(8)
    for name, fn in QUERIES.items():
        if any(name.startswith(p) for p in sys.argv[2:]):
            start = time.time()
            df = fn(spark, folder)
            rows = df.collect()
            said = ""
            if name in ORACLE:
                columns, _, want = sql_rows(folder, ORACLE[name])
                said = "equal" if rows_of(df.columns, rows) == rows_of(columns, want) else "DIFFERENT"
            print(name, len(rows), f"{time.time() - start:.1f}s", said, rows[:2], flush=True)
