"""Development check: run registered queries against DuckDB. Usage: check.py [sf] [name-part ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]
from compare import connect, diff  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from dossier.session import local_session  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
parts = sys.argv[2:]
folder = f"/root/testdata/sf{sf}"
spark = local_session(cores="8")
spark.sparkContext.setLogLevel("ERROR")
con, sql = connect(folder), entry.oracle_sql()
bad = 0
for name, run in entry.queries().items():
    if parts and not any(p in name for p in parts):
        continue
    t = time.time()
    try:
        df = run(spark, folder)
        if name in sql:
            problem, n = diff(df, con, sql[name])
        else:
            problem, n = None, len(df.collect())
    except Exception as exc:  # noqa: BLE001
        problem, n = f"{type(exc).__name__}: {str(exc)[:1500]}", -1
    bad += problem is not None
    print(f"{'FAIL' if problem else 'ok  '} {name:32s} rows={n:<7d} {time.time() - t:6.2f}s {'' if name in sql else '(no oracle)'} {problem or ''}", flush=True)
print("failures:", bad)
