"""Run all or the named registered queries against DuckDB: python tests/run_oracle.py [name ...]"""

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import oracle  # noqa: E402

import __spark_entry__ as e  # noqa: E402
from sparkprep.session import local_session  # noqa: E402

spark = local_session(8)
con = oracle.connect()
queries, sql = e.queries(), e.oracle_sql()
bad = 0
for name in sys.argv[1:] or queries:
    start = time.time()
    try:
        df = queries[name](spark, oracle.FOLDER)
        found = oracle.differences(df, con, sql[name]) if name in sql else []
        note = "" if name in sql else f"rows only: {df.count()}"
    except Exception as error:  # noqa: BLE001
        found, note = [f"{type(error).__name__}: {str(error)[:600]}"], ""
    bad += bool(found)
    print(f"{'BAD' if found else 'ok '} {name} {time.time() - start:.1f}s {note} {found or ''}", flush=True)
print(f"{bad} bad")
