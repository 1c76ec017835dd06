"""Run registered queries against their check SQL: python tests/run_checks.py [sf] [name-prefix ...]"""

import sys
import time

sys.path.insert(0, ".")
sys.path.insert(0, "tests")
import harness
from conftest import make_session

import __spark_entry__ as entry

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
only = sys.argv[2:]
sf_dir = f"/root/testdata/sf{sf}"
spark = make_session()
con = harness.connect(sf_dir)
queries, oracles = entry.queries(), entry.oracle_sql()
failed = 0
for name, fn in queries.items():
    if only and not any(name.startswith(p) for p in only):
        continue
    start = time.time()
    try:
        if name in oracles:
            problem, n = harness.compare(spark, con, fn, oracles[name], sf_dir)
            state = "ok" if problem is None else f"FAIL {problem}"
            failed += problem is not None
        else:
            n = len(fn(spark, sf_dir).collect())
            state = "rows-only"
    except Exception as e:  # report and go on
        n, state = -1, f"ERROR {type(e).__name__}: {str(e)[:1200]}"
        failed += 1
    print(f"{name:34s} {n:7d} rows {time.time() - start:6.2f}s  {state}", flush=True)
print("failed:", failed)
