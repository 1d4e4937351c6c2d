"""Run registered queries against their oracles: check_oracles.py [sf] [name prefix ...]"""

import os
import sys
import time

sys.path[:0] = [os.path.dirname(os.path.dirname(os.path.abspath(__file__))), os.path.dirname(os.path.abspath(__file__))]

import oracle

import __spark_entry__ as entry
from cipherledger.session import local_session

sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
prefixes = tuple(sys.argv[2:])
folder = f"/root/testdata/sf{sf}"
spark = local_session("8")
spark.sparkContext.setLogLevel("ERROR")
con = oracle.connect(folder)
sqls = entry.oracle_sql()
bad = 0
for name, plan in entry.queries().items():
    if prefixes and not name.startswith(prefixes):
        continue
    t = time.time()
    try:
        if name in sqls:
            ok, note = oracle.compare(spark, con, folder, plan, sqls[name])
        else:
            ok, note = True, f"{plan(spark, folder).count()} rows, no oracle"
    except Exception as e:
        ok, note = False, f"{type(e).__name__} {str(e)[:600]}"
    bad += not ok
    print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - t:.2f}s {note}", flush=True)
print("failures:", bad)
