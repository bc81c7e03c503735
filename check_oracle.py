"""Run registered queries against their DuckDB oracle: python check_oracle.py [sf_dir] [names…]"""

import json
import os
import sys
import time

from tagspace.catalog import ORACLE, QUERIES
from tagspace.plans.compare import compare, duck_connect
from tagspace.session import local_session

if __name__ == "__main__":
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(os.environ.get("CHECK_CPUS", "8"))
    con = duck_connect(sf_dir)
    bad = 0
    for n in names:
        t = time.time()
        try:
            res = compare(spark, sf_dir, QUERIES[n], ORACLE.get(n), duck_connect(sf_dir))
        except Exception as e:  # report and go on
            res = {"error": repr(e)[:600]}
        res["sec"] = round(time.time() - t, 2)
        ok = res.get("ok", "rows" if "error" not in res else False)
        bad += ok is False
        print(n, json.dumps(res, default=str), flush=True)
    print("FAILED", bad)
