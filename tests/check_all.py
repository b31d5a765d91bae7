"""Compare all (or the named) queries with their SQL: python -m tests.check_all SF [names]."""

import sys
import traceback

from areascope.queries import QUERIES
from areascope.session import local_session
from tests.compare import compare, connect

if __name__ == "__main__":
    folder = f"/root/testdata/{sys.argv[1]}"
    names = sys.argv[2:] or list(QUERIES)
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    good = 0
    for name in names:
        try:
            verdict, seconds, n = compare(spark, con, name, folder)
        except Exception:
            verdict, seconds, n = "FAILED " + traceback.format_exc(limit=2)[-1500:], 0, 0
        good += verdict in ("ok", "rows only")
        print(f"{name:24s} {seconds:6.2f}s {n:7d} {verdict}", flush=True)
    print(f"{good}/{len(names)}")
