"""Run named queries next to their SQL: python tests/llm/run_query.py sf_dir name ..."""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from oracle_check import check, duck, session  # noqa: E402

from hitgauge.llm.queries import QUERIES  # noqa: E402
from hitgauge.llm.queries_sql import ORACLES  # noqa: E402

if __name__ == "__main__":
    spark, con = session(), duck(sys.argv[1])
    for name in sys.argv[2:] or QUERIES:
        start = time.time()
        found = check(spark, con, sys.argv[1], QUERIES[name], ORACLES.get(name))
        print(name, found, round(time.time() - start, 1), flush=True)
        QUERIES[name](spark, sys.argv[1]).show(5, truncate=60)
