"""Compare registered queries with their SQL: ``python tests/check.py [sf_dir] [name part ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import harness  # noqa: E402
from conftest import local_session  # noqa: E402

import __spark_entry__ as entry_point  # noqa: E402


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:]
    spark, con = local_session(), harness.duck(sf_dir)
    sqls, bad = entry_point.oracle_sql(), 0
    for name, fn in entry_point.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        started = time.time()
        try:
            if name in sqls:
                problem = harness.compare(fn(spark, sf_dir), con, sqls[name])
                size = con.execute(f"select count(*) from ({sqls[name]})").fetchall()[0][0]
            else:
                size, problem = fn(spark, sf_dir).count(), None
            if not problem and not size:
                problem = "no rows"
        except Exception as error:  # noqa: BLE001 - report and go on
            size, problem = -1, f"{type(error).__name__}: {str(error)[:700]}"
        bad += bool(problem)
        mark = "BAD " if problem else ("ok  " if name in sqls else "rows")
        print(f"{mark} {name} {time.time() - started:.2f}s n={size} {problem or ''}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
