"""Run all queries against their SQL: python tests/check_all.py [sf_dir] [name ...]"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_point  # noqa: E402
from folioscope.runtime import build_session  # noqa: E402
from tests.compare import compare, connect  # noqa: E402


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    queries, checks = entry_point.queries(), entry_point.oracle_sql()
    spark, con = build_session("check", "8"), connect(sf_dir)
    bad = 0
    for name in argv[1:] or sorted(queries):
        started = time.time()
        try:
            if name in checks:
                problems = compare(spark, con, sf_dir, queries[name], checks[name])
            else:
                problems = [] if queries[name](spark, sf_dir).count() else ["no rows"]
        except Exception as error:  # report and go on
            problems = [f"{type(error).__name__}: {str(error)[:600]}"]
        bad += bool(problems)
        print(f"{'FAIL' if problems else 'ok  '} {name} {time.time() - started:.1f}s {'' if name in checks else '(rows only)'}", flush=True)
        for problem in problems:
            print("     ", problem, flush=True)
    print(f"{bad} of {len(argv[1:] or queries)} failed")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]) and 1)
