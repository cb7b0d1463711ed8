"""Run registered queries against their DuckDB oracles: ``python check.py [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

from tagstream.plans import catalog  # noqa: F401
from tagstream.plans.compare import compare, duck
from tagstream.plans.registry import ORACLE, QUERIES
from tagstream.session import drop_scratch, get_spark


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or sorted(QUERIES)
    spark = get_spark("local[8]")
    con = duck(sf_dir)
    bad = 0
    for n in names:
        t0 = time.time()
        try:
            df = QUERIES[n](spark, sf_dir)
            if n in ORACLE:
                ok, msg = compare(df, con, ORACLE[n])
            else:
                ok, msg = True, f"rows-only: {df.count()} rows"
        except Exception as e:  # report and continue
            ok, msg = False, f"error: {type(e).__name__}: {str(e)[:400]}"
        drop_scratch(spark)
        bad += 0 if ok else 1
        print(f"{'OK ' if ok else 'BAD'} {n:32s} {time.time() - t0:6.1f}s  {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
