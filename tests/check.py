"""Run registered queries against the checking SQL: check.py [sf_dir] [name prefix ...]"""

import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

import compare  # noqa: E402
from session import make_session  # noqa: E402

import __spark_entry__ as entry  # noqa: E402


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    prefixes = sys.argv[2:]
    spark = make_session()
    con = compare.connect(sf)
    bad = []
    oracle = entry.oracle_sql()
    for name, build in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = build(spark, sf)
            if name in oracle:
                msg = compare.difference(df, con, oracle[name])
            else:
                n = df.count()
                msg = None
                name += f" (rows only: {n})"
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{'ok  ' if msg is None else 'FAIL'} {time.time() - t:6.2f}s {name}" +
              ("" if msg is None else f"\n     {msg}"), flush=True)
        if msg:
            bad.append(name)
    print(f"{len(bad)} failed: {bad}")


if __name__ == "__main__":
    main()
