"""Run registered queries in Spark and their SQL oracle in DuckDB; compare.

usage: python tools/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/tools/", 1)[0])

from contrail.plans.registry import oracle_sql, queries  # noqa: E402
from contrail.session import local_session  # noqa: E402

from tests._compare import duck, rows_of  # noqa: E402


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 and sys.argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in sys.argv[1:] if not a.startswith("/")]
    spark = local_session("oracle-check")
    con = duck(sf_dir)
    qs, sqls = queries(), oracle_sql()
    bad = 0
    for name in (names or sorted(qs)):
        t0 = time.time()
        try:
            df = qs[name](spark, sf_dir)
            srows = [tuple(r) for r in df.collect()]
            scols = df.columns
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {type(e).__name__}: {str(e)[:400]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            res = con.execute(sqls[name])
            dcols = [d[0] for d in res.description]
            drows = res.fetchall()
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb error {str(e)[:400]}")
            bad += 1
            continue
        a, b = rows_of(scols, srows), rows_of(dcols, drows)
        ok = sorted(scols) == sorted(dcols) and a == b
        if ok:
            print(f"ok   {name}: {len(a)} rows {ts:.1f}s")
        else:
            bad += 1
            print(f"FAIL {name}: spark {len(a)} rows cols={scols}; duck {len(b)} rows cols={dcols}")
            sa, sb = set(a), set(b)
            for r in list(sa - sb)[:3]:
                print("   spark-only", r)
            for r in list(sb - sa)[:3]:
                print("   duck-only ", r)
    print("mismatches:", bad)


if __name__ == "__main__":
    main()
