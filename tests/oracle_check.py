"""Run queries() and oracle_sql() side by side, as the driver does.

Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import time

sys.path.insert(0, __file__.rsplit("/tests/", 1)[0])

import duckdb  # noqa: E402

import __spark_entry__ as E  # noqa: E402
from fathom.session import build_session  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6)
    if hasattr(v, "isoformat"):
        return v.isoformat(sep=" ") if hasattr(v, "hour") else v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if v is not None and not isinstance(v, (int, str, bool)):
        return str(v)
    return v


def main():
    args = [a for a in sys.argv[1:] if a != "--vanilla"]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    only = set(args[1:])
    if "--vanilla" in sys.argv:
        # a plain session, as the driver may create it: none of our settings
        from pyspark.sql import SparkSession
        spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
                 .config("spark.sql.shuffle.partitions", "8").getOrCreate())
        spark.sparkContext.setLogLevel("ERROR")
    else:
        spark = build_session("local[8]")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    qs, sqls = E.queries(), E.oracle_sql()
    bad = 0
    for name, fn in qs.items():
        if only and name not in only:
            continue
        t0 = time.time()
        try:
            sdf = fn(spark, sf_dir)
            cols = sdf.columns
            srows = [tuple(norm(r[c]) for c in sorted(cols)) for r in sdf.collect()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark error {str(e)[:800]}")
            bad += 1
            continue
        ts = time.time() - t0
        if name not in sqls:
            print(f"rows {name}: {len(srows)} rows (no oracle) {ts:.1f}s")
            continue
        try:
            rel = con.sql(sqls[name])
            ocols = rel.columns
            orows = [tuple(norm(dict(zip(ocols, r))[c]) for c in sorted(ocols)) for r in rel.fetchall()]
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: oracle error {str(e)[:800]}")
            bad += 1
            continue
        if sorted(cols) != sorted(ocols):
            print(f"FAIL {name}: columns {sorted(cols)} vs {sorted(ocols)}")
            bad += 1
            continue
        a, b = sorted(srows, key=repr), sorted(orows, key=repr)
        if a != b:
            bad += 1
            print(f"FAIL {name}: rows spark={len(a)} oracle={len(b)}")
            sa, sb = set(a), set(b)
            for r in list(sa - sb)[:3]:
                print("   spark only ", r)
            for r in list(sb - sa)[:3]:
                print("   oracle only", r)
        else:
            print(f"ok   {name}: {len(a)} rows {ts:.1f}s")
    print("failures:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
