"""Compare registered queries with their SQL oracles, or time them.

usage: python scripts/check.py [--sf sf0.01] [--time] [name-part ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

import workloads  # noqa: E402
from parcelwise.session import build_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)):
        f = float(v)
        return repr(f + 0.0) if f != 0 else "0.0"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canon(r[i]) for i in order) for r in rows)


def main() -> int:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="sf0.01")
    ap.add_argument("--time", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    sf_dir = f"/root/testdata/{a.sf}"
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
           "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    workloads.load_all()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    bad = 0
    for name, fn in workloads.QUERIES.items():
        if a.names and not any(n in name for n in a.names):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir)
            got = [tuple(r) for r in df.collect()]
            cols, mine = rows_of(df.columns, got)
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: spark {type(e).__name__}: {str(e)[:1500]}", flush=True)
            bad += 1
            continue
        t1 = time.time()
        sql = workloads.ORACLES.get(name)
        if sql is None or a.time:
            print(f"ROWS {name}: {len(mine)} rows {t1 - t0:.2f}s", flush=True)
            continue
        try:
            rel = con.execute(sql)
            ocols, oracle = rows_of([d[0] for d in rel.description], rel.fetchall())
        except Exception as e:  # noqa: BLE001
            print(f"FAIL {name}: duckdb {str(e)[:800]}", flush=True)
            bad += 1
            continue
        t2 = time.time()
        if cols != ocols or mine != oracle:
            bad += 1
            print(f"DIFF {name}: {len(mine)} vs {len(oracle)} rows {t1 - t0:.2f}s", flush=True)
            if cols != ocols:
                print("  columns", cols, ocols)
            else:
                only = sorted(set(mine) - set(oracle))[:4], sorted(set(oracle) - set(mine))[:4]
                print("  columns", cols)
                for side, rows in zip(("spark ", "duckdb"), only):
                    for r in rows:
                        print("  ", side, str(r)[:600])
        else:
            print(f"ok   {name}: {len(mine)} rows spark {t1 - t0:.2f}s duckdb {t2 - t1:.2f}s", flush=True)
    print("bad:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
