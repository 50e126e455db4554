"""Run registered queries against their SQL oracles: ``python tests/compare.py [keys]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings"
          " pages benchmark labels conversations").split()


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted((tuple(r[i] for i in order) for r in cur.fetchall()), key=repr)


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def main(argv):
    import __spark_entry__ as entry
    from tidemark import session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = session.build("local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false",
        "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    keys = [k for k in queries if not argv or any(a in k for a in argv)]
    bad = []
    for key in keys:
        t0 = time.time()
        try:
            got = spark_rows(queries[key](spark, sf_dir))
        except Exception as e:  # noqa: BLE001
            print(f"{key}: SPARK ERROR {str(e)[:1500]}", flush=True)
            bad.append(key)
            continue
        took = time.time() - t0
        if key not in oracles:
            print(f"{key}: {len(got[1])} rows, no oracle ({took:.1f}s)", flush=True)
            continue
        t0 = time.time()
        try:
            want = oracle_rows(con, oracles[key])
        except Exception as e:  # noqa: BLE001
            print(f"{key}: ORACLE ERROR {str(e)[:1500]}", flush=True)
            bad.append(key)
            continue
        same = got == want
        print(f"{key}: {'ok' if same else 'DIFF'} {len(got[1])}/{len(want[1])} rows"
              f" (spark {took:.1f}s, oracle {time.time() - t0:.1f}s)", flush=True)
        if not same:
            bad.append(key)
            if got[0] != want[0]:
                print("  columns", got[0], want[0])
            else:
                left, right = set(got[1]), set(want[1])
                print("  cols ", got[0])
                for r in sorted(left - right, key=repr)[:3]:
                    print("  spark ", r)
                for r in sorted(right - left, key=repr)[:3]:
                    print("  oracle", r)
    print("BAD:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
