"""Run registered queries against their SQL twins: ``check_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from logloom.plans import registry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if isinstance(v, float):
            v = round(v, 6)
            return repr(v + 0.0)
        return repr(v) if not isinstance(v, (list, tuple)) else repr([norm(x) for x in v])

    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, con, name, run, sql, sf_dir):
    started = time.time()
    df = run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    spent = time.time() - started
    if sql is None:
        return f"rows-only {len(got)}", spent, len(got) > 0
    cur = con.execute(sql)
    cols = [x[0] for x in cur.description]
    want = cur.fetchall()
    if sorted(cols) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(cols)}", spent, False
    a, b = canonical(got, df.columns), canonical(want, cols)
    if a != b:
        only_a = [x for x in a if x not in set(b)][:2]
        only_b = [x for x in b if x not in set(a)][:2]
        return f"rows {len(a)} vs {len(b)}\n   cols  {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}", spent, False
    return f"ok {len(a)}", spent, len(a) > 0


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    runs, sqls = registry.queries(), registry.oracle_sql()
    bad = 0
    for name in runs:
        if wanted and not any(name == w or name.startswith(w.rstrip("*")) and w.endswith("*") for w in wanted):
            continue
        try:
            text, spent, fine = compare(spark, con, name, runs[name], sqls.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            text, spent, fine = f"{type(e).__name__}: {str(e)[:1200]}", 0.0, False
        bad += not fine
        if not fine or not os.environ.get("QUIET"):
            print(f"{'  ' if fine else '! '}{name:24s} {spent:6.2f}s {text}", flush=True)
    print(f"{bad} problems")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
