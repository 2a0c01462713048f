"""Run registered queries next to their SQL and compare: python tests/compare.py [sf] [name ...]"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def session(cpus: str = "8"):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("eqpanel")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def plain(v):
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


def key(row):
    return tuple((v is None, str(type(v)), v if not isinstance(v, (tuple, bool)) else str(v)) for v in row)


def compare(df, sql: str, con) -> str | None:
    """None when rows agree, else what differs."""
    cols = sorted(df.columns)
    got = [tuple(plain(r[c]) for c in cols) for r in df.collect()]
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    if sorted(names) != cols:
        return f"columns {cols} vs {sorted(names)}"
    order = [names.index(c) for c in cols]
    want = [tuple(plain(r[i]) for i in order) for r in rel.fetchall()]
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    got.sort(key=key), want.sort(key=key)
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        diff = [(c, a, b) for c, a, b in zip(cols, *bad[0]) if a != b]
        return f"{len(bad)}/{len(got)} rows differ, first: {bad[0][0][:4]} {diff[:5]}"
    types = {c: type(next((r[i] for r in got if r[i] is not None), None)).__name__ for i, c in enumerate(cols)}
    want_types = {c: type(next((r[i] for r in want if r[i] is not None), None)).__name__ for i, c in enumerate(cols)}
    return None if types == want_types else f"types {types} vs {want_types}"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def main(argv):
    from eqpanel.plans.catalog import ORACLES, QUERIES

    sf = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    names = [n for n in QUERIES if any(n.startswith(a) for a in argv[1:])] if argv[1:] else list(QUERIES)
    spark, con = session(), connect(sf_dir)
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = QUERIES[n].run(spark, sf_dir)
            doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
            if doubles != set(QUERIES[n].digits):
                print(f"  {n}: double columns {doubles ^ set(QUERIES[n].digits)} not declared")
            if n in ORACLES:
                res = compare(df, ORACLES[n], con)
            else:
                res = None if df.count() >= 0 else "?"
            extra = f" rows={df.count()}" if n in ORACLES else " (no SQL)"
        except Exception as e:  # report and go on
            res, extra = f"{type(e).__name__}: {str(e)[:1500]}", ""
        failed += res is not None
        print(f"{'ok  ' if res is None else 'FAIL'} {n} {time.time() - t:.1f}s{extra} {res or ''}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
