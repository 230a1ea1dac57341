"""Run registered queries next to their SQL in the other engine and compare."""

from __future__ import annotations

import math
import sys
import time

import duckdb

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(sf_dir):
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"create view {b} as select * from read_parquet('{sf_dir}/{b}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


def compare(spark, con, sf_dir, fn, sql):
    """None when equal, else what differs."""
    df = fn(spark, sf_dir)
    cols = sorted(df.columns)
    got = [tuple(norm(v) for v in r) for r in df.select(*cols).collect()]
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    types = [str(d[1]) for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} / {sorted(names)}"
    at = [names.index(c) for c in cols]
    want = [tuple(norm(r[i]) for i in at) for r in res.fetchall()]
    if not got and not want:
        return "both empty"
    if len(got) != len(want):
        return f"rows {len(got)} / {len(want)}"
    key = lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r)
    for g, w in zip(sorted(got, key=key), sorted(want, key=key)):
        if g != w:
            return f"{cols}\n  got  {g}\n  want {w}"
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    kinds = dict(df.dtypes)
    off = [f"{c}: {kinds[c]}/{types[i]}" for c, i in zip(cols, at) if same.get(kinds[c]) != types[i].upper().replace("NUMBER", types[i])]
    return f"types {off}" if off else None


def session(cpus=8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as e

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark, con = session(), duck(sf)
    q, o = e.queries(), e.oracle_sql()
    bad = 0
    for n in names or q:
        t0 = time.time()
        try:
            msg = compare(spark, con, sf, q[n], o.get(n))
        except Exception as ex:  # report and go on
            msg = f"{type(ex).__name__}: {str(ex)[:700]}"
        bad += msg is not None
        print(f"{'ok ' if msg is None else 'BAD'} {n} {time.time() - t0:.2f}s {'' if n in o else '(rows only)'} {msg or ''}", flush=True)
    print("bad:", bad)
