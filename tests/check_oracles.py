"""Run queries next to their SQL in DuckDB: ``python tests/check_oracles.py [sf] [name prefix ...]``."""

from __future__ import annotations

import decimal
import os
import sys
import time
import uuid

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean", "DATE": "date"}


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute(f"SET temp_directory = '/tmp/checkpoints/duckdb-{uuid.uuid4().hex}'")
    con.execute("SET max_temp_directory_size = '8GB'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6) + 0.0
    return str(v)


def normalized(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str | None):
    """None when both sides agree, else a description of the difference."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    cur = con.execute(sql)
    types = dict(df.dtypes)
    wrong = {d[0]: (types.get(d[0]), str(d[1])) for d in cur.description if TYPES.get(str(d[1])) != types.get(d[0])}
    if wrong:
        return f"types differ: {wrong}"
    want_cols, want = normalized([d[0] for d in cur.description], cur.fetchall())
    got_cols, got = normalized(df.columns, rows)
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}: {sorted(set(got) - set(want), key=repr)[:2]} / {sorted(set(want) - set(got), key=repr)[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{got_cols}: {str(g)[:300]} != {str(w)[:300]}"
    return None


def session():
    from pyspark.sql import SparkSession

    return (SparkSession.builder.master("local[8]").appName("twinfold-check")
            .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
            .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
            .config("spark.sql.session.timeZone", "UTC")
            .config("spark.checkpoint.dir", f"/tmp/checkpoints/check-{uuid.uuid4().hex}").getOrCreate())


def main() -> int:
    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = f"/root/testdata/sf{args[0]}" if args else "/root/testdata/sf0.01"
    spark, con, bad = session(), connect(sf_dir), 0
    spark.sparkContext.setLogLevel("ERROR")
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if args[1:] and not any(name.startswith(a) for a in args[1:]):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, fn, oracles.get(name))
        except Exception as err:  # report and go on
            problem = f"{type(err).__name__}: {str(err)[:600]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {time.time() - start:.1f}s"
              f"{'' if name in oracles else ' (rows only)'} {problem or ''}", flush=True)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
