"""Run registered queries against their SQL on one scale folder and compare the rows.

    python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import math
import sys
import tempfile
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (int, float)) or hasattr(v, "as_integer_ratio"):
        f = float(v)
        if math.isnan(f):
            return "nan"
        return repr(f + 0.0)
    return str(v)


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canon(r[i]) for i in order) for r in rows)


def compare(spark, con, fn, sql: str | None, sf_dir: str) -> str:
    t = time.time()
    df = fn(spark, sf_dir)
    got = df.collect()
    took = time.time() - t
    if sql is None:
        return f"ROWS {len(got)} ({took:.1f}s)"
    t = time.time()
    rel = con.execute(sql)
    cols = [c[0] for c in rel.description]
    want = rel.fetchall()
    sql_took = time.time() - t
    if sorted(cols) != sorted(df.columns):
        return f"FAIL columns {sorted(df.columns)} vs {sorted(cols)}"
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    note = f"{len(a)} rows ({took:.1f}s, sql {sql_took:.1f}s)"
    if a == b:
        return f"OK {note}"
    only_a = sorted(set(a) - set(b))[:3]
    only_b = sorted(set(b) - set(a))[:3]
    return f"FAIL {note} sql {len(b)} rows; {sorted(cols)}\n   spark {only_a}\n   sql   {only_b}"


def main() -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='stages-')}")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in names or queries:
        try:
            verdict = compare(spark, con, queries[name], oracles.get(name), sf_dir)
        except Exception as error:  # report and go on
            verdict = f"ERROR {type(error).__name__}: {str(error)[:600]}"
        bad += not verdict.startswith(("OK", "ROWS"))
        print(f"{name}: {verdict}", flush=True)
    print(f"{bad} bad of {len(names or queries)}")
    return bad


if __name__ == "__main__":
    sys.path.insert(0, ".")
    sys.exit(1 if main() else 0)
