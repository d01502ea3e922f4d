"""Compare registered queries with their SQL in DuckDB, exactly as values.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def session():
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


SPARK_SECONDS: dict[str, float] = {}


def _plain(v):
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    return v


def _table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(body, key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, name: str, run, sql: str | None, sf_dir: str) -> str:
    """Empty when the two agree, else what differs."""
    df = run(spark, sf_dir)
    t = time.time()
    got = _table(df.columns, df.collect())
    SPARK_SECONDS[name] = time.time() - t
    if sql is None:
        return "" if got[1] else "no rows"
    cur = con.execute(sql)
    want = _table([c[0] for c in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} != {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"rows {len(got[1])} != {len(want[1])}"
    bad = [(g, w) for g, w in zip(got[1], want[1]) if g != w]
    return f"{len(bad)} of {len(got[1])} rows differ, e.g.\n   {bad[0][0]}\n   {bad[0][1]}" if bad else ""


def main(argv: list[str]) -> int:
    from barloom import catalog

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    spark, con = session(), database(sf_dir)
    all_queries = catalog.load()
    failed = []
    for name in argv[2:] or all_queries:
        q = all_queries[name]
        t = time.time()
        try:
            problem = compare(spark, con, name, q, q.oracle, sf_dir)
        except Exception as e:  # report and go on
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        mark = "rows-only" if q.oracle is None else "oracle"
        print(f"{'FAIL' if problem else 'ok  '} {name:28s} {time.time() - t:6.2f}s (collect {SPARK_SECONDS.get(name, 0):.2f}s) {mark} {problem}", flush=True)
        if problem:
            failed.append(name)
    print(f"{len(failed)} failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
