"""Compare registered queries with their SQL in DuckDB; usable as a script: oracle.py SF_DIR [names]."""

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry_module  # noqa: E402


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def _rows(columns: list[str], rows: list) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_normal(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def compare(spark, con, sf_dir: str, name: str) -> str | None:
    """None when rows, columns and values agree, else what differs."""
    df = entry_module.queries()[name](spark, sf_dir)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    cursor = con.execute(entry_module.oracle_sql()[name])
    want_cols, want = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    differing = [(g, w) for g, w in zip(got, want) if g != w]
    if differing:
        return f"{len(differing)} of {len(got)} rows differ, first {differing[0]}"
    types = [(type(a).__name__, type(b).__name__) for g, w in zip(got, want) for a, b in zip(g, w) if a is not None and b is not None and type(a) is not type(b)]
    return f"types differ: {sorted(set(types))}" if types else None


if __name__ == "__main__":
    from txrisk.session import local_session

    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sys.argv[1])
    names = sys.argv[2:] or list(entry_module.queries())
    for n in names:
        t = time.time()
        try:
            result = compare(spark, con, sys.argv[1], n) if n in entry_module.oracle_sql() else f"no SQL, {entry_module.queries()[n](spark, sys.argv[1]).count()} rows"
        except Exception as e:  # noqa: BLE001
            result = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'ok' if result is None else 'FAIL':4} {n} {time.time() - t:.1f}s {result or ''}", flush=True)
