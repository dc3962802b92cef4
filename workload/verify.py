"""Run queries next to their SQL in DuckDB and compare rows: ``python -m workload.verify [names]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from workload import all_queries, all_sql

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal, else what differs. Values must be exactly equal."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    got, want = canonical(got), canonical(want)
    for c in got.columns:
        a, b = got[c], want[c]
        same = (a == b) | (a.isna() & b.isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, first {a[i]!r} != {b[i]!r}"
        if a.dtype != b.dtype:
            return f"{c}: type {a.dtype} != {b.dtype}"
    return None


def main(names: list[str]) -> int:
    from tests.session import make_session
    sf_dir = os.environ.get("VERIFY_SF_DIR", "/root/testdata/sf0.01")
    spark = make_session()
    con = connect(sf_dir)
    queries, sql = all_queries(), all_sql()
    bad = 0
    for name in names or queries:
        start = time.time()
        try:
            got = queries[name](spark, sf_dir).toPandas()
            if name in sql:
                problem = difference(got, con.execute(sql[name]).df())
            else:
                problem = None if len(got) else "no rows"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
            got = []
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:28s} rows={len(got):7d} "
              f"{time.time() - start:6.2f}s {'' if name in sql else '(rows only) '}{problem or ''}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
