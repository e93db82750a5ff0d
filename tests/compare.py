"""Run queries at one scale against their SQL in DuckDB: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb
import pandas as pd


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{src}')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
            return "[" + ",".join(one(x) for x in v) + "]"
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return "∅"
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return f"{float(v):.9g}"
        return str(v)

    cols = sorted(df.columns)
    return sorted(tuple(one(v) for v in row) for row in df[cols].astype(object).itertuples(index=False, name=None))


def matches(spark, con, query, sql: str, sf_dir: str) -> str:
    """Empty when equal, else what differs."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:3], [x for x in b if x not in set(a)][:3]
    return f"{len(a)} rows and {len(b)}; only Spark {only_a}; only SQL {only_b}"


if __name__ == "__main__":
    from treeline.plans.session import local_session
    import __spark_entry__ as entry

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = local_session("8"), connect(sf)
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            why = matches(spark, con, queries[name], oracle[name], sf) if name in oracle else f"no SQL; {queries[name](spark, sf).count()} rows"
        except Exception as e:
            why = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{name}: {why or 'equal'} ({time.time() - began:.1f} s)", flush=True)
