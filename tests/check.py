"""Compare registered queries with their SQL twins in DuckDB.

usage: python tests/check.py [sf] [name-prefix ...]
"""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET threads TO 4")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    rows = []
    for row in df.itertuples(index=False, name=None):
        rows.append(tuple(_cell(v) for v in row))
    return sorted(rows, key=repr)


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (float, np.floating)):
        return None if np.isnan(v) else (int(v) if float(v).is_integer() else float(v))
    if isinstance(v, (int, np.integer)):
        return int(v)
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v


def compare(spark_df: pd.DataFrame, oracle_df: pd.DataFrame) -> str | None:
    if sorted(spark_df.columns) != sorted(oracle_df.columns):
        return f"columns differ: {sorted(spark_df.columns)} vs {sorted(oracle_df.columns)}"
    if len(spark_df) != len(oracle_df):
        return f"row counts differ: {len(spark_df)} vs {len(oracle_df)}"
    a, b = canonical(spark_df), canonical(oracle_df)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)} of {len(a)} rows differ; cols {sorted(spark_df.columns)}\n   spark  {bad[0][0]}\n   oracle {bad[0][1]}"
    return None


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(8), connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if prefixes and not any(name == p or name.startswith(p + "_") for p in prefixes):
            continue
        start = time.time()
        try:
            got = fn(spark, sf_dir).toPandas()
            took = time.time() - start
            if name in oracles:
                want = con.execute(oracles[name]).df()
                problem = compare(got, want)
            else:
                problem = None if len(got) else "no rows"
            label = "ok  " if problem is None else "FAIL"
            kind = "sql" if name in oracles else "rows"
            print(f"{label} {name:28s} {kind:4s} {len(got):7d} rows {took:6.2f}s {problem or ''}", flush=True)
            failed += problem is not None
        except Exception as e:  # noqa: BLE001
            failed += 1
            text = str(e).strip().split("\n")
            print(f"ERR  {name:28s} {type(e).__name__}: {' | '.join(text[:3])[:700]}", flush=True)
            if len(prefixes) == 1:
                traceback.print_exc()
    print(f"{failed} problems")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main()))
