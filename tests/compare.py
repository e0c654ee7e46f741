"""Run registered queries against their SQL in DuckDB: python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _canonical(df: pd.DataFrame) -> pd.DataFrame:
    """Columns by name, every value as text, rows in order."""

    def show(v) -> str:
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "<null>"
        if isinstance(v, (pd.Timestamp,)) or hasattr(v, "isoformat"):
            return pd.Timestamp(v).isoformat()
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype"):
            return repr(float(v))
        return str(v)

    df = df[sorted(df.columns)]
    out = pd.DataFrame({c: [show(v) for v in df[c]] for c in df.columns})
    return out.sort_values(list(out.columns), ignore_index=True) if len(out) else out


def difference(spark_df, con, sql: str) -> str | None:
    left, right = spark_df.toPandas(), con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}"
    kinds = {c: (str(left[c].dtype)[:3], str(right[c].dtype)[:3]) for c in left.columns}
    a, b = _canonical(left), _canonical(right)
    if not a.equals(b):
        bad = (a != b).any(axis=1)
        return f"{int(bad.sum())} rows differ, first:\n{a[bad].head(3)}\n{b[bad].head(3)}"
    odd = {c: k for c, k in kinds.items() if k[0] != k[1]}
    return f"(types {odd})" if odd else None


def main() -> None:
    from jobruns.plans.catalog import QUERIES
    from jobruns.plans.oracle import ORACLE
    from jobruns.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    names = sys.argv[2:] or list(QUERIES)
    spark, con = local_session(), database(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            n = None
            if name in ORACLE:
                problem = difference(df, con, ORACLE[name])
            else:
                n = df.count()
                problem = None
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None and not problem.startswith("(types")
        print(f"{name:28s} {time.time() - start:6.2f}s {'ok' if problem is None else problem} {n if n is not None else ''}", flush=True)
    print("without SQL:", [n for n in QUERIES if n not in ORACLE], "failed:", bad)


if __name__ == "__main__":
    main()
