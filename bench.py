"""Time every registered query and print one JSON line.

BENCH_SF_DIR   input tables (default /root/testdata/sf0.1)
BENCH_CPUS     cores of the local session (default: all)
BENCH_QUERIES  comma-separated names (default: all)
BENCH_DUCKDB   set to 1 to time the SQL of each query in DuckDB as well
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from jobruns.plans.catalog import QUERIES  # noqa: E402
from jobruns.plans.oracle import ORACLE  # noqa: E402
from jobruns.session import local_session  # noqa: E402


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(QUERIES)
    spark = local_session("bench", cpus, shuffle_partitions=int(cpus))
    for name in ("runs_by_status", "ready_now"):
        run(QUERIES[name], spark, sf_dir)
    seconds = {name: run(QUERIES[name], spark, sf_dir) for name in names}
    line = {
        "metric": "total_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": Path(sf_dir).name.removeprefix("sf"),
    }
    if os.environ.get("BENCH_DUCKDB") == "1":
        from tests.compare import database

        con = database(sf_dir)
        con.execute(f"SET threads = {cpus}")
        line["duckdb"] = {}
        for name in names:
            start = time.perf_counter()
            con.execute(ORACLE[name]).fetchall()
            line["duckdb"][name] = round(time.perf_counter() - start, 3)
    print(json.dumps(line))


if __name__ == "__main__":
    main()
