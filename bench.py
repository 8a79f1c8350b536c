"""Benchmark: build the master fact once, then time every registered query over it.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Prints one JSON line: {"metric", "value" (sum of warm per-query seconds), "unit", "queries",
"cold", "ingest_sec", "sf", ...}. Each query is executed with the ``noop`` sink (full plan
evaluation, nothing collected); cold = first run, warm = median of the next runs.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from riskloom import contract as K  # noqa: E402
from riskloom.plans.registry import REGISTRY  # noqa: E402
from riskloom.session import get_spark  # noqa: E402
from riskloom.sources.fixture import complaint_fact  # noqa: E402
from riskloom.sources.sinks import save_bucketed  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    warm_runs = int(os.environ.get("BENCH_WARM_RUNS", "2"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    scratch = tempfile.mkdtemp(prefix="riskloom-bench-")
    partitions = max(cpus, 8)
    spark = get_spark(
        master=f"local[{cpus}]",
        shuffle_partitions=partitions,
        conf={
            "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
            "spark.sql.warehouse.dir": os.path.join(scratch, "warehouse"),
            "spark.checkpoint.dir": os.path.join(scratch, "checkpoints"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    # ingest: derive the fact from the raw tables and store it bucketed by firm (the master table)
    t0 = time.perf_counter()
    fact = save_bucketed(complaint_fact(spark, sf_dir), "complaints", buckets=partitions)
    ingest = time.perf_counter() - t0
    fact_rows = fact.count()

    cold: dict[str, float] = {}
    warm: dict[str, float] = {}
    for name, entry in REGISTRY.items():
        if only and name not in only:
            continue

        def build():
            return entry.on_fact(fact) if entry.on_fact is not None else entry.build(spark, sf_dir)

        times = []
        for _ in range(1 + warm_runs):
            t = time.perf_counter()
            run(build())
            times.append(time.perf_counter() - t)
        cold[name] = round(times[0], 3)
        warm[name] = round(statistics.median(times[1:]) if len(times) > 1 else times[0], 3)

    sf_match = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "sum_warm_query_seconds",
        "value": round(sum(warm.values()), 3),
        "unit": "sec",
        "queries": warm,
        "cold": cold,
        "ingest_sec": round(ingest, 3),
        "fact_rows": fact_rows,
        "sf": float(sf_match.group(1)) if sf_match else sf_dir,
        "cpus": cpus,
        "shuffle_partitions": partitions,
        "fixture": {"base_year": K.FIXTURE_BASE_YEAR, "cutover_order": K.FIXTURE_CUTOVER_ORDER},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
