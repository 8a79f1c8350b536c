"""Physical-plan facts per registered query over the bucketed master (markdown table on stdout).

    python tools/plan_report.py [--sf-dir /root/testdata/sf0.1]
"""

from __future__ import annotations

import argparse
import json
import os
import re
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plans_by_query(folder: str) -> dict[str, list[str]]:
    """Final physical plans of all SQL executions by their job description, from the event log."""
    owner: dict[int, str] = {}
    last: dict[int, str] = {}
    for file in os.listdir(folder):
        with open(os.path.join(folder, file), errors="replace") as lines:
            for line in lines:
                if "physicalPlanDescription" not in line:
                    continue
                e = json.loads(line)
                k = e["executionId"]
                if "description" in e:
                    owner[k] = e["description"]
                last[k] = e["physicalPlanDescription"].split("== Initial Plan ==")[0]
    out: dict[str, list[str]] = {}
    for k, text in last.items():
        out.setdefault(owner.get(k, ""), []).append(text.split("\n\n")[0])
    return out


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf-dir", default="/root/testdata/sf0.1")
    args = ap.parse_args()
    from riskloom.plans.registry import REGISTRY
    from riskloom.session import get_spark
    from riskloom.sources.fixture import complaint_fact
    from riskloom.sources.sinks import save_bucketed

    scratch = tempfile.mkdtemp(prefix="riskloom-plans-")
    log = os.path.join(scratch, "events")
    os.makedirs(log)
    spark = get_spark(master="local[8]", shuffle_partitions=8, conf={
        "spark.sql.warehouse.dir": os.path.join(scratch, "wh"), "spark.checkpoint.dir": os.path.join(scratch, "ck"),
        "spark.eventLog.enabled": "true", "spark.eventLog.dir": log, "spark.eventLog.rolling.enabled": "false",
        "spark.eventLog.compress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    fact = save_bucketed(complaint_fact(spark, args.sf_dir), "complaints", buckets=8)
    for name, e in REGISTRY.items():
        spark.sparkContext.setJobDescription(name)
        df = e.on_fact(fact) if e.on_fact else e.build(spark, args.sf_dir)
        df.write.format("noop").mode("overwrite").save()
    spark.stop()
    found = plans_by_query(log)
    print("| query | SQL executions | shuffle exchanges | broadcasts | sort-merge joins | sort aggregates | python UDF |")
    print("|---|---|---|---|---|---|---|")
    for name in REGISTRY:
        plans = found.get(name, [])
        count = lambda pattern: sum(len(re.findall(pattern, p)) for p in plans)
        udf = count(r"BatchEvalPython|ArrowEvalPython")
        print(f"| {name} | {len(plans)} | {count(r'(?<!Broadcast)(?<!Reused)Exchange ?')} | {count('BroadcastExchange')} | "
              f"{count('SortMergeJoin')} | {count('SortAggregate')} | {'yes' if udf else 'no'} |")


if __name__ == "__main__":
    main()
