"""Plan checks: no Python UDFs, pruned and filtered scans, no single-partition window over the
fact, bucketed master reads without shuffles."""

import re

import pytest

from riskloom.plans import named_queries as Q
from riskloom.plans.registry import REGISTRY
from riskloom.sources.fixture import complaint_fact
from riskloom.sources.sinks import save_bucketed
from tests.conftest import SF_SMALL


def plan_text(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", list(REGISTRY))
def test_no_python_udf_and_no_cartesian_in_any_query(spark, name):
    text = plan_text(REGISTRY[name].build(spark, SF_SMALL))
    assert "BatchEvalPython" not in text and "ArrowEvalPython" not in text and "PythonUDF" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_lineitem_scan_is_pruned(spark):
    fact = complaint_fact(spark, SF_SMALL)
    text = fact._jdf.queryExecution().executedPlan().toString()
    # only the seven lineitem columns the fact needs are read
    assert "l_extendedprice" not in text and "l_discount" not in text and "l_suppkey" not in text


def test_filter_pushed_to_scan(spark):
    from pyspark.sql import functions as F

    from riskloom.sources.tables import read_table

    df = read_table(spark, SF_SMALL, "lineitem").filter(F.col("l_quantity") > 40).select("l_orderkey")
    text = plan_text(df)
    assert "PushedFilters" in text and "GreaterThan(l_quantity,40.0)" in text


def test_quartiles_avoid_single_partition_exchange(spark, small_fact):
    """The only single-partition exchange may carry the per-slice counts (one row per range
    partition), never firm rows."""
    lines = plan_text(Q.c3_danger_quadrant(small_fact)).splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert "keys=[__rl_pid" in lines[i + 1], lines[i : i + 3]


def test_bucketed_master_needs_no_shuffle_for_firm_aggregates(spark, small_fact):
    master = save_bucketed(small_fact, "complaints_bucketed_test", buckets=4)
    text = master.groupBy("firm_name", "firm_type").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text


MULTI_PASS = [
    "master_changes", "pivot_volume", "pivot_upheld", "upheld_heat_matrix", "category_stack", "summary_totals", "findings_table",
    "unpivot_sheets", "assemble_measures",
]


@pytest.mark.parametrize("name", MULTI_PASS)
def test_the_raw_tables_are_joined_once(spark, name, monkeypatch):
    """The fact is built once and stored: no later job or branch scans lineitem again."""
    from riskloom.plans import registry

    calls = []
    monkeypatch.setattr(registry, "complaint_fact", lambda *a: calls.append(1) or complaint_fact(*a))
    text = plan_text(REGISTRY[name].build(spark, SF_SMALL))
    assert len(calls) == 1 and "l_orderkey" not in text


def test_fact_pass_of_the_risk_base_is_a_hash_aggregate(spark):
    from riskloom.plans.risk import risk_base
    from tests.conftest import fact_rows

    fact = fact_rows(spark, [("A", "Bank", "x", 1, 5, 100)])
    deepest = [x for x in plan_text(risk_base(fact)).split("\n") if "Aggregate(" in x][-1]
    assert "HashAggregate" in deepest and "period_order" in deepest


def test_duplicates_of_an_ingest_are_fetched_late(spark):
    """No aggregate carries the wide rows: the first place of each key is found by a hash aggregate."""
    text = plan_text(REGISTRY["ingest_duplicates"].build(spark, SF_SMALL))
    assert "SortAggregate" not in text and "LeftSemi" in text


def test_findings_read_the_fact_once(spark, small_fact, monkeypatch):
    from riskloom.plans import dashboard

    seen, base = [], dashboard.regime_base
    monkeypatch.setattr(dashboard, "regime_base", lambda f: seen.append(f) or base(f))
    text = plan_text(dashboard.findings_table(small_fact))
    assert len(seen) == 1 and "product_category" not in text and "upheld_tenths" not in text


def scanned_rows(df) -> tuple[str, int]:
    """The buckets that the scan of an executed query was pruned to, and the rows that it gave."""
    df.collect()
    execution = df._jdf.queryExecution()
    plan = execution.executedPlan()
    plan = plan.finalPhysicalPlan() if "AdaptiveSparkPlan" in plan.nodeName() else plan
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    buckets = re.search(r"SelectedBucketsCount: (\d+ out of \d+)", execution.explainString(mode))
    return buckets[1] if buckets else "", plan.collectLeaves().head().metrics().apply("numOutputRows").value()


def test_a_firm_lookup_reads_one_bucket_and_skips_row_groups_by_bloom_filter(spark, small_fact):
    """Rows in random order within a bucket and no dictionary, so neither least and greatest values nor dictionaries can skip a row
    group: a firm that is not there costs all rows of its bucket without bloom filters and none with them."""
    from pyspark.sql import functions as F

    from riskloom.plans.dashboard import firm_drilldown

    mixed = small_fact.withColumn("mix", F.xxhash64("firm_name", "product_category", "period_order"))
    spark.conf.set("parquet.enable.dictionary", "false")  # read by the writer, as a hadoop setting of the session
    try:
        for name, ndv in (("lookup_plain", None), ("lookup_bloom", 10_000)):
            save_bucketed(mixed, name, 4, sort_by=("mix",), bloom_ndv=ndv)
    finally:
        spark.conf.unset("parquet.enable.dictionary")
    firms = sorted(r[0] for r in small_fact.select("firm_name").distinct().collect())
    firm = firms[len(firms) // 2]
    lookup = lambda n: spark.table(n).filter(F.col("firm_name") == firm + "-absent").select("firm_name", "period_order")
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # the plan then tells the buckets that it read
    try:
        plain, bloom = scanned_rows(lookup("lookup_plain")), scanned_rows(lookup("lookup_bloom"))
    finally:
        spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert plain[0] == bloom[0] == "1 out of 4"
    assert plain[1] > 0 and bloom[1] == 0
    there = spark.table("lookup_bloom")
    assert sorted(map(str, firm_drilldown(there, firm).collect())) == sorted(map(str, firm_drilldown(small_fact, firm).collect()))


def test_the_master_moves_its_wide_rows_once(spark, small_fact):
    """Dedup, changes and record ids share one exchange by slices of firms (before: one each, and a join by firm)."""
    from riskloom.plans import master as M
    from riskloom.session import materialise

    text = plan_text(M.master_changes(materialise(small_fact, "fact"))).split("Initial Plan")[-1]
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text


def test_a_csv_export_of_the_master_moves_its_wide_rows_once(spark, small_fact, monkeypatch):
    from riskloom.plans import registry

    texts, write = [], registry.SK.write_tables
    monkeypatch.setattr(registry.SK, "write_tables", lambda t, *a, **k: texts.append(plan_text(t["master"])) or write(t, *a, **k))
    registry._master_csv(small_fact.cache())
    assert texts[0].split("InMemoryTableScan")[0].count("Exchange hashpartitioning") == 1


def test_slices_of_the_master_follow_its_rows(spark, monkeypatch):
    """A task sorts one slice of bounded size, however few shuffle partitions there are (before: as many slices as these)."""
    from riskloom.plans import master as M
    from tests.conftest import fact_rows

    rows = [(f"f{k // 6:03}", "t", f"c{k % 3}", 1 + k % 2, k, k) for k in range(2400)]
    fact = fact_rows(spark, [*rows, *rows[::7]]).cache()
    want = sorted(map(str, M.master_changes(fact).collect()))
    assert len(want) == len(rows)
    monkeypatch.setattr(M, "SLICE_ROWS", 100)
    many = M.master_changes(fact)
    text = plan_text(many).split("InMemoryTableScan")[0]
    assert text.count("Exchange") == 1
    sizes = [n for n in many.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(sizes) > 2 * 8 and max(sizes) <= 300 and sum(sizes) == len(rows)
    assert sorted(map(str, many.collect())) == want


def test_a_csv_export_of_the_master_is_compressed(spark, small_fact):
    from riskloom.plans import registry

    assert all(f.endswith(".csv.gz") for f in registry._master_csv(small_fact.cache()).inputFiles())
