"""The three stages of the original application as Spark jobs, for users switching over.

* ``clean_stage``: period sheet files -> master (changes, flags, bands) + the summary tables;
* ``sql_stage``: the twelve named analyses and the findings table, one output each;
* ``notebook_stage``: the chart datasets and the saved risk table.

Stages hand over through storage (the master table), exactly like the original's files, but each
stage is one lazy plan per output; nothing is collected.

    python -m riskloom.plans.stages clean    --input <sheets dir> --out <dir>
    python -m riskloom.plans.stages sql      --master <dir>/master --out <dir>/sql_outputs
    python -m riskloom.plans.stages notebook --master <dir>/master --out <dir>/notebook
"""

from __future__ import annotations

import argparse
import os
from functools import cache, partial

from pyspark.sql import DataFrame, SparkSession

from riskloom import contract as K
from riskloom.plans import dashboard as D
from riskloom.plans import incremental as IN
from riskloom.plans import master as M
from riskloom.plans import named_queries as Q
from riskloom.plans import notebook as N
from riskloom.plans import risk as R
from riskloom.session import materialise
from riskloom.sources import sheets as SH
from riskloom.sources import sinks as SK

SQL_OUTPUTS = {
    "a1_volume_by_firm": Q.a1_volume_by_firm,
    "a2_period_on_period": Q.a2_period_on_period,
    "a3_fastest_growing": Q.a3_fastest_growing,
    "a4_industry": Q.a4_industry,
    "b1_category_volume": Q.b1_category_volume,
    "b2_category_shift": Q.b2_category_shift,
    "c1_upheld_ranked": Q.c1_upheld_ranked,
    "c2_rising_upheld": Q.c2_rising_upheld,
    "c3_danger_quadrant": Q.c3_danger_quadrant,
    "c4_pre_post": Q.c4_pre_post,
    "d1_resolution": Q.d1_resolution,
    "d2_resolution_duty": Q.d2_resolution_duty,
}


def summary_tables(master: DataFrame, labels: list[str] | None = None) -> dict[str, DataFrame]:
    """The four named tables of the cleaning export (the multi-sheet workbook, as tables)."""
    labels = labels if labels is not None else N.period_labels(master)
    return {
        "all_data": master,
        "volume_by_firm_x_period": M.pivot_volume(master, labels),
        "upheld_by_firm_x_period": M.pivot_upheld(master, labels),
        "category_summary": M.category_summary(master),
    }


def clean_stage(spark: SparkSession, sheets_dir: str, out_dir: str, manifest=K.PERIOD_MANIFEST,
                pre_periods=K.PRE_DUTY_PERIODS, categories=K.PRODUCT_CATS, alias_map=None,
                table: str | None = None, buckets: int = 0, csv_export: bool = False, bloom_ndv: int | None = None) -> str:
    """Build and store the master, then the summary tables.

    With ``table`` and ``buckets`` the master is also saved as a catalog table bucketed by firm -
    the layout the analyses should read at scale (per-firm aggregations and windows then need no
    shuffle; ``bloom_ndv`` adds bloom filters for lookups of one firm); the Parquet folder partitioned by period stays the portable export, and ``csv_export`` adds the master
    as CSV. The other stages read any of the three (:func:`read_stage_master`).
    """
    # read several times (first rows, numbering): the sheets are scanned and assembled once
    assembled = materialise(SH.load_workbooks(spark, sheets_dir, manifest, pre_periods, categories, alias_map=alias_map), "assembled")
    master_path = os.path.join(out_dir, "master")
    SK.write_master(M.master_changes(assembled), master_path)
    master = SK.read_master(spark, master_path)
    if csv_export:
        SK.write_tables({"master_csv": master}, out_dir, fmt="csv")
    if table and buckets:
        master = SK.save_bucketed(master, table, buckets, bloom_ndv=bloom_ndv)
    SK.write_tables({k: v for k, v in summary_tables(master).items() if k != "all_data"}, out_dir)
    return master_path


def load_stage(spark: SparkSession, batch: DataFrame, out_dir: str) -> dict[str, str]:
    """Load the periods of ``batch`` (assembled rows) into the stored master and the state of firms, then commit the summary tables
    and the risk index anew as one set; return its tables' folders."""
    master, state = os.path.join(out_dir, "master_by_period"), os.path.join(out_dir, "firm_state")
    batch = materialise(M.first_rows(batch), "batch")
    IN.load_periods(spark, master, batch)
    IN.load_state(spark, state, batch)
    tables = {k: v for k, v in summary_tables(IN.read_stored(spark, master)).items() if k != "all_data"}
    SK.commit_set(tables | {"risk_index": lambda: IN.risk_index_from_state(spark, state)}, out_dir, spark)
    return SK.current_set(spark, out_dir)


def read_stage_master(spark: SparkSession, master_path: str | None = None, table: str | None = None, fmt: str = "parquet") -> DataFrame:
    """The master that a stage reads: the (bucketed) catalog table if one is named, else the Parquet or CSV folder."""
    if table:
        return spark.table(table)
    if not master_path:
        raise ValueError("name the master's folder or table")
    return SK.read_master(spark, master_path, fmt)


def sql_stage(spark: SparkSession, master_path: str | None, out_dir: str, min_first: int = K.MIN_FIRST_VOLUME,
              table: str | None = None, fmt: str = "parquet") -> list[str]:
    """The named analyses and the findings; one that fails does not stop the others (``sinks.run_queries``)."""
    master = SK.register_view(read_stage_master(spark, master_path, table, fmt))
    kw = {Q.a3_fastest_growing: {"min_first": min_first}}
    outputs = {name: partial(fn, master, **kw.get(fn, {})) for name, fn in SQL_OUTPUTS.items()}
    return SK.run_queries(outputs | {"findings_table": partial(D.findings_table, master)}, out_dir)


def notebook_stage(spark: SparkSession, master_path: str | None, out_dir: str, alias_map=K.NAME_ALIASES,
                   table: str | None = None, fmt: str = "parquet", stack_order=K.CATEGORY_STACK) -> list[str]:
    from riskloom.functions.rules import unify_names

    df = unify_names(read_stage_master(spark, master_path, table, fmt), alias_map)
    risk = cache(lambda: R.risk_index(df))
    outputs = {
        "period_totals": lambda: N.n1_period_totals(df),
        "top15_firms": lambda: N.n2_top_firms(df),
        "box_summary_by_type": lambda: N.n3_box_by_type(df),
        "category_pre_post_matrix": lambda: N.n4_category_pre_post(df),
        "upheld_heat_matrix": lambda: N.n5_heat_matrix(df),
        "median_quadrant": lambda: N.n6_median_quadrant(df),
        "group_trajectory": lambda: N.n7_group_trajectory(df, K.GROUP_SUBSIDIARIES),
        "risk_top20": lambda: R.risk_table(risk(), 20),
        "type_pre_post": lambda: N.n9_type_pre_post(df),
        "category_stack": lambda: N.n10_category_stack(df, stack_order),
        "risk_top15": lambda: R.risk_table(risk(), 15),
        "summary_totals": lambda: N.n11_summary(df, risk=risk()),
    }
    return SK.run_queries(outputs, out_dir)


def main(argv=None) -> None:
    from riskloom.session import drop_stored, get_spark

    ap = argparse.ArgumentParser(prog="python -m riskloom.plans.stages")
    ap.add_argument("stage", choices=["clean", "sql", "notebook"])
    ap.add_argument("--input")
    ap.add_argument("--master")
    ap.add_argument("--out", required=True)
    ap.add_argument("--table", help="catalog table of the master, bucketed by firm (clean: written, else: read)")
    ap.add_argument("--buckets", type=int, default=0, help="clean: number of buckets of --table")
    ap.add_argument("--csv", action="store_true", help="clean: also export the master as CSV; else: --master is a CSV folder")
    a = ap.parse_args(argv)
    spark = get_spark()
    if a.stage == "clean":
        print(clean_stage(spark, a.input, a.out, table=a.table, buckets=a.buckets, csv_export=a.csv))
    else:
        stage = sql_stage if a.stage == "sql" else notebook_stage
        print("\n".join(stage(spark, a.master, a.out, table=a.table, fmt="csv" if a.csv else "parquet")))
    drop_stored(spark)


if __name__ == "__main__":
    main()
