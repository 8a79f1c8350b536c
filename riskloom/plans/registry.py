"""Registry of runnable queries: name -> (spark builder over an sf directory, DuckDB oracle SQL).

Every builder reads the driver's tables (through the fixture fact or directly) so its work grows
with the data; no builder runs on made-up input alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from riskloom import contract as K
from riskloom.plans import named_queries as Q
from riskloom.plans import oracles as O
from riskloom.session import materialise, stored_path
from riskloom.sources.fixture import complaint_fact


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    on_fact: Callable[[DataFrame], DataFrame] | None = None


def _on_fact(fn, store: bool = False, **kw):
    """Builder of a query over the fact. ``store``: for queries that read the fact in several jobs or branches, it is joined
    and aggregated from the raw tables once and stored (it is far smaller than the tables), instead of once for each."""

    def over_fact(fact: DataFrame) -> DataFrame:
        return fn(fact, **kw)

    def build(spark: SparkSession, sf_dir: str) -> DataFrame:
        fact = complaint_fact(spark, sf_dir)
        return over_fact(materialise(fact, "fact") if store else fact)

    build.__name__ = getattr(fn, "__name__", "query")
    build.over_fact = over_fact
    return build


REGISTRY: dict[str, Entry] = {}


def register(name: str, build, sql: str | None) -> None:
    """Register a query; builders made by ``_on_fact`` also expose the fact-level function, so a
    caller holding a materialised master table can run the query over it directly."""
    REGISTRY[name] = Entry(build, sql, getattr(build, "over_fact", None))


register("a1_volume_by_firm", _on_fact(Q.a1_volume_by_firm), O.SQL["a1_volume_by_firm"])
register("a2_period_on_period", _on_fact(Q.a2_period_on_period), O.SQL["a2_period_on_period"])
register("a3_fastest_growing", _on_fact(Q.a3_fastest_growing, min_first=K.FIXTURE_MIN_FIRST),
         O.SQL["a3_fastest_growing"])
register("a4_industry", _on_fact(Q.a4_industry), O.SQL["a4_industry"])
register("b1_category_volume", _on_fact(Q.b1_category_volume), O.SQL["b1_category_volume"])
register("b2_category_shift", _on_fact(Q.b2_category_shift), O.SQL["b2_category_shift"])
register("c1_upheld_ranked", _on_fact(Q.c1_upheld_ranked), O.SQL["c1_upheld_ranked"])
register("c2_rising_upheld", _on_fact(Q.c2_rising_upheld), O.SQL["c2_rising_upheld"])
register("c3_danger_quadrant", _on_fact(Q.c3_danger_quadrant), O.SQL["c3_danger_quadrant"])
register("c4_pre_post", _on_fact(Q.c4_pre_post), O.SQL["c4_pre_post"])
register("d1_resolution", _on_fact(Q.d1_resolution), O.SQL["d1_resolution"])
register("d2_resolution_duty", _on_fact(Q.d2_resolution_duty), O.SQL["d2_resolution_duty"])
register("k1_overview", _on_fact(Q.k1_overview), O.SQL["k1_overview"])
register("k2_danger_list", _on_fact(Q.k2_danger_list), O.SQL["k2_danger_list"])
register("k3_duty_shift", _on_fact(Q.k3_duty_shift), O.SQL["k3_duty_shift"])
register("k4_worsened", _on_fact(Q.k4_worsened), O.SQL["k4_worsened"])


# ------------------------------------------------------------------ master, marts, notebook, risk
from riskloom.operators.reshape import keep_first  # noqa: E402
from riskloom.functions.rules import classify  # noqa: E402
from riskloom.plans import dashboard as D  # noqa: E402
from riskloom.plans import incremental as IN  # noqa: E402
from riskloom.plans import master as M  # noqa: E402
from riskloom.plans import notebook as N  # noqa: E402
from riskloom.plans import oracles_marts as OM  # noqa: E402
from riskloom.plans import planted as PL  # noqa: E402
from riskloom.plans import risk as R  # noqa: E402
from riskloom.plans import sketches as SX  # noqa: E402
from riskloom.operators import stats as ST  # noqa: E402
from riskloom.sources import ragged as RG  # noqa: E402
from riskloom.sources import sheets as SH  # noqa: E402
from riskloom.sources import sinks as SK  # noqa: E402
from riskloom.sources.tables import read_table  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402


def _with_labels(fn):
    def over_fact(fact):
        return fn(fact, N.period_labels(fact))

    def build(spark, sf_dir):
        return over_fact(materialise(complaint_fact(spark, sf_dir), "fact"))

    build.over_fact = over_fact
    return build


_master = _on_fact(M.master_changes, store=True)


def _firm_slope(fact):
    rated = fact.filter(F.col(K.UPHELD_T).isNotNull())
    return ST.trend_slope(rated, [K.FIRM], K.ORDER, K.UPHELD_T)


def _firm_growth(fact):
    return ST.growth_pct(fact, [K.FIRM], K.ORDER, K.OPENED)


def _sheets_long(fact):
    cats = N.categories(fact)
    return SH.melt_sheets(SH.fixture_sheets(fact, cats, materialise=True), categories=cats)


def _unpivot_fact(fact):
    return SH.unpivot_long(_sheets_long(fact))


def _assemble_fact(fact):
    return SH.assemble_measures(_sheets_long(fact), SH.fact_manifest(fact)).drop(K.ROW_POS)


def _files_fact(fact):
    """The sheets written as CSV files, a folder for each measure and period with its own headers, and read back in one scan."""
    spark, cats = fact.sparkSession, N.categories(fact)
    sheets = []
    for measure, sheet in SH.fixture_sheets(fact, cats, materialise=True).items():
        path = stored_path(spark, f"csv-{measure}")
        sheet.write.partitionBy("source").option("header", True).csv(path)
        sheets += [RG.Sheet(label, measure, f"{path}/source={label}") for label in N.period_labels(fact)]
    rows, loose, typed = RG.read_sheets(spark, sheets, cats)
    return SH.assemble_stacked(rows, SH.fact_manifest(fact), loose, typed).drop(K.ROW_POS)


def _loads(fact):
    """Batches of a load history that ends at the fact: all but one period with another one restated, then these two as they are."""
    orders = sorted(r[0] for r in fact.select(K.ORDER).distinct().collect())  # one row a period
    middle, last = orders[len(orders) // 2], orders[-1]
    at = F.col(K.ORDER)
    restated = F.when(at == last, F.col(K.OPENED) + 5).otherwise(F.col(K.OPENED))
    return [fact.filter(at != middle).withColumn(K.OPENED, restated), fact.filter(at == middle), fact.filter(at == last)]


def _master_incremental(fact):
    path = stored_path(fact.sparkSession, "master-by-period")
    for batch in _loads(fact):
        IN.load_periods(fact.sparkSession, path, batch)
    return IN.read_loaded(fact.sparkSession, path)


def _risk_from_state(fact):
    path = stored_path(fact.sparkSession, "firm-state")
    for batch in _loads(fact):
        IN.load_state(fact.sparkSession, path, batch)
    return IN.risk_index_from_state(fact.sparkSession, path)


def _sector_sketches(fact):
    return SX.sketch_audit(materialise(SX.sketch_mart(fact), "sketch-mart"), fact, [K.TYPE])


def _master_csv(fact):
    spark, path = fact.sparkSession, stored_path(fact.sparkSession, "master-csv")
    SK.write_tables({"master": M.master_changes(fact)}, path, fmt="csv", compression="gzip")
    return SK.read_master(spark, f"{path}/master", fmt="csv")


def _committed_set(fact):
    """The summary tables committed as a set of the first regime, then as a set of all rows; what a reader sees in the end."""
    spark, path = fact.sparkSession, stored_path(fact.sparkSession, "summary-sets")
    for rows in (fact.filter(F.col(K.DUTY) == K.PRE_LABEL), fact):
        SK.commit_set({"category_summary": M.category_summary(rows), "period_totals": N.n1_period_totals(rows)}, path, spark)
    return SK.read_set(spark, path)["category_summary"]


_unpivot_sheets = _on_fact(_unpivot_fact, store=True)
_assemble = _on_fact(_assemble_fact, store=True)


def _dedup(spark, sf_dir):
    li = read_table(spark, sf_dir, "lineitem")
    rest = [c for c in li.columns if c not in ("l_orderkey", "l_linenumber")]
    return keep_first(li, ["l_orderkey", "l_linenumber"], rest)


def _classify_parts(spark, sf_dir):
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    return part.select("p_partkey", "p_name", classify("p_name", OM.PART_NAME_RULES, OM.PART_NAME_DEFAULT).alias("name_class"))


def _classify_many(spark, sf_dir):
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    return part.select("p_partkey", classify("p_name", OM.MANY_RULES, "none").alias("name_class"))


register("master_changes", _master, OM.SQL["master_changes"])
register("pivot_volume", _with_labels(M.pivot_volume), OM.SQL["pivot_volume"])
register("pivot_upheld", _with_labels(M.pivot_upheld), OM.SQL["pivot_upheld"])
register("category_summary", _on_fact(M.category_summary), OM.SQL["category_summary"])
register("period_totals", _on_fact(N.n1_period_totals), OM.SQL["period_totals"])
register("top15_firms", _on_fact(N.n2_top_firms), OM.SQL["top15_firms"])
register("box_summary_by_type", _on_fact(N.n3_box_by_type), OM.SQL["box_summary_by_type"])
register("category_pre_post_matrix", _on_fact(N.n4_category_pre_post), OM.SQL["category_pre_post_matrix"])
register("upheld_heat_matrix", _on_fact(N.n5_heat_matrix, store=True), OM.SQL["upheld_heat_matrix"])
register("median_quadrant", _on_fact(N.n6_median_quadrant), OM.SQL["median_quadrant"])
register("group_trajectory", _on_fact(N.n7_group_trajectory), OM.SQL["group_trajectory"])
register("group_trajectory_list", _on_fact(N.n7_group_trajectory, firms=OM.FIXTURE_FIRMS), OM.SQL["group_trajectory_list"])
register("firm_slope", _on_fact(_firm_slope), OM.SQL["firm_slope"])
register("firm_growth", _on_fact(_firm_growth), OM.SQL["firm_growth"])
register("risk_index", _on_fact(R.risk_index), OM.SQL["risk_index"])
register("risk_top15", _on_fact(lambda f: R.risk_table(R.risk_index(f), 15)), OM.SQL["risk_top15"])
register("type_pre_post", _on_fact(N.n9_type_pre_post), OM.SQL["type_pre_post"])
register("category_stack", _on_fact(N.n10_category_stack, store=True, cats=OM.FIXTURE_STACK), OM.SQL["category_stack"])
register("summary_totals", _on_fact(N.n11_summary), OM.SQL["summary_totals"])
register("exec_top12", _on_fact(D.exec_top_firms), OM.SQL["exec_top12"])
register("exec_sector_share", _on_fact(D.exec_sector_share), OM.SQL["exec_sector_share"])
register("firm_drilldown", _on_fact(D.firm_drilldown), OM.SQL["firm_drilldown"])
register("firm_page_one", _on_fact(D.firm_drilldown, firm=K.FIXTURE_FIRM), OM.SQL["firm_page_one"])
register("firm_category", _on_fact(D.firm_category), OM.SQL["firm_category"])
register("firm_category_one", _on_fact(D.firm_category, firm=K.FIXTURE_FIRM), OM.SQL["firm_category_one"])
register("diagonal_pairs", _on_fact(D.diagonal_pairs), OM.SQL["diagonal_pairs"])
register("findings_table", _on_fact(D.findings_table), OM.SQL["findings_table"])
register("unpivot_sheets", _unpivot_sheets, OM.SQL["unpivot_sheets"])
register("assemble_measures", _assemble, OM.SQL["assemble_measures"])
register("ingest_one_scan", _on_fact(_files_fact, store=True), OM.SQL["assemble_measures"])
register("dedup_keep_first", _dedup, OM.SQL["dedup_keep_first"])
register("classify_keywords", _classify_parts, OM.SQL["classify_keywords"])
register("classify_many_rules", _classify_many, OM.SQL["classify_many_rules"])
register("regime_records", _on_fact(N.regime_records), OM.SQL["regime_records"])
register("c2_rising_upheld_chronological", _on_fact(Q.c2_rising_upheld, mode="chronological"),
         OM.SQL["c2_rising_upheld_chronological"])
for _name in ("ingest_duplicates", "ingest_missing_group", "ingest_sheet_order", "name_rules"):
    register(_name, getattr(PL, _name), PL.SQL[_name])
register("master_incremental", _on_fact(_master_incremental, store=True), OM.SQL["master_changes"])
register("risk_index_state", _on_fact(_risk_from_state, store=True), OM.SQL["risk_index"])
register("sector_sketches", _on_fact(_sector_sketches, store=True), OM.SQL["sector_sketches"])
register("master_csv", _on_fact(_master_csv, store=True), OM.SQL["master_changes"])
register("committed_set", _on_fact(_committed_set, store=True), OM.SQL["category_summary"])
