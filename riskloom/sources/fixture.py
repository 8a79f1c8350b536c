"""The complaint fact derived from the driver's TPC-H-like tables (FIXTURES.md section 4).

lineitem x orders x customer x nation x part, grouped by customer, nation, part type and the
half-year of the ship date:

=====================  ==========================================================================
firm_name / firm_type  c_name / c_mktsegment;  firm_group = n_name
product_category       p_type
period                 'H<half> <year>', order (year - base_year) * 2 + half, Pre-Duty up to the
                       cutover order
complaints_opened      q = sum(l_quantity)
complaints_closed      f = sum(l_quantity) over lines with l_linestatus = 'F'
upheld_tenths          null if q < 15, else round-half-up(1000 * u / q), u = returned ('R') quantity
closed3_tenths         the same with f
=====================  ==========================================================================

Plan shape (what matters at 100 TB): lineitem is joined to orders and part on their keys (the two
unavoidable lineitem-sized shuffles, planned as sort-merge or, under AQE, broadcast when a side is
measured small), then aggregated once by (o_custkey, p_type, year, half) with map-side partial
aggregation *before* the customer join, so customer and nation only meet the aggregate and add
attributes (the customer name labels one customer key; the master's keep-first dedup enforces the
firm grain downstream). A hot customer (a third of all lines) is spread over its type x period
groups and reduced by the partial aggregation; after it, no key holds more than types x periods
rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import idiv, tenths_to_pct
from riskloom.sources.tables import read_table


def _tenths(part: F.Column, total: F.Column, min_volume: int) -> F.Column:
    # round-half-up of 1000 * part / total, in integers
    return F.when(total >= F.lit(min_volume), idiv(part * F.lit(2000) + total, total * F.lit(2)))


def complaint_fact(
    spark: SparkSession,
    sf_dir: str,
    base_year: int = K.FIXTURE_BASE_YEAR,
    cutover_order: int = K.FIXTURE_CUTOVER_ORDER,
    min_volume: int = K.FIXTURE_MIN_VOLUME,
) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_partkey",
        "l_quantity",
        (F.col("l_linestatus") == "F").alias("is_f"),
        (F.col("l_returnflag") == "R").alias("is_r"),
        (F.year("l_shipdate") * 2 + F.when(F.month("l_shipdate") <= 6, F.lit(0)).otherwise(F.lit(1))).alias("halves"),
    )
    orders = read_table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    part = read_table(spark, sf_dir, "part", ["p_partkey", "p_type"])
    customer = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_nationkey"])
    nation = read_table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])

    per_customer = (
        li.join(orders, li.l_orderkey == orders.o_orderkey)
        .join(part, li.l_partkey == part.p_partkey)
        .groupBy("o_custkey", "p_type", "halves")
        .agg(
            F.sum("l_quantity").alias("q"),
            F.sum(F.when(F.col("is_f"), F.col("l_quantity")).otherwise(F.lit(0.0))).alias("f"),
            F.sum(F.when(F.col("is_r"), F.col("l_quantity")).otherwise(F.lit(0.0))).alias("u"),
        )
    )
    agg = (
        per_customer.join(customer, per_customer.o_custkey == customer.c_custkey)
        .join(nation, customer.c_nationkey == nation.n_nationkey)
        .select(
            F.col("c_name").alias(K.FIRM),
            F.col("c_mktsegment").alias(K.TYPE),
            F.col("n_name").alias(K.GROUP),
            F.col("p_type").alias(K.CAT),
            idiv("halves", F.lit(2)).cast("int").alias("year"),
            F.coalesce(F.col("halves") % 2 + 1, F.lit(2)).alias("half"),
            F.col("q").cast("bigint").alias("q"),
            F.col("f").cast("bigint").alias("f"),
            F.col("u").cast("bigint").alias("u"),
        )
    )
    order = (F.col("year") - F.lit(base_year)) * 2 + F.col("half")
    h1 = F.col("half") == 1
    return agg.select(
        K.FIRM,
        K.TYPE,
        K.GROUP,
        K.CAT,
        F.col("year").cast("int").alias("year"),
        F.col("half").cast("int").alias("half"),
        F.concat(F.lit("H"), F.col("half").cast("string"), F.lit(" "), F.col("year").cast("string")).alias(K.LABEL),
        order.cast("int").alias(K.ORDER),
        F.make_date("year", F.when(h1, 1).otherwise(7), F.lit(1)).alias("period_start"),
        F.make_date("year", F.when(h1, 6).otherwise(12), F.when(h1, 30).otherwise(31)).alias("period_end"),
        F.when(order <= cutover_order, F.lit(K.PRE_LABEL)).otherwise(F.lit(K.POST_LABEL)).alias(K.DUTY),
        F.col("q").alias(K.OPENED),
        F.col("f").cast("double").alias(K.CLOSED),
        _tenths(F.col("u"), F.col("q"), min_volume).alias(K.UPHELD_T),
        _tenths(F.col("f"), F.col("q"), min_volume).alias(K.CLOSED3_T),
    ).select("*", tenths_to_pct(K.UPHELD_T).alias(K.UPHELD), tenths_to_pct(K.CLOSED3_T).alias(K.CLOSED3))
