"""Queries over the driver's tables with the irregularities of real report files planted: duplicate rows, missing group columns,
unusable names, shuffled sheets, company-name tokens. They run the ingest operators on whole tables; the DuckDB side restates the
expected outcome.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.rules import classify, replace_chain, unify_names
from riskloom.plans import master as M
from riskloom.session import materialise
from riskloom.sources import sheets as SH
from riskloom.sources.tables import read_table

CATS = (K.PRODUCT_CATS[0], K.PRODUCT_CATS[2])
FIRMS = 400  # customers share this many firm names, so every firm has duplicates
SHEETS = ("Opened", "% closed within 3 days", "Closed", "% Upheld", "Notes")
#: Texts put behind customer names: tokens of the name rules and of the firm-type keywords.
SUFFIXES = (" Limited", " Insurance Services PLC", " Barclays Plc", " LV= Saga", " Aviva Life", " MBNA Limited", " AJ Bell", "")


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"])
    key = F.col("c_custkey")
    firm = F.concat(F.lit("Firm "), (key % FIRMS).cast("string"))
    padded = F.concat(F.lit(" "), firm, F.lit(" "))
    return c.select(
        key.alias(K.ROW_POS),
        F.when(key % 50 == 0, F.lit(None).cast("string")).when(key % 50 == 1, F.lit(" nan ")).when(key % 50 == 2, F.lit("  "))
        .when(key % 3 == 0, padded).otherwise(firm).alias("Firm Name"),
        F.when(key % 7 == 0, F.lit(None).cast("string")).otherwise(F.col("c_mktsegment")).alias("Group"),
        F.abs(F.col("c_acctbal")).cast("bigint").alias("amount"), F.col("c_nationkey").alias("nation"), (key % 11).alias("eleventh"),
    )


def _sheet(rows: DataFrame, group: bool, first, second) -> DataFrame:
    """A wide sheet of strings: two categories; a cell of '*' is suppressed."""
    return rows.select(
        K.ROW_POS, "Firm Name", *(["Group"] if group else []),
        F.when(F.col("eleventh") == 5, "*").otherwise(first.cast("string")).alias(CATS[0]), second.cast("string").alias(CATS[1]),
    )


def _assembled(spark: SparkSession, sf_dir: str, grouped: dict[str, dict[str, bool]]) -> DataFrame:
    """Two periods of planted sheets; ``grouped``: source -> measure -> whether its sheet has a group column."""
    rows = _customers(spark, sf_dir)
    amount, nation = F.col("amount"), F.col("nation")
    cells = {
        "opened": (amount, nation + 1), "closed": (amount + 1000, nation + 2),
        "upheld": ((amount % 1000) / F.lit(1000.0), (nation % 10) / F.lit(10.0)),
    }
    sheets = {
        source: {m: _sheet(rows, has, *cells[m]) for m, has in measures.items()} for source, measures in grouped.items()
    }
    return SH.assemble_measures(SH.stack_sheets(sheets, CATS), SH.manifest_df(spark))


EVERY = {"opened": True, "closed": True, "upheld": True}


def ingest_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate firms with different groups and values: the master keeps the first row of each sheet."""
    rows = materialise(_assembled(spark, sf_dir, {"H1 2022": EVERY, "H2 2023": EVERY}), "assembled")
    master = M.master_changes(rows)
    return master.select(K.FIRM, K.GROUP, K.CAT, K.LABEL, K.DUTY, K.OPENED, K.CLOSED, K.UPHELD, "record_id")


def ingest_missing_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group column is missing in one measure of one period and in the opened sheet of another."""
    grouped = {"H1 2022": EVERY | {"closed": False}, "H2 2022": EVERY, "H1 2024": EVERY | {"opened": False}}
    return _assembled(spark, sf_dir, grouped).select(
        K.FIRM, K.GROUP, K.CAT, K.LABEL, K.ORDER, "period_start", "year", "half", K.DUTY, K.OPENED, K.CLOSED, K.UPHELD, K.ROW_POS
    )


def ingest_sheet_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part is a workbook with the five sheets in another order; the first that holds a keyword is taken."""
    part = read_table(spark, sf_dir, "part", ["p_partkey"])
    place = lambda i: (F.col("p_partkey") * (i + 1) + i * i) % 7 * 5 + i
    sheets = F.array(*[F.struct(F.lit(n).alias("n"), place(i).cast("int").alias("p")) for i, n in enumerate(SHEETS)])
    catalog = part.select(F.col("p_partkey").alias("source"), F.explode(sheets).alias("s")).select(
        "source", F.col("s.n").alias("sheet_name"), F.col("s.p").alias("sheet_pos")
    )
    return SH.resolve_sheets(catalog).select("source", "measure", "sheet_name")


def name_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer names with company tokens: one spelling unified, names shortened, firm types by the real keyword rules."""
    c = read_table(spark, sf_dir, "customer", ["c_custkey", "c_name"])
    suffix = F.get(F.array(*[F.lit(x) for x in SUFFIXES]), (F.col("c_custkey") % len(SUFFIXES)).cast("int"))
    alias = next(iter(K.NAME_ALIASES))
    name = F.when(F.col("c_custkey") % 13 == 0, F.lit(alias)).otherwise(F.concat("c_name", suffix))
    named = unify_names(c.select("c_custkey", name.alias(K.FIRM)), K.NAME_ALIASES)
    return named.select("c_custkey", K.FIRM, replace_chain(K.FIRM).alias("short_name"), classify(K.FIRM).alias(K.TYPE))


# -- the same in DuckDB ------------------------------------------------------------------------------------------------

_ROWS = f"""
cells AS (
  SELECT c_custkey AS pos, 'Firm ' || (c_custkey % {FIRMS}) AS firm, CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment END AS grp,
         CAST(trunc(abs(c_acctbal)) AS BIGINT) AS amount, c_nationkey AS nation, c_custkey % 11 = 5 AS hidden
  FROM customer WHERE c_custkey % 50 > 2),
long AS (
  SELECT pos, firm, grp, '{CATS[0]}' AS cat, amount AS opened, CAST(amount + 1000 AS DOUBLE) AS closed, (amount % 1000) / 1000.0 AS upheld
  FROM cells WHERE NOT hidden
  UNION ALL
  SELECT pos, firm, grp, '{CATS[1]}', nation + 1, CAST(nation + 2 AS DOUBLE), (nation % 10) / 10.0 FROM cells),
firsts AS (
  SELECT firm, grp, cat, min(pos) AS pos, arg_min(opened, pos) AS opened, arg_min(closed, pos) AS closed, arg_min(upheld, pos) AS upheld
  FROM long GROUP BY ALL),
loose AS (SELECT firm, cat, min(pos) AS pos, arg_min(opened, pos) AS opened, arg_min(closed, pos) AS closed FROM long GROUP BY ALL)"""

_PCT = "CAST(CAST(upheld * 1000 AS BIGINT) AS DOUBLE) / 10"  # planted rates have three decimals: nothing to round

SQL = {
    "ingest_duplicates": f"""WITH {_ROWS},
periods(period_label, nth, pre_post_duty) AS (VALUES ('H1 2022', 1, '{K.PRE_LABEL}'), ('H2 2023', 4, '{K.POST_LABEL}'))
SELECT firm AS firm_name, coalesce(grp, '') AS firm_group, cat AS product_category, period_label, pre_post_duty,
       CAST(opened AS BIGINT) AS complaints_opened, closed AS complaints_closed, {_PCT} AS upheld_pct,
       ROW_NUMBER() OVER (ORDER BY firm, cat, nth) AS record_id
FROM (SELECT * FROM firsts QUALIFY ROW_NUMBER() OVER (PARTITION BY firm, cat ORDER BY pos) = 1), periods""",
    "ingest_missing_group": f"""WITH {_ROWS},
rows AS (
  SELECT firm, grp, cat, 'H1 2022' AS label, 1 AS nth, f.opened, l.closed, f.upheld, f.pos
  FROM firsts f JOIN loose l USING (firm, cat)
  UNION ALL SELECT firm, grp, cat, 'H2 2022', 2, opened, closed, upheld, pos FROM firsts
  UNION ALL SELECT firm, '', cat, 'H1 2024', 5, opened, NULL, NULL, pos FROM loose)
SELECT firm AS firm_name, coalesce(grp, '') AS firm_group, cat AS product_category, label AS period_label, nth AS period_order,
       make_date(CAST(label[4:] AS INT), CASE WHEN label[2] = '1' THEN 1 ELSE 7 END, 1) AS period_start,
       CAST(label[4:] AS INT) AS year, CAST(label[2] AS INT) AS half,
       CASE WHEN nth <= 3 THEN '{K.PRE_LABEL}' ELSE '{K.POST_LABEL}' END AS pre_post_duty,
       CAST(opened AS BIGINT) AS complaints_opened, closed AS complaints_closed, {_PCT} AS upheld_pct, pos AS {K.ROW_POS}
FROM rows""",
    "ingest_sheet_order": "WITH sheets AS (SELECT p_partkey AS source, name, (p_partkey * (i + 1) + i * i) % 7 * 5 + i AS pos FROM part, (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(SHEETS)) + ") AS n(i, name)), words(measure, word) AS (VALUES "
    + ", ".join(f"('{m}', '{w}')" for m, ws in K.SHEET_KEYWORDS.items() for w in ws)
    + ") SELECT source, measure, arg_min(name, pos) AS sheet_name FROM sheets JOIN words ON contains(lower(name), word) GROUP BY ALL",
}

_SHORT = K.FIRM
for _a, _b in K.SHORT_NAME_REPLACEMENTS:
    _SHORT = f"replace({_SHORT}, '{_a}', '{_b}')"
_TYPES = " ".join(
    "WHEN " + " OR ".join(f"contains(lower({K.FIRM}), '{w}')" for w in words) + f" THEN '{label}'" for label, words in K.FIRM_TYPE_RULES
)
SQL["name_rules"] = f"""
WITH n AS (
  SELECT c_custkey, CASE WHEN c_custkey % 13 = 0 THEN '{next(iter(K.NAME_ALIASES.values()))}'
                         ELSE c_name || {[*SUFFIXES]}[1 + c_custkey % {len(SUFFIXES)}] END AS {K.FIRM} FROM customer)
SELECT c_custkey, {K.FIRM}, {_SHORT} AS short_name, CASE {_TYPES} ELSE '{K.FIRM_TYPE_DEFAULT}' END AS {K.TYPE} FROM n
"""
