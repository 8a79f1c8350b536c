"""Data contract: column names, the master schema and the domain constants.

Domain constants are defaults of operator arguments; nothing below is hard-wired into an operator.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import types as T

# ---------------------------------------------------------------------------------------------
# FIXED VALUES. These must equal the reference application's values for the results to agree.
# They are stated as given, in their original order.
# ---------------------------------------------------------------------------------------------

# Period manifest: (file, period_label, period_order, period_start, period_end)
PERIOD_MANIFEST = [
    ("firm-level-complaints-data-2022-h1.xlsx", "H1 2022", 1, "2022-01-01", "2022-06-30"),
    ("firm-level-complaints-data-2022-h2.xlsx", "H2 2022", 2, "2022-07-01", "2022-12-31"),
    ("firm-level-complaints-data-2023-h1.xlsx", "H1 2023", 3, "2023-01-01", "2023-06-30"),
    ("firm-level-complaints-data-2023-h2.xlsx", "H2 2023", 4, "2023-07-01", "2023-12-31"),
    ("firm-level-complaints-data-2024-h1.xlsx", "H1 2024", 5, "2024-01-01", "2024-06-30"),
]

PRE_DUTY_PERIODS = ["H1 2022", "H2 2022", "H1 2023"]
POST_DUTY_PERIODS = ["H2 2023", "H1 2024"]
PRE_LABEL = "Pre-Duty"
POST_LABEL = "Post-Duty"

PRODUCT_CATS = [
    "Banking & Credit Cards",
    "Decumulation & Pensions",
    "Home Finance",
    "Insurance & Pure Protection",
    "Investments",
]

# Ordered firm-type rules: first rule whose keyword is a substring of the lower-cased name wins.
FIRM_TYPE_RULES = [
    ("Retail Bank / Building Society", [
        "barclays", "hsbc", "lloyds", "natwest", "santander", "halifax", "nationwide", "monzo",
        "starling", "metro bank", "bank of scotland", "tsb", "virgin money", "co-operative bank",
        "clydesdale", "royal bank of scotland", "tesco bank", "sainsbury", "marks & spencer financial",
    ]),
    ("General Insurance", [
        "aviva insurance", "axa insurance", "direct line", "admiral", "esure", "hastings",
        "liverpool victoria", "lv=", "ageas", "allianz", "hiscox", "uk insurance", "u k insurance",
        "eui limited", "nfu mutual", "saga", "zurich insurance",
    ]),
    ("Life & Pensions", [
        "scottish widows", "legal & general", "phoenix life", "reassure", "aegon", "zurich assurance",
        "prudential", "aviva life", "sun life", "metlife", "royal london", "wesleyan", "unum",
        "vitality life",
    ]),
    ("Investment Platform", [
        "hargreaves lansdown", "aj bell", "interactive investor", "fidelity", "vanguard", "nutmeg",
        "quilter", "invesco", "columbia threadneedle", "standard life savings",
    ]),
    ("Mortgage Lender", [
        "accord mortgages", "kensington mortgage", "platform home loans", "mortgage works",
        "landmark mortgages",
    ]),
    ("Credit Card / Consumer Finance", [
        "american express", "capital one", "newday", "vanquis", "mbna",
    ]),
]
FIRM_TYPE_DEFAULT = "Other Financial Services"

# Sheet resolution keywords per measure (first sheet, in file order, containing any keyword).
SHEET_KEYWORDS = {
    "opened": ["opened", "open"],
    "closed": ["closed"],
    "upheld": ["upheld", "% upheld"],
    "threeday": ["3 day", "3days", "closed in 3", "within 3"],
}

# Header harmonisation, ordered: (kind, pattern(s), target). kinds: "in" exact lower-trim match
# against a list, "contains" substring, "all" every substring present, "startswith" prefix.
HEADER_RULES = [
    ("in", ["firm name", "firm_name"], "firm_name"),
    ("in", ["group", "group name"], "group"),
    ("contains", ["banking"], "Banking & Credit Cards"),
    ("contains", ["decumulation"], "Decumulation & Pensions"),
    ("contains", ["home finance"], "Home Finance"),
    ("all", ["insurance", "pure"], "Insurance & Pure Protection"),
    ("startswith", ["invest"], "Investments"),
]

# Upheld band of the master (null -> Unknown).
UPHELD_BANDS = [(70, "Very High (70%+)"), (50, "High (50-70%)"), (35, "Moderate (35-50%)")]
UPHELD_BAND_OTHER = "Lower (<35%)"
UPHELD_BAND_NULL = "Unknown"
HIGH_UPHOLD_THRESHOLD = 50

# Traffic light of the top-firms chart (missing -> green).
TRAFFIC_LIGHT = [(50, "red"), (35, "amber")]
TRAFFIC_LIGHT_OTHER = "green"

# Verdict texts of the named queries.
A3_FLAGS = ("GROWING POST-DUTY - HIGH RISK", "GROWING", "DECLINING OR STABLE")
B2_VERDICTS = (
    "WORSENED - Volume and uphold rate both increased",
    "IMPROVED - Volume and uphold rate both decreased",
    "MIXED - More complaints but lower uphold rate",
    "MIXED - Signal unclear",
)
C1_BANDS = (
    "VERY HIGH RISK - 70 percent or above",
    "HIGH RISK - 50 to 70 percent",
    "MODERATE - 35 to 50 percent",
    "LOWER RISK - Below 35 percent",
)
C2_VERDICTS = (
    "SHARP DETERIORATION - Over 10 percentage points",
    "MODERATE DETERIORATION - 5 to 10 percentage points",
    "SLIGHT INCREASE - 0 to 5 percentage points",
    "STABLE OR IMPROVING",
)
C3_CLASSES = (
    "DANGER QUADRANT - Highest risk",
    "HIGH RISK - High volume, elevated uphold rate",
    "HIGH RISK - High uphold rate, significant volume",
    "ELEVATED - High volume, acceptable uphold rate",
    "ELEVATED - High uphold rate, lower volume",
    "ACCEPTABLE - Within normal parameters",
)
C4_RESPONSES = (
    "WORSENED SIGNIFICANTLY - Over 5 points",
    "WORSENED SLIGHTLY - 0 to 5 points",
    "MINIMAL IMPROVEMENT - 0 to 5 points",
    "CLEAR IMPROVEMENT - Over 5 points",
)
D1_BANDS = (
    "FAST RESOLVER - 70 percent or more in 3 days",
    "MODERATE RESOLVER - 40 to 70 percent in 3 days",
    "SLOW RESOLVER - Under 40 percent in 3 days",
)

# Name shortening used for chart labels (applied in this order, anywhere in the text).
SHORT_NAME_REPLACEMENTS = [
    (" Limited", ""), (" Plc", ""), (" PLC", ""), (" Insurance", " Ins."), (" Services", " Svcs"),
]

# One entity name unified before the notebook analyses.
NAME_ALIASES = {"SCOTTISH WIDOWS LIMITED": "Scottish Widows Limited"}

# Group subsidiaries followed in the group trajectory chart.
GROUP_SUBSIDIARIES = [
    "National Westminster Bank Plc",
    "The Royal Bank of Scotland Plc",
    "Coutts & Company",
]

# Order in which the category chart stacks its bars, from the bottom up.
CATEGORY_STACK = [
    "Banking & Credit Cards",
    "Insurance & Pure Protection",
    "Investments",
    "Home Finance",
    "Decumulation & Pensions",
]

# Composite risk index: weights for volume, upheld, trend, growth; clip quantiles; chart threshold.
RISK_WEIGHTS = (0.30, 0.35, 0.20, 0.15)
RISK_CLIP = (0.05, 0.95)
RISK_HIGH = 60

# Query thresholds.
MIN_TOTAL = 1000
MIN_FIRST_VOLUME = 500

# ---------------------------------------------------------------------------------------------
# Fixture parameters (driver tables). The fact built from the TPC-H-like tables has 14 half-years
# from 1995; its first volumes are smaller, so A3 uses 75 in place of 500 (FIXTURES.md).
# ---------------------------------------------------------------------------------------------
FIXTURE_BASE_YEAR = 1995
FIXTURE_CUTOVER_ORDER = 7
FIXTURE_MIN_VOLUME = 15
FIXTURE_MIN_FIRST = 75
FIXTURE_FIRM = "Customer#000000001"

# ---------------------------------------------------------------------------------------------
# Column names
# ---------------------------------------------------------------------------------------------
FIRM = "firm_name"
TYPE = "firm_type"
GROUP = "firm_group"
CAT = "product_category"
LABEL = "period_label"
ORDER = "period_order"
DUTY = "pre_post_duty"
OPENED = "complaints_opened"
CLOSED = "complaints_closed"
UPHELD = "upheld_pct"
CLOSED3 = "pct_closed_3days"
UPHELD_T = "upheld_tenths"
CLOSED3_T = "closed3_tenths"
#: Position of a row in the sheet it was read from (bigint, ascending); orders duplicates, and is no master column.
ROW_POS = "sheet_row"

FACT_SCHEMA = T.StructType([
    T.StructField(FIRM, T.StringType(), False),
    T.StructField(TYPE, T.StringType(), True),
    T.StructField(GROUP, T.StringType(), True),
    T.StructField(CAT, T.StringType(), False),
    T.StructField("year", T.IntegerType(), True),
    T.StructField("half", T.IntegerType(), True),
    T.StructField(LABEL, T.StringType(), False),
    T.StructField(ORDER, T.IntegerType(), False),
    T.StructField("period_start", T.DateType(), True),
    T.StructField("period_end", T.DateType(), True),
    T.StructField(DUTY, T.StringType(), True),
    T.StructField(OPENED, T.LongType(), False),
    T.StructField(CLOSED, T.DoubleType(), True),
    T.StructField(UPHELD_T, T.LongType(), True),
    T.StructField(CLOSED3_T, T.LongType(), True),
    T.StructField(UPHELD, T.DoubleType(), True),
    T.StructField(CLOSED3, T.DoubleType(), True),
])

MASTER_COLUMNS = [
    FIRM, GROUP, CAT, OPENED, CLOSED, LABEL, ORDER, "period_start", "period_end", "year", "half",
    DUTY, UPHELD, CLOSED3, TYPE, "record_id", "complaints_change_abs", "complaints_change_pct",
    "upheld_change_ppts", "high_uphold_flag", "upheld_band",
]


def manifest_rows(manifest=PERIOD_MANIFEST, pre_periods=PRE_DUTY_PERIODS):
    """Manifest tuples typed for ``spark.createDataFrame`` (dates parsed, regime attached)."""
    out = []
    for pos, (file, label, order, start, end) in enumerate(manifest):
        s = _dt.date.fromisoformat(start)
        e = _dt.date.fromisoformat(end)
        out.append((pos, file, label, int(order), s, e, s.year, 1 if "H1" in label else 2,
                    PRE_LABEL if label in pre_periods else POST_LABEL))
    return out


MANIFEST_SCHEMA = T.StructType([
    T.StructField("file_pos", T.IntegerType(), False),
    T.StructField("file", T.StringType(), False),
    T.StructField(LABEL, T.StringType(), False),
    T.StructField(ORDER, T.IntegerType(), False),
    T.StructField("period_start", T.DateType(), False),
    T.StructField("period_end", T.DateType(), False),
    T.StructField("year", T.IntegerType(), False),
    T.StructField("half", T.IntegerType(), False),
    T.StructField(DUTY, T.StringType(), False),
])
