"""SQL text for the independent DuckDB oracles: the fixture fact as a CTE and rounding helpers.

The oracle is plain ANSI-ish SQL over the raw driver tables; it shares no code path with the Spark
operators, only the numeric conventions (integer tenths, exact rational rounding).
"""

from __future__ import annotations

from riskloom import contract as K


def fact_cte(base_year: int = K.FIXTURE_BASE_YEAR, cutover: int = K.FIXTURE_CUTOVER_ORDER,
             min_volume: int = K.FIXTURE_MIN_VOLUME) -> str:
    return f"""fact AS (
  SELECT firm_name, firm_type, firm_group, product_category, year, half,
         'H' || CAST(half AS VARCHAR) || ' ' || CAST(year AS VARCHAR) AS period_label,
         CAST((year - {base_year}) * 2 + half AS INTEGER) AS period_order,
         make_date(year, CASE WHEN half = 1 THEN 1 ELSE 7 END, 1) AS period_start,
         make_date(year, CASE WHEN half = 1 THEN 6 ELSE 12 END, CASE WHEN half = 1 THEN 30 ELSE 31 END) AS period_end,
         CASE WHEN (year - {base_year}) * 2 + half <= {cutover} THEN 'Pre-Duty' ELSE 'Post-Duty' END AS pre_post_duty,
         q AS complaints_opened,
         CAST(f AS DOUBLE) AS complaints_closed,
         CASE WHEN q >= {min_volume} THEN (2000 * u + q) // (2 * q) END AS upheld_tenths,
         CASE WHEN q >= {min_volume} THEN (2000 * f + q) // (2 * q) END AS closed3_tenths,
         CAST(CASE WHEN q >= {min_volume} THEN (2000 * u + q) // (2 * q) END AS DOUBLE) / 10 AS upheld_pct,
         CAST(CASE WHEN q >= {min_volume} THEN (2000 * f + q) // (2 * q) END AS DOUBLE) / 10 AS pct_closed_3days
  FROM (
    SELECT c.c_name AS firm_name, c.c_mktsegment AS firm_type, n.n_name AS firm_group,
           p.p_type AS product_category,
           CAST(year(l.l_shipdate) AS INTEGER) AS year,
           CASE WHEN month(l.l_shipdate) <= 6 THEN 1 ELSE 2 END AS half,
           CAST(SUM(l.l_quantity) AS BIGINT) AS q,
           CAST(SUM(CASE WHEN l.l_linestatus = 'F' THEN l.l_quantity ELSE 0 END) AS BIGINT) AS f,
           CAST(SUM(CASE WHEN l.l_returnflag = 'R' THEN l.l_quantity ELSE 0 END) AS BIGINT) AS u
    FROM lineitem l
    JOIN orders o ON l.l_orderkey = o.o_orderkey
    JOIN customer c ON o.o_custkey = c.c_custkey
    JOIN nation n ON c.c_nationkey = n.n_nationkey
    JOIN part p ON l.l_partkey = p.p_partkey
    GROUP BY 1, 2, 3, 4, 5, 6
  ) agg
)"""


def with_fact(body: str, *ctes: str) -> str:
    """``WITH fact AS (...), <ctes> <body>``."""
    parts = [fact_cte(), *ctes]
    return "WITH " + ",\n".join(parts) + "\n" + body


def round_ratio_int(num: str, den: str, dp: int = 1, scale: int = 1) -> str:
    """Exact ``ROUND(scale * num / den, dp) * 10**dp`` as BIGINT, half away from zero."""
    k = 10 ** dp
    return (
        f"(CASE WHEN ({den}) <> 0 THEN CAST((CASE WHEN (({num}) < 0) <> (({den}) < 0) THEN -1 ELSE 1 END)"
        f" * ((abs({num}) * {2 * k * scale} + abs({den})) // (abs({den}) * 2)) AS BIGINT) END)"
    )


def round_ratio(num: str, den: str, dp: int = 1, scale: int = 1) -> str:
    """Exact ``ROUND(scale * num / den, dp)`` half away from zero; NULL when den = 0."""
    return f"(CAST({round_ratio_int(num, den, dp, scale)} AS DOUBLE) / {10 ** dp})"


def rounded_mean_int(x: str, unit: int = 1, dp: int = 1) -> str:
    return round_ratio_int(f"SUM({x})", f"COUNT({x}) * {unit}", dp=dp)


def rounded_mean(x: str, unit: int = 1, dp: int = 1) -> str:
    return round_ratio(f"SUM({x})", f"COUNT({x}) * {unit}", dp=dp)


def exact_mean(x: str, unit: int = 1) -> str:
    return f"(CAST(SUM({x}) AS DOUBLE) / (COUNT({x}) * {unit}))"


def pct_change(new: str, old: str, dp: int = 1) -> str:
    return round_ratio(f"(({new}) - ({old}))", old, dp=dp, scale=100)


def tenths(x: str) -> str:
    return f"(CAST({x} AS DOUBLE) / 10)"


def rint(x: str, dp: int = 1) -> str:
    """numpy-style half-to-even rounding of a double at ``dp`` decimals."""
    k = 10 ** dp
    y = f"(({x}) * {float(k)})"
    return (
        f"((CASE WHEN {y} - floor({y}) = 0.5 THEN "
        f"(CASE WHEN CAST(floor({y}) AS BIGINT) % 2 = 0 THEN floor({y}) ELSE floor({y}) + 1 END) "
        f"ELSE round({y}) END) / {float(k)})"
    )


def case_chain(pairs: list[tuple[str, str]], otherwise: str) -> str:
    whens = " ".join(f"WHEN {cond} THEN '{label}'" for cond, label in pairs)
    return f"(CASE {whens} ELSE '{otherwise}' END)"
