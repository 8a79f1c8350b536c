"""Master fact (M1) and its summary marts (M2 volume pivot, M3 upheld pivot, M4 category summary).

M1 = dedup on (firm, category, period) -> period-on-period changes per (firm, category) ->
record_id in (firm, category, period order) -> flag and band. The wide rows move once, to slices of firms in order
(:mod:`riskloom.operators.slices`): a slice holds all rows of its firms, so dedup, changes and numbering run in it one after the
other, and a record id is the slice's first number (from one narrow count) plus the row's number in its slice. Within a slice the
dedup and change windows are bounded by categories and periods of a firm.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import idiv, round_ratio
from riskloom.functions.rules import flag_at_least, upheld_band
from riskloom.operators.reshape import keep_first, keep_first_placed, pivot_measure
from riskloom.operators.slices import SortKey, boundaries, slice_count, slice_of
from riskloom.operators.windows import add_changes

MASTER_OUT = [*K.MASTER_COLUMNS, K.UPHELD_T, K.CLOSED3_T]


#: Rows of one firm from which duplicates are reduced where they are read, before any row moves.
HOT_FIRM = 1_000_000
#: Rows of a slice of firms, whatever the number of shuffle partitions, so that a task sorts the wide rows of one slice in memory. Beyond
#: MOST_SLICES slices (whose boundaries are literals) slices grow instead.
SLICE_ROWS, MOST_SLICES = 250_000, 2_000
_SLICE = "__rl_firms"
_ROW_KEYS = [K.FIRM, K.CAT, K.LABEL]


def master_changes(fact: DataFrame, dedup: bool = True) -> DataFrame:
    """The master of ``fact``, which is read four times: give it stored or cheap."""
    rows = fact.groupBy(*_ROW_KEYS).agg(F.count(F.lit(1)).alias("n")) if dedup else fact.select(*_ROW_KEYS, F.lit(1).alias("n"))
    firm_slice, firsts, hottest = firm_slices(fact, rows)
    late = dedup and (K.ROW_POS in fact.columns or hottest > HOT_FIRM)
    df = reduced_rows(fact) if late else fact
    dealt = _dealt(df, firm_slice, len(firsts))
    if dedup and not late:
        dealt = keep_first(dealt, [_SLICE, *_ROW_KEYS], [K.ORDER])
    return _numbered(change_rows(dealt, within=[_SLICE]), firsts)


def reduced_rows(fact: DataFrame) -> DataFrame:
    """Of rows with the same firm, category and period the first one, by file (a period is a file) and row of its sheet.

    Rows of an ingest carry their sheet row, which names one row of a key: the wide rows are fetched late. Rows without it are
    ordered by their other columns instead (:func:`keep_first`) and reduced before they move."""
    if K.ROW_POS in fact.columns:
        return keep_first_placed(fact, _ROW_KEYS, [K.ORDER, K.ROW_POS])
    return keep_first(fact, _ROW_KEYS, [K.ORDER])


def first_rows(fact: DataFrame) -> DataFrame:
    """:func:`reduced_rows`, distributed by firm unless the rows carry their sheet row or one firm is hot.

    The rows of a firm meet in one task unsorted and are reduced there, so that no task sorts all wide rows it reads, and windows by
    firm move nothing."""
    if K.ROW_POS in fact.columns:
        return reduced_rows(fact)
    hottest, rows = fact.groupBy(K.FIRM).count().agg(F.max("count"), F.sum("count")).first()
    if (hottest or 0) > HOT_FIRM:
        return reduced_rows(fact)
    parts = _wanted(fact, rows or 0)
    more = [parts] if parts > slice_count(fact, None) else []  # without a number AQE may join small parts
    return reduced_rows(fact.repartition(*more, F.col(K.FIRM)))


def change_rows(df: DataFrame, within: Sequence[str] = ()) -> DataFrame:
    """The master's columns without the record id; changes are against the previous row of the firm and category.

    ``within``: columns that the firm determines and that ``df`` is distributed by; they are kept."""
    return add_changes(df, (*within, K.FIRM, K.CAT), K.ORDER, K.OPENED, K.UPHELD_T).withColumns({
        "high_uphold_flag": flag_at_least(K.UPHELD, K.HIGH_UPHOLD_THRESHOLD),
        "upheld_band": upheld_band(K.UPHELD),
    }).select(*[c for c in MASTER_OUT if c != "record_id"], *within)


def firm_slices(df: DataFrame, rows: DataFrame) -> tuple[Column, list[int], int]:
    """The slice of a row's firm, the number of master rows before each slice, and the most rows that one firm has in ``df``.

    ``rows`` holds a row for each row of the master, and in ``n`` how many rows of ``df`` became that one. Boundaries are the firms of
    sampled rows, so slices have about as many rows each; a sum for each slice comes to the driver."""
    sampled = [SortKey(c) for c in (K.FIRM, K.CAT, K.LABEL)]
    bounds = boundaries(df.select(*_ROW_KEYS), sampled, _wanted(df, df.count()))
    firms = df.select(K.FIRM)
    cuts = sorted({r[0] for r in bounds if r[0] is not None})
    firm_slice = slice_of(firms, [SortKey(K.FIRM)], [(c,) for c in cuts])
    per_firm = rows.groupBy(K.FIRM).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("given"))
    sums = per_firm.groupBy(firm_slice.alias("slice")).agg(F.sum("rows").alias("rows"), F.max("given").alias("given")).collect()
    found = {r["slice"]: r["rows"] for r in sums}  # a row a slice
    firsts = [0]
    for k in range(len(cuts)):
        firsts.append(firsts[-1] + found.get(k, 0))
    return firm_slice, firsts, max((r["given"] for r in sums), default=0)


def _wanted(df: DataFrame, rows: int) -> int:
    """Into how many parts ``rows`` wide rows go."""
    return max(slice_count(df, None), min(MOST_SLICES, -(-rows // SLICE_ROWS)))


def _dealt(df: DataFrame, firm_slice: Column, slices: int) -> DataFrame:
    """``df`` distributed by slice of firms; more slices than shuffle partitions get a task each."""
    sliced = df.withColumn(_SLICE, firm_slice)
    if slices <= slice_count(df, None):
        return sliced.repartition(F.col(_SLICE))
    return sliced.repartitionById(slices, F.col(_SLICE))


def _numbered(changes: DataFrame, firsts: Sequence[int]) -> DataFrame:
    """``changes``, distributed by slice of firms, with record ids."""
    local = F.row_number().over(Window.partitionBy(_SLICE).orderBy(K.FIRM, K.CAT, K.ORDER))
    before = F.get(F.array(*[F.lit(n).cast("bigint") for n in firsts]), F.col(_SLICE))
    return changes.withColumn("record_id", (local + before).cast("bigint")).select(*MASTER_OUT)


def numbered(changes: DataFrame) -> DataFrame:
    """Stored ``changes`` (a row for each row of the master) with record ids."""
    firm_slice, firsts, _ = firm_slices(changes, changes.select(*_ROW_KEYS, F.lit(1).alias("n")))
    return _numbered(_dealt(changes, firm_slice, len(firsts)), firsts)


def half_even_mean_tenths(x: str) -> F.Column:
    """Aggregate: mean of integer tenths, rounded half-to-even to whole tenths, as a percentage.

    Exact version of ``mean(pct).round(1)`` (numpy rounds half to even).
    """
    s, n = F.sum(x), F.count(x)
    q = idiv(s, n)
    r = s - q * n
    up = (r * 2 > n) | ((r * 2 == n) & (q % 2 == 1))
    return F.when(n > 0, (q + up.cast("bigint")).cast("double") / F.lit(10))


def pivot_volume(master: DataFrame, labels: Sequence[str]) -> DataFrame:
    """M2: (firm, type) x period volume sums, missing cells 0, chronological columns."""
    return pivot_measure(master, [K.FIRM, K.TYPE], K.LABEL, labels, K.OPENED, agg="sum", fill=0)


def pivot_upheld(master: DataFrame, labels: Sequence[str]) -> DataFrame:
    """M3: (firm, type) x period mean uphold rate at 1 dp; firms without any rate disappear."""
    cells = (
        master.filter(F.col(K.UPHELD_T).isNotNull())
        .groupBy(K.FIRM, K.TYPE, K.LABEL)
        .agg(half_even_mean_tenths(K.UPHELD_T).alias("v"))
    )
    return pivot_measure(cells, [K.FIRM, K.TYPE], K.LABEL, labels, "v", agg="first")


def category_summary(master: DataFrame) -> DataFrame:
    """M4: per (period, category, regime) total volume, mean uphold rate (1 dp) and firm count."""
    return master.groupBy(K.LABEL, K.CAT, K.DUTY).agg(
        F.sum(K.OPENED).alias("total_opened"),
        half_even_mean_tenths(K.UPHELD_T).alias("avg_upheld_pct"),
        F.countDistinct(K.FIRM).alias("firm_count"),
    )


__all__ = ["master_changes", "pivot_volume", "pivot_upheld", "category_summary", "round_ratio"]
