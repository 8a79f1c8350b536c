"""Global ranking without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` plans ``Exchange SinglePartition``: every row goes
through one task. That is fine for a 30-row top-k, not for an entity table with billions of rows.
Row numbers here are running totals over slices (:mod:`riskloom.operators.slices`): boundary keys are
collected once, a row's slice is a pure function of its key, and nothing is stored or range-partitioned.
NTILE, RANK and quantiles are derived from the row number arithmetically.

A table that is already distributed by an entity (the master, bucketed by firm) is not moved at all:
:func:`row_number_by_entity` numbers the entities' row counts and counts rows within each entity.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.functions.numeric import idiv
from riskloom.operators.slices import SortKey, running_total, sort_key


def global_row_number(
    df: DataFrame,
    order: Sequence[Column | str | SortKey],
    name: str = "rn",
    total_name: str | None = None,
    num_partitions: int | None = None,
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Add a 1-based row number in ``order`` (and optionally the row count), globally or within
    each ``partition_by`` group.

    ``order`` names columns (``"c"``, ``"c DESC"`` or ``F.desc("c")``) and should end in unique tie-breaks for a
    deterministic numbering. With ``partition_by`` the groups lead the order and each group's first number is taken off;
    the groups' row counts come to the driver - use it for a handful of groups (measures of a table), not for an
    entity-sized key. ``num_partitions``: slices (default: spark.sql.shuffle.partitions). ``df`` is evaluated a few times,
    so give it stored or cheap.
    """
    groups = list(partition_by)
    out, total = running_total(df, [*groups, *order], name=name, slices=num_partitions)
    if not groups:
        return out.withColumn(total_name, F.lit(total).cast("bigint")) if total_name else out
    counts = df.groupBy(*groups).agg(F.count(F.lit(1)).alias("n")).orderBy(*groups).collect()  # a handful
    first, size, before = F.lit(None).cast("bigint"), F.lit(None).cast("bigint"), total
    for row in reversed(counts):
        before -= row["n"]
        mine = F.lit(True)
        for g in groups:
            mine = mine & F.col(g).eqNullSafe(F.lit(row[g]))
        first = F.when(mine, F.lit(before)).otherwise(first)
        size = F.when(mine, F.lit(row["n"])).otherwise(size)
    out = out.withColumn(name, F.col(name) - first)
    return out.withColumn(total_name, size) if total_name else out


def row_number_by_entity(
    df: DataFrame,
    entity: str,
    within: Sequence[Column | str],
    counts: DataFrame,
    name: str = "rn",
    num_partitions: int | None = None,
) -> DataFrame:
    """Global row number in the order (``entity``, ``within``) for a table distributed by ``entity``.

    ``counts`` holds (entity, n), the number of rows of each entity: a narrow table, whose running total gives each
    entity's offset. Rows are numbered within their entity (bounded by the table's grain) where they are, and join the
    offsets on the entity: the wide rows of a bucketed table never move.
    """
    n = "__rl_n"
    sums, _ = running_total(counts.select(F.col(entity), F.col("n").alias(n)), [entity], F.col(n), "__rl_to", num_partitions)
    offsets = sums.select(F.col(entity).alias("__rl_of"), (F.col("__rl_to") - F.col(n)).alias("__rl_from"))
    local = F.row_number().over(Window.partitionBy(entity).orderBy(*within))
    numbered = df.withColumn(name, local).join(offsets, F.col(entity).eqNullSafe(F.col("__rl_of")))
    return numbered.withColumn(name, (F.col(name) + F.col("__rl_from")).cast("bigint")).drop("__rl_of", "__rl_from")


def ntile_of(rn: Column | str, total: Column | str, k: int) -> Column:
    """SQL ``NTILE(k)`` bucket of 1-based row ``rn`` among ``total`` rows.

    The first ``total mod k`` buckets hold one extra row.
    """
    r = F.col(rn) if isinstance(rn, str) else rn
    n = F.col(total) if isinstance(total, str) else total
    b = idiv(n, F.lit(k))
    rem = n - b * F.lit(k)
    big = rem * (b + 1)
    return F.when(r <= big, idiv(r - 1, b + 1) + 1).otherwise(rem + idiv(r - 1 - big, b) + 1).cast("bigint")


def ntile(
    df: DataFrame,
    k: int,
    order: Sequence[Column | str],
    name: str = "ntile",
    scalable: bool = True,
    num_partitions: int | None = None,
) -> DataFrame:
    """Add ``NTILE(k) OVER (ORDER BY order)`` as ``name`` (bigint)."""
    if not scalable:
        return df.withColumn(name, F.ntile(k).over(Window.orderBy(*[sort_key(o).column() for o in order])).cast("bigint"))
    rn, tot = f"__rl_rn_{name}", f"__rl_tot_{name}"
    out = global_row_number(df, order, name=rn, total_name=tot, num_partitions=num_partitions)
    return out.withColumn(name, ntile_of(rn, tot, k)).drop(rn, tot)


def global_rank(
    df: DataFrame,
    keys: Sequence[str],
    descending: bool = True,
    tiebreak: Sequence[str] = (),
    name: str = "rank",
    num_partitions: int | None = None,
) -> DataFrame:
    """``RANK() OVER (ORDER BY keys)``: 1 + rows strictly before, equal keys share the rank.

    Rank = smallest global row number among rows with equal keys; the per-key minimum is a
    partial-aggregated group-by (skew safe) joined back on the keys.
    """
    order = [SortKey(k, descending) for k in keys] + [SortKey(t) for t in tiebreak]
    rn = f"__rl_rn_{name}"
    numbered = global_row_number(df, order, name=rn, num_partitions=num_partitions)
    first = numbered.groupBy(*keys).agg(F.min(rn).alias(name))
    return numbered.join(first, [numbered[k].eqNullSafe(first[k]) for k in keys]).select(
        numbered["*"], first[name].cast("bigint").alias(name)
    ).drop(rn)


def rank_within_top(df: DataFrame, k: int, key: str, tiebreak: Sequence[str], name: str) -> DataFrame:
    """Top ``k`` rows by ``key`` desc with their global ``RANK()`` over the whole input.

    Every row ranked above a top-k row is itself in the top k, so the rank computed inside the
    k-row result equals the global rank: the plan is a ``TakeOrderedAndProject`` (per-partition
    top-k, then a k x partitions merge), never a global sort.
    """
    top = df.orderBy(F.desc(key), *[F.asc(t) for t in tiebreak]).limit(k)
    return top.withColumn(name, F.rank().over(Window.orderBy(F.desc(key))).cast("bigint"))
