"""Reshape operators: wide sheet -> long measure, long -> pivot matrix, keep-first dedup."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions.numeric import coerce_numeric


def melt_measure(
    df: DataFrame,
    measure: str,
    ids: Sequence[str] = ("firm_name", "group"),
    categories: Sequence[str] | None = None,
    category_col: str = "product_category",
) -> DataFrame | None:
    """Unpivot the category columns of a wide sheet into ``(ids..., category_col, measure)``.

    Only the ids and categories present are used; no firm-name column or no category column ->
    ``None``. Values are coerced leniently to double and missing values are dropped (a ``*``
    suppression marker, ``'1,234'``, ``''`` all become missing).
    """
    cols = set(df.columns)
    if "firm_name" not in cols:
        return None
    id_cols = [c for c in ids if c in cols]
    value_cols = [c for c in (categories if categories is not None else []) if c in cols]
    if not value_cols:
        return None
    wide = df.select(*id_cols, *[F.col(c).cast("string").alias(c) for c in value_cols])
    long = wide.unpivot(id_cols, value_cols, category_col, "__raw")
    return long.select(*id_cols, category_col, coerce_numeric("__raw").alias(measure)).filter(
        F.col(measure).isNotNull()
    )


def pivot_measure(
    df: DataFrame,
    rows: Sequence[str],
    column: str,
    values: Sequence,
    value: str,
    agg: str = "sum",
    fill=None,
    require_all: bool = False,
) -> DataFrame:
    """``groupBy(rows).pivot(column, values).agg(agg(value))``.

    ``values`` is passed explicitly (no distinct job; chronological order when so given).
    ``fill`` replaces missing cells; ``require_all`` drops rows with any missing cell;
    """
    fn = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min, "first": F.first}[agg]
    out = df.groupBy(*rows).pivot(column, list(values)).agg(fn(value))
    names = [str(v) for v in values]
    if fill is not None:
        out = out.na.fill(fill, subset=names)
    if require_all:
        out = out.na.drop(how="any", subset=names)
    return out


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``keys``: the first by ``order`` (ascending, nulls first).

    ``order`` should name a row within its key, e.g. end with the position that the row had in its input (``ROW_POS``); rows
    that tie in it are ordered by their other columns, so that the result is the same every time.

    Implemented as ``min(struct(order..., rest...))`` per key. The struct makes it a sort-based aggregate (its buffer
    cannot be updated in place), but a partial one: a key that holds a third of all rows is reduced on every mapper
    before the shuffle, where a ``row_number`` window would bring all of its rows to one task.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    packed = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    firsts = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return firsts.select(*keys, *[F.col("__first")[c].alias(c) for c in [*order, *rest]]).select(*df.columns)


#: More than the distance of any two bigints: a number times this plus a bigint sorts by the number first.
_APART = Decimal(2 * 10**19)


def place_of(df: DataFrame, order: Sequence[str]) -> Column:
    """``order`` (a whole-number column, or an int and another) as one number of fixed width that sorts alike."""
    kinds = [df.schema[c].dataType.simpleString() for c in order]
    small, whole = ("tinyint", "smallint", "int"), ("tinyint", "smallint", "int", "bigint")
    if len(order) == 1 and kinds[0] in whole:
        return F.col(order[0])
    if len(order) == 2 and kinds[0] in small and kinds[1] in whole:
        first, second = F.col(order[0]).cast("decimal(10,0)"), F.col(order[1]).cast("decimal(19,0)")
        return first * F.lit(_APART).cast("decimal(20,0)") + second
    raise ValueError(f"no number of fixed width for the order {list(zip(order, kinds))}")


def keep_first_placed(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """:func:`keep_first` by late fetch, where ``order`` is whole numbers (see :func:`place_of`) without nulls that name one row of
    a key, such as file and sheet row.

    The least place of each key is a hash aggregate with a buffer of fixed width over keys and place alone; the wide rows are
    only fetched by a semi-join with it, never carried through aggregation buffers. It joins on keys and place, so the rows of a
    hot key are spread over tasks. ``df`` is read twice: give it stored.
    """
    place, names = "__rl_place", [f"__rl_key{k}" for k in range(len(keys))]
    placed = df.withColumn(place, place_of(df, order))
    firsts = placed.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)]).agg(F.min(place).alias("__rl_least"))
    same = F.col(place) == F.col("__rl_least")
    for key, name in zip(keys, names, strict=True):
        same &= F.col(key).eqNullSafe(F.col(name))
    return placed.join(firsts, same, "left_semi").drop(place)
