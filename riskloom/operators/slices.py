"""Running totals over a total order without a single-partition window, a range exchange or a stored copy.

The order is cut into *slices* by boundary keys that are collected once: the keys with the least hashes are a sample of fixed size, and
every so many of them is a boundary. From then on a row's slice is a pure function of its key (a comparison with literals), so every
evaluation and every retry after a lost executor puts it into the same slice. Three narrow passes:

1. the sample (a top-k by hash: k rows for each task, k in all) comes to the driver, in order;
2. one sum for each slice comes to the driver: its running totals are literals;
3. rows are dealt out by slice and a window runs within each slice.

Only the columns given are read and moved. Keys must be unique for a defined numbering; a hot value is split by the tie-breaks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Sampled keys for each slice: a slice has more than twice its share of the rows with a probability below 1e-5.
SAMPLED = 32
#: Boundaries are compared in two steps: with every STEP-th one, then with those in between.
STEP = 16
#: Rows for which further slices pay: below, one task counts them faster than another job.
SLICE_ROWS = 50_000
_SLICE = "__rl_slice"


class SortKey(NamedTuple):
    """A column and its direction; nulls come first when ascending and last when descending."""

    name: str
    descending: bool = False

    def column(self) -> Column:
        return F.desc(f"`{self.name}`") if self.descending else F.asc(f"`{self.name}`")


def sort_key(item: Column | str | SortKey) -> SortKey:
    """From a SortKey, ``"name"``, ``"name DESC"`` or a sort column such as ``F.desc("name")``."""
    if isinstance(item, SortKey):
        return item
    text = item if isinstance(item, str) else re.sub(r"^Column<'(.*)'>$", r"\1", str(item))
    found = re.fullmatch(r"`?(.+?)`?(?:\s+(ASC|DESC)(?:\s+NULLS\s+(?:FIRST|LAST))?)?", text)
    return SortKey(found[1], found[2] == "DESC")


def before(keys: Sequence[SortKey], left: Sequence[Column], right: Sequence[Column]) -> Column:
    """Whether the key ``left`` comes before ``right``."""
    out = F.lit(False)
    for key, a, b in reversed(list(zip(keys, left, right, strict=True))):
        less = F.when(b.isNull(), key.descending & a.isNotNull()).when(a.isNull(), F.lit(not key.descending))
        less = less.otherwise(a > b if key.descending else a < b)
        out = less | (a.eqNullSafe(b) & out)
    return out


def boundaries(df: DataFrame, keys: Sequence[SortKey], slices: int) -> list[Row]:
    """At most ``slices - 1`` keys, in order, that cut the rows of ``df`` into slices of about equal size."""
    names = [k.name for k in keys]
    hashed = df.select(*[F.col(f"`{n}`") for n in names]).withColumn("__rl_hash", F.xxhash64(*[F.col(f"`{n}`") for n in names]))
    sample = hashed.orderBy("__rl_hash").limit(slices * SAMPLED).drop("__rl_hash")
    rows = sample.orderBy(*[k.column() for k in keys]).collect()  # bounded: slices * SAMPLED keys
    step = max(1, -(-len(rows) // slices))
    return rows[step::step]


def slice_of(df: DataFrame, keys: Sequence[SortKey], bounds: Sequence[Row]) -> Column:
    """The number of boundaries that are not behind the row's key."""
    if not bounds:
        return F.lit(0)
    fields = [df.schema[k.name] for k in keys]
    kind = T.ArrayType(T.StructType([T.StructField(f"k{n}", f.dataType) for n, f in enumerate(fields)]))

    def literal(rows: Sequence[Row]) -> Column:
        each = [F.struct(*[F.lit(v).cast(f.dataType).alias(f"k{n}") for n, (v, f) in enumerate(zip(r, fields, strict=True))]) for r in rows]
        return F.array(*each).cast(kind)

    mine = [F.col(f"`{k.name}`") for k in keys]

    def reached(values: Column) -> Column:
        behind = lambda b: ~before(keys, mine, [b[f"k{n}"] for n in range(len(keys))])
        return F.size(F.filter(values, behind))

    blocks = [bounds[at : at + STEP] for at in range(0, len(bounds), STEP)]
    if len(blocks) == 1:
        return reached(literal(blocks[0]))
    block = reached(literal([b[0] for b in blocks]))  # blocks whose first boundary is reached
    inner = F.array(*[literal(b[1:]) for b in blocks])
    within = F.when(block == 0, F.lit(0)).otherwise((block - 1) * F.lit(STEP) + 1 + reached(F.get(inner, block - 1)))
    return within


def slice_count(df: DataFrame, slices: int | None) -> int:
    return slices or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")))


def running_total(
    df: DataFrame,
    order: Sequence[Column | str | SortKey],
    value: Column | None = None,
    name: str = "running",
    slices: int | None = None,
) -> tuple[DataFrame, int]:
    """``df`` with the sum of ``value`` (default: one a row) over all rows up to and including each, and the sum over all.

    ``value`` is a bigint column without nulls. ``df`` is evaluated three times: give it stored or cheap.
    """
    keys = [sort_key(o) for o in order]
    value = F.lit(1) if value is None else value
    bounds = boundaries(df, keys, slice_count(df, slices))
    amount = value.cast("bigint")
    sliced = df.withColumn(_SLICE, slice_of(df, keys, bounds))
    sums = {r[0]: r[1] for r in sliced.groupBy(_SLICE).agg(F.sum(amount)).collect()}  # a row a slice
    totals = [0]
    for k in range(len(bounds) + 1):
        totals.append(totals[-1] + sums.get(k, 0))
    so_far = Window.partitionBy(_SLICE).orderBy(*[k.column() for k in keys]).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    base = F.get(F.array(*[F.lit(t).cast("bigint") for t in totals[:-1]]), F.col(_SLICE))
    return sliced.withColumn(name, F.sum(amount).over(so_far) + base).drop(_SLICE), totals[-1]
