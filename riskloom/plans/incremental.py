"""Period-by-period loads of the master, and firm state that follows them.

**Master.** The stored table has a folder for each period and every master column but the record id, which depends on all rows and
is given when the table is read. A load replaces its own period and recomputes changes only for rows that can differ: the
next row of each (firm, category) of the period's old and new rows, which may lie in any later period. Only the periods with such
rows are written again (dynamic partition overwrite), and a load of the latest period writes one folder. Of the other periods, four
narrow columns are read, joined with the loaded keys, and reduced to the row before and the row after for each key.

**State.** A period's (firm, period, type) sums are all that the risk base needs, and depend on that period only, so they are stored
and replaced by period; the base is one aggregate over them and the fact is not read again.

Defined cases: a load of an empty batch for named periods empties these periods; a period loaded twice is replaced; periods may
come in any order; a table that does not exist yet is made of the whole batch. Later, a batch may hold several periods; they are
loaded one after the other.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import contract as K
from riskloom.plans import master as M
from riskloom.plans import risk as R
from riskloom.session import materialise, stored_path
from riskloom.sources.sinks import table_exists

KEYS = [K.FIRM, K.CAT]
#: Columns that depend on the row before.
CHANGES = ["complaints_change_abs", "complaints_change_pct", "upheld_change_ppts"]
#: Files of a period that a load writes at most.
FILES = 8
STORED = [c for c in M.MASTER_OUT if c != "record_id"]


def load_periods(spark: SparkSession, path: str, batch: DataFrame, orders: Sequence[int] | None = None) -> list[int]:
    """Load the periods of ``batch`` (the fact's columns) into the master at ``path``; return the orders of all periods written.

    ``orders`` names the periods when the batch may lack rows for some of them (default: the periods that it holds)."""
    if not table_exists(spark, path):
        _replace(M.change_rows(M.first_rows(batch)), path)
        return sorted(_orders(read_stored(spark, path)) if orders is None else orders)
    batch = materialise(M.first_rows(batch), "batch")
    if orders is None:
        orders = _orders(batch)
    written = set()
    for order in sorted(orders):
        written.update(_load_one(spark, path, batch.filter(F.col(K.ORDER) == order), int(order)))
    return sorted(written)


def _orders(rows: DataFrame) -> list[int]:
    return [r[0] for r in rows.select(K.ORDER).distinct().collect()]  # one row a period


def _load_one(spark: SparkSession, path: str, new: DataFrame, order: int) -> list[int]:
    stored = read_stored(spark, path)
    at = F.col(K.ORDER)
    keys = new.select(*KEYS).union(stored.filter(at == order).select(*KEYS)).distinct()
    others = stored.filter(at != order).select(*KEYS, K.ORDER, K.OPENED, K.UPHELD_T).join(keys, KEYS, "left_semi")
    seen = F.struct(K.ORDER, K.OPENED, K.UPHELD_T)
    around = materialise(others.groupBy(*KEYS).agg(
        F.max(F.when(at < order, seen)).alias("prev"), F.min(F.when(at > order, seen)).alias("next")
    ), "around")
    later = _orders(around.filter("next is not null").select("next.*"))
    before = around.filter("prev is not null").select(*KEYS, "prev.*")
    after = around.filter("next is not null").select(*KEYS, "next.*")
    fact = [c for c in new.columns if c in stored.columns]
    changed = M.change_rows(new.select(*fact).unionByName(before, allowMissingColumns=True)).filter(at == order)
    # the rows after: their changes follow from narrow columns (at most three rows for each key), all else stays as it is
    narrow = new.select(*before.columns).unionByName(before).unionByName(after)
    fixed = M.add_changes(narrow, KEYS, K.ORDER, K.OPENED, K.UPHELD_T).filter(at.isin(later))
    fixed = fixed.select(*KEYS, K.ORDER, F.struct(*CHANGES).alias("fixed"))
    rest = stored.filter(at.isin(later)).join(fixed, [*KEYS, K.ORDER], "left").withColumns(
        {c: F.when(F.col("fixed").isNotNull(), F.col("fixed")[c]).otherwise(F.col(c)) for c in CHANGES}
    )
    _replace(changed.unionByName(rest.select(*STORED)), path, clear=order if new.isEmpty() else None)
    return [order, *later]


def _replace(rows: DataFrame, path: str, clear: int | None = None) -> None:
    """Write the rows' periods in place of the stored ones. They are stored aside first: they are read from the same folders.

    Aside they lie by period as well, in as many files as there were tasks; each period's files are then read by FILES tasks, so the
    rows need no further exchange for a period to have few files."""
    spark = rows.sparkSession
    aside = stored_path(spark, "load")
    rows.select(*STORED).write.partitionBy(K.ORDER).parquet(aside)
    rows = read_stored(spark, aside, rows.select(*STORED).schema)
    parts = [rows.filter(F.col(K.ORDER).eqNullSafe(o)).coalesce(FILES) for o in _orders(rows)]
    dealt = reduce(DataFrame.union, parts, rows.limit(0) if not parts else parts.pop())
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(K.ORDER).parquet(path)
    if clear is not None and table_exists(spark, gone := os.path.join(path, f"{K.ORDER}={clear}")):
        spark.createDataFrame([], rows.drop(K.ORDER).schema).write.mode("overwrite").parquet(gone)


def read_stored(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """The stored rows, without record ids. ``schema``: for a folder that may hold no file."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path).withColumn(K.ORDER, F.col(K.ORDER).cast("int")).select(*STORED)


def read_loaded(spark: SparkSession, path: str) -> DataFrame:
    """The master with its record ids."""
    rows = read_stored(spark, path)
    return M.numbered(rows)


# ------------------------------------------------------------------------------------------ state of firms


def load_state(spark: SparkSession, path: str, batch: DataFrame) -> None:
    """Replace the state of the periods that ``batch`` holds."""
    rows = materialise(R.firm_periods(batch), "state")
    dealt = rows.repartition(F.col(K.ORDER), F.pmod(F.xxhash64(K.FIRM), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(K.ORDER).parquet(path)


def read_state(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn(K.ORDER, F.col(K.ORDER).cast("int"))


def risk_index_from_state(spark: SparkSession, path: str, min_total: int = K.MIN_TOTAL) -> DataFrame:
    """The risk index of all periods loaded so far."""
    return R.index_from_base(materialise(R.prepared_from_periods(read_state(spark, path), min_total), "risk-base"))
