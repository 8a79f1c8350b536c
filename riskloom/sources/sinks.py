"""Sinks: the master table, named result tables, per-query outputs, the findings report.

All writes are Spark writers into a folder the caller names (on a cluster: shared storage). The
master is written once and read by every analysis, bucketed by firm so that per-firm aggregations
and windows - nearly every query - find their input already clustered and skip the shuffle.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import nan_to_null


def write_master(df: DataFrame, path: str, partition_by: str | None = K.LABEL, mode: str = "overwrite",
                 files_per_partition: int = 8, spread_by: str = K.FIRM) -> None:
    """Master fact as Parquet, partitioned by period (period filters prune whole folders).

    Rows are dealt out by (period, hash of the firm) first, so a period has at most ``files_per_partition`` files instead
    of one for each task. Raise the number until a file has a few hundred MB.
    """
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    slot = F.pmod(F.xxhash64(spread_by), F.lit(files_per_partition))
    df.repartition(F.col(partition_by), slot).write.mode(mode).partitionBy(partition_by).parquet(path)


def save_bucketed(df: DataFrame, table: str, buckets: int, by: str = K.FIRM, sort_by: tuple[str, ...] = (K.FIRM, K.ORDER),
                  path: str | None = None, bloom_ndv: int | None = None) -> DataFrame:
    """Save as a bucketed, sorted catalog table and return it read back.

    Rows are dealt out by the bucket hash first, so each bucket is one file. Reads of the table report
    ``HashPartitioning(by, buckets)``, which satisfies any group-by or window whose keys include ``by``.

    ``bloom_ndv``: write Parquet bloom filters of ``by``, sized for so many distinct values in a row group. A lookup of one value then
    reads one bucket (bucket pruning) and of its row groups only those that may hold it; the filters cost about 1.2 bytes a value.
    """
    w = df.repartition(buckets, by).write.mode("overwrite").format("parquet").bucketBy(buckets, by).sortBy(*sort_by)
    if bloom_ndv:
        w = w.option(f"parquet.bloom.filter.enabled#{by}", "true").option(f"parquet.bloom.filter.expected.ndv#{by}", str(bloom_ndv))
    if path:
        w = w.option("path", path)
    w.saveAsTable(table)
    return df.sparkSession.table(table)


#: Types of the master's columns in a CSV export.
MASTER_TYPES = {f.name: f.dataType.simpleString() for f in K.FACT_SCHEMA} | {
    "record_id": "bigint", "complaints_change_abs": "double", "complaints_change_pct": "double",
    "upheld_change_ppts": "double", "high_uphold_flag": "int", "upheld_band": "string",
}


def read_master(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Master fact reader; NaN in a Parquet double is read as null.

    A CSV is matched by header name, in any column order: known columns get their types, ``group`` is accepted for
    ``firm_group``, an empty group is '', and integer tenths that the file lacks are derived from the percentages.
    """
    if fmt != "csv":
        stored = spark.read.parquet(path)
        doubles = [c for c, kind in stored.dtypes if kind == "double"]
        return stored.withColumns({c: nan_to_null(c) for c in doubles}) if doubles else stored
    raw = spark.read.option("header", True).csv(path)
    if K.GROUP not in raw.columns and "group" in raw.columns:
        raw = raw.withColumnRenamed("group", K.GROUP)
    out = raw.select(*[F.col(f"`{c}`").cast(MASTER_TYPES.get(c, "string")).alias(c) for c in raw.columns])
    for rate, tenths in ((K.UPHELD, K.UPHELD_T), (K.CLOSED3, K.CLOSED3_T)):
        if tenths not in out.columns and rate in out.columns:
            out = out.withColumn(tenths, F.rint(F.col(rate) * 10).cast("bigint"))
    return out.na.fill({K.GROUP: ""}) if K.GROUP in out.columns else out


def register_view(df: DataFrame, name: str = "complaints") -> DataFrame:
    """Expose the master to SQL users under the original table name (replace semantics)."""
    df.createOrReplaceTempView(name)
    return df


def write_tables(tables: Mapping[str, DataFrame], base: str, fmt: str = "parquet", compression: str | None = None) -> dict[str, str]:
    """Write several named result tables (the multi-sheet export), one folder each.

    ``compression``: codec of the files, e.g. ``gzip`` for a large CSV (default: the format's own)."""
    out = {}
    for name, df in tables.items():
        path = os.path.join(base, name)
        writer = df.write.mode("overwrite").format(fmt).option("header", True)
        (writer.option("compression", compression) if compression else writer).save(path)
        out[name] = path
    return out


def run_query(name: str, df: DataFrame, out_dir: str, fmt: str = "csv") -> str:
    """Write one query result as ``<out_dir>/<name>``; errors propagate (never an empty result)."""
    path = os.path.join(out_dir, name)
    df.write.mode("overwrite").format(fmt).option("header", True).save(path)
    return path


# ------------------------------------------------------------------------------------------ sets of tables, committed together


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def table_exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def commit_set(tables: Mapping[str, DataFrame | Callable[[], DataFrame]], base: str, spark: SparkSession, fmt: str = "parquet") -> str:
    """Write several tables so that readers see all of them or none; return the folder of the new set.

    Every table goes to a new folder ``<base>/sets/<id>``. When all are written, the pointer ``<base>/CURRENT`` is replaced by one
    rename. Any failure leaves the pointer on the old set, and a reader that has opened a set keeps its files. A value may be a
    function that makes its table, so a plan can be built when the tables before it are written.
    """
    name = uuid.uuid4().hex
    for table, df in tables.items():
        made = df() if callable(df) else df
        made.write.mode("error").format(fmt).option("header", True).save(os.path.join(base, "sets", name, table))
    _point(spark, base, name, fmt, list(tables))
    return os.path.join(base, "sets", name)


def _point(spark: SparkSession, base: str, name: str, fmt: str, tables: list[str]) -> None:
    """Replace the pointer file: written beside it, then renamed over it (atomic on HDFS and local file systems)."""
    jvm = spark.sparkContext._jvm
    new, fs = _path(spark, os.path.join(base, f".CURRENT-{name}"))
    out = fs.create(new, True)
    out.write(bytearray("\n".join([name, fmt, *tables]).encode()))
    out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(new), fs.makeQualified(_path(spark, os.path.join(base, "CURRENT"))[0]), options)


def current_set(spark: SparkSession, base: str) -> dict[str, str]:
    """Table name -> folder of the committed set (empty: none was committed yet)."""
    if not table_exists(spark, os.path.join(base, "CURRENT")):
        return {}
    name, _, *tables = _pointer(spark, base)
    return {t: os.path.join(base, "sets", name, t) for t in tables}


def _pointer(spark: SparkSession, base: str) -> list[str]:
    return [r.value for r in spark.read.text(os.path.join(base, "CURRENT"), wholetext=True).collect()][0].split("\n")


def read_set(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The tables of the committed set; a KeyError for a table it lacks is the caller's to see."""
    paths = current_set(spark, base)
    if not paths:
        raise FileNotFoundError(f"no set was committed in {base}")
    fmt = _pointer(spark, base)[1]
    return {t: spark.read.format(fmt).option("header", True).load(p) for t, p in paths.items()}


def drop_old_sets(spark: SparkSession, base: str) -> int:
    """Delete all sets but the committed one (when no reader uses them any more); return their number."""
    now = {os.path.basename(os.path.dirname(p)) for p in current_set(spark, base).values()}
    p, fs = _path(spark, os.path.join(base, "sets"))
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in now] if fs.exists(p) and now else []
    return sum(fs.delete(o, True) for o in old)


class OutputErrors(RuntimeError):
    """Outputs of a stage that failed (``errors``: name -> exception); all others were written."""

    def __init__(self, errors: dict[str, Exception]):
        super().__init__("; ".join(f"{n}: {type(e).__name__}" for n, e in errors.items()))
        self.errors = errors


def run_queries(outputs: Mapping[str, Callable[[], DataFrame]], out_dir: str, fmt: str = "csv") -> list[str]:
    """:func:`run_query` for each output. A failing one does not stop the others; all failures are raised together at the end."""
    written, errors = [], {}
    for name, make in outputs.items():
        try:
            written.append(run_query(name, make(), out_dir, fmt))
        except Exception as e:  # noqa: BLE001 - raised below with its name
            errors[name] = e
    if errors:
        raise OutputErrors(errors)
    return written
