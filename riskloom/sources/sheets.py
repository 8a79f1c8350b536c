"""Ingest of periodic wide sheets: resolve, harmonise headers, unpivot, assemble the master rows.

A *sheet* is a wide DataFrame of string columns: firm name, group, one column per product
category, one measure per sheet (opened, closed, upheld rate, closed-within-3-days rate). Sheets of
all periods are read in one scan and tagged with their source (``spark.read.csv([...])`` plus
``_metadata.file_path`` or a ``source`` column); the tag is joined to the period manifest.

Deliberate deviations from the original cleaning stage (documented):
* firm names are trimmed on *every* measure before joining (the original trimmed only the base,
  so padded names silently lost their measures);
* the group key is compared null-safely;
* of rows that share source, firm, group and category, assembly emits the first one of each sheet (the original's
  duplicates only lived until its next step, which kept the first one of each firm, category and period);
* two headers that harmonise to the same target raise an error instead of producing duplicate
  columns.
"""

from __future__ import annotations

import os
import re
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import rint_dp
from riskloom.functions.rules import classify, harmonised_name, unify_names
from riskloom.operators.reshape import melt_measure
from riskloom.sources.ragged import Sheet, read_sheets

MEASURE_VALUE = {
    "opened": "complaints_opened",
    "closed": "complaints_closed",
    "upheld": "upheld_rate",
    "threeday": "pct_closed_3days_raw",
}


# ------------------------------------------------------------------------------ sheet resolution


def resolve_sheets(catalog: DataFrame, rules: Mapping[str, Sequence[str]] = K.SHEET_KEYWORDS,
                   source_col: str = "source", name_col: str = "sheet_name", pos_col: str = "sheet_pos") -> DataFrame:
    """For each (source, measure): the first sheet in file order whose lower-trimmed name contains
    any of the measure's keywords. ``catalog`` lists (source, sheet_name, sheet_pos).

    The keyword lists are a small driver-side constant; they become a literal array per measure.
    Missing optional measures simply have no row.
    """
    low = F.lower(F.trim(F.col(name_col)))
    per_measure = []
    for measure, kws in rules.items():
        hit = None
        for kw in kws:
            c = low.contains(kw)
            hit = c if hit is None else (hit | c)
        per_measure.append(
            catalog.filter(hit)
            .groupBy(source_col)
            .agg(F.min_by(F.col(name_col), F.col(pos_col)).alias(name_col))
            .withColumn("measure", F.lit(measure))
        )
    out = per_measure[0]
    for df in per_measure[1:]:
        out = out.unionByName(df)
    return out


# -------------------------------------------------------------------------- header harmonisation


def harmonise_columns(df: DataFrame, rules=K.HEADER_RULES) -> DataFrame:
    """Rename columns by the ordered header rules (pure name -> name mapping, one ``toDF``)."""
    new = [harmonised_name(c, rules) for c in df.columns]
    seen: dict[str, str] = {}
    for old, target in zip(df.columns, new):
        if target in seen:
            raise ValueError(f"columns {seen[target]!r} and {old!r} both map to {target!r}")
        seen[target] = old
    return df.toDF(*new)


# --------------------------------------------------------------------------------- unpivot/load


def with_position(sheet: DataFrame) -> DataFrame:
    """The sheet with the position of each row in it (``ROW_POS``), unless it has that column already."""
    return sheet if K.ROW_POS in sheet.columns else sheet.withColumn(K.ROW_POS, F.monotonically_increasing_id())


def melt_sheets(
    sheets: Mapping[str, DataFrame],
    categories: Sequence[str] = K.PRODUCT_CATS,
    ids: Sequence[str] = ("source", "firm_name", "group", K.TYPE),
) -> dict[str, DataFrame]:
    """Harmonise and unpivot each measure sheet; measures that cannot be read are left out.

    Returns measure -> long DataFrame ``(ids present..., ROW_POS, product_category, <measure value>)``.
    """
    out: dict[str, DataFrame] = {}
    for measure, sheet in sheets.items():
        if sheet is None:
            continue
        long = melt_measure(with_position(harmonise_columns(sheet)), MEASURE_VALUE[measure], ids=(*ids, K.ROW_POS),
                            categories=categories)
        if long is not None:
            out[measure] = long
    if "opened" not in out:
        raise ValueError("no readable 'opened' sheet: nothing to assemble")
    return out


def unpivot_long(long: Mapping[str, DataFrame]) -> DataFrame:
    """All measures stacked: (source, firm_name, group, firm_type, product_category, measure, value)."""
    frames = []
    for measure, df in long.items():
        frames.append(df.drop(K.ROW_POS).withColumnRenamed(MEASURE_VALUE[measure], "value").withColumn("measure", F.lit(measure)))
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def assemble_measures(
    long: Mapping[str, DataFrame],
    manifest: DataFrame,
    source_col: str = "source",
    rules=K.FIRM_TYPE_RULES,
    default_type: str = K.FIRM_TYPE_DEFAULT,
    alias_map: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row per source, firm, group and category of the opened sheets (rows with a usable firm name), with the
    closed / upheld / 3-day values of the same key; period columns from the manifest; rates to 1-dp percentages; firm type
    by the keyword rules unless the sheet carries it. Emits the master columns (before change metrics), the integer-tenth
    helpers and ``ROW_POS``, the row's position in its opened sheet. ``alias_map`` unifies firm spellings after
    assembly, so every later analysis sees the same firms (the original only unified them in the notebook).

    All measures are stacked and grouped once: the first value of each measure by ``ROW_POS`` (fixed-width buffers, so a
    hash aggregate with one shuffle) instead of three joins. Whether the group is part of a measure's key is decided for each
    source: rows of a sheet without group (no ``group`` column, or ``has_group`` false) match every group of the firm.
    """
    stacked, ungrouped = [], []
    for measure, df in long.items():
        flagged = "has_group" in df.columns
        grouped = df if flagged or "group" in df.columns else None
        row = [
            F.col(source_col), F.trim(F.col("firm_name")).alias("firm_name"),
            (F.col("group") if grouped is not None else F.lit(None).cast("string")).alias("group"), F.col(K.CAT),
            F.lit(measure).alias("measure"), F.col(MEASURE_VALUE[measure]).alias("value"),
            (F.col(K.ROW_POS) if K.ROW_POS in df.columns else F.lit(0).cast("bigint")).alias("pos"),
            (F.col(K.TYPE) if K.TYPE in df.columns and measure == "opened" else F.lit(None).cast("string")).alias("given_type"),
        ]
        if measure == "opened":  # an opened sheet without group has the group ''
            if grouped is None:
                row[2] = F.lit("").alias("group")
            elif flagged:
                row[2] = F.when(F.col("has_group"), F.col("group")).otherwise(F.lit("")).alias("group")
            stacked.append(df.select(*row))
        elif grouped is None:
            ungrouped.append(df.select(*row))
        elif flagged:
            stacked.append(df.filter(F.col("has_group")).select(*row))
            ungrouped.append(df.filter(~F.col("has_group")).select(*row))
        else:
            stacked.append(df.select(*row))
    usable = F.col("firm_name").isNotNull() & (F.col("firm_name") != "") & (F.col("firm_name") != "nan")
    of = lambda measure, x: F.when(F.col("measure") == measure, F.col(x))
    firsts = lambda names: [F.min_by(of(m, "value"), of(m, "pos")).alias(MEASURE_VALUE[m]) for m in names]
    rights = [m for m in MEASURE_VALUE if m != "opened"]
    base = (
        _union(stacked).filter(usable)
        .groupBy(source_col, "firm_name", "group", K.CAT)
        .agg(*firsts(MEASURE_VALUE), F.min(of("opened", "pos")).alias(K.ROW_POS), F.min("given_type").alias("given_type"))
        .filter(F.col(K.ROW_POS).isNotNull())
        .withColumn("complaints_opened", F.coalesce(F.col("complaints_opened"), F.lit(0.0)).cast("bigint"))
    )
    if ungrouped:
        loose = _union(ungrouped).groupBy(source_col, "firm_name", K.CAT).agg(*firsts(rights))
        loose = loose.withColumnsRenamed({MEASURE_VALUE[m]: f"{m}_loose" for m in rights})
        base = base.join(loose, [source_col, "firm_name", K.CAT], "left").withColumns(
            {MEASURE_VALUE[m]: F.coalesce(MEASURE_VALUE[m], f"{m}_loose") for m in rights}
        )
    base = base.withColumn(K.TYPE, F.col("given_type")) if K.TYPE in long["opened"].columns else base
    return _master_rows(base, manifest, source_col, rules, default_type, alias_map)


def assemble_stacked(
    rows: DataFrame,
    manifest: DataFrame,
    loose: bool,
    typed: Sequence[str] | bool,
    rules=K.FIRM_TYPE_RULES,
    default_type: str = K.FIRM_TYPE_DEFAULT,
    alias_map: Mapping[str, str] | None = None,
) -> DataFrame:
    """:func:`assemble_measures` of the values of :func:`riskloom.sources.ragged.read_sheets`, without reading them twice.

    ``loose``: some sheets have no group. Their values are grouped with the others under a mark of their own and reach the
    groups of their firm by a window over (source, firm, category), which holds a firm's groups only. ``typed``: the firm types of
    the opened sheets in order (or whether there are any). Given as a list, the least type of a group is its least rank there: all
    grouped values then have a fixed width, and no task sorts its rows."""
    opened = F.col("measure") == "opened"
    group = F.when(opened & ~F.col("has_group"), F.lit("")).otherwise(F.col("group")).alias("group")
    of = lambda measure, x: F.when(F.col("measure") == measure, F.col(x))
    named = rows.select("source", F.trim("firm_name").alias("firm_name"), group, K.CAT, "measure", "value", "pos", "given_type",
                        (~opened & ~F.col("has_group")).alias("loose"))
    named = named.filter(F.col("firm_name").isNotNull() & (F.col("firm_name") != "") & (F.col("firm_name") != "nan"))
    keys = ["source", "firm_name", "group", K.CAT, *(["loose"] if loose else [])]
    ranked = not isinstance(typed, bool)
    ranks = F.create_map(*[F.lit(x) for k, t in enumerate(typed) for x in (t, k)]) if ranked and typed else None
    kind = F.col("given_type") if not ranked else F.lit(None).cast("int") if ranks is None else F.element_at(ranks, F.col("given_type"))
    base = named.withColumn("given_type", kind).groupBy(*keys).agg(
        *[F.min_by(of(m, "value"), of(m, "pos")).alias(v) for m, v in MEASURE_VALUE.items()],
        F.min(of("opened", "pos")).alias(K.ROW_POS), F.min("given_type").alias("given_type"),
    )
    if loose:
        firm = Window.partitionBy("source", "firm_name", K.CAT)
        shared = lambda v: F.max(F.when(F.col("loose"), F.col(v))).over(firm)
        base = base.withColumns({v: F.coalesce(F.col(v), shared(v)) for m, v in MEASURE_VALUE.items() if m != "opened"})
        base = base.filter(~F.col("loose"))
    base = base.filter(F.col(K.ROW_POS).isNotNull())
    base = base.withColumn("complaints_opened", F.coalesce(F.col("complaints_opened"), F.lit(0.0)).cast("bigint"))
    if ranked:
        base = base.withColumn("given_type", F.get(F.array(*[F.lit(t) for t in typed]).cast("array<string>"), F.col("given_type")))
    base = base.withColumn(K.TYPE, F.col("given_type")) if typed is not False else base
    return _master_rows(base, manifest, "source", rules, default_type, alias_map)


def _master_rows(base: DataFrame, manifest: DataFrame, source_col: str, rules, default_type: str,
                 alias_map: Mapping[str, str] | None) -> DataFrame:
    """The master columns of assembled rows: firm type by rules unless given, period columns, rates as percentages."""
    typed = base if K.TYPE in base.columns else base.withColumn(K.TYPE, classify("firm_name", rules, default_type))
    periods = F.broadcast(manifest)  # one row for each report file
    with_period = typed.join(periods, typed[source_col] == manifest[K.LABEL]) if source_col != K.LABEL else typed.join(periods, K.LABEL)
    upheld = rint_dp(F.col("upheld_rate") * F.lit(100.0), 1)
    three = rint_dp(F.col("pct_closed_3days_raw") * F.lit(100.0), 1)
    out = with_period.select(
        "firm_name",
        F.coalesce(F.trim(F.col("group")), F.lit("")).alias(K.GROUP),
        K.CAT,
        "complaints_opened",
        F.col("complaints_closed").cast("double").alias(K.CLOSED),
        K.LABEL,
        K.ORDER,
        "period_start",
        "period_end",
        "year",
        "half",
        K.DUTY,
        upheld.alias(K.UPHELD),
        three.alias(K.CLOSED3),
        K.TYPE,
        F.rint(upheld * F.lit(10.0)).cast("bigint").alias(K.UPHELD_T),
        F.rint(three * F.lit(10.0)).cast("bigint").alias(K.CLOSED3_T),
        K.ROW_POS,
    )
    return unify_names(out, alias_map) if alias_map else out


# ---------------------------------------------------------------------- manifests and test sheets


def manifest_df(spark: SparkSession, manifest=K.PERIOD_MANIFEST, pre_periods=K.PRE_DUTY_PERIODS) -> DataFrame:
    """The period manifest as a tiny DataFrame (one row per source file)."""
    return spark.createDataFrame(K.manifest_rows(manifest, pre_periods), K.MANIFEST_SCHEMA).drop("file_pos", "file")


def fact_manifest(fact: DataFrame) -> DataFrame:
    """Period manifest derived from a fact (one row per period)."""
    return fact.select(K.LABEL, K.ORDER, "period_start", "period_end", "year", "half", K.DUTY).distinct()


# header spellings per measure sheet: the same sheets drift between readers
FIXTURE_HEADERS = {
    "opened": ("Firm Name", "Group"),
    "closed": ("firm_name", "Group Name"),
    "upheld": (" FIRM NAME ", "group"),
    "threeday": ("Firm_Name", "GROUP NAME"),
}


def fixture_sheets(fact: DataFrame, categories: Sequence[str], suppressed: str = "*",
                   materialise: bool = False) -> dict[str, DataFrame]:
    """Wide all-string sheets per measure derived from a fact (one pivot, one scan).

    Every sheet holds all periods (``source`` = period label) - the stacked equivalent of one file
    per period. Rates are 0-1 fractions; a suppressed rate is ``'*'``; an absent (firm, category)
    cell is null. Firm names on the upheld sheet are padded to exercise trimming.
    ``materialise`` stores the pivot once (the stand-in for writing the sheet files), so the
    four sheets are reads of stored data rather than four recomputations of the pivot.
    """
    none = F.lit(float("nan"))  # a missing rate, apart from an absent row: numbers have a fixed width, texts would be sorted to group
    cells = {
        "opened": F.col(K.OPENED).cast("bigint"), "closed": F.col(K.CLOSED).cast("bigint"),
        "upheld": F.coalesce(F.col(K.UPHELD_T) / F.lit(1000.0), none), "threeday": F.coalesce(F.col(K.CLOSED3_T) / F.lit(1000.0), none),
    }
    firsts = fact.groupBy(F.col(K.LABEL).alias("source"), K.FIRM, K.GROUP, K.TYPE).agg(
        *[F.first(F.when(F.col(K.CAT).eqNullSafe(F.lit(c)), x), ignorenulls=True).alias(f"{c}_{m}") for c in categories for m, x in cells.items()]
    )
    shown = lambda x, m: x.cast("string") if m in ("opened", "closed") else F.when(F.isnan(x), suppressed).otherwise(x.cast("string"))
    wide = firsts.select(
        "source", K.FIRM, K.GROUP, K.TYPE, *[shown(F.col(f"`{c}_{m}`"), m).alias(f"{c}_{m}") for c in categories for m in cells]
    )
    if materialise:
        from riskloom.session import materialise as store

        wide = store(wide, "fixture-sheets")
    sheets = {}
    for measure, (firm_h, group_h) in FIXTURE_HEADERS.items():
        name = F.concat(F.lit("  "), F.col(K.FIRM), F.lit(" ")) if measure == "upheld" else F.col(K.FIRM)
        sheets[measure] = wide.select(
            "source",
            name.alias(firm_h),
            F.col(K.GROUP).alias(group_h),
            K.TYPE,
            *[F.col(f"`{c}_{measure}`").alias(c) for c in categories],
        )
    return sheets


# ------------------------------------------------------------------------ file-based period scan


def _list_dir(spark: SparkSession, path: str) -> list[str] | None:
    """Names in a folder on any Hadoop file system (local, HDFS, object stores); None if absent."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return None
    return sorted(st.getPath().getName() for st in fs.listStatus(hpath))


SHEET_ORDER_FILE = "sheet_order.txt"


def sheet_positions(names: Sequence[str], order: Sequence[str] | None) -> list[tuple[str, int]]:
    """(sheet name, place in the workbook) of CSV exports, by an order list or by numeric prefixes ("02 Closed").

    The place decides which sheet a keyword finds, so a folder that tells neither is an error (a single sheet needs none).
    """
    if order is not None:
        missing = [n for n in names if n not in order]
        if missing:
            raise ValueError(f"sheets that {SHEET_ORDER_FILE} does not list: {missing}")
        return [(n, order.index(n)) for n in names]
    numbered = [re.fullmatch(r"(\d+)[ ._-]+(.+)", n) for n in names]
    if all(numbered):
        return [(m[2], int(m[1])) for m in numbered]
    if len(names) == 1:
        return [(names[0], 0)]
    raise ValueError(f"workbook order of the sheets {list(names)} is unknown: number them, or list them in {SHEET_ORDER_FILE}")


def workbook_catalog(spark: SparkSession, base_dir: str, manifest=K.PERIOD_MANIFEST) -> DataFrame:
    """Sheet catalog ``(source, sheet_name, sheet_pos, path)`` of the period files present.

    Layout: ``<base_dir>/<file stem>/<sheet name>.csv`` - one folder per period workbook, one CSV export per sheet; the
    workbook's sheet order is given by a file ``sheet_order.txt`` (a name per line) or by numbers before the names.
    A missing period folder is skipped with a warning; no folder at all is an error.
    """
    rows = []
    for file, label, *_ in manifest:
        folder = os.path.join(base_dir, file.rsplit(".", 1)[0])
        names = _list_dir(spark, folder)
        if names is None:
            warnings.warn(f"period file not found, skipped: {folder}")
            continue
        order = None
        if SHEET_ORDER_FILE in names:
            text = spark.read.option("wholetext", True).text(os.path.join(folder, SHEET_ORDER_FILE)).first()
            order = [x.strip() for x in (text[0] if text else "").splitlines() if x.strip()]
        sheets = [n[: -len(".csv")] for n in names if n.lower().endswith(".csv")]
        placed = sheet_positions(sheets, order) if sheets else []
        rows += [(label, name, i, os.path.join(folder, f"{n}.csv")) for n, (name, i) in zip(sheets, placed, strict=True)]
    if not rows:
        raise ValueError(f"no period files found under {base_dir}")
    return spark.createDataFrame(rows, "source string, sheet_name string, sheet_pos int, path string")


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    """One CSV sheet as strings, with ``ROW_POS``: where the scan's split begins plus the row's number in the task. A split
    has no more rows than bytes, so the sum ascends over the whole file however it is split."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return raw.select("*", (F.col("_metadata.file_block_start") + row).alias(K.ROW_POS))


def stack_sheets(
    sheets: Mapping[str, Mapping[str, DataFrame]], categories: Sequence[str] = K.PRODUCT_CATS
) -> dict[str, DataFrame]:
    """Long frame per measure of wide sheets given as source -> measure -> sheet, for :func:`assemble_measures`.

    Each sheet is harmonised and unpivoted for itself and says whether it has a group (``has_group``). A sheet that cannot be
    used, and all sheets of a source without a usable opened sheet, are left out with a warning.
    """
    per_measure: dict[str, list[DataFrame]] = {}
    for source, given in sheets.items():
        usable = {}
        for measure, sheet in given.items():
            clean = with_position(harmonise_columns(sheet)).withColumn("source", F.lit(source))
            long = melt_measure(clean, MEASURE_VALUE[measure], ids=("source", "firm_name", "group", K.TYPE, K.ROW_POS),
                                categories=categories)
            if long is None:
                warnings.warn(f"sheet without firm or category columns, left out: {source}, {measure}")
                continue
            has_group = "group" in long.columns
            filled = long if has_group else long.withColumn("group", F.lit(None).cast("string"))
            usable[measure] = filled.withColumn("has_group", F.lit(has_group))
        if "opened" not in usable:
            warnings.warn(f"source without a usable opened sheet, left out: {source}")
            continue
        for measure, df in usable.items():
            per_measure.setdefault(measure, []).append(df)
    if not per_measure:
        raise ValueError("no readable 'opened' sheet in any source: nothing to assemble")
    return {measure: _union(frames) for measure, frames in per_measure.items()}


def load_workbooks(
    spark: SparkSession,
    base_dir: str,
    manifest=K.PERIOD_MANIFEST,
    pre_periods=K.PRE_DUTY_PERIODS,
    categories: Sequence[str] = K.PRODUCT_CATS,
    sheet_rules: Mapping[str, Sequence[str]] = K.SHEET_KEYWORDS,
    alias_map: Mapping[str, str] | None = None,
) -> DataFrame:
    """Manifest-driven scan of every period's sheets into assembled master rows.

    The resolved sheet list and the headers are metadata (at most four sheets per period file) and the only things brought to
    the driver; all files are then one text scan (:mod:`riskloom.sources.ragged`), however their headers differ.
    """
    catalog = workbook_catalog(spark, base_dir, manifest)
    resolved = resolve_sheets(catalog.drop("path"), sheet_rules).join(
        catalog.select("source", "sheet_name", "path"), ["source", "sheet_name"]
    ).collect()
    rows, loose, typed = read_sheets(spark, [Sheet(r["source"], r["measure"], r["path"]) for r in resolved], categories)
    return assemble_stacked(rows, manifest_df(spark, manifest, pre_periods), loose, typed, alias_map=alias_map)
