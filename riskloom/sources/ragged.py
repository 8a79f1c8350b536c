"""One scan over many CSV sheets whose headers differ.

``spark.read.csv`` takes one header for all its files, so sheets whose columns drift between periods used to be one scan each. Here
all files are one text scan. Each file's header is its first line, found by a grouped minimum over the position of the lines; headers
are harmonised on the driver (one line a file) and become a *layout*: for each file the places of firm name, group, type and of each
category. The layout is broadcast (a row a file), lines are split by ``from_csv`` into an array of strings, and each
line yields one row for each category it has a value of. The plan has one file scan for any number of periods and sheets.

A sheet may be a file or a folder of part files, each with its own header line; part files follow one another by name.
"""

from __future__ import annotations

import csv
import warnings
from collections.abc import Iterable, Sequence
from typing import NamedTuple
from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom import contract as K
from riskloom.functions.numeric import coerce_numeric
from riskloom.functions.rules import harmonised_name

#: Part files of a sheet are numbered in front of the position in a file.
PART_BITS = 40
#: Firm types of the opened sheets up to which a type is carried as its rank, so that grouped values have a fixed width.
MOST_TYPES = 1000


class Sheet(NamedTuple):
    """A resolved sheet: its period's source, its measure, and the path of the file or folder."""

    source: str
    measure: str
    path: str


def scan_lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """path, block_start, pos, line of every line of all files, in one scan.

    ``pos`` ascends within a file: a task reads no more bytes than one split has, so the row's number in the task is smaller than
    the distance to the next split's beginning."""
    raw = spark.read.text(list(paths))
    row = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    start = F.col("_metadata.file_block_start")
    return raw.select(
        F.col("_metadata.file_path").alias("path"), start.alias("block_start"), (start + row).alias("pos"), F.col("value").alias("line")
    )


def plain_path(path: str) -> str:
    """A path without scheme, host and escapes, to compare what was asked for with what the scan names."""
    parts = urlsplit(path)
    return (unquote(parts.path) if parts.scheme else path).rstrip("/")


class Layout(NamedTuple):
    """Where one file's columns are, and where its rows begin."""

    path: str
    source: str
    measure: str
    head: int
    first_pos: int
    firm_at: int
    group_at: int | None
    type_at: int | None
    cells: list[tuple[str, int]]


LAYOUT = (
    "path string, source string, measure string, head bigint, first_pos bigint, firm_at int, group_at int, type_at int, "
    "cells array<struct<category: string, at: int>>"
)


def header_names(line: str, rules=K.HEADER_RULES) -> list[str]:
    """The harmonised column names of a header line; two columns of one name are an error."""
    given = next(csv.reader([line]), [])
    names = [harmonised_name(c, rules) for c in given]
    for k, name in enumerate(names):
        if name in names[:k]:
            raise ValueError(f"columns {given[names.index(name)]!r} and {given[k]!r} both map to {name!r}")
    return names


def layouts(heads: Iterable, sheets: Sequence[Sheet], categories: Sequence[str], rules=K.HEADER_RULES) -> tuple[list[Layout], int]:
    """The layout of each file, and the largest number of columns. ``heads``: rows (path, head, line), one a file.

    Files of a sheet that cannot be used, and all files of a source without a usable opened sheet, are left out with a warning."""
    asked = {plain_path(s.path): s for s in sheets}
    found: list[Layout] = []
    width, numbers = 1, {}
    for head in sorted(heads, key=lambda h: h["path"]):
        path = plain_path(head["path"])
        sheet = asked.get(path) or asked.get(path.rsplit("/", 1)[0])
        if sheet is None:
            raise ValueError(f"no sheet was asked for at {head['path']}")
        names = header_names(head["line"], rules)
        width = max(width, len(names))
        at = {n: k for k, n in enumerate(names)}
        cells = [(c, at[c]) for c in categories if c in at]
        number = numbers[sheet] = numbers.get(sheet, -1) + 1
        if "firm_name" not in at or not cells:
            warnings.warn(f"sheet without firm or category columns, left out: {sheet.source}, {sheet.measure}")
            continue
        found.append(Layout(head["path"], sheet.source, sheet.measure, head["head"], number << PART_BITS, at["firm_name"],
                            at.get("group"), at.get(K.TYPE), cells))
    opened = {x.source for x in found if x.measure == "opened"}
    for source in sorted({s.source for s in sheets} - opened):
        warnings.warn(f"source without a usable opened sheet, left out: {source}")
    return [x for x in found if x.source in opened], width


def read_sheets(spark: SparkSession, sheets: Sequence[Sheet], categories: Sequence[str] = K.PRODUCT_CATS,
                rules=K.HEADER_RULES) -> tuple[DataFrame, bool, list[str] | bool]:
    """All values of all sheets as rows (source, firm_name, group, category, measure, value, pos, given_type, has_group),
    whether some sheet has no group, and the firm types of the opened sheets in order (True: more than MOST_TYPES, False: no sheet
    carries any)."""
    paths = sorted({s.path for s in sheets})
    lines = scan_lines(spark, paths)
    first = lines.where(F.col("block_start") == 0).groupBy("path").agg(F.min_by("line", "pos").alias("line"), F.min("pos").alias("head"))
    known, width = layouts(first.collect(), sheets, categories, rules)  # a row a file
    if not known:
        raise ValueError("no readable 'opened' sheet in any source: nothing to assemble")
    typed = [x for x in known if x.measure == "opened" and x.type_at is not None]
    rows = _with_fields(lines, known, width)
    field = lambda at: F.get("fields", F.col(at))
    values = rows.select(
        "source", field("firm_at").alias("firm_name"), field("group_at").alias("group"), "measure",
        (F.col("first_pos") + F.col("pos")).alias("pos"),
        F.when(F.col("measure") == "opened", field("type_at")).alias("given_type"),
        F.col("group_at").isNotNull().alias("has_group"), "fields", F.explode("cells").alias("cell"),
    )
    values = values.select(
        "source", "firm_name", "group", F.col("cell.category").alias(K.CAT), "measure",
        coerce_numeric(F.get("fields", F.col("cell.at"))).alias("value"), "pos", "given_type", "has_group",
    ).where(F.col("value").isNotNull())
    return values, any(x.group_at is None for x in known), _given_types(spark, sheets, typed, width) if typed else False


def _with_fields(lines: DataFrame, known: Sequence[Layout], width: int) -> DataFrame:
    """The lines behind the header of the files of ``known``, with their layout and their fields."""
    layout = lines.sparkSession.createDataFrame([tuple(x) for x in known], LAYOUT).withColumnRenamed("path", "of").coalesce(1)
    rows = lines.join(F.broadcast(layout), F.col("path") == F.col("of"))
    rows = rows.where((F.col("pos") > F.col("head")) & (F.trim("line") != ""))
    fields = F.from_csv("line", ", ".join(f"c{k} string" for k in range(width)))
    # a generator of one row: filters on fields stay above it, where the line is not parsed anew for each use of a field
    rows = rows.select("*", F.explode(F.array(fields)).alias("csv"))
    return rows.withColumn("fields", F.array(*[F.col(f"csv.c{k}") for k in range(width)]))


def _given_types(spark: SparkSession, sheets: Sequence[Sheet], typed: Sequence[Layout], width: int) -> list[str] | bool:
    """The firm types in the opened sheets, in order, or True if there are more than MOST_TYPES. Reads those sheets only."""
    opened = sorted({s.path for s in sheets if s.measure == "opened"})
    rows = _with_fields(scan_lines(spark, opened), typed, width)
    found = rows.select(F.get("fields", F.col("type_at")).alias("t")).where("t is not null").distinct().limit(MOST_TYPES + 1).collect()
    return sorted(r["t"] for r in found) if len(found) <= MOST_TYPES else True
