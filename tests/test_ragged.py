"""One scan over sheets with differing headers: the same master as sheet by sheet."""

import csv
import os

import pytest

from riskloom import contract as K
from riskloom.sources import ragged as RG
from riskloom.sources import sheets as SH

CATS = list(K.PRODUCT_CATS[:2])
SHEETS = {"opened": "1 Opened", "closed": "2 Closed", "upheld": "3 % Upheld"}


def write(base, stem, sheets):
    folder = os.path.join(base, stem)
    os.makedirs(folder, exist_ok=True)
    for name, rows in sheets.items():
        with open(os.path.join(folder, name + ".csv"), "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
    return folder


def three_periods(base):
    a, b = CATS
    write(base, "p one", {
        "1 Opened": [["Firm Name", "Group", a, b], ["A, Ltd", "G", "10", "1,234"], ["A, Ltd", "H", "20", "*"], ["  Pad ", "", "3", "4"],
                     ["A, Ltd", "G", "99", "99"], ["", "G", "7", "7"]],
        "2 Closed": [[b, "FIRM NAME ", a], ["5", "A, Ltd", "6"], ["8", "Pad"]],  # no group, other order, a short line
        "3 % Upheld": [["group name", "firm_name", "other", a], ["G", "A, Ltd", "x", "0.25"], ["H", " A, Ltd", "x", "0.5"]],
    })
    write(base, "p2", {
        "1 Opened": [["note", "firm_name", a, "more", "Group Name"], ['say "hi"', "A, Ltd", "1", "", "G"], ["", "B", "2", "y", "Z"], []],
        "2 Closed": [["Firm Name", "Group", a, b], ["B", "Z", "7", "1"], ["A, Ltd", "G", "nan", "2"]],
    })
    write(base, "p3", {"1 Opened": [["Firm Name", b], ["Ünï", "12"]], "2 Closed": [["Firm Name", "Group", b], ["Ünï", "G", "11"]]})
    return [("p one.xlsx", "H1 2022", 1, "2022-01-01", "2022-06-30"), ("p2.xlsx", "H2 2022", 2, "2022-07-01", "2022-12-31"),
            ("p3.xlsx", "H1 2023", 3, "2023-01-01", "2023-06-30")]


def sheet_by_sheet(spark, base, manifest):
    given = {}
    for file, label, *_ in manifest:
        folder = os.path.join(base, file.rsplit(".", 1)[0])
        given[label] = {m: SH.read_sheet(spark, os.path.join(folder, n + ".csv")) for m, n in SHEETS.items()
                        if os.path.exists(os.path.join(folder, n + ".csv"))}
    return SH.assemble_measures(SH.stack_sheets(given, CATS), SH.manifest_df(spark, manifest, ["H1 2022"]))


def answer(df):
    return sorted(map(str, df.drop(K.ROW_POS).collect()))


def test_same_master_as_sheet_by_sheet_and_one_scan(spark, tmp_path):
    manifest = three_periods(str(tmp_path))
    got = SH.load_workbooks(spark, str(tmp_path), manifest, ["H1 2022"], CATS)
    assert answer(got) == answer(sheet_by_sheet(spark, str(tmp_path), manifest))
    rows = {(r.period_label, r.firm_name, r.firm_group, r.product_category): (r.complaints_opened, r.complaints_closed) for r in got.collect()}
    assert rows["H1 2022", "A, Ltd", "G", CATS[0]] == (10, 6.0) and rows["H1 2022", "A, Ltd", "G", CATS[1]] == (99, 5.0)  # '1,234' is missing
    assert rows["H1 2022", "A, Ltd", "H", CATS[0]] == (20, 6.0) and rows["H1 2022", "Pad", "", CATS[1]] == (4, 8.0)
    assert rows["H1 2023", "Ünï", "", CATS[1]] == (12, None)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("FileScan") == 1 and "SortAggregate" not in plan and "Python" not in plan


def test_scans_do_not_grow_with_periods(spark, tmp_path):
    a, b = CATS
    sheets = []
    for n in range(12):
        folder = write(str(tmp_path), f"q{n}", {"1 Opened": [["Firm Name", "Group", a], ["F", "G", str(n)]],
                                                "2 Closed": [["Group", "Firm Name", b, a], ["G", "F", "1", str(n)]]})
        sheets += [RG.Sheet(f"s{n}", m, os.path.join(folder, SHEETS[m] + ".csv")) for m in ("opened", "closed")]
    rows, loose, typed = RG.read_sheets(spark, sheets, CATS)
    assert (loose, typed) == (False, False)
    assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("FileScan") == 1
    values = {(r.source, r.measure, r.product_category): r.value for r in rows.collect()}
    assert len(values) == 36 and all(values[f"s{n}", "opened", a] == n == values[f"s{n}", "closed", a] for n in range(12))


def test_part_files_of_a_sheet_and_small_splits(spark, tmp_path):
    """A folder of part files, split into pieces of a few lines: positions ascend over all of them."""
    folder = os.path.join(str(tmp_path), "Opened")
    os.makedirs(folder)
    want = []
    for part in range(3):
        rows = [["Firm Name", CATS[0]]] + [[f"firm {part} {k}", str(k)] for k in range(400)]
        with open(os.path.join(folder, f"part-{part}.csv"), "w", newline="") as f:
            csv.writer(f, lineterminator="\n").writerows(rows)
        want += [r[0] for r in rows[1:]]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows, loose, _ = RG.read_sheets(spark, [RG.Sheet("s", "opened", folder)], CATS)
        got = [r.firm_name for r in sorted(rows.collect(), key=lambda r: r.pos)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and loose


def test_bad_headers(spark, tmp_path):
    folder = write(str(tmp_path), "w", {"1 Opened": [["Firm Name", "firm_name ", CATS[0]], ["a", "b", "1"]],
                                        "2 Closed": [["Firm Name", CATS[0]], ["a", "1"]], "empty": [["Nobody"], ["x"]]})
    path = lambda n: os.path.join(folder, n + ".csv")
    with pytest.raises(ValueError, match="both map"):
        RG.read_sheets(spark, [RG.Sheet("s", "opened", path("1 Opened"))], CATS)
    with pytest.warns(UserWarning, match="without a usable opened"), pytest.raises(ValueError, match="nothing to assemble"):
        RG.read_sheets(spark, [RG.Sheet("s", "closed", path("2 Closed"))], CATS)
    with pytest.warns(UserWarning, match="without firm or category"):
        rows, _, _ = RG.read_sheets(spark, [RG.Sheet("s", "opened", path("2 Closed")), RG.Sheet("s", "closed", path("empty"))], CATS)
    assert rows.count() == 1


def test_a_line_is_parsed_once_and_types_need_no_sort(spark, tmp_path):
    """Filters on names and values don't parse the line again, and firm types are grouped by rank: the least type of a group."""
    a = CATS[0]
    folder = write(str(tmp_path), "typed", {
        "1 Opened": [["Firm Name", "Group", "firm_type", a], ["F", "G", "b", "1"], ["F", "G", "a", "2"], ["H", "G", "", "3"], ["nan", "G", "a", "4"]],
        "2 Closed": [["Firm Name", "Group", a], [" F ", "G", "7"]],
    })
    sheets = [RG.Sheet("H1 2022", m, os.path.join(folder, SHEETS[m] + ".csv")) for m in ("opened", "closed")]
    rows, loose, typed = RG.read_sheets(spark, sheets, CATS)
    assert typed == ["a", "b"]
    got = SH.assemble_stacked(rows, SH.manifest_df(spark), loose, typed)
    assert {(r.firm_name, r.firm_type, r.complaints_opened, r.complaints_closed) for r in got.collect()} == {("F", "a", 1, 7.0), ("H", None, 3, None)}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1
    assert "SortAggregate" not in got._jdf.queryExecution().executedPlan().toString()
    by_text = SH.assemble_stacked(rows, SH.manifest_df(spark), loose, True)
    assert sorted(map(str, by_text.collect())) == sorted(map(str, got.collect()))


def test_the_fixture_pivot_is_a_hash_aggregate(spark, small_fact):
    sheet = SH.fixture_sheets(small_fact, CATS)["upheld"]
    assert "SortAggregate" not in sheet._jdf.queryExecution().executedPlan().toString()
