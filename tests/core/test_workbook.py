"""The workbook sink: rows come back, files are bounded, and a write that fails leaves nothing."""

import os
import zipfile

import pytest
from gleanery.sources import io, workbook
from pyspark.sql import functions as F


def cells(spark, path):
    out = {}
    for r in io.read_xlsx(spark, path).collect():
        out.setdefault(r.path, []).append((r.row_no, list(r.cells)))
    return [[c for _, c in sorted(rows)] for _, rows in sorted(out.items())]


def test_rows_come_back(spark, tmp_path):
    rows = [(1, "=SUM(1)", 1.5, True, ["a"], None), (2, 'a<b&"c"\x01', float("inf"), False, [], "x"), (10**17, " -x\n y", -2.0, None, None, "日本 é"), (-4, "-3", None, None, ["=1"], "")]
    df = spark.createDataFrame(rows, "id long, t string, d double, b boolean, a array<string>, n string").withColumn("at", F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    workbook.write_xlsx(df.coalesce(1), f"{tmp_path}/x")
    (sheet,) = cells(spark, f"{tmp_path}/x/*.xlsx")
    at = "2024-01-02 03:04:05"
    assert sheet == [
        ["id", "t", "d", "b", "a", "n", "at"],
        ["1", "'=SUM(1)", "1.5", "1", '["a"]', "", at], ["2", 'a<b&"c"', "inf", "0", "[]", "x", at], [str(10**17), " -x\n y", "-2.0", "", "", "日本 é", at], ["-4", "'-3", "", "", '["=1"]', "", at],
    ]
    name = next(f for f in os.listdir(tmp_path / "x") if f.endswith(".xlsx"))
    with zipfile.ZipFile(tmp_path / "x" / name) as z:
        assert z.testzip() is None and "xl/workbook.xml" in z.namelist()


def test_files_are_bounded_and_modes(spark, tmp_path):
    place = f"{tmp_path}/many"
    workbook.write_xlsx(spark.range(0, 250, 1, 3), place, rows_per_file=40)
    sheets = cells(spark, f"{place}/*.xlsx")
    assert len(sheets) == 9 and max(len(s) for s in sheets) == 41 and sorted(int(r[0]) for s in sheets for r in s[1:]) == list(range(250))
    workbook.write_xlsx(spark.range(300, 310, 1, 1), place)
    assert sum(len(s) - 1 for s in cells(spark, f"{place}/*.xlsx")) == 260
    workbook.write_xlsx(spark.range(5).coalesce(1), place, mode="overwrite")
    assert [[r[0] for r in s] for s in cells(spark, f"{place}/*.xlsx")] == [["id", "0", "1", "2", "3", "4"]]
    assert sorted(f for f in os.listdir(place) if not f.startswith(".")) == sorted(f for f in os.listdir(place) if f.endswith(".xlsx"))
    with pytest.raises(ValueError):
        workbook.Workbook({"path": place, "rows_per_file": "2000000"}).writer(spark.range(1).schema, False)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    place = f"{tmp_path}/fails"
    df = spark.range(0, 400, 1, 4).select("id", F.when(F.col("id") == 399, F.raise_error(F.lit("broken row"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="broken row"):
        workbook.write_xlsx(df, place, rows_per_file=10)
    left = [f for _, _, files in os.walk(place) for f in files]
    assert left == []
    workbook.write_xlsx(spark.range(3), place)
    before = sorted(os.listdir(place))
    with pytest.raises(Exception, match="broken row"):
        workbook.write_xlsx(df, place, mode="overwrite")
    assert sorted(os.listdir(place)) == before


def test_empty(spark, tmp_path):
    workbook.write_xlsx(spark.range(0), f"{tmp_path}/none")
    assert [f for f in os.listdir(tmp_path / "none") if f.endswith(".xlsx")] == []
