"""Workbooks: round trips, other writers' sheets, ranges of rows, failed tasks; the columns of exports."""

import datetime
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tidewater.sources import files, workbook
from tidewater.sources.workbook import read_workbook, write_workbook


def test_letters():
    assert [workbook.letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(workbook.number(f"{workbook.letters(i)}7") == i for i in range(1500))


def test_round_trip_of_many_rows(spark, tmp_path):
    """20,000 rows of the list's columns: one file, read by ranges."""
    rows = spark.range(20_000).select(F.format_string("公司 %05d", "id").alias("customer_name"), (F.col("id") % 101).cast("int").alias("intent_score"), F.when(F.col("id") % 3 > 0, F.lit("<a & \"b\">")).alias("industry"))
    frame = files.export_frame(rows)
    files.write_sheet(frame, f"{tmp_path}/x")
    assert len(workbook.files_of(f"{tmp_path}/x")) == 1
    back = read_workbook(spark, f"file://{tmp_path}/x")
    assert back.columns == [head for _, head, _ in files.EXPORT] and back.rdd.getNumPartitions() == 4
    got = back.collect()
    want = sorted(((100 - i % 101, f"公司 {i:05d}", None if i % 3 == 0 else '<a & "b">') for i in range(20_000)), key=lambda r: (r[0], r[1]))
    assert [(100 - int(r["意向分"]), r["客户名称"], r["行业"]) for r in got] == want and {r["专项"] for r in got} == {None}
    declared = files.read_excel(spark, f"{tmp_path}/x", [("客户名称", "name", "string"), ("意向分", "score", "int"), ("none", "none", "date")])
    assert declared.agg(F.sum("score"), F.count("none")).first() == (sum(i % 101 for i in range(20_000)), 0)


def test_values_of_all_kinds(spark, tmp_path):
    at = datetime.datetime(2024, 1, 30, 12, 5)
    rows = [(1, 2.5, Decimal("10.00"), True, at, at.date(), ["a", "b"], " spaced\nline\r", "\x01é😀"), (None,) * 9, (-3, 1e300, None, False, None, None, [], "", "=1+1")]
    df = spark.createDataFrame(rows, "i int, d double, m decimal(9,2), b boolean, t timestamp_ntz, day date, l array<string>, s string, o string").coalesce(1)
    write_workbook(df, f"{tmp_path}/x", "a/b & 客户", (5, 6))
    got = [tuple(r) for r in read_workbook(spark, f"{tmp_path}/x", rows=2).collect()]
    assert got == [("1", "2.5", "10.00", "true", "2024-01-30 12:05", "2024-01-30", "a,b", " spaced\nline\r", "é😀"), (None,) * 9, ("-3", "1e+300", None, "false", None, None, None, None, "=1+1")]


def test_parts_modes_and_failures(spark, tmp_path):
    at = f"{tmp_path}/x"
    df = spark.createDataFrame([(i,) for i in range(10)], "n int").repartition(3)
    write_workbook(df, at)
    write_workbook(df.limit(1), at, mode="append")
    assert read_workbook(spark, at).count() == 11 and len(workbook.files_of(at)) >= 4
    boom = df.select(F.when(F.col("n") == 7, F.raise_error(F.lit("boom"))).otherwise(F.col("n")).alias("n"))
    with pytest.raises(Exception, match="boom"):
        write_workbook(boom, at)
    assert read_workbook(spark, at).count() == 11 and not list((tmp_path / "x").glob("_*"))  # the old export is whole
    write_workbook(df.limit(0), at)
    empty = read_workbook(spark, at)
    assert empty.columns == ["n"] and empty.count() == 0


def test_sheets_of_other_writers(spark, tmp_path):
    """Shared texts, a stated size, rows and cells left out, repeated and empty headers."""
    ns = f'xmlns="{workbook._NS}"'
    shared = f'<sst {ns}><si><t>name</t></si><si><r><t>ri</t></r><r><t>ch</t></r></si><si><t/></si></sst>'
    sheet = f'<worksheet {ns}><dimension ref="A1:D5"/><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>0</v></c><c r="D1" t="str"><v>last</v></c></row><row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3"><v>45000.5</v></c></row><row r="5"><c r="A5" t="s"><v>2</v></c><c r="C5" t="b"><v>1</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "o.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", shared)
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    for rows in (1, 2, 50):
        back = read_workbook(spark, f"{tmp_path}/o.xlsx", rows)
        assert back.columns == ["name", "name_2", "C", "last"]
        assert [tuple(r) for r in back.collect()] == [(None,) * 4, (None, "rich", None, "45000.5"), (None,) * 4, (None, None, "true", None)]
