"""Workbooks parsed back, commits and aborts, and the ledger."""

import datetime as dt
import decimal
import io
import os
import re
import xml.etree.ElementTree as ET
import zipfile

import pytest
from pyspark.sql import functions as F

from freightlens.sources import sheets as X

NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}


def parsed(data):
    """Rows of the first sheet, its header included, and the second sheet as pairs."""
    book = zipfile.ZipFile(data)
    assert book.testzip() is None

    def cells(name):
        root = ET.fromstring(book.read(name))
        for row in root.find("m:sheetData", NS):
            yield [float(c.find("m:v", NS).text) if c.find("m:v", NS) is not None else "".join(t.text or "" for t in c.iter("{%s}t" % NS["m"])) for c in row]

    root = ET.fromstring(book.read("xl/worksheets/sheet1.xml"))
    assert root.find("m:sheetViews/m:sheetView/m:pane", NS).get("state") == "frozen"
    return list(cells("xl/worksheets/sheet1.xml")), dict(cells("xl/worksheets/sheet2.xml")), root.find("m:autoFilter", NS).get("ref")


def test_values():
    row = (1, -2.5, decimal.Decimal("3.10"), None, True, "a <b> & 'c'\x00\x07 é🙂", dt.datetime(2025, 3, 4, 5, 6), "", float("nan"), 10**18)
    out = io.BytesIO()
    assert X.write_book(out, [f"t{i}" for i in range(len(row))], iter([row]), {"title": "x"}) == 1
    rows, about, ref = parsed(out)
    assert rows[1] == [1.0, -2.5, 3.1, "", "yes", "a <b> & 'c' é🙂", "04.03.2025 05:06", "", "nan", 1e18] and rows[0][0] == "t0"
    assert about == {"title": "x", "rows": 1.0} and ref == "A1:J2"
    assert [X.column_name(n) for n in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]


def test_a_report_over_many_tasks(spark, tmp_path):
    df = spark.range(0, 97, 1, 5).select("id", F.concat(F.lit("n"), "id").alias("name"), (F.col("id") / 4).alias("tons"))
    X.write_report(df, str(tmp_path), "facilities", {"name": "Name", "tons": "Tons"}, sheet_rows=10)
    books = [parsed(str(tmp_path / f)) for f in sorted(os.listdir(tmp_path)) if f.endswith(".xlsx")]
    assert all(rows[0] == ["Name", "Tons"] and len(rows) <= 11 and about["rows"] == len(rows) - 1 for rows, about, _ in books)
    assert sorted((r[0], r[1]) for rows, _, _ in books for r in rows[1:]) == sorted((f"n{i}", i / 4) for i in range(97))
    (row,) = X.ledger(spark, str(tmp_path)).collect()
    assert (row.title, row.status, row.rows, row.files) == ("facilities", "done", 97, len(books)) and row.bytes == sum(os.path.getsize(tmp_path / f) for f in os.listdir(tmp_path) if f.endswith(".xlsx"))
    assert not [f for f in os.listdir(tmp_path) if f.startswith("_")]


def test_an_aborted_report_leaves_no_file(spark, tmp_path):
    bad = spark.range(0, 50, 1, 5).select(F.when(F.col("id") == 33, F.raise_error(F.lit("no such row"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="no such row"):
        X.write_report(bad, str(tmp_path), "broken")
    assert [f for f in os.listdir(tmp_path) if "xlsx" in f and f[0] not in "_."] == []
    (row,) = X.ledger(spark, str(tmp_path)).collect()
    assert (row.title, row.status, row.rows) == ("broken", "failed", 0)
    X.write_report(spark.range(3), str(tmp_path), "whole")
    assert {(r.title, r.status, r.rows) for r in X.ledger(spark, str(tmp_path)).collect()} == {("broken", "failed", 0), ("whole", "done", 3)}
    assert all(re.fullmatch(r"whole-[0-9a-f]{8}-\d{5}\.xlsx", f) for f in os.listdir(tmp_path) if "xlsx" in f)


def test_no_rows(spark, tmp_path):
    X.write_report(spark.range(0), str(tmp_path), "empty")
    assert [(r.status, r.rows, r.files) for r in X.ledger(spark, str(tmp_path)).collect()] == [("done", 0, 0)]


def test_documents(spark, tmp_path):
    df = spark.range(0, 25, 1, 2).select("id", F.concat(F.lit("<n> & "), "id").alias("name"), (F.col("id") > 3).alias("large"))
    X.write_report(df, str(tmp_path), "list", {"name": "Name", "large": "Large"}, form="docx")
    word = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    found = []
    for f in os.listdir(tmp_path):
        if f.endswith(".docx"):
            first, second = ET.fromstring(zipfile.ZipFile(tmp_path / f).read("word/document.xml")).iter(word + "tbl")
            rows = [["".join(t.text or "" for t in c.iter(word + "t")) for c in r.iter(word + "tc")] for r in second.iter(word + "tr")]
            assert rows[0] == ["Name", "Large"] and "list" in ["".join(t.text or "" for t in c.iter(word + "t")) for c in first.iter(word + "tc")]
            found += rows[1:]
    assert sorted(found) == sorted([f"<n> & {i}", "yes" if i > 3 else "no"] for i in range(25))
    assert [(r.status, r.rows) for r in X.ledger(spark, str(tmp_path)).collect()] == [("done", 25)]
