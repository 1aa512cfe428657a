"""Transactional sink of spreadsheet reports, with a ledger.

``df.write.format("xlsx_parts")``: every task writes its rows as workbooks of its own (a sheet of rows with a bold, frozen header and a filter, and a sheet
that tells of the report), under names that readers skip. The commit gives them their final names; an abort removes them
(and the next report what a task still wrote after that).
The ledger gets a record when a report begins and one when it's done (with rows, bytes and files) or has failed. Rows stream through
the zipped XML; a task holds one row. A sheet takes ``SHEET_ROWS`` rows by its format, so more begin another workbook.
"""

from __future__ import annotations

import json
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from xml.sax.saxutils import escape

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SHEET_ROWS = 1_000_000
LEDGER = "ledger"

# Fixed parts of the format.
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_RELS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_TYPES = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_FIXED = {
    "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{_TYPES}.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="{_TYPES}.worksheet+xml"/><Override PartName="/xl/worksheets/sheet2.xml" ContentType="{_TYPES}.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="{_TYPES}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
    "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_RELS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{_RELS}/worksheet" Target="worksheets/sheet2.xml"/><Relationship Id="rId3" Type="{_RELS}/styles" Target="styles.xml"/></Relationships>',
    "xl/workbook.xml": f'<workbook xmlns="{_MAIN}" xmlns:r="{_RELS}"><sheets><sheet name="Rows" sheetId="1" r:id="rId1"/><sheet name="About" sheetId="2" r:id="rId2"/></sheets></workbook>',
    "xl/styles.xml": f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>',
}


def column_name(n: int) -> str:
    """A, B, ..., Z, AA, ... of a column from 0."""
    name = ""
    n += 1
    while n:
        n, rest = divmod(n - 1, 26)
        name = chr(65 + rest) + name
    return name


def cell(value: object, bold: bool = False) -> str:
    """A cell: numbers as such, words for booleans, nothing for null, text otherwise. Signs that XML can't hold are left out."""
    if value is None:
        return "<c/>"
    if not bold and not isinstance(value, bool) and (isinstance(value, int) or type(value).__name__ in ("float", "Decimal")) and value == value and abs(value) != float("inf"):
        return f"<c><v>{value}</v></c>"
    text = as_text(value)
    return f'<c t="inlineStr"{" s=\"1\"" if bold else ""}><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def write_book(target: object, titles: list[str], rows: Iterator[tuple], about: dict[str, object], most: int = SHEET_ROWS) -> int:
    """Write a workbook of at most ``most`` rows to a binary stream; returns how many rows it took from the iterator."""
    count = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in _FIXED.items():
            book.writestr(name, _HEAD + body)
        with book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True) as sheet:
            sheet.write(f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData><row>{"".join(cell(t, True) for t in titles)}</row>'.encode())
            for row in rows:
                sheet.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                count += 1
                if count == most:
                    break
            sheet.write(f'</sheetData><autoFilter ref="A1:{column_name(max(0, len(titles) - 1))}{count + 1}"/></worksheet>'.encode())
        lines = "".join(f"<row>{cell(k)}{cell(v)}</row>" for k, v in {**about, "rows": count}.items())
        book.writestr("xl/worksheets/sheet2.xml", f'{_HEAD}<worksheet xmlns="{_MAIN}"><sheetData>{lines}</sheetData></worksheet>')
    return count


_WORD = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
_TEXT_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
_FIXED_WORD = {
    "[Content_Types].xml": f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{_TEXT_TYPE}"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_RELS}/officeDocument" Target="word/document.xml"/></Relationships>',
}


def as_text(value: object) -> str:
    """A value in a document: words for booleans, day and minute for instants, nothing for null. Signs that XML can't hold are left out."""
    if isinstance(value, bool):
        value = "yes" if value else "no"
    elif isinstance(value, datetime):
        value = value.strftime("%d.%m.%Y %H:%M")
    return "".join(c for c in ("" if value is None else str(value)) if c in "\t\n" or c >= " " and c not in "\ufffe\uffff" and not "\ud800" <= c <= "\udfff")


def write_document(target: object, titles: list[str], rows: Iterator[tuple], about: dict[str, object], most: int = SHEET_ROWS) -> int:
    """Write a text document of at most ``most`` rows: a table that tells of the report, then the table of rows; returns how many rows it took.

    The number of rows stands after the table, as rows stream through.
    """
    def line(values: Iterator[object], bold: bool = False) -> bytes:
        style = "<w:rPr><w:b/></w:rPr>" if bold else ""
        cells = (f'<w:tc><w:p><w:r>{style}<w:t xml:space="preserve">{escape(as_text(v))}</w:t></w:r></w:p></w:tc>' for v in values)
        return f"<w:tr>{''.join(cells)}</w:tr>".encode()

    count = 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as book:
        for name, body in _FIXED_WORD.items():
            book.writestr(name, _HEAD + body)
        with book.open("word/document.xml", "w", force_zip64=True) as text:
            text.write(f'{_HEAD}<w:document xmlns:w="{_WORD}"><w:body><w:tbl>'.encode() + b"".join(line(pair) for pair in about.items()) + b"</w:tbl><w:p/><w:tbl>" + line(titles, True))
            for row in rows:
                text.write(line(row))
                count += 1
                if count == most:
                    break
            text.write(f"</w:tbl><w:p><w:r><w:t>rows: {count}</w:t></w:r></w:p></w:body></w:document>".encode())
    return count


#: How a report of each format is written.
FORMATS = {"xlsx": write_book, "docx": write_document}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, with the rows of each."""

    files: list[tuple[str, int]]


class SheetWriter(DataSourceWriter):
    """Writes, commits or aborts one report."""

    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.path, self.title, self.most = options["path"].rstrip("/"), options.get("title", "report"), int(options.get("sheet_rows", SHEET_ROWS))
        self.form = options.get("form", "xlsx")
        self.names, self.job = schema.names, uuid.uuid4().hex
        self.titles = json.loads(options["titles"]) if options.get("titles") else schema.names
        self.note("pending")

    def note(self, status: str, **more: object) -> None:
        """Add a record to the ledger: a file of its own, so records never collide."""
        system, path = _open(self.path)
        system.create_dir(f"{path}/{LEDGER}", recursive=True)
        record = {"job": self.job, "title": self.title, "status": status, "at": datetime.now(UTC).isoformat(), **more}
        with system.open_output_stream(f"{path}/{LEDGER}/{self.job}-{status}.json") as file:
            file.write((json.dumps(record) + "\n").encode())

    def write(self, iterator: Iterator[T.Row]) -> Written:
        system, path = _open(self.path)
        part, files = TaskContext.get().partitionId(), []
        rows = (tuple(row) for row in iterator)
        first = next(rows, None)
        while first is not None:
            name = f"{path}/_{self.job}-{part:05}-{TaskContext.get().taskAttemptId()}-{len(files):03}.{self.form}"

            def own(first: tuple = first) -> Iterator[tuple]:
                yield first
                for row in rows:  # a full sheet must not close the iterator
                    yield row

            with system.open_output_stream(name) as file:
                files.append((name, FORMATS[self.form](file, self.titles, own(), {"title": self.title, "part": part}, self.most)))
            first = next(rows, None)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, path = _open(self.path)
        files = [f for m in messages if m for f in m.files]
        size = 0
        for n, (name, _) in enumerate(sorted(files)):
            size += system.get_file_info(name).size
            system.move(name, f"{path}/{self.title}-{self.job[:8]}-{n:05}.{self.form}")
        self.clear()  # what lost attempts of tasks left
        self.note("done", rows=sum(n for _, n in files), bytes=size, files=len(files))

    def abort(self, messages: list[Written | None]) -> None:
        self.clear()
        self.note("failed", rows=0, bytes=0, files=0)

    def clear(self) -> None:
        """Remove files without a final name: this report's, and what tasks of failed reports wrote after their abort."""
        system, path = _open(self.path)
        failed = {i.base_name.split("-")[0] for i in system.get_file_info(fs.FileSelector(f"{path}/{LEDGER}")) if i.base_name.endswith("-failed.json")}
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.base_name.startswith("_") and info.base_name[1:].split("-")[0] in {self.job, *failed}:
                system.delete_file(info.path)


class SheetSink(DataSource):
    """The data source of ``xlsx_parts``; options: ``title``, ``titles`` (JSON list), ``sheet_rows``, ``form`` (xlsx or docx)."""

    @classmethod
    def name(cls) -> str:
        return "xlsx_parts"

    def writer(self, schema: T.StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(dict(self.options), schema)


def write_report(df: DataFrame, path: str, title: str, titles: dict[str, str] | None = None, sheet_rows: int = SHEET_ROWS, form: str = "xlsx") -> None:
    """Write columns under their titles as workbooks (numbers stay numbers) or text documents in a folder."""
    titles = titles or {c: c for c in df.columns}
    df.sparkSession.dataSource.register(SheetSink)
    out = df.select(*titles).write.format("xlsx_parts").option("title", title).option("titles", json.dumps(list(titles.values()))).option("sheet_rows", sheet_rows).option("form", form)
    out.mode("append").save(path)


def ledger(spark: SparkSession, path: str) -> DataFrame:
    """The latest record of every report of a folder: job, title, status, at, rows, bytes, files."""
    rows = spark.read.schema("job string, title string, status string, at string, rows long, bytes long, files long").json(f"{path.rstrip('/')}/{LEDGER}")
    order = {"pending": 0, "failed": 1, "done": 2}
    place = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("status")]
    return rows.groupBy("job").agg(F.max_by(F.struct(*rows.columns), place).alias("row")).select("row.*")
