"""Readers of SQL scripts and GeoJSON files that split one file over many tasks.

A file is cut into ranges at line starts. Whether a cut lies inside a quoted value, a comment or a statement (or at which depth
of a JSON document) depends on all before it, so each range is first reduced to what it does to any such state; the
reductions are made in parallel and composed in order, a few numbers a range. Then every range is read on its own: it skips what began
before it and finishes what began in it.

Paths are local ones or URIs that Arrow's file systems know (hdfs, s3, gs); ``seed_script.read_script`` reads scripts from any
other store that only Spark reaches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SPLIT_BYTES = 64 << 20
CHUNK = 1 << 20
#: Bits of a row's position that hold its byte; those above hold the number of the file.
BYTE_BITS = 44

OUT, IN, QUOTE, BLOCK_OUT, BLOCK_IN = range(5)
_NEXT = {
    OUT: re.compile(rb"--[^\n]*|/\*|;|\S"), IN: re.compile(rb"'|--[^\n]*|/\*|;|\"[^\"\n]*\""), QUOTE: re.compile(rb"'"), BLOCK_OUT: re.compile(rb"\*/"), BLOCK_IN: re.compile(rb"\*/"),
}
_JSON_SIGN = re.compile(rb"[{}\[\]]|\"(?:[^\"\\]|\\.)*\"")


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of the files in a folder, in the order of their names; hidden ones are left out."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(inner)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(inner)) if i.type == fs.FileType.File and i.base_name[0] not in "._"]
    return [(prefix + i.path, i.size) for i in sorted(found, key=lambda i: i.path)]


def lines_from(path: str, start: int) -> Iterator[tuple[int, bytes]]:
    """(offset, bytes) of stretches of whole lines from the first line that begins at or after ``start``."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    with system.open_input_file(inner) as file:
        at, held = start, b""
        if start:  # a line that begins exactly here follows a line feed
            file.seek(start - 1)
            at, skipping = start - 1, True
        else:
            skipping = False
        while data := file.read(CHUNK):
            if skipping:
                end = data.find(b"\n")
                at += len(data) if end < 0 else end + 1
                if end < 0:
                    continue
                data, skipping = data[end + 1 :], False
            held += data
            cut = held.rfind(b"\n") + 1
            if cut:
                yield at, held[:cut]
                at, held = at + cut, held[cut:]
        if held:
            yield at, held


def scan(data: bytes, state: int) -> tuple[int, list[tuple[int, bool]]]:
    """The state after some whole lines, and where statements begin (True) and end (False, past the semicolon)."""
    at, marks = 0, []
    while (m := _NEXT[state].search(data, at)) is not None:
        sign, at = m.group(), m.end()
        if state == QUOTE:
            state = IN
        elif state in (BLOCK_OUT, BLOCK_IN):
            state = OUT if state == BLOCK_OUT else IN
        elif sign == b"/*":
            state = BLOCK_OUT if state == OUT else BLOCK_IN
        elif sign.startswith(b"--"):
            continue
        elif state == OUT:
            if sign != b";":
                marks.append((m.start(), True))
                state, at = IN, m.start()
        elif sign == b"'":
            state = QUOTE
        elif sign == b";":
            marks.append((at, False))
            state = OUT
    return state, marks


def depth_change(data: bytes) -> int:
    """How much deeper in a JSON document one is after some whole lines; a line never begins inside a string."""
    return sum((s in b"{[") - (s in b"}]") for s in _JSON_SIGN.findall(data) if s[:1] != b'"')


@dataclass
class Range(InputPartition):
    """A range of a file and the state at its first line."""

    file: str
    number: int
    start: int
    end: int
    state: int


def reduced(path: str, start: int, end: int, kind: str) -> list[int]:
    """What a range does: for a script the state after it for each state before it, for JSON the change of depth."""
    states, change = list(range(5)), 0
    for at, data in lines_from(path, start):
        if at >= end:
            break
        cut = _line_cut(at, data, end)
        if kind == "json":
            change += depth_change(data[:cut])
        else:
            after = {s: scan(data[:cut], s)[0] for s in set(states)}
            states = [after[s] for s in states]
        if cut < len(data):
            break
    return [change] if kind == "json" else states


def _line_cut(at: int, data: bytes, end: int) -> int:
    """How many of the bytes at ``at`` belong to lines that begin before ``end``."""
    if at + len(data) <= end:
        return len(data)
    found = data.find(b"\n", max(0, end - 1 - at))
    return len(data) if found < 0 else found + 1


def ranges_of(path: str, size: int) -> list[tuple[str, int, int, int]]:
    """(file, number, start, end) of all ranges of about ``size`` bytes."""
    return [(file, number, start, min(start + size, length)) for number, (file, length) in enumerate(files_of(path)) for start in range(0, length, size)]


def composed(ranges: list[tuple[str, int, int, int]], changes: list[list[int]], kind: str) -> list[Range]:
    """The ranges with the state at each one's beginning."""
    out, state = [], 0
    for (file, number, start, end), change in zip(ranges, changes, strict=True):
        state = 0 if start == 0 else state
        out.append(Range(file, number, start, end, state))
        state = state + change[0] if kind == "json" else change[state]
    return out


class _Splitting(DataSourceReader):
    """Ranges from the options: their changes as ``split_frame`` found them, or found here one by one."""

    kind = ""

    def __init__(self, options: dict) -> None:
        self.path, self.size, self.changes = options["path"], int(options.get("split_bytes", SPLIT_BYTES)), options.get("changes")

    def partitions(self) -> list[Range]:
        found = ranges_of(self.path, self.size)
        return composed(found, json.loads(self.changes) if self.changes else [reduced(file, start, end, self.kind) for file, _, start, end in found], self.kind)


class _ScriptReader(_Splitting):
    kind = "sql"

    def read(self, partition: Range) -> Iterator[tuple]:
        from freightlens.sources.seed_script import parse_statement

        for at, text in statements(partition):
            for nth, row in enumerate(parse_statement(text)):
                yield (partition.number << BYTE_BITS | at, nth, *row)


def statements(part: Range) -> Iterator[tuple[int, str]]:
    """(offset, text) of the statements that begin in a range; the last may end beyond it."""
    state, began, held = part.state, None, b""
    for at, data in lines_from(part.file, part.start):
        if at >= part.end and began is None:
            return
        state, marks = scan(data, state)
        last = 0
        for place, begins in marks:
            if begins:
                if _line_start(data, place, at) >= part.end:
                    return
                began, last = at + place, place
            else:
                if began is not None:
                    yield began, (held + data[last:place]).decode("utf-8", "replace")
                began, held, last = None, b"", place
        if began is not None:
            held += data[last:]
    if began is not None:  # a script may end without a semicolon
        yield began, held.decode("utf-8", "replace")


class _GeoJsonReader(_Splitting):
    kind = "json"

    def read(self, partition: Range) -> Iterator[tuple]:
        for at, text in objects(partition):
            try:
                found = json.loads(text)
            except ValueError as e:
                yield partition.number << BYTE_BITS | at, None, None, str(e)
                continue
            if isinstance(found, dict) and found.get("type") == "Feature":
                own = {k: v if isinstance(v, str) or v is None else json.dumps(v, ensure_ascii=False) for k, v in (found.get("properties") or {}).items()}
                yield partition.number << BYTE_BITS | at, json.dumps(found["geometry"], ensure_ascii=False) if found.get("geometry") else None, own, None


def objects(part: Range, level: int = 2) -> Iterator[tuple[int, str]]:
    """(offset, text) of the objects that open at a depth of ``level`` in a range: the members of an array in the outermost object."""
    depth, began, held = part.state, None, b""
    for at, data in lines_from(part.file, part.start):
        if at >= part.end and began is None:
            return
        last = 0
        for m in _JSON_SIGN.finditer(data):
            sign = m.group()
            if sign in b"{[":
                if sign == b"{" and depth == level and began is None:
                    if _line_start(data, m.start(), at) >= part.end:
                        return
                    began, last = at + m.start(), m.start()
                depth += 1
            elif sign in b"}]":
                depth -= 1
                if depth == level and began is not None:
                    yield began, (held + data[last : m.end()]).decode("utf-8", "replace")
                    began, held = None, b""
        if began is not None:
            held += data[last:]


def _line_start(data: bytes, place: int, at: int) -> int:
    return at + data.rfind(b"\n", 0, place) + 1


class SqlScript(DataSource):
    """``spark.read.format("sql_script")``: a row for each row of the INSERT statements of a script."""

    @classmethod
    def name(cls) -> str:
        return "sql_script"

    def schema(self) -> str:
        return "line long, nth int, table string, fields map<string,string>, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _ScriptReader(dict(self.options))


class GeoJson(DataSource):
    """``spark.read.format("geojson_features")``: a row for each feature; ``geometry`` is GeoJSON text, properties are text."""

    @classmethod
    def name(cls) -> str:
        return "geojson_features"

    def schema(self) -> str:
        return "line long, geometry string, properties map<string,string>, error string"

    def reader(self, schema: object) -> DataSourceReader:
        return _GeoJsonReader(dict(self.options))


def split_frame(spark: SparkSession, path: str, source: type[DataSource] = SqlScript, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A file read by many tasks; the ranges' changes of state are found by tasks too, the driver gets a few numbers a range."""
    spark.dataSource.register(source)
    kind = source(options={"path": path}).reader(None).kind
    found = ranges_of(path, split_bytes)
    reader = spark.read.format(source.name()).option("split_bytes", split_bytes)
    if len(found) > 1:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for n in batch.column(0).to_pylist():
                    file, _, start, end = found[n]
                    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([reduced(file, start, end, kind)], pa.list_(pa.int64()))], names=["n", "change"])

        rows = spark.range(0, len(found), 1, len(found)).mapInArrow(each, "n long, change array<long>").collect()
        reader = reader.option("changes", json.dumps([r["change"] for r in sorted(rows, key=lambda r: r["n"])]))
    return reader.load(path)


def geometries(features: DataFrame, parse: Callable | None = None) -> DataFrame:
    """Features with their geometry as WKT (null for none or an unknown one)."""
    from freightlens.functions.geometry import from_geojson

    return features.withColumn("geom", (parse or from_geojson)(F.col("geometry")))
