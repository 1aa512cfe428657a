"""Loader of SQL scripts with one INSERT of one or more rows a line, and its journal.

The script is read as text lines by Spark; a line is split and its values are
turned into typed columns by table. Bad rows are counted and kept apart, never fatal.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import UTC, datetime

import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from freightlens.sources.model import LOCAL_ZONE, SCHEMAS

ORDER = tuple(SCHEMAS)
# The statement's head: a name, quoted or not, that may have a schema before it; a list of columns; then rows of values.
_NAME = r'(?:"[^"]+"|[A-Za-z_]\w*)'
HEAD = rf"(?i)^\s*insert\s+into\s+(?:{_NAME}\s*\.\s*)?({_NAME})\s*\(([^()]*)\)\s*values\s*(\(.*)$"
# What a column that can't be null takes for NULL or if it isn't named; "now" is the instant of the load.
DEFAULTS = {
    "districts": {"name": "", "short_name": ""}, "infrastructure_types": {"code": "", "name": ""}, "cargo_categories": {"code": "", "name": "", "hazard_class": 0},
    "data_sources": {"code": "", "name": "", "source_type": "", "is_active": True}, "infrastructure_objects": {"name": "", "created_at": "now", "updated_at": "now"},
    "road_segments": {"name": "", "road_class": ""}, "cargo_routes": {"name": "", "route_type": ""}, "freight_flow_stats": {"period_type": "month", "direction": ""},
    "traffic_conditions": {"incident_flag": False}, "traffic_incidents": {"incident_type": "", "severity": 1, "affects_cargo": False},
    "etl_log": {"started_at": "now", "target_table": "", "records_loaded": 0, "records_errors": 0, "status": "running"},
}
_TOKEN = re.compile(r"'(?:[^']|'')*'|[(),']|[^'(),]+")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")
_CALL = re.compile(r"(\w+)\s*\((.*)\)", re.S)
#: A time of day with an offset from UTC.
OFFSET = r"\d\d:\d\d(:\d\d(\.\d+)?)?\s*(Z|[+-]\d\d(:?\d\d)?)$"


def value_rows(text: str) -> list[list[str]]:
    """Rows of raw values in "(a, b), (c, d);"; commas in quotes (a doubled quote is a quote) and inner parentheses don't part."""
    rows, depth, own, piece = [], 0, [], []
    for token in _TOKEN.findall(text):
        if token == "'":
            raise ValueError("unpaired quote")
        depth += (token == "(") - (token == ")")
        if token == "(" and depth == 1:
            own, piece = [], []
        elif (token == "," and depth == 1) or (token == ")" and depth == 0):
            own.append("".join(piece).strip())
            piece = []
            if token == ")":
                rows.append(own)
        elif depth:
            piece.append(token)
    if depth:
        raise ValueError("unbalanced parentheses")
    return rows


def split_values(text: str) -> list[str]:
    """Top-level values of one row."""
    return value_rows(f"({text})")[0] if text.strip() else []


def _geometry(raw: str) -> str:
    """WKT of a geometry constructor, with its reference system in front if that isn't the usual one."""
    call = _CALL.fullmatch(raw)
    name, args = (call[1].lower(), split_values(call[2])) if call else ("", [])
    system, body = "4326", None
    if name == "st_setsrid" and len(args) == 2:
        system, body = args[1], _geometry(args[0]).rpartition(";")[2]
    elif name == "st_makepoint" and len(args) == 2 and all(map(_NUMBER.fullmatch, args)):
        body = f"POINT ({args[0]} {args[1]})"
    elif name == "st_geomfromtext" and len(args) in (1, 2) and len(args[0]) > 1 and args[0][0] == args[0][-1] == "'":
        system, body = (*args[1:], "4326")[0], args[0][1:-1]
    if body is None or not system.isdigit():
        raise ValueError(f"unknown value {raw[:60]}")
    return body if system == "4326" else f"SRID={system};{body}"


def plain_value(raw: str) -> str | None:
    """The value as text, null for NULL; geometry constructors become WKT; anything else unknown is an error."""
    raw = raw.strip()
    word = raw.upper()
    if word in ("NULL", "TRUE", "FALSE"):
        return None if word == "NULL" else word.lower()
    if len(raw) > 1 and raw[0] == raw[-1] == "'":
        return raw[1:-1].replace("''", "'")
    return raw if _NUMBER.fullmatch(raw) else _geometry(raw)


def parse_rows(columns: str, values: str) -> list[tuple[dict | None, str | None]]:
    """For each row its fields by column, or what is wrong with it."""
    names = [c.strip().strip('"').lower() for c in columns.split(",")]
    try:
        rows = value_rows(values)
    except ValueError as e:
        return [(None, str(e))]
    out = []
    for raw in rows:
        try:
            if len(names) != len(raw):
                raise ValueError(f"{len(names)} columns, {len(raw)} values")
            out.append((dict(zip(names, map(plain_value, raw), strict=True)), None))
        except ValueError as e:
            out.append((None, str(e)))
    return out


def _typed(field: T.StructField) -> Column:
    """A field's value in its declared type; null if it doesn't fit."""
    raw, kind = F.try_element_at("fields", F.lit(field.name)), field.dataType.simpleString()
    if kind != "timestamp":
        return raw.try_cast(kind)
    # a time with an offset is an instant; a naive one is local
    return F.when(raw.rlike(OFFSET), raw.try_cast("timestamp")).otherwise(F.to_utc_timestamp(raw.try_cast("timestamp_ntz").cast("timestamp"), LOCAL_ZONE))


_STATEMENT = re.compile(HEAD.replace("(?i)", "").removesuffix("$") + r"\Z", re.I | re.S)
_REMARK = re.compile(r"('(?:[^']|'')*')|--[^\n]*|/\*.*?\*/", re.S)


def parse_statement(text: str) -> list[tuple[str, dict | None, str | None]]:
    """(table, fields, error) of each row of an INSERT statement that may span lines and hold remarks; nothing for another statement."""
    found = _STATEMENT.match(_REMARK.sub(lambda m: m[1] or " ", text))
    return [(found[1].strip('"').lower(), *row) for row in parse_rows(found[2], found[3])] if found else []


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Every row of the INSERT lines: ``line`` (grows through the file), ``nth`` in the line, ``part`` of the file, ``table``, ``fields`` and ``error``."""
    parsed = "array<struct<fields:map<string,string>,error:string>>"

    @F.pandas_udf(parsed)
    def parse(columns: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([[{"fields": f, "error": e} for f, e in parse_rows(c, v)] for c, v in zip(columns, values, strict=True)])

    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    part = lambda i: F.regexp_extract("value", HEAD, i)
    name = F.lower(F.replace(part(1), F.lit('"'), F.lit("")))
    lines = text.where(F.col("value").rlike(HEAD))
    found = lines.select("line", name.alias("table"), F.posexplode(parse(part(2), part(3))).alias("nth", "row"))
    return found.select("line", "nth", F.shiftright("line", 33).alias("part"), "table", "row.fields", "row.error")


def read_statements(spark: SparkSession, path: str, split_bytes: int = 64 << 20) -> DataFrame:
    """The same by the splitting reader: statements may span lines, and one file is read by many tasks."""
    from freightlens.sources.split_files import BYTE_BITS, SqlScript, split_frame

    place = F.col("line").bitwiseAND(F.lit((1 << BYTE_BITS) - 1))
    return split_frame(spark, path, SqlScript, split_bytes).withColumn("part", F.shiftright("line", BYTE_BITS) * 1_000_000 + (place / F.lit(split_bytes)).cast("long"))


def misfits(table: str) -> Column:
    """The columns of a row whose value doesn't fit the declared type; empty if all fit."""
    return F.concat_ws(", ", *[F.when(F.try_element_at("fields", F.lit(f.name)).isNotNull() & _typed(f).isNull(), f.name) for f in T.StructType.fromDDL(SCHEMAS[table]).fields])


def _fitted(rows: DataFrame, table: str) -> DataFrame:
    wrong = misfits(table)
    return rows.withColumn("error", F.coalesce("error", F.when(wrong != "", F.concat(F.lit("misfit in "), wrong))))


def read_script(spark: SparkSession, path: str) -> DataFrame:
    """``read_rows``, where a value that doesn't fit its column's type is an error of its row."""
    rows = read_rows(spark, path)
    known = F.lit(None).cast("string")
    for table in SCHEMAS:
        wrong = misfits(table)
        known = F.when(F.col("table") == table, F.when(wrong != "", F.concat(F.lit("misfit in "), wrong))).otherwise(known)
    return rows.withColumn("error", F.coalesce("error", known))


def typed_columns(table: str) -> list[Column]:
    """A table's columns in their declared types; those that can't be null get their default for null."""
    columns = []
    for field in T.StructType.fromDDL(SCHEMAS[table]).fields:
        value, default = _typed(field), DEFAULTS[table].get(field.name)
        filled = value if default is None else F.coalesce(value, F.current_timestamp() if default == "now" else F.lit(default))
        columns.append(filled.alias(field.name))
    return columns


def numbered(rows: DataFrame) -> DataFrame:
    """``place`` of each row in the script's order, from 1: inside each part of the file, shifted by the rows of the parts before."""
    counts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each part of the file
    shifts = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    place = F.col("shift") + F.row_number().over(Window.partitionBy("part").orderBy("line", "nth"))
    return rows.join(shifts, "part").withColumn("place", place.cast("int"))


def typed_table(rows: DataFrame, table: str) -> DataFrame:
    """Good rows of one table with its declared types. Unknown columns are dropped; columns that can't be null get their default.

    Naive timestamps are local time and become UTC. Where the script gives no id, rows are numbered from 1 in its order.
    """
    own = numbered(rows.where((F.col("table") == table) & F.col("error").isNull()))
    return own.select("place", *typed_columns(table)).withColumn("id", F.coalesce("id", "place")).drop("place")


def journal(rows: DataFrame) -> DataFrame:
    """Loaded and rejected rows of each table, and the load's status."""
    by = rows.groupBy("table").agg(F.count_if(F.col("error").isNull()).alias("records_loaded"), F.count_if(F.col("error").isNotNull()).alias("records_errors"))
    return by.withColumn("status", F.when(F.col("records_errors") == 0, "success").otherwise("partial"))


def first_errors(rows: DataFrame, k: int = 5) -> DataFrame:
    """The first rejected lines, for a report."""
    return rows.where("error IS NOT NULL").orderBy("line").limit(k).select("line", "table", "error")


def _observed(table: str) -> list[Column]:
    own = F.col("table") == table
    return [
        F.count_if(own).alias(f"{table}.rows"), F.count_if(own & F.col("error").isNotNull()).alias(f"{table}.bad"),
        F.count_if(own & F.col("error").isNull() & F.try_element_at("fields", F.lit("id")).isNull()).alias(f"{table}.without_id"),
    ]


def load(spark: SparkSession, path: str, out_dir: str, read: Callable[[SparkSession, str], DataFrame] = read_rows) -> DataFrame:
    """Write every table of the script as Parquet, replacing what is there; returns the journal.

    The script is parsed in one job, which writes its rows by table and observes their numbers; each table that it names is
    then one job, which observes the misfits as it writes (one more where rows must be numbered). The load itself
    becomes one more row of ``etl_log``. Cached results that were read from ``out_dir`` are dropped, others stay.
    """
    out_dir, started = out_dir.rstrip("/"), datetime.now(UTC).replace(tzinfo=None)
    staged, seen = f"{out_dir}/_staged", Observation("rows of the script")
    rows = read(spark, path).select("line", "nth", "part", "table", "fields", "error")
    known = rows.where(F.col("table").isin(*SCHEMAS)).observe(seen, *[c for t in ORDER for c in _observed(t)])
    known.write.mode("overwrite").partitionBy("table").parquet(staged)
    counts = seen.get
    layout = T.StructType([f for f in rows.schema.fields if f.name != "table"])
    found = []
    for table in ORDER:
        total, bad = counts[f"{table}.rows"], counts[f"{table}.bad"]
        if not total:
            continue
        fitted, fits = _fitted(spark.read.schema(layout).parquet(f"{staged}/table={table}"), table), Observation(f"rows of {table}")
        own = fitted.observe(fits, F.count_if(F.col("error").isNotNull()).alias("bad"))
        own = own.where("error IS NULL")
        if counts[f"{table}.without_id"]:
            own = numbered(fitted.where("error IS NULL"))
            bad = fitted.agg(F.count_if(F.col("error").isNotNull())).first()[0] if total > bad else bad
            new = own.select("place", *typed_columns(table)).withColumn("id", F.coalesce("id", "place")).drop("place")
            new.write.mode("overwrite").parquet(f"{out_dir}/{table}.parquet")
        else:
            own.select(*typed_columns(table)).write.mode("overwrite").parquet(f"{out_dir}/{table}.parquet")
            bad = fits.get["bad"]
        found.append((table, total - bad, bad, "partial" if bad else "success"))
    absent = [t for t in ORDER if not counts[f"{t}.rows"]]  # a table that the script doesn't name becomes empty
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(inheritable_thread_target(spark)(lambda t: spark.createDataFrame([], SCHEMAS[t]).coalesce(1).write.mode("overwrite").parquet(f"{out_dir}/{t}.parquet")), absent))
    folder = spark._jvm.org.apache.hadoop.fs.Path(staged)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    log, errors = f"{out_dir}/etl_log.parquet", sum(bad for _, _, bad, _ in found)
    last = spark.read.schema(SCHEMAS["etl_log"]).parquet(log).agg(F.max("id")).first()[0] or 0 if "etl_log" not in absent else 0
    own = (last + 1, started, datetime.now(UTC).replace(tzinfo=None), None, f"seed:{path.rsplit('/', 1)[-1]}", sum(good for _, good, _, _ in found), errors, "partial" if errors else "success", None)
    spark.createDataFrame([own], SCHEMAS["etl_log"]).coalesce(1).write.mode("append").parquet(log)
    spark.catalog.refreshByPath(out_dir)
    return spark.createDataFrame(found, "table string, records_loaded long, records_errors long, status string")


def fill_centres(districts: DataFrame, centres: DataFrame, force: bool = False) -> DataFrame:
    """Centres by short name, only where missing unless forced; running it again changes nothing."""
    known = centres.select("short_name", F.col("center").alias("new_center"))
    joined = districts.join(known, "short_name", "left")
    chosen = F.coalesce("new_center", "center") if force else F.coalesce("center", "new_center")
    return joined.withColumn("center", chosen).select(*districts.columns)
