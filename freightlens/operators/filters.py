"""Predicates, parameters, sorting and paging that registry queries share."""

from __future__ import annotations

import contextlib
import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def equal_if_given(df: DataFrame, **wanted: object) -> DataFrame:
    """Equality on each column whose value is truthy; 0, "" and None mean no filter."""
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in wanted.items() if v), df)


def text_matches(term: str, *columns: str) -> Column:
    """Whether any column contains the term, without regard to case; wildcards are plain characters."""
    return reduce(Column.__or__, (F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False)) for c in columns))


def search(df: DataFrame, term: str | None, *columns: str) -> DataFrame:
    """Rows of which a column contains the trimmed term; all rows for an empty term."""
    term = (term or "").strip()
    return df.where(text_matches(term, *columns)) if term else df


def since(column: str, now: Column, days: int) -> Column:
    """At most so many days before now."""
    return F.col(column) >= now - F.expr(f"INTERVAL '{int(days)}' DAY")


def null_or_empty(column: str) -> Column:
    """Missing or empty text."""
    return F.col(column).isNull() | (F.col(column) == "")


def published(df: DataFrame, now: Column, flag: str = "is_published", at: str = "published_at") -> DataFrame:
    """Published rows whose date isn't in the future."""
    return df.where(F.col(flag) & (F.col(at) <= now))


#: What a request's text may be, by kind: how it is read, and whether the value is fit.
_READ: dict[str, Callable[[str], object]] = {"int": int, "float": lambda t: float(t.replace(",", ".")), "choice": str}


def parameter(raw: object, kind: str, default: object = None, fit: Callable[[object], bool] = lambda _: True) -> object:
    """A request's value, blanks around it left out; the default for a missing, malformed or unfit one."""
    text = "" if raw is None else str(raw).strip()
    if not text:
        return default
    with contextlib.suppress(ValueError):
        value = _READ[kind](text)
        return value if fit(value) else default
    return default


def int_param(raw: object, default: int | None = None) -> int | None:
    """A whole number."""
    return parameter(raw, "int", default)


def choice_param(raw: str | None, allowed: tuple[str, ...], default: str = "") -> str:
    """A value of the allowed ones."""
    return parameter(raw, "choice", default, allowed.__contains__)


def float_param(raw: object, low: float, high: float, default: float = 0.0) -> float:
    """A finite number held within [low, high]."""
    value = parameter(raw, "float", None, math.isfinite)
    return default if value is None else min(high, max(low, value))


def box_param(raw: str | None) -> tuple[float, float, float, float] | None:
    """Four comma-separated numbers, or nothing."""
    try:
        parts = [float(p) for p in (raw or "").split(",")]
    except ValueError:
        return None
    return tuple(parts) if len(parts) == 4 else None


def sorted_by(df: DataFrame, code: str | None, allowed: dict[str, list[tuple[str, bool]]], default: str, key: str = "id") -> DataFrame:
    """Sort by a whitelisted code (column, descending); nulls last, the key breaks ties."""
    wanted = allowed.get(code or "", allowed[default])
    keys = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in wanted]
    return df.orderBy(*keys, F.col(key))


#: The order of each entity where none is asked for: column, descending; the last one tells rows apart.
ORDERINGS: dict[str, list[tuple[str, bool]]] = {
    "district": [("id", False)], "facility": [("name", False), ("id", False)], "road": [("name", False), ("id", False)], "route": [("id", False)],
    "flow_lines": [("period_date", True), ("id", False)], "condition": [("recorded_at", True), ("id", False)], "incident": [("reported_at", True), ("id", False)], "run": [("started_at", True), ("id", False)],
}


def in_default_order(df: DataFrame, entity: str) -> DataFrame:
    """Rows in their entity's default order; nulls last."""
    return df.orderBy(*[F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in ORDERINGS[entity]])


def page_of(rows: int, size: int, page: int) -> int:
    """The page shown for a request: below 1 or beyond the end means the last."""
    last = max(1, -(-rows // size))
    return page if 1 <= page <= last else last


def paged(df: DataFrame, order: list[Column], size: int, page: int) -> DataFrame:
    """One page of a sorted frame. The order is total; only the pages up to the wanted one are sorted out."""
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def html_page(df: DataFrame, order: list[Column], size: int, raw: object) -> DataFrame:
    """A page by its raw number: no number means the first, one out of range the last."""
    return paged(df, order, size, page_of(df.count(), size, int_param(raw, 1)))


def envelope(df: DataFrame, size: int, page: int) -> DataFrame:
    """Count, pages, and numbers of the neighbouring pages, for a page of at most 500 rows."""
    size = max(1, min(size, 500))
    counted = df.agg(F.count(F.lit(1)).alias("count"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("count") / size)).cast("long")
    return counted.withColumn("pages", pages).select(
        "count", "pages", F.lit(page).cast("long").alias("page"), F.when(F.col("pages") > page, F.lit(page + 1)).cast("long").alias("next"),
        F.when(F.lit(page > 1), F.lit(page - 1)).cast("long").alias("previous"),
    )


def top_per_group(df: DataFrame, group: str | list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group; the limit applies before the shuffle."""
    group = [group] if isinstance(group, str) else group
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(rank) <= k)


def latest(df: DataFrame, group: str, at: str, key: str = "id") -> DataFrame:
    """The latest row of each group, the greatest key among equals; combined before the shuffle."""
    best = df.groupBy(group).agg(F.max_by(F.struct(*df.columns), F.struct(at, key)).alias("row"))
    return best.select("row.*")
