"""Pages of a sorted table by range counts.

The table is written once as sorted ranges of its order, with the number of rows before each range. Any page, the
last as well as the first, then opens the one or two ranges that hold it; no other row is read or sorted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from freightlens.operators.filters import page_of

Order = list[tuple[str, bool]]
#: Rows that a range is meant to hold.
RANGE_ROWS = 1_000_000
RANGE = "_range"


def _keys(order: Order) -> list[Column]:
    return [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_last() for c, down in order]


def write_pages(df: DataFrame, path: str, order: Order, ranges: int | None = None) -> None:
    """Write ``df`` as sorted ranges of ``order`` (column, descending), whose last column tells rows apart; nulls are last."""
    ranges = ranges or max(1, -(-df.count() // RANGE_ROWS))
    dealt = df.repartitionByRange(ranges, *_keys(order)).withColumn(RANGE, F.spark_partition_id()).sortWithinPartitions(*_keys(order))
    dealt.write.mode("overwrite").partitionBy(RANGE).parquet(f"{path}/rows")
    df.sparkSession.createDataFrame([(dealt.schema.json(),)], "layout string").coalesce(1).write.mode("overwrite").text(f"{path}/layout")
    counts = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    counts.withColumn("before", before).coalesce(1).write.mode("overwrite").parquet(f"{path}/counts")


class Pages:
    """The pages of a written table; the driver holds a number for each range."""

    def __init__(self, spark: SparkSession, path: str, order: Order) -> None:
        self.order = order
        layout = StructType.fromJson(json.loads(spark.read.text(f"{path}/layout").first()["value"]))
        self.rows = spark.read.schema(layout).parquet(f"{path}/rows")
        self.counts = sorted((r[RANGE], r["before"], r["n"]) for r in spark.read.schema(f"{RANGE} int, n long, before long").parquet(f"{path}/counts").collect())
        self.total = sum(n for *_, n in self.counts)

    def last(self, size: int) -> int:
        """The number of the last page."""
        return max(1, -(-self.total // size))

    def page(self, size: int, number: int) -> DataFrame:
        """The rows of a page, in order; a page beyond the last is empty."""
        first = (number - 1) * size
        held = [(r, before) for r, before, n in self.counts if before < first + size and before + n > first]
        rows = self.rows.where(F.col(RANGE).isin([r for r, _ in held]) if held else F.lit(False)).drop(RANGE)
        return rows.orderBy(*_keys(self.order)).offset(first - held[0][1] if held else 0).limit(size)

    def html_page(self, size: int, number: int) -> DataFrame:
        """The page shown for a number: below 1 or beyond the end means the last."""
        return self.page(size, page_of(self.total, size, number))
