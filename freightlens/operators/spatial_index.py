"""Box and radius search over geometries of any kind by a space-filling key.

Every geometry is anchored at the lower left corner of its bounds. Its key interleaves the bits of the anchor's longitude and
latitude (Z-order), so near anchors mostly have near keys; the table is written sorted by size class and key. A box becomes
a few ranges of keys, which reach the Parquet scan as filters on stored columns: files, row groups and pages without such keys
are not read. Larger geometries have a class of their own, for which the box is grown by the class's extent, so none is missed.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.functions import geometry as g

BITS = 20
#: Ranges of keys that a box becomes at most, for each size class.
MOST_RANGES = 12
_SIDE = 1 << BITS
_UNIT = 360.0 / _SIDE
Box = tuple[float, float, float, float]


def _place(degrees: Column, low: float) -> Column:
    return F.least(F.greatest(F.floor((degrees - F.lit(low)) / F.lit(_UNIT)), F.lit(0)), F.lit(_SIDE - 1)).cast("long")


def _spread(x: Column) -> Column:
    """A number's bits with a zero before each."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask))
    return x


def cell(lon: Column, lat: Column) -> Column:
    """The key of a point."""
    return _spread(_place(lon, -180.0)).bitwiseOR(F.shiftleft(_spread(_place(lat, -180.0)), 1))


def key_ranges(low: tuple[int, int], high: tuple[int, int], most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """At most ``most`` ranges of keys that hold all cells of a rectangle (columns and rows, ends included), as tight as that allows."""
    def inside(x: int, y: int, side: int) -> bool:
        return low[0] <= x and x + side - 1 <= high[0] and low[1] <= y and y + side - 1 <= high[1]

    def apart(x: int, y: int, side: int) -> bool:
        return x > high[0] or x + side - 1 < low[0] or y > high[1] or y + side - 1 < low[1]

    done: list[tuple[int, int]] = []
    open_: list[tuple[int, int, int, int]] = [(-_SIDE, 0, 0, 0)]  # the largest square first: (-side, key, x, y)
    while open_ and len(done) + len(open_) < 8 * most:
        side, key, x, y = heapq.heappop(open_)
        side = -side
        if inside(x, y, side):
            done.append((key, key + side * side - 1))
            continue
        half = side // 2
        for quarter in range(4):
            qx, qy = x + half * (quarter & 1), y + half * (quarter >> 1)
            if not apart(qx, qy, half):
                heapq.heappush(open_, (-half, key + quarter * half * half, qx, qy))
    merged: list[list[int]] = []
    for a, b in sorted(done + [(key, key + side * side - 1) for side, key, _, _ in open_]):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    while len(merged) > most:  # close the smallest gap
        at = min(range(len(merged) - 1), key=lambda i: merged[i + 1][0] - merged[i][1])
        merged[at : at + 2] = [[merged[at][0], merged[at + 1][1]]]
    return [(a, b) for a, b in merged]


def write_indexed(df: DataFrame, path: str, bounds: Column, parts: int | None = None, row_group_bytes: int | None = None) -> None:
    """Write ``df`` with its bounds (struct of min_lon, min_lat, max_lon, max_lat) sorted by size class and key; rows without bounds are left out."""
    own = df.withColumn("box", bounds).where("box IS NOT NULL")
    extent = F.greatest(F.col("box.max_lon") - F.col("box.min_lon"), F.col("box.max_lat") - F.col("box.min_lat"))
    size_class = F.when(extent <= 0, 0).otherwise(F.greatest(F.lit(1), F.ceil(F.log2(extent / F.lit(_UNIT))) + 1)).cast("int")
    keyed = own.withColumns({"cell": cell(F.col("box.min_lon"), F.col("box.min_lat")), "size_class": size_class}).select(
        *df.columns, *[F.col(f"box.{c}").alias(c) for c in ("min_lon", "min_lat", "max_lon", "max_lat")], "cell", "size_class",
    )
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(parts, "size_class", "cell", F.xxhash64(*df.columns)).sortWithinPartitions("size_class", "cell")
    writer = dealt.write.mode("overwrite").partitionBy("size_class")
    (writer.option("parquet.block.size", row_group_bytes) if row_group_bytes else writer).parquet(f"{path}/rows")
    rows = df.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows")
    rows.groupBy("size_class").agg(F.count(F.lit(1)).alias("n")).coalesce(1).write.mode("overwrite").parquet(f"{path}/classes")


class SpatialIndex:
    """A table that ``write_indexed`` wrote; the driver holds its size classes, some twenty at most."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.rows = spark.read.parquet(f"{path}/rows")
        self.classes = sorted(r["size_class"] for r in spark.read.parquet(f"{path}/classes").collect())

    def in_box(self, box: Box) -> DataFrame:
        """Rows whose bounds meet a box, edges included."""
        wanted = F.lit(False)
        for size_class in self.classes:
            grown = 0.0 if size_class == 0 else _UNIT * 2.0 ** (size_class - 1)

            def place(degrees: float) -> int:
                return min(_SIDE - 1, max(0, math.floor((degrees + 180.0) / _UNIT)))

            keys = key_ranges((place(box[0] - grown), place(box[1] - grown)), (place(box[2]), place(box[3])))
            near = F.lit(False)
            for a, b in keys:
                near = near | F.col("cell").between(a, b)
            wanted = wanted | ((F.col("size_class") == size_class) & near)
        exact = (F.col("min_lon") <= box[2]) & (F.col("max_lon") >= box[0]) & (F.col("min_lat") <= box[3]) & (F.col("max_lat") >= box[1])
        return self.rows.where(wanted & exact)

    def nearest(self, lon: float, lat: float, radius_km: float, limit: int, at: tuple[str, str] = ("lon", "lat"), key: str = "id") -> DataFrame:
        """Rows whose point ``at`` lies within a radius, by distance; their bounds hold that point."""
        dy = radius_km / g.KM_PER_DEGREE
        dx = radius_km / max(g.KM_PER_DEGREE * math.cos(math.radians(lat)), 1e-6)
        near = self.in_box((lon - dx, lat - dy, lon + dx, lat + dy)).where(g.in_box(F.col(at[0]), F.col(at[1]), (lon - dx, lat - dy, lon + dx, lat + dy)))
        near = near.withColumn("distance_km", g.haversine(F.lit(lon), F.lit(lat), F.col(at[0]), F.col(at[1])))
        return near.where(F.col("distance_km") <= radius_km).orderBy("distance_km", key).limit(limit)


def point_bounds(lon: str = "lon", lat: str = "lat") -> Column:
    """Bounds of a point in two columns."""
    x, y = F.col(lon), F.col(lat)
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("min_lon"), y.alias("min_lat"), x.alias("max_lon"), y.alias("max_lat")))
