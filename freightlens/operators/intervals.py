"""First points of many time windows, by merged order.

Points and the windows' beginnings are put into one order per key and hour. A point's place in its key's whole
order is its place in the hour plus the points of the hours before; a window's place is the number of points before
it. So a window's first points are a range of places, found by an equi-join on blocks of places: the work is bounded by
the result, however long the windows and however dense the points are, and a key with many points is dealt by hours and
then by blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Places that meet in one group of the join.
BLOCK = 128


def first_in_windows(windows: DataFrame, points: DataFrame, key: str, most: int, bucket: str = "hour") -> DataFrame:
    """``window_id, point_id, at, rank`` of the first ``most`` points of every window, its ends included.

    ``windows`` has ``window_id``, the key, ``low`` and ``high``; ``points`` has ``point_id``, the key and ``at``.
    Points of one instant are in the order of their id. Rows without a key or an end or instant meet nothing.
    """
    starts = windows.where(f"{key} IS NOT NULL AND low IS NOT NULL AND high IS NOT NULL").select(
        key, F.col("low").alias("at"), F.lit(0).alias("is_point"), F.col("window_id").alias("own_id"), "high",
    )
    marks = points.where(f"{key} IS NOT NULL AND at IS NOT NULL").select(key, "at", F.lit(1).alias("is_point"), F.col("point_id").alias("own_id"), F.lit(None).cast(dict(windows.dtypes)["high"]).alias("high"))
    merged = starts.unionByName(marks).withColumn("bucket", F.date_trunc(bucket, "at"))
    # a window's beginning stands before the points of its instant
    inside = Window.partitionBy(key, "bucket").orderBy("at", "is_point", "own_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = merged.withColumn("inside", F.sum("is_point").over(inside))
    counts = merged.groupBy(key, "bucket").agg(F.sum("is_point").alias("n"))
    ahead = Window.partitionBy(key).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(key, "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    placed = placed.join(before, [key, "bucket"]).withColumn("place", F.col("before") + F.col("inside") - F.col("is_point"))
    own = placed.where("is_point = 1").select(key, F.col("own_id").alias("point_id"), "at", "place", F.expr(f"place div {BLOCK}").alias("block"))
    first = placed.where("is_point = 0").select(key, F.col("own_id").alias("window_id"), "high", F.col("place").alias("from"))
    spread = first.withColumn("block", F.explode(F.sequence(F.expr(f"from div {BLOCK}"), F.expr(f"(from + {most - 1}) div {BLOCK}"))))
    near = spread.join(own, [key, "block"]).where((F.col("place") >= F.col("from")) & (F.col("place") < F.col("from") + most) & (F.col("at") <= F.col("high")))
    return near.select("window_id", "point_id", "at", (F.col("place") - F.col("from") + 1).cast("int").alias("rank"))
