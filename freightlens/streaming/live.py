"""Streams over measurements: our own additions, the model itself has none."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def hourly_levels(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Tumbling hours: samples and sum of levels; rows later than the watermark are left out."""
    level = F.least(F.lit(10), F.floor(F.col("value") / 20).cast("int"))
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness)
    by = timed.groupBy(F.window("at", "1 hour")).agg(F.count(F.lit(1)).alias("samples"), F.sum(level).alias("level_sum"))
    return by.select(F.col("window.start").alias("hour"), "samples", "level_sum")


def without_repeats(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Each event once within the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", lateness).dropDuplicatesWithinWatermark(["event_id"])


def wanted_incidents(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Stream-static join: each error event with the active subscriptions that its severity meets."""
    k = F.get_json_object("props", "$.k").cast("int")
    incidents = events.where("event_type = 'error'").select("event_id", (1 + k % 5).alias("severity"), (k % 2 == 1).alias("affects_cargo"))
    s = subscriptions.where("is_active")
    return incidents.join(s, (F.col("severity") >= F.col("min_severity")) & (~F.col("cargo_only") | F.col("affects_cargo")))


def episodes(measurements: DataFrame, lateness: str | None = None, least: int = 7) -> DataFrame:
    """Congestion episodes of each road: runs of measurements of at least a level whose gaps are shorter than their state allows.

    A jam (level 9 and up) is taken to last 6 hours from its measurement, heavy traffic 3 hours. ``road_id, began, ends, samples, worst``;
    ``measurements`` has ``road_id, recorded_at, level``, batch or stream (then with a lateness).
    """
    timed = measurements.where((F.col("level") >= least) & F.col("road_id").isNotNull()).withColumn("at", F.col("recorded_at").cast("timestamp"))
    timed = timed.withWatermark("at", lateness) if lateness else timed
    gap = F.when(F.col("level") >= 9, "6 hours").otherwise("3 hours")
    by = timed.groupBy("road_id", F.session_window("at", gap).alias("span")).agg(F.count(F.lit(1)).alias("samples"), F.max("level").alias("worst"))
    return by.select("road_id", F.col("span.start").alias("began"), F.col("span.end").alias("ends"), "samples", "worst")


def measured_incidents(incidents: DataFrame, measurements: DataFrame, hours: int = 6, longest_hours: int = 120, lateness: str = "1 day") -> DataFrame:
    """Stream-stream join: measurements of an incident's road from some hours before it to some hours after its end.

    ``incidents`` has ``incident_id, incident_road, reported_at, resolved_at``, ``measurements`` ``condition_id, road_id, recorded_at, level``. An incident that's open or
    longer counts for ``longest_hours``, so both sides' state is bounded by that time and the lateness.
    """
    gap, longest = F.expr(f"INTERVAL '{hours}' HOUR"), F.expr(f"INTERVAL '{longest_hours}' HOUR")
    i = incidents.where("incident_road IS NOT NULL").withColumn("begin_at", F.col("reported_at").cast("timestamp")).withWatermark("begin_at", lateness)
    end = F.least(F.coalesce(F.col("resolved_at").cast("timestamp"), F.col("begin_at") + longest), F.col("begin_at") + longest)
    i = i.withColumn("end_at", end)
    c = measurements.withColumn("at", F.col("recorded_at").cast("timestamp")).withWatermark("at", lateness)
    near = (F.col("incident_road") == F.col("road_id")) & (F.col("at") >= F.col("begin_at") - gap) & (F.col("at") <= F.col("begin_at") + longest + gap) & (F.col("at") <= F.col("end_at") + gap)
    return i.join(c, near).select("incident_id", "condition_id", "at", "level")


class _Latest(StatefulProcessor):
    """The newest measurement of a road as a value, and a timer that forgets a road which has been silent too long."""

    def __init__(self, silent_ms: int) -> None:
        self.silent_ms = silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("latest", "at long, id long, level int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        before = self.kept.get() if self.kept.exists() else None
        best = tuple(before) if before is not None else None
        for row in rows:
            own = (int(row["at_us"]), int(row["id"]), row["level"])
            if best is None or own[:2] > best[:2]:
                best = own
        if before is not None and best == tuple(before):
            return  # late or repeated rows change nothing
        self.kept.update(best)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(best[0] // 1000 + self.silent_ms)
        yield Row(road_id=key[0], at_us=best[0], id=best[1], level=best[2], silent=False)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        if self.kept.exists():
            at, own, level = self.kept.get()
            self.kept.clear()
            yield Row(road_id=key[0], at_us=at, id=own, level=level, silent=True)

    def close(self) -> None:
        pass


def latest_by_road(measurements: DataFrame, lateness: str = "30 days", silent_hours: int = 24 * 365) -> DataFrame:
    """The newest measurement of each road as a stream of changes: ``road_id, at_us, id, level, silent``.

    Of equal instants the greater id counts. Rows may come late (within the lateness), in any order and repeatedly; a road without a measurement for
    ``silent_hours`` is told once as silent and forgotten. The state is one row and one timer a road. Needs the state store of RocksDB.
    """
    timed = measurements.where("road_id IS NOT NULL AND recorded_at IS NOT NULL").withColumn("at", F.col("recorded_at").cast("timestamp")).withWatermark("at", lateness)
    rows = timed.select("road_id", "at", F.unix_micros("at").alias("at_us"), "id", "level")
    out = "road_id long, at_us long, id long, level int, silent boolean"
    return rows.groupBy("road_id").transformWithState(statefulProcessor=_Latest(silent_hours * 3_600_000), outputStructType=out, outputMode="Update", timeMode="EventTime")
