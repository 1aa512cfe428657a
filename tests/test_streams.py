"""Streams against their batch counterparts, over several micro-batches, late and repeated rows, and restarts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from freightlens.operators import aggregates as A
from freightlens.sources.model import Freight
from freightlens.streaming import live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def m(spark, sf_dir):
    return Freight(spark, sf_dir)


def feed(spark, frames, folder):
    """Write frames as files that a stream takes one by one, and give the stream."""
    for n, frame in enumerate(frames):
        frame.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{n:03}")
    return spark.readStream.schema(frames[0].schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))


def ran(stream, checkpoint, mode="append", into=None):
    """All rows that a stream gives until its input is used up, batch by batch."""
    rows = [] if into is None else into
    query = stream.writeStream.outputMode(mode).option("checkpointLocation", str(checkpoint)).foreachBatch(lambda df, _: rows.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(240)
    return rows


def split(df, key, parts, seed):
    """A frame in so many parts in a random order of rows."""
    rows = df.collect()
    random.Random(seed).shuffle(rows)
    return [df.sparkSession.createDataFrame(rows[i::parts], df.schema) for i in range(parts)]


@pytest.fixture()
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def test_latest_by_road(spark, m, tmp_path, rocks):
    """Any order of micro-batches, repeated rows, and a restart in the middle give the newest row of each road."""
    rows = m.condition.select("id", "road_id", "recorded_at", "level").persist()
    parts = split(rows, "id", 4, 3)
    parts.append(parts[0])
    found = []
    first = feed(spark, parts[:2], tmp_path / "in")
    ran(live.latest_by_road(first, lateness="60 days"), tmp_path / "checkpoint", "update", found)
    whole = feed(spark, parts, tmp_path / "in2")
    for n in (2, 3, 4):  # more files for the same stream
        parts[n].coalesce(1).write.parquet(str(tmp_path / f"in/{n:03}"))
    ran(live.latest_by_road(first, lateness="60 days"), tmp_path / "checkpoint", "update", found)
    last = {}
    for r in found:
        assert r.road_id not in last or (r.at_us, r.id) > (last[r.road_id].at_us, last[r.road_id].id)
        last[r.road_id] = r
    want = {r.road_id: (r.id, r.level) for r in A.latest_per_road(m).collect()}
    assert {k: (r.id, r.level) for k, r in last.items()} == want and not any(r.silent for r in found)
    rows.unpersist()
    assert whole.isStreaming


def test_silent_roads_are_forgotten(spark, tmp_path, rocks):
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    frames = [spark.createDataFrame(rows, "id long, road_id long, recorded_at timestamp, level int") for rows in ([(1, 1, at(0), 3)], [(2, 2, at(100), 4)], [(3, 2, at(101), 5)], [(4, None, at(102), 1)])]
    found = ran(live.latest_by_road(feed(spark, frames, tmp_path / "in"), lateness="1 hour", silent_hours=10), tmp_path / "c", "update")
    assert [(r.road_id, r.id) for r in found if r.silent] == [(1, 1)]
    assert {(r.road_id, r.id) for r in found if not r.silent} == {(1, 1), (2, 2), (2, 3)}


def test_stream_stream_join(spark, m, tmp_path):
    incidents = m.incident.where("resolved_at IS NOT NULL").select(F.col("id").alias("incident_id"), F.col("road_id").alias("incident_road"), "reported_at", "resolved_at")
    points = m.condition.select(F.col("id").alias("condition_id"), "road_id", "recorded_at", "level")
    gap = F.expr("INTERVAL '6' HOUR")
    want = incidents.join(points, (F.col("incident_road") == F.col("road_id")) & F.col("recorded_at").between(F.col("reported_at") - gap, F.col("resolved_at") + gap))
    want = sorted((r.incident_id, r.condition_id) for r in want.collect())
    left, right = (feed(spark, split(df, "x", 3, 5), tmp_path / name) for df, name in ((incidents, "i"), (points, "c")))
    found = ran(live.measured_incidents(left, right, lateness="40 days"), tmp_path / "checkpoint")
    assert sorted((r.incident_id, r.condition_id) for r in found) == want and len(want) > 50


def test_stream_join_forgets_old_rows(spark, tmp_path):
    """Once the watermark has passed a window's end, a row that comes for it is left out."""
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    i = [spark.createDataFrame([x], "incident_id int, incident_road int, reported_at timestamp, resolved_at timestamp") for x in ((1, 1, at(0), at(1)), (2, 1, at(2000), None), (3, 1, at(2001), None), (4, 1, at(2002), None))]
    c = [spark.createDataFrame([x], "condition_id int, road_id int, recorded_at timestamp, level int") for x in ((1, 1, at(3), 5), (2, 1, at(2000), 5), (3, 1, at(2001), 5), (4, 1, at(4), 5))]
    found = ran(live.measured_incidents(feed(spark, i, tmp_path / "i"), feed(spark, c, tmp_path / "c"), lateness="1 hour"), tmp_path / "k")
    assert {(r.incident_id, r.condition_id) for r in found} == {(1, 1), (2, 2), (2, 3), (3, 2), (3, 3), (4, 2), (4, 3)}


def test_episodes(spark, m, tmp_path):
    rows = m.condition.select("road_id", "recorded_at", "level")
    want = sorted(map(tuple, live.episodes(rows).collect()))
    late = spark.createDataFrame([(1, dt.datetime(2030, 1, 1), 9)], "road_id long, recorded_at timestamp_ntz, level int")
    found = ran(live.episodes(feed(spark, [*split(rows, "x", 3, 1), late], tmp_path / "in"), lateness="40 days"), tmp_path / "c")
    assert sorted(map(tuple, found)) == want and len(want) > 20


def test_repeats_and_wanted_incidents(spark, m, tmp_path):
    """The two streams that had no test: repeated events count once; each error event meets the subscriptions that want it."""
    events = m.table("events")
    parts = split(events, "event_id", 2, 2)
    found = ran(live.without_repeats(feed(spark, [*parts, parts[0]], tmp_path / "a"), "60 days"), tmp_path / "ca")
    assert sorted(r.event_id for r in found) == sorted(r.event_id for r in events.select("event_id").collect())
    subs = m.subscription.select("id", "min_severity", "cargo_only", "is_active")
    found = ran(live.wanted_incidents(feed(spark, parts, tmp_path / "b"), subs), tmp_path / "cb")
    plain = live.wanted_incidents(events, subs)
    assert sorted((r.event_id, r.id) for r in found) == sorted((r.event_id, r.id) for r in plain.collect()) and found
