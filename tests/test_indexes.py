"""Written indexes: pages by range counts, box and radius search by a space-filling key, substring search by trigrams."""

import random

import pytest
from pyspark.sql import functions as F

from freightlens.functions import geometry as g
from freightlens.operators import filters as P
from freightlens.operators import intervals, paging, spatial_index, trigrams
from freightlens.sources.model import Freight


@pytest.fixture(scope="module")
def m(spark, sf_dir):
    return Freight(spark, sf_dir)


def scanned_rows(df):
    """Rows that the file scans of a plan gave, after it has run."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    total, stack = 0, [plan]
    while stack:
        node = stack.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            stack.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return total


def test_every_page(spark, m, tmp_path):
    order = [("capacity_tons", True), ("id", False)]
    rows = m.facility.select("id", "name", "capacity_tons")
    paging.write_pages(rows, str(tmp_path), order, ranges=9)
    pages = paging.Pages(spark, str(tmp_path), order)
    whole = [r.id for r in P.sorted_by(rows, "c", {"c": [("capacity_tons", True)]}, "c").collect()]
    assert pages.total == len(whole) and pages.last(7) == -(-len(whole) // 7)
    for size in (7, 40, 1000):
        assert [r.id for n in range(1, pages.last(size) + 1) for r in pages.page(size, n).collect()] == whole
    assert pages.page(7, 9999).count() == 0
    assert [r.id for r in pages.html_page(7, -1).collect()] == whole[7 * (pages.last(7) - 1) :]


def test_a_page_opens_few_ranges(spark, m, tmp_path):
    paging.write_pages(m.facility.select("id", "name"), str(tmp_path), [("name", False), ("id", False)], ranges=10)
    pages = paging.Pages(spark, str(tmp_path), [("name", False), ("id", False)])
    for number in (1, pages.last(5) // 2, pages.last(5)):
        assert scanned_rows(pages.page(5, number)) <= 2 * max(n for *_, n in pages.counts) < pages.total / 2


def test_no_rows_to_page(spark, m, tmp_path):
    paging.write_pages(m.facility.where(F.lit(False)).select("id"), str(tmp_path), [("id", False)])
    pages = paging.Pages(spark, str(tmp_path), [("id", False)])
    assert pages.total == 0 and pages.last(5) == 1 and pages.html_page(5, 3).count() == 0


def test_key_ranges_hold_their_cells():
    def key(x, y):
        return sum(((x >> b) & 1) << (2 * b) | ((y >> b) & 1) << (2 * b + 1) for b in range(spatial_index.BITS))

    r = random.Random(5)
    for _ in range(40):
        x, y = r.randrange(1 << 20), r.randrange(1 << 20)
        w, h = r.randrange(30), r.randrange(30)
        high = min(x + w, (1 << 20) - 1), min(y + h, (1 << 20) - 1)
        ranges = spatial_index.key_ranges((x, y), high)
        assert len(ranges) <= spatial_index.MOST_RANGES and all(a <= b for a, b in ranges)
        assert all(any(a <= key(i, j) <= b for a, b in ranges) for i in range(x, high[0] + 1) for j in range(y, high[1] + 1))


def test_boxes_find_any_geometry(spark, tmp_path):
    r = random.Random(8)
    rows = []
    for i in range(600):
        x, y, s = r.uniform(-180, 180), r.uniform(-85, 85), r.choice([0.001, 0.01, 0.5, 7.0])
        kind = i % 4
        if kind == 0:
            wkt = f"POINT ({x} {y})"
        elif kind == 1:
            wkt = f"LINESTRING ({x} {y}, {x + s} {y + s / 3}, {x + s / 2} {y + s})"
        elif kind == 2:
            wkt = f"POLYGON (({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y}))"
        else:
            wkt = None if i % 7 == 0 else f"MULTIPOLYGON ((({x} {y}, {x + s} {y}, {x + s} {y + s}, {x} {y})), (({x + 2} {y}, {x + 3} {y}, {x + 3} {y + 1}, {x + 2} {y})))"
        rows.append((i, wkt))
    df = spark.createDataFrame(rows, "id int, geom string")
    spatial_index.write_indexed(df, str(tmp_path), g.bounds(g.rings(F.col("geom"))), parts=5)
    index = spatial_index.SpatialIndex(spark, str(tmp_path))
    plain = g.of_shape(df, "geom").persist()
    boxes = [(-180, -90, 180, 90), (0, 0, 0, 0), (170, -10, 180, 10)] + [(x, y, x + r.uniform(0, 60), y + r.uniform(0, 30)) for x, y in ((r.uniform(-180, 150), r.uniform(-80, 60)) for _ in range(5))]
    for box in boxes:
        want = sorted(x.id for x in plain.where(g.meets_box(F.col("box"), box)).collect())
        assert sorted(x.id for x in index.in_box(box).collect()) == want
    plain.unpersist()


def test_box_reads_few_rows(spark, tmp_path):
    n = 60_000
    df = spark.range(n).select("id", (F.rand(1) * 2 + 37).alias("lon"), (F.rand(2) * 2 + 55).alias("lat"), F.repeat(F.sha2(F.col("id").cast("string"), 256), 2).alias("text"))
    spatial_index.write_indexed(df, str(tmp_path), spatial_index.point_bounds(), parts=2, row_group_bytes=256 * 1024)
    index = spatial_index.SpatialIndex(spark, str(tmp_path))
    box = (37.5, 55.5, 37.6, 55.6)
    found = index.in_box(box)
    assert found.count() == df.where(g.in_box(F.col("lon"), F.col("lat"), box)).count() > 50
    assert scanned_rows(index.in_box(box)) < n / 4
    plain = [r.id for r in g.nearest(df, 37.55, 55.55, 3.0, 25).collect()]
    assert [r.id for r in index.nearest(37.55, 55.55, 3.0, 25).collect()] == plain and len(plain) == 25


@pytest.mark.parametrize("term", ["", " ", "a", "E", "rt", "street 1", "STREET", "t_1%", "zz", "9", "et 9", "customer#000000001", "Ж", "nothing like it", "ь ", "\\", "%"])
def test_trigram_search_equals_search(spark, m, tmp_path_factory, term):
    path = str(tmp_path_factory.getbasetemp() / "trigrams")
    rows = m.facility.select("id", "name", "address").unionByName(spark.createDataFrame(
        [(-1, "Склад Жуков", "ул. Северная"), (-2, None, None), (-3, "", "x"), (-4, "ab", "a%b_c t_1% \\ d"), (-5, "t_1%", None)], "id long, name string, address string",
    ))
    if not test_trigram_search_equals_search.__dict__.get("written"):
        trigrams.write_trigrams(rows, path, "id", ["name", "address"])
        test_trigram_search_equals_search.written = True
    index = trigrams.TrigramIndex(spark, path)
    want = sorted(r.id for r in P.search(rows, term, "name", "address").collect())
    assert sorted(r.id for r in index.search(rows, term, "id", "name", "address").collect()) == want


def most_rows_of_a_task(spark, run):
    """What ``run`` gives, and the most rows that a task of it wrote to and read from a shuffle."""
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(30_000)
    spark.sparkContext.setJobGroup(group := f"rows-{random.random()}", "")
    found = run()
    context.listenerBus().waitUntilEmpty(30_000)
    spark.sparkContext._jsc.clearJobGroup()
    store, tracker, wrote, read = context.statusStore(), spark.sparkContext.statusTracker(), 0, 0
    for stage in {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        for task in [tasks.apply(i).taskMetrics() for i in range(tasks.size())]:
            if task.isDefined():
                wrote, read = max(wrote, task.get().shuffleWriteMetrics().recordsWritten()), max(read, task.get().shuffleReadMetrics().recordsRead())
    return found, wrote, read


def test_trigrams_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """However large the table, and though one task reads it all, no task makes or sorts more than about PART_ROWS trigrams or counts more than about LOOKUP_ROWS."""
    for name, most in (("PART_ROWS", 4_000), ("LOOKUP_ROWS", 1_000)):
        monkeypatch.setattr(trigrams, name, most, raising=False)
    df = spark.range(0, 3_000, 1, 1).select("id", F.concat(F.lit("Customer#"), F.lpad(F.col("id").cast("string"), 9, "0")).alias("name"), F.concat(F.lit("Street "), F.col("id") % 97).alias("address"))
    _, wrote, read = most_rows_of_a_task(spark, lambda: trigrams.write_trigrams(df, str(tmp_path), "id", ["name", "address"]))
    written = spark.read.parquet(f"{tmp_path}/postings")
    assert written.count() > 60_000 and wrote < 8_000 and read < 8_000
    assert written.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < 8_000
    index = trigrams.TrigramIndex(spark, str(tmp_path))
    for term in ("customer", "street", "t", "s", "eet 4"):
        want = {r.id for r in P.search(df, term, "name", "address").collect()}
        keys, _, read = most_rows_of_a_task(spark, lambda: {r.key for r in index.candidates(term).collect()})
        assert keys >= want and len(want) > 300 and read < 2_000
        assert {r.id for r in index.search(df, term, "id", "name", "address").collect()} == want


def test_trigrams_of_rows_that_share_a_key(spark, tmp_path):
    """A key's rows are found by any of its texts, each key once among the candidates."""
    rows = spark.createDataFrame([(1, "north gate"), (1, "north gate"), (1, "gate north"), (2, "north"), (2, "gate"), (3, "orth gate orth gate"), (4, "th g"), (None, "north gate")], "id long, name string")
    trigrams.write_trigrams(rows, str(tmp_path), "id", ["name"])
    index = trigrams.TrigramIndex(spark, str(tmp_path))
    for term in ("north gate", "gate", "th g", "rth", "g", "th", "north", "gate north"):
        keys = [r.key for r in index.candidates(term).collect()]
        assert len(keys) == len(set(keys))
        want = sorted(tuple(r) for r in P.search(rows.where("id is not null"), term, "name").collect())
        assert sorted(tuple(r) for r in index.search(rows, term, "id", "name").collect()) == want


def brute_windows(windows, points, most):
    out = []
    for wid, key, low, high in windows:
        own = sorted((at, pid) for pid, k, at in points if k is not None and k == key and at is not None and low is not None and high is not None and low <= at <= high)
        out += [(wid, pid, rank) for rank, (_, pid) in enumerate(own[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("most", [1, 5, 128, 300])
def test_first_points_of_windows(spark, most):
    """Dense and sparse keys, equal instants, windows without points, nulls; a third of all points on one key."""
    import datetime as dt

    r, zero = random.Random(most), dt.datetime(2024, 1, 1)
    at = lambda minutes: zero + dt.timedelta(minutes=minutes)
    points = [(i, r.choice([1, 1, 1, 2, 3, 4, None]), at(r.randrange(0, 3000, r.choice([1, 60])))) for i in range(1500)] + [(5000, 2, None)]
    windows = []
    for i in range(60):
        low = r.randrange(-500, 3500)
        windows.append((i, r.choice([1, 2, 3, 9, None]), at(low), at(low + r.choice([0, 1, 60, 3000]))))
    windows += [(100, 1, None, at(10)), (101, 1, at(10), None), (102, 1, at(50), at(20))]
    found = intervals.first_in_windows(
        spark.createDataFrame(windows, "window_id int, road int, low timestamp_ntz, high timestamp_ntz"), spark.createDataFrame(points, "point_id int, road int, at timestamp_ntz"), "road", most,
    )
    assert sorted((x.window_id, x.point_id, x.rank) for x in found.collect()) == brute_windows(windows, points, most)


def test_interval_plan_has_no_row_an_hour(m):
    """The join meets blocks of places; nothing is exploded by hours."""
    from freightlens.operators.aggregates import incident_window

    plan = incident_window(m)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence" not in plan.replace("sequence((from", "") and "block" in plan
    assert "INTERVAL '1' HOUR" not in plan
