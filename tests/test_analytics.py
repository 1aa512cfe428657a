"""Scaling, regression, clustering, loader, sinks and streams."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from freightlens.operators import aggregates as A
from freightlens.plans import analytics as M
from freightlens.sources import seed_script as S
from freightlens.sources import sinks as K
from freightlens.sources.model import Freight
from freightlens.streaming import live


def column(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, v double")


@pytest.mark.parametrize(("values", "want"), [([10, 20, 30, 40], [0, 1 / 3, 2 / 3, 1]), ([7, 7, 7], [0.5] * 3), ([], [])])
def test_min_max(spark, values, want):
    assert [r.v_norm for r in M.min_max(column(spark, values), ["v"]).orderBy("i").collect()] == pytest.approx(want)


def test_min_max_ignores_scale(spark):
    a = M.min_max(column(spark, [3, 9, 4]), ["v"]).orderBy("i").collect()
    b = M.min_max(column(spark, [30, 90, 40]), ["v"]).orderBy("i").collect()
    assert [r.v_norm for r in a] == pytest.approx([r.v_norm for r in b])


def test_z_scores(spark):
    z = [r.v_z for r in M.z_scores(column(spark, [10, 20, 30, 40, 50]), ["v"]).orderBy("i").collect()]
    assert sum(z) == pytest.approx(0) and sum(x * x for x in z) / 5 == pytest.approx(1)
    assert {r.v_z for r in M.z_scores(column(spark, [0.1] * 12), ["v"]).collect()} == {0.0}


@pytest.mark.parametrize(("ys", "slope", "intercept", "r2"), [([2, 5, 8, 11, 14], 3, 2, 1), ([4, 4, 4], 0, 4, 0), ([7], 0, 7, 0)])
def test_regression(spark, ys, slope, intercept, r2):
    row = M.regression(column(spark, ys), "i", "v").first()
    assert (row.slope, row.intercept, row.r2) == pytest.approx((slope, intercept, r2))


def plain_clusters(rows, k):
    """Labels and spread with numpy: the same draws, distances as one matrix."""
    x, draw = np.array(rows, float), random.Random(42)
    picked = [draw.randrange(len(x))]
    while len(picked) < k:
        near = ((x[:, None] - x[picked][None]) ** 2).sum(2).min(1)
        total = near.sum()
        picked.append(draw.randrange(len(x)) if total <= 0 else int(np.searchsorted(near.cumsum(), draw.random() * total)))
    centres, labels = x[picked].copy(), np.zeros(len(x), int)
    for _ in range(100):
        new = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        same, labels = (new == labels).all(), new
        for j in set(labels):
            centres[j] = x[labels == j].mean(0)
        if same:
            break
    return labels.tolist(), ((x - centres[labels]) ** 2).sum()


@pytest.mark.parametrize("k", [2, 3, 5])
def test_k_means(spark, k):
    r = random.Random(3)
    for points in ([[0, 0], [0, 1], [1, 0], [10, 10], [10, 11], [11, 10]], [[r.gauss(0, 3), r.gauss(0, 1)] for _ in range(40)]):
        df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "place int, x double, y double").persist()
        found, centres, spread = M.k_means(df, ["x", "y"], k)
        labels, want = plain_clusters(points, k)
        assert [x.cluster for x in found.orderBy("place").collect()] == labels and spread == pytest.approx(want) and len(centres) == k


def test_k_means_of_few_rows(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 1.0)], "place int, x double")
    assert len(M.k_means(df, ["x"], 5)[1]) == 2 and M.k_means(df.limit(0), ["x"], 3)[1:] == ([], 0.0)


def test_typology_reports_its_clusters(spark, sf_dir):
    m = Freight(spark, sf_dir)
    rows, clusters = M.typology(m, 3).collect(), M.typology_clusters(m, 3).orderBy("cluster").collect()
    assert {c.cluster: c.districts for c in clusters} == dict(Counter(r.cluster for r in rows)) and {c.k for c in clusters} == {3}
    heavy = [c.capacity_z + c.flow_z + c.congestion_z + c.incidents_z for c in clusters]
    assert heavy == sorted(heavy) and len({c.inertia for c in clusters}) == 1


def test_index_is_a_permutation(spark, sf_dir):
    rows = M.load_index(Freight(spark, sf_dir)).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, len(rows) + 1))
    assert all(0 <= r["score"] <= 100 for r in rows)


def test_forecast_needs_four_months(spark, sf_dir):
    m = Freight(spark, sf_dir)
    assert M.forecast(m, horizon=99).count() == 12 and M.forecast(m, horizon=1).count() == 3
    m.flow_lines = m.flow_lines.where("period_date < date'1995-04-01'")
    assert M.forecast(m).count() == 0


def test_scenario_for_some_districts_changes_them(spark, sf_dir):
    m = Freight(spark, sf_dir)
    assert M.scenario(m, flow=0, capacity=0, road=0).where("delta <> 0").count() == 0
    assert M.scenario(m, flow=80, capacity=0, road=0, only=[3]).where("delta <> 0").count() > 0


def test_compare_keeps_order_and_repeats(spark, sf_dir):
    rows = M.compare(Freight(spark, sf_dir), [3, 99, 1, 3]).orderBy("place").collect()
    assert [r.district_id for r in rows] == [3, 1, 3] and sum(r.leads_flow for r in rows) == 1


def test_plans_push_filters_and_columns(spark, sf_dir):
    plan = Freight(spark, sf_dir).table("customer").where("c_custkey = 7").select("c_name")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(c_custkey), EqualTo(c_custkey,7)]" in plan and "ReadSchema: struct<c_custkey:bigint,c_name:string>" in plan


def test_top_k_limits_before_the_shuffle(spark, sf_dir):
    assert "WindowGroupLimit" in A.similar_routes(Freight(spark, sf_dir))._jdf.queryExecution().toString()


SCRIPT = """-- seed
INSERT INTO districts (name, short_name, area_sq_km, population, center, extra) VALUES ('O''Neil, north', 'N', 12.5, NULL, ST_SetSRID(ST_MakePoint(37.6, 55.7), 4326), 1);
INSERT INTO districts (name, short_name) VALUES (NULL, 'S');
INSERT INTO districts (name) VALUES ('a', 'b');
INSERT INTO districts (name, geom) VALUES ('x', ST_Buffer(1));
INSERT INTO traffic_conditions (recorded_at, road_id, congestion_level, incident_flag) VALUES ('2025-01-01 12:00:00', 1, 5, TRUE);
"""


def test_seed_script(spark, tmp_path):
    (tmp_path / "seed.sql").write_text(SCRIPT)
    journal = {r.table: r for r in S.load(spark, str(tmp_path / "seed.sql"), str(tmp_path / "out")).collect()}
    assert (journal["districts"].records_loaded, journal["districts"].records_errors, journal["districts"].status) == (2, 2, "partial")
    log = spark.read.parquet(str(tmp_path / "out/etl_log.parquet")).collect()
    assert [(r.id, r.target_table, r.records_loaded, r.records_errors, r.status) for r in log] == [(1, "seed:seed.sql", 3, 2, "partial")]
    assert journal["traffic_conditions"].status == "success"
    rows = spark.read.parquet(str(tmp_path / "out/districts.parquet")).orderBy("id").collect()
    assert [(r.id, r.name, r.short_name, r.center) for r in rows] == [(1, "O'Neil, north", "N", "POINT (37.6 55.7)"), (2, "", "S", None)]
    at = spark.read.parquet(str(tmp_path / "out/traffic_conditions.parquet")).first()
    assert str(at.recorded_at) == "2025-01-01 09:00:00" and at.incident_flag is True
    rejected = S.first_errors(S.read_script(spark, str(tmp_path / "seed.sql"))).collect()
    assert len(rejected) == 2


MORE = """insert into public."road_segments" ("name", geom) values ('a', ST_SetSRID(ST_GeomFromText('LINESTRING(37.6 55.7, 37.7 55.8)'), 4326)), ('b', ST_GeomFromText('POINT(1 2)', 3857)), ('c; (d)', NULL);
INSERT INTO traffic_incidents (reported_at, severity, road_id) VALUES ('2025-01-01 12:00:00+00', 2, 1), ('2025-01-01T12:00:00Z', 3, 1), ('2025-01-01 12:00', 4, 1), ('soon', 5, 1), ('2025-01-01 12:00:00', 'high', 1);
INSERT INTO data_sources (name, is_active) VALUES ('x', TRUE
"""


def test_seed_script_forms(spark, tmp_path):
    (tmp_path / "more.sql").write_text(MORE)
    found = {r.table: (r.records_loaded, r.records_errors) for r in S.load(spark, str(tmp_path / "more.sql"), str(tmp_path / "out")).collect()}
    assert found == {"road_segments": (3, 0), "traffic_incidents": (3, 2), "data_sources": (0, 1)}
    roads = spark.read.parquet(str(tmp_path / "out/road_segments.parquet")).orderBy("id").collect()
    assert [(r.id, r.name, r.geom) for r in roads] == [(1, "a", "LINESTRING(37.6 55.7, 37.7 55.8)"), (2, "b", "SRID=3857;POINT(1 2)"), (3, "c; (d)", None)]
    at = spark.read.parquet(str(tmp_path / "out/traffic_incidents.parquet")).orderBy("id").collect()
    assert [str(r.reported_at) for r in at] == ["2025-01-01 12:00:00", "2025-01-01 12:00:00", "2025-01-01 09:00:00"]
    errors = {r.error for r in S.read_script(spark, str(tmp_path / "more.sql")).where("error IS NOT NULL").collect()}
    assert errors == {"misfit in reported_at", "misfit in severity", "unbalanced parentheses"}


@pytest.mark.parametrize(("text", "want"), [("1, 'a,b', f(1, 2)", ["1", "'a,b'", "f(1, 2)"]), ("'it''s, ok', NULL", ["'it''s, ok'", "NULL"]), ("", [])])
def test_split_values(text, want):
    assert S.split_values(text) == want


def test_centres_fill_only_gaps(spark):
    d = spark.createDataFrame([(1, "N", None), (2, "S", "POINT (1 1)")], "id int, short_name string, center string")
    c = spark.createDataFrame([("N", "POINT (2 2)"), ("S", "POINT (3 3)")], "short_name string, center string")
    assert [r.center for r in S.fill_centres(d, c).orderBy("id").collect()] == ["POINT (2 2)", "POINT (1 1)"]
    assert [r.center for r in S.fill_centres(d, c, force=True).orderBy("id").collect()] == ["POINT (2 2)", "POINT (3 3)"]


def test_csv_and_features(spark, tmp_path):
    df = spark.createDataFrame([(1, "a;b", True, 1.5), (2, None, False, None)], "id int, name string, ok boolean, v double")
    K.write_csv(K.titled(df, {"id": "Id", "name": "Name", "ok": "Ok", "v": "V"}).coalesce(1), str(tmp_path / "csv"))
    text = next((tmp_path / "csv").glob("part-*.csv")).read_text(encoding="utf-8")
    assert text.startswith("﻿Id;Name;Ok;V") and '1;"a;b";yes;1.5' in text and "2;;no;" in text
    places = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0)], "id int, lon double, lat double").withColumns({"kind": F.lit("POINT"), "shape": K.point_shape()})
    assert [r.feature for r in K.features(places, ["id"]).collect()] == ['{"type":"Feature","geometry":{"type":"Point","coordinates":[1.0,2.0]},"properties":{"id":1}}']


def test_stale_files(spark):
    files = spark.createDataFrame([("a",), ("b",)], "path string")
    assert [r.path for r in K.stale_files(files, spark.createDataFrame([("a", 1)], "path string, id int")).collect()] == ["b"]


def test_stream_counts_every_event_once(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = live.hourly_levels(stream).writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.awaitTermination(60)
    assert spark.table("hours").agg(F.sum("samples")).first()[0] == events.count()


def test_entry_without_training_text(spark):
    import __spark_entry__ as entry

    assert "load_index" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
