"""Derived columns, geometry and parameters on hand-made values."""

import pytest
from pyspark.sql import functions as F

from freightlens.functions import derived as d
from freightlens.functions import geometry as g
from freightlens.operators import filters as P


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("a", "b", "want"), [(10, 4, 2.5), (0, 4, None), (10, 0, None), (None, 4, None)])
def test_quotient(spark, a, b, want):
    assert one(spark, d.quotient(F.lit(a).cast("int"), F.lit(b).cast("int"))) == want


def test_speed_ratio_keeps_zero(spark):
    assert one(spark, d.speed_ratio(F.lit(0), F.lit(60))) == 0.0
    assert one(spark, d.speed_ratio(F.lit(30), F.lit(0))) is None


@pytest.mark.parametrize(("level", "state"), [(0, "free"), (-1, "free"), (3, "light"), (6, "moderate"), (7, "heavy"), (10, "jam"), (None, "unknown")])
def test_congestion_state(spark, level, state):
    assert one(spark, d.congestion_state(F.lit(level).cast("int"))) == state


def test_severity(spark):
    assert [one(spark, d.severity_label(F.lit(v).cast("int"))) for v in (0, None, 3, 9)] == ["minor", "minor", "serious", "unknown"]


def test_error_rate_and_share(spark):
    assert one(spark, d.error_rate(F.lit(1), F.lit(3))) == 25.0
    assert one(spark, d.error_rate(F.lit(0), F.lit(0))) == 0.0
    assert one(spark, d.share_percent(F.lit(300), F.lit(100))) == 100.0
    assert one(spark, d.share_percent(F.lit(3), F.lit(0))) == 0.0


def test_text(spark):
    assert one(spark, d.slug(F.lit("  Été à l'Öst -- Straße!"))) == "ete-a-l-ost-strasse"
    assert one(spark, d.shortened(F.lit("abcdefgh"), 5)) == "abcd…"
    assert one(spark, d.shortened(F.lit(" "), 5)) == "-"
    assert one(spark, d.lenient_double(F.lit(" 3,5 "))) == 3.5
    assert one(spark, d.lenient_double(F.lit("x"))) is None
    assert one(spark, d.plain_decimal(F.lit("12.50"))) == "12.5"
    assert one(spark, d.plain_decimal(F.lit("100"))) == "100"
    assert one(spark, d.tons(F.lit(2500000))) == "2,50 Mt"
    assert one(spark, d.id_list(F.lit("3, x,5,,7"))) == [3, 5, 7]
    assert one(spark, d.paragraphs(F.lit("a\n\n b \n\n\n\n"))) == ["a", "b"]


@pytest.mark.parametrize("wkt", ["POINT (37.6 55.7)", "LINESTRING (1 2, 3 4, 5.5 -6)", "POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))"])
def test_wkt_round_trip(spark, wkt):
    text = F.lit("SRID=4326;" + wkt.lower())
    assert one(spark, g.to_wkt(g.geometry_type(text), g.rings(text))) == wkt


@pytest.mark.parametrize("bad", ["", "POINT", "POINT (1)", "CIRCLE (1 2)", "LINESTRING (1 2", "POINT (a b)"])
def test_bad_wkt_is_null(spark, bad):
    assert one(spark, g.rings(F.lit(bad))) is None


def test_geojson(spark):
    assert one(spark, g.from_geojson(F.lit('{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2]}}'))) == "POINT (1.5 2)"
    assert one(spark, g.from_geojson(F.lit('{"type":"LineString","coordinates":[[1,2],[3,4]]}'))) == "LINESTRING (1 2, 3 4)"
    assert one(spark, g.to_geojson(F.lit("POINT"), g.rings(F.lit("POINT (1 2)")))) == '{"type":"Point","coordinates":[1.0,2.0]}'


def test_distances(spark):
    km = one(spark, g.haversine(F.lit(37.6173), F.lit(55.7558), F.lit(30.3351), F.lit(59.9343)))
    assert 630 < km < 640
    assert 110 < one(spark, g.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) < 112
    assert one(spark, g.haversine(F.lit(1.0), F.lit(2.0), F.lit(1.0), F.lit(2.0))) == 0


def test_line(spark):
    shape = g.rings(F.lit("LINESTRING (37.6 55.7, 37.8 55.9, 37.5 55.6)"))
    assert tuple(one(spark, g.bounds(shape))) == (37.5, 55.6, 37.8, 55.9)
    assert one(spark, g.length_km(g.rings(F.lit("POINT (1 2)")))) == 0
    thin = one(spark, g.thinned(g.vertices(g.rings(F.lit("LINESTRING (0 0, 1 0, 2 0, 3 0, 4 0, 5 0)"))), 2))
    assert [p["lon"] for p in thin] == [0, 2, 4, 5]


def test_parameters():
    assert P.int_param("7") == 7 and P.int_param("x", 3) == 3
    assert P.choice_param("b", ("a", "b")) == "b" and P.choice_param("z", ("a",), "a") == "a"
    assert P.float_param("300", -90, 200) == 200 and P.float_param("nan", -90, 200) == 0
    assert P.box_param("1,2,3,4") == (1, 2, 3, 4) and P.box_param("1,2") is None and P.box_param("a,b,c,d") is None
    assert [P.page_of(51, 25, p) for p in (1, 3, 4, 0, -2)] == [1, 3, 3, 3, 3]


def test_search_takes_wildcards_literally(spark):
    df = spark.createDataFrame([(1, "50% off", None), (2, "500 off", "Été"), (3, None, "x_y")], "id int, a string, b string")
    assert [r.id for r in P.search(df, "0%", "a", "b").collect()] == [1]
    assert [r.id for r in P.search(df, " éTÉ ", "a", "b").collect()] == [2]
    assert P.search(df, "  ", "a").count() == 3


def test_latest_breaks_ties_by_key(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 7), (3, "a", 7), (4, "b", 1)], "id int, g string, t int")
    assert sorted(r.id for r in P.latest(df, "g", "t").collect()) == [3, 4]


def test_helpers(spark):
    assert one(spark, d.icon(F.lit("a"), {"a": "A"}, "?")) == "A" and one(spark, d.icon(F.lit("b"), {"a": "A"}, "?")) == "?"
    assert [one(spark, d.file_size(F.lit(n))) for n in (5, 2048, 3 << 20)] == ["5 B", "2,0 KB", "3,0 MB"]
    assert one(spark, d.age_days(F.to_date(F.lit("2025-01-01")), F.to_date(F.lit("2025-01-31")))) == 30


def test_slug_of_cyrillic(spark):
    from pyspark.sql import functions as F

    from freightlens.functions import derived as d

    titles = {"Отчёт: Щёлково, объекты 2025": "otchet-schelkovo-obekty-2025", "???": "report", "Чёрный жук": "chernyy-zhuk"}
    rows = spark.createDataFrame([(t,) for t in titles], "t string").select("t", d.slug(F.col("t")).alias("s")).collect()
    assert {r.t: r.s for r in rows} == titles


def test_means_round_ties_to_even(spark):
    from pyspark.sql import functions as F

    from freightlens.functions import derived as d

    rows = spark.createDataFrame([(17, 8), (19, 8), (1, 3), (0, 0), (5, 1)], "s long, n long").select(d.rounded_mean(F.col("s"), F.col("n")).alias("x")).collect()
    assert [r.x for r in rows] == [round(17 / 8, 2), round(19 / 8, 2), 0.33, None, 5.0]


def test_minutes_and_published(spark):
    from datetime import datetime as T

    from pyspark.sql import functions as F

    from freightlens.functions import derived as d
    from freightlens.operators import filters as P

    df = spark.createDataFrame([(1, T(2025, 1, 1, 10), T(2025, 1, 1, 10, 30), True, T(2025, 1, 1)), (2, T(2025, 1, 1), None, True, T(2026, 1, 1)), (3, T(2025, 1, 1), None, False, T(2025, 1, 1))], "id int, a timestamp, b timestamp, is_published boolean, published_at timestamp")
    assert [r.m for r in df.select(d.minutes_between(F.col("a"), F.col("b")).alias("m")).collect()] == [30.0, None, None]
    assert [r.id for r in P.published(df, F.lit(T(2025, 6, 1))).collect()] == [1]


def test_holes_and_parts_stay(spark):
    from pyspark.sql import functions as F

    from freightlens.functions import geometry as g

    ring, hole, far = "(0 0, 4 0, 4 4, 0 0)", "(1 1, 2 1, 2 2, 1 1)", "(9 9, 10 9, 10 10, 9 9)"
    texts = {f"POLYGON ({ring}, {hole})": 1, f"MULTIPOLYGON (({ring}, {hole}), ({far}))": 2, f"multipolygon((({ring[1:-1]}),{hole}) , ({far}))": 2, "POINT (1 2)": None}
    c = F.col("t")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.size(g.polygons(c)).alias("n"), g.polygons_to_wkt(g.polygons(c)).alias("wkt"), g.from_geojson(g.polygons_to_geojson(g.polygons(c))).alias("back")).collect()
    for r in rows:
        want = texts[r.t]
        assert (r.n if r.n != -1 else None) == want
        if want:
            assert r.wkt == r.back == (f"POLYGON ({ring}, {hole})" if want == 1 else f"MULTIPOLYGON (({ring}, {hole}), ({far}))")


def test_boxes_and_distances_of_any_shape(spark):
    from pyspark.sql import functions as F

    from freightlens.functions import geometry as g

    df = g.of_shape(spark.createDataFrame([(1, "LINESTRING (37 55, 38 56)"), (2, "POLYGON ((40 60, 41 60, 41 61, 40 60))"), (3, None)], "id int, w string"), "w")
    assert [r.id for r in df.where(g.meets_box(F.col("box"), (37.9, 55.9, 39.0, 57.0))).collect()] == [1]
    assert [r.id for r in g.nearest(df, 37.5, 55.5, 25, 5).collect()] == [1]
