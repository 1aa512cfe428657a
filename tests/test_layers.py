"""Layers with holes and thinning, titled features, report notes, parameters, centres and labels."""

import json

import pytest
from pyspark.sql import functions as F

from freightlens.functions import derived as d
from freightlens.functions import geometry as g
from freightlens.operators import filters as P
from freightlens.sources import sinks as K
from freightlens.sources.model import Freight

HOLED = "MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1)), ((20 20, 21 20, 21 21, 20 20)))"


@pytest.fixture(scope="module")
def m(spark, sf_dir):
    return Freight(spark, sf_dir)


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("wkt", "want"), [
    ("POINT (1 2)", {"type": "Point", "coordinates": [1, 2]}), ("SRID=4326;linestring (1 2, 3 4)", {"type": "LineString", "coordinates": [[1, 2], [3, 4]]}),
    ("POLYGON ((0 0, 9 0, 9 9, 0 0), (1 1, 2 1, 2 2, 1 1))", {"type": "Polygon", "coordinates": [[[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]]}),
    (HOLED, {"type": "MultiPolygon", "coordinates": [[[[0, 0], [9, 0], [9, 9], [0, 0]], [[1, 1], [2, 1], [2, 2], [1, 1]]], [[[20, 20], [21, 20], [21, 21], [20, 20]]]]}),
    ("MULTIPOLYGON (((0 0, 9 0, 9 9, 0 0)))", {"type": "MultiPolygon", "coordinates": [[[[0, 0], [9, 0], [9, 9], [0, 0]]]]}), ("nonsense", None), (None, None),
])
def test_geometry_keeps_its_holes(spark, wkt, want):
    found = value(spark, g.wkt_to_geojson(F.lit(wkt).cast("string")))
    assert (json.loads(found) if found else None) == want


def test_routes_are_thinned(m):
    features = [json.loads(r.feature) for r in K.route_layer(m).collect()]
    assert {len(f["geometry"]["coordinates"]) for f in features} == {3}
    whole = [json.loads(r.feature) for r in K.route_layer(m, every=1).collect()]
    assert [f["geometry"]["coordinates"] for f in features] == [f["geometry"]["coordinates"][::2] for f in whole]


def test_titled_features_and_their_head(spark):
    df = spark.createDataFrame([(1, "a", 2.50, "POINT (1 2)"), (2, None, None, "POINT (3 4)"), (3, "c", 1.0, None)], "id int, name string, tons double, geom string")
    features = K.titled_features(df, {"name": "Name", "tons": "Tons"})
    assert [json.loads(r.feature)["properties"] for r in features.collect()] == [{"Name": "a", "Tons": "2.5"}, {"Name": "", "Tons": ""}]
    head = json.loads(K.file_head(features, "All", "us", F.to_timestamp(F.lit("2025-01-02 03:04:05"))).first()["head"])
    assert (head["name"], head["metadata"]) == ("All", {"system": "us", "generated_at": "2025-01-02T03:04:05", "count": 2})


def test_report_note(spark):
    assert tuple(K.report_note(spark.range(7), 5).first()) == (7, 5, 2, "The first 5 of 7 rows are shown.")
    assert tuple(K.report_note(spark.range(5), 5).first()) == (5, 5, 0, None)


def test_chart_joins_at_the_last_fact(m):
    chart = json.loads(K.forecast_chart(m, horizon=4).first()["chart"])
    n = len(chart["labels"])
    assert len(chart["fact"]) == len(chart["predicted"]) == n and chart["fact"][-4:] == [None] * 4 and None not in chart["fact"][:-4]
    assert chart["predicted"][: n - 5] == [None] * (n - 5) and chart["predicted"][n - 5] == chart["fact"][n - 5] and None not in chart["predicted"][n - 5 :]


def test_parameters():
    assert P.choice_param(" open ", ("open", "closed")) == "open" and P.choice_param("x", ("open",), "open") == "open" and P.choice_param(None, ("open",)) == ""
    assert P.int_param(" 7 ") == 7 and P.int_param("7.5", 3) == 3 and P.int_param(None, 4) == 4 and P.int_param("", 5) == 5 and P.int_param(0, 9) == 0
    assert P.float_param("2,5", 0, 10) == 2.5 and P.float_param("nan", 0, 10, 1.0) == 1.0 and P.float_param("99", 0, 10) == 10 and P.float_param("x", 0, 10, 2.0) == 2.0


def test_centres_and_labels(spark):
    at = lambda a, b: value(spark, g.map_centre(F.lit(a).cast("string"), F.lit(b).cast("string")))
    assert tuple(at("POINT (1 2)", HOLED)) == (1, 2) and tuple(at(None, "POLYGON ((0 0, 4 0, 4 4, 0 0))")) == (2, 1) and at(None, None) is None
    assert [value(spark, d.hazard_label(F.lit(x).cast("int"))) for x in (None, 0, 3, 42)] == ["not hazardous", "not hazardous", "flammable liquids", "class 42"]
    assert value(spark, K.file_name(F.lit("ﬁle Ⅷ ｗｉｄｅ"), F.to_timestamp(F.lit("2025-01-02 03:04:05")), "csv")) == "file-viii-wide-20250102-030405.csv"


def test_incident_layers(m):
    whole, open_ = K.incident_layer(m, limit=None).count(), K.incident_layer(m, "open", limit=None).count()
    assert whole == m.incident.where("lon IS NOT NULL").count() > open_ == m.incident.where("lon IS NOT NULL AND resolved_at IS NULL").count() > 0
