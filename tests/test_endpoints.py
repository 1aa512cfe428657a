"""The public query surface, pages and report helpers."""

import json

import pytest
from pyspark.sql import functions as F

from freightlens.operators import filters as P
from freightlens.plans import endpoints as E
from freightlens.sources import sinks as K
from freightlens.sources.model import Freight


@pytest.fixture(scope="module")
def m(spark, sf_dir):
    return Freight(spark, sf_dir)


@pytest.mark.parametrize("name", sorted(set(E.ENDPOINTS) - {"objects/nearby", "objects/detail"}))
def test_every_endpoint_answers_without_parameters(m, name):
    assert E.ask(m, name).limit(1).count() == 1


def test_page_size_is_held_within_bounds(m):
    assert E.ask(m, "objects").count() == 50
    assert E.ask(m, "etl-runs", page_size="100000").count() == 500
    assert E.ask(m, "etl-runs", page_size="-3").count() == 1


def test_unknown_values_mean_no_filter(m):
    whole = E.ask(m, "roads", page_size="500").count()
    assert E.ask(m, "roads", page_size="500", **{"class": "footpath"}).count() == whole
    assert E.ask(m, "roads", page_size="500", district="x").count() == whole


def test_nearby_needs_a_place_and_is_sorted(m):
    with pytest.raises(E.BadRequest):
        E.ask(m, "objects/nearby", lon="37.6")
    rows = E.ask(m, "objects/nearby", lon="37.6", lat="55.7", radius="25", limit="999").collect()
    assert 0 < len(rows) <= 100 and [r.distance_km for r in rows] == sorted(r.distance_km for r in rows) and rows[-1].distance_km <= 25
    with pytest.raises(E.BadRequest):
        E.ask(m, "nothing")


def test_pages_by_raw_number(spark):
    df = spark.range(53)
    page = lambda raw: [r.id for r in P.html_page(df, [F.col("id")], 25, raw).collect()]
    assert page("x") == page("1") == list(range(25)) and page("9") == page("0") == [50, 51, 52] and page(2)[0] == 25


def test_json_keeps_nulls(spark):
    row = E.as_json(spark.createDataFrame([(1, None)], "id int, name string")).first()
    assert json.loads(row["json"]) == {"id": 1, "name": None}


def test_typology_names_every_district_once(m):
    rows = E.ask(m, "analytics/typology", k="99").collect()
    assert len({r.district_id for r in rows}) == len(rows) == 25 and {r.label for r in rows} <= {"calm", "balanced", "busy", "critical"}


def test_file_name(spark):
    name = K.file_name(F.lit("Übersicht: Lager & Häfen"), F.to_timestamp(F.lit("2025-03-04 05:06:07")), "csv")
    assert spark.range(1).select(name).first()[0] == "ubersicht-lager-hafen-20250304-050607.csv"


def test_report_is_limited(m):
    assert K.report_rows(m.facility, [F.col("id")], 7).count() == 7


def test_lists_have_an_envelope_and_errors(m):
    row = E.listed(m, "objects", page="2", page_size="20").first()
    assert (row["count"], row["page"], row["previous"], len(json.loads(row["results"]))) == (m.facility.count(), 2, 1, 20)
    with pytest.raises(E.NotFound):
        E.listed(m, "objects", page="9999")
    with pytest.raises(E.NotFound):
        E.ask(m, "objects/detail", id="-5")
    with pytest.raises(E.Unprocessable):
        E.ask(m, "analytics/forecast", district="99")


def test_collections_count_their_features(m):
    row = K.collection(K.district_layer(m)).first()
    found = json.loads(row["collection"])
    assert found["type"] == "FeatureCollection" and found["count"] == len(found["features"]) == 25
