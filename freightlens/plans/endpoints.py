"""The public query surface: each endpoint turns request parameters into a plan.

Parameters are text, as a request has them. Unknown or malformed ones mean no filter;
limits are held within their bounds. A list is one page of at most 500 rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import derived as d
from freightlens.functions import geometry as g
from freightlens.operators import aggregates as A
from freightlens.operators import filters as P
from freightlens.plans import analytics as M
from freightlens.sources.model import ROAD_CLASSES, ROUTE_TYPES, Freight

PAGE_SIZE, PAGE_MOST = 50, 500
#: Inside the library: the rows of a list without paging.
ALL_ROWS = "all"
Params = dict[str, str]


class BadRequest(ValueError):
    """A parameter that an endpoint can't do without is missing or malformed."""


class NotFound(LookupError):
    """There is no such row or page."""


class Unprocessable(ValueError):
    """The data can't give what was asked for."""


def page(df: DataFrame, p: Params, order: list[Column]) -> DataFrame:
    """The page asked for, sorted."""
    if p.get("page_size") == ALL_ROWS:
        return df
    size = max(1, min(P.int_param(p.get("page_size"), PAGE_SIZE), PAGE_MOST))
    return P.paged(df, order, size, max(1, P.int_param(p.get("page"), 1)))


def place(lon: str, lat: str) -> Column:
    """GeoJSON of a point in two columns, null if either is missing."""
    return F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.to_json(F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))))


def districts(m: Freight, p: Params) -> DataFrame:
    return page(m.district.withColumn("density", d.quotient(F.col("population"), F.col("area_sq_km"))).withColumn("area_sq_km", F.col("area_sq_km").cast("double")), p, [F.col("name")])


def district_summary(m: Freight, p: Params) -> DataFrame:
    return A.district_profiles(m).orderBy(F.desc("volume"), "district_id")


def types(m: Freight, p: Params) -> DataFrame:
    return A.objects_by_type(m).orderBy("type")


def cargo_categories(m: Freight, p: Params) -> DataFrame:
    return m.category.withColumns({"is_hazardous": d.hazard(F.col("hazard_class")), "hazard_label": d.hazard_label(F.col("hazard_class"))}).orderBy("name")


def object_detail(m: Freight, p: Params) -> DataFrame:
    """One facility with its names; a missing one is an error."""
    rows = m.facility.where(F.col("id") == P.int_param(p.get("id"), -1))
    if rows.isEmpty():
        raise NotFound("no such facility")
    names = m.district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    return rows.join(names, "district_id").select("id", "name", "type", "district", "address", "operating_hours", F.col("capacity_tons").cast("double").alias("capacity"), "lon", "lat")


def sources(m: Freight, p: Params) -> DataFrame:
    return m.source.orderBy("name")


def objects(m: Freight, p: Params) -> DataFrame:
    rows = P.equal_if_given(m.facility, district_id=P.int_param(p.get("district")), type=p.get("type"))
    rows = P.search(rows, p.get("q"), "name", "address")
    names = m.district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    return page(rows.join(names, "district_id").select("id", "name", "type", "district", F.col("capacity_tons").cast("double").alias("capacity"), place("lon", "lat").alias("geometry")), p, [F.col("name"), F.col("id")])


def nearby(m: Freight, p: Params) -> DataFrame:
    try:
        lon, lat = float(p["lon"]), float(p["lat"])
    except (KeyError, ValueError) as e:
        raise BadRequest("lon and lat are needed") from e
    radius, limit = P.float_param(p.get("radius"), 0.0, 25.0, 3.0), max(1, min(P.int_param(p.get("limit"), 20), 100))
    return g.nearest(m.facility, lon, lat, radius, limit).select("id", "name", F.round("distance_km", 3).alias("distance_km"))


def roads(m: Freight, p: Params) -> DataFrame:
    rows = P.equal_if_given(m.road, district_id=P.int_param(p.get("district")), road_class=P.choice_param(p.get("class"), ROAD_CLASSES))
    return page(rows.select("id", "name", "road_class", "district_id", "lanes", "speed_limit_kmh", g.wkt_to_geojson(F.col("geom")).alias("geometry")), p, [F.col("name"), F.col("id")])


def incidents(m: Freight, p: Params) -> DataFrame:
    rows = P.equal_if_given(m.incident, incident_type=p.get("type"))
    state = P.choice_param(p.get("state"), ("open", "closed"))
    if state:
        rows = rows.where(F.col("resolved_at").isNull() if state == "open" else F.col("resolved_at").isNotNull())
    if p.get("cargo"):
        rows = rows.where("affects_cargo")
    if severity := P.int_param(p.get("severity")):
        rows = rows.where(F.col("severity") >= severity)
    names = m.road.select(F.col("id").alias("road_id"), F.col("name").alias("road"))
    return page(rows.join(names, "road_id", "left").select("id", "incident_type", "severity", "affects_cargo", "road", "reported_at", place("lon", "lat").alias("geometry")), p, [F.desc("reported_at"), F.desc("id")])


def routes(m: Freight, p: Params) -> DataFrame:
    rows = P.equal_if_given(m.route, route_type=P.choice_param(p.get("type"), ROUTE_TYPES))
    return page(rows.select("id", "origin_id", "destination_id", "route_type", F.col("distance_km").cast("long").alias("distance_km"), "trucks", g.wkt_to_geojson(F.col("geom")).alias("geometry")), p, [F.col("id")])


def flows(m: Freight, p: Params) -> DataFrame:
    rows = P.equal_if_given(m.flow, district_id=P.int_param(p.get("district")), category=p.get("category"), direction=p.get("direction"))
    for name, test in (("period_from", Column.__ge__), ("period_to", Column.__le__)):
        if p.get(name):
            rows = rows.where(test(F.col("period_date"), F.to_date(F.lit(p[name]))))
    return page(rows.select("id", "period_date", "district_id", "category", "direction", F.col("volume_tons").cast("double").alias("volume"), "vehicle_count"), p, [F.desc("period_date"), F.col("id")])


def etl_runs(m: Freight, p: Params) -> DataFrame:
    names = m.source.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return page(m.run.join(names, "source_id", "left").select("id", "source", "status", "records_loaded", "records_errors"), p, [F.desc("id")])


def traffic_current(m: Freight, p: Params) -> DataFrame:
    raw = p.get("district", "")
    rows = P.equal_if_given(m.road, district_id=int(raw) if raw.isdigit() else None).select(F.col("id").alias("road_id"), "name")
    return rows.join(A.latest_per_road(m), "road_id").select("road_id", "name", "level", "state", d.congestion_tone(F.col("level")).alias("tone")).orderBy(F.desc("level"), "name")


def load_index(m: Freight, p: Params) -> DataFrame:
    return M.load_index(m).orderBy("rank")


def forecast(m: Freight, p: Params) -> DataFrame:
    found = M.forecast(m, P.int_param(p.get("district")), P.int_param(p.get("horizon"), 6)).orderBy("step")
    if found.isEmpty():
        raise Unprocessable("fewer than four months of data")
    return found


def typology(m: Freight, p: Params) -> DataFrame:
    return M.typology(m, max(2, min(6, P.int_param(p.get("k"), 4))))


ENDPOINTS: dict[str, Callable[[Freight, Params], DataFrame]] = {
    "districts": districts, "districts/summary": district_summary, "types": types, "sources": sources, "cargo-categories": cargo_categories, "objects": objects, "objects/detail": object_detail, "objects/nearby": nearby,
    "roads": roads, "incidents": incidents, "routes": routes, "flows": flows, "etl-runs": etl_runs, "traffic/current": traffic_current,
    "analytics/load-index": load_index, "analytics/forecast": forecast, "analytics/typology": typology,
}


def ask(m: Freight, endpoint: str, **params: str) -> DataFrame:
    """The rows that an endpoint answers with."""
    if endpoint not in ENDPOINTS:
        raise BadRequest(f"no endpoint {endpoint}")
    return ENDPOINTS[endpoint](m, params)


def listed(m: Freight, endpoint: str, **params: str) -> DataFrame:
    """One row: the envelope of a list (count, pages, neighbouring pages) with its page of rows as JSON; a page beyond the end is an error."""
    size, number = max(1, min(P.int_param(params.get("page_size"), PAGE_SIZE), PAGE_MOST)), max(1, P.int_param(params.get("page"), 1))
    whole = ask(m, endpoint, **(params | {"page": "1", "page_size": ALL_ROWS}))
    envelope = P.envelope(whole, size, number)
    if number > 1 and number > envelope.first()["pages"]:
        raise NotFound(f"no page {number}")
    rows = ask(m, endpoint, **params).select(F.struct("*").alias("row"))  # one page at most
    return envelope.crossJoin(F.broadcast(rows.agg(F.to_json(F.collect_list("row"), {"ignoreNullFields": "false"}).alias("results"))))


def as_json(df: DataFrame) -> DataFrame:
    """Rows as JSON text, nulls written out."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))
