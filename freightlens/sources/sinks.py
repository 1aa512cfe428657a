"""Report outputs: data sets with titled columns, CSV, JSON lines, GeoJSON, chart series, file names.

XLSX, DOCX and PDF need libraries that aren't part of Spark; ``report_rows`` gives
the rows that such a writer would print.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freightlens.functions import derived as d
from freightlens.functions.geometry import geometry_type, rings, thinned, to_geojson, vertices, wkt_to_geojson
from freightlens.operators import aggregates as A
from freightlens.operators.filters import equal_if_given, search
from freightlens.sources.model import DIRECTIONS, Freight

MAP_MAX_FEATURES = 5000
REPORT_ROWS = 400


def as_text(column: str, kind: str) -> Column:
    """Text of a value in a report: words for booleans, plain decimals, day and minute for instants, nothing for null."""
    x = F.col(column)
    if kind == "boolean":
        x = d.yes_no(x)
    elif kind.startswith("decimal") or kind in ("double", "float"):
        x = d.plain_decimal(x)
    elif kind.startswith("timestamp"):
        x = F.date_format(x, "dd.MM.yyyy HH:mm")
    elif kind == "date":
        x = F.date_format(x, "dd.MM.yyyy")
    return F.coalesce(x.cast("string"), F.lit(""))


def titled(df: DataFrame, titles: dict[str, str]) -> DataFrame:
    """All columns as text under their titles."""
    kinds = dict(df.dtypes)
    return df.select(*[as_text(c, kinds[c]).alias(t) for c, t in titles.items()])


def write_csv(df: DataFrame, path: str) -> None:
    """Semicolon-separated text with a header and a byte order mark; one file for each partition."""
    first = df.columns[0]
    marked = df.withColumnRenamed(first, "\ufeff" + first)
    marked.write.mode("overwrite").option("sep", ";").option("header", True).option("emptyValue", "").csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def features(df: DataFrame, properties: list[str], kind: str = "kind", shape: str = "shape", limit: int | None = MAP_MAX_FEATURES) -> DataFrame:
    """GeoJSON features as text; rows without a shape are left out, at most ``limit`` of them (a map's cap)."""
    rows = df.where(F.col(shape).isNotNull())
    rows = rows.limit(limit) if limit else rows
    return rows.select(feature(to_geojson(F.col(kind), F.col(shape)), F.to_json(F.struct(*properties))).alias("feature"))


def point_shape(lon: str = "lon", lat: str = "lat") -> Column:
    """A parsed point of two columns, null if either is missing."""
    return F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), F.array(F.array(F.struct(F.col(lon).alias("lon"), F.col(lat).alias("lat")))))


def facility_layer(m: Freight, limit: int | None = MAP_MAX_FEATURES) -> DataFrame:
    """Map layer of facilities with a place."""
    rows = m.facility.withColumns({"kind": F.lit("POINT"), "shape": point_shape()}).orderBy("id")
    return features(rows, ["id", "name", "type"], limit=limit)


def chart_series(m: Freight) -> DataFrame:
    """Labels and values of the monthly series, in order, as one row of JSON. The rows are months."""
    s = A.flow_timeseries(m).select("month", "volume")
    packed = F.transform(F.array_sort(F.collect_list(F.struct("month", "volume"))), lambda x: F.struct(F.date_format(x["month"], "MM.yy").alias("label"), x["volume"].cast("decimal(20,2)").alias("value")))
    return s.agg(F.to_json(packed).alias("series"))


def report_rows(df: DataFrame, order: list[Column], limit: int = REPORT_ROWS) -> DataFrame:
    """The first rows of a printed report."""
    return df.orderBy(*order).limit(limit)


def report_note(df: DataFrame, limit: int = REPORT_ROWS) -> DataFrame:
    """How many rows there are, how many a printed report shows and how many it leaves out, with a line that says so if any are."""
    left = F.greatest(F.col("total") - limit, F.lit(0).cast("long"))
    counted = df.agg(F.count(F.lit(1)).alias("total")).select("total", F.least("total", F.lit(limit).cast("long")).alias("shown"), left.alias("left_out"))
    note = F.concat(F.lit("The first "), F.col("shown").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" rows are shown."))
    return counted.withColumn("note", F.when(F.col("left_out") > 0, note))


def file_name(title: Column, at: Column, extension: str) -> Column:
    """Slug of the title, the instant to the second and the extension."""
    return F.concat(d.slug(d.compatible(title)), F.lit("-"), F.date_format(at, "yyyyMMdd-HHmmss"), F.lit(f".{extension}"))


def stale_files(files: DataFrame, ledger: DataFrame) -> DataFrame:
    """Files that no export in the ledger names (anti-join)."""
    return files.join(ledger.select("path"), "path", "left_anti")


def export_objects(m: Freight, district: int | None = None, kind: str | None = None, q: str | None = None) -> DataFrame:
    """Facilities with district names and utilisation; the filters of the report."""
    rows = search(equal_if_given(m.facility, district_id=district, type=kind), q, "name", "address")
    names = m.district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    return rows.join(names, "district_id", "left").select("id", "name", "type", "district", F.col("capacity_tons").cast("double").alias("capacity"), d.quotient(F.col("capacity_tons"), F.col("area_sq_m")).alias("utilization"))


def export_districts(m: Freight) -> DataFrame:
    """Districts with their measures and state, by volume."""
    p = A.district_profiles(m)
    return p.select(F.col("name").alias("district"), F.col("area_sq_km").cast("double").alias("area"), "population", "objects", "capacity", "volume", "vehicles", "road_km", "congestion", d.congestion_state(F.col("congestion")).alias("state"))


def export_roads(m: Freight, district: int | None = None, road_class: str | None = None) -> DataFrame:
    """Roads with their newest measurement."""
    now = A.latest_per_road(m).select(F.col("road_id").alias("id"), "level", "speed", "recorded_at")
    names = m.district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    rows = equal_if_given(m.road, district_id=district, road_class=road_class).join(names, "district_id", "left").join(now, "id", "left")
    return rows.select("name", "road_class", "district", F.col("length_km").cast("double").alias("length"), "lanes", "speed_limit_kmh", "level", "speed", "recorded_at")


def export_incidents(m: Freight, severity: int | None = None) -> DataFrame:
    """Incidents with road, district, label and hours."""
    rows = m.incident.where(F.col("severity") >= severity) if severity else m.incident
    roads = m.road.select(F.col("id").alias("road_id"), F.col("name").alias("road"), "district_id")
    names = m.district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    hours = d.hours_between(F.col("reported_at"), F.coalesce("resolved_at", m.now()))
    return rows.join(roads, "road_id", "left").join(names, "district_id", "left").select(
        "id", "incident_type", "severity", d.severity_label(F.col("severity")).alias("label"), "road", "district", "reported_at", "resolved_at", F.bround(hours, 1).alias("hours"), "affects_cargo",
    )


def export_flows(m: Freight, direction: str | None = None) -> DataFrame:
    """Flows with labels of month, direction and district."""
    names = m.district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    label = F.element_at(F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair]), F.col("direction"))
    return equal_if_given(m.flow, direction=direction).join(names, "district_id", "left").select(
        "id", F.date_format("period_date", "MM.yyyy").alias("period"), label.alias("direction"), "district", "category", F.col("volume_tons").cast("double").alias("volume"), "vehicle_count", "avg_speed_kmh",
    )


def export_routes(m: Freight, kind: str | None = None) -> DataFrame:
    """Routes with the names of their ends."""
    ends = m.district.select("id", "name")
    rows = equal_if_given(m.route, route_type=kind)
    for end in ("origin", "destination"):
        rows = rows.join(ends.select(F.col("id").alias(f"{end}_id"), F.col("name").alias(end)), f"{end}_id")
    return rows.select("id", "route_type", "origin", "destination", F.col("distance_km").cast("long").alias("distance_km"), F.col("duration_h").cast("long").alias("duration_h"), "trucks")


def export_totals(m: Freight) -> DataFrame:
    """Totals under the reports of roads, incidents, flows and routes: name and value, a row each."""
    parts = [
        m.road.agg(F.count(F.lit(1)).cast("double").alias("roads"), A.amount("length_km").alias("road km")),
        m.incident.agg(F.count(F.lit(1)).cast("double").alias("incidents"), F.count_if(F.col("resolved_at").isNull()).cast("double").alias("open incidents"), F.count_if("affects_cargo").cast("double").alias("cargo incidents")),
        m.flow_lines.agg(F.count(F.lit(1)).cast("double").alias("flows"), A.amount("volume_tons").alias("volume"), A.amount("vehicle_count").alias("vehicles")),
        m.route.agg(F.count(F.lit(1)).cast("double").alias("routes"), A.amount("trucks").alias("trucks")),
    ]
    return reduce(DataFrame.unionByName, [df.unpivot([], df.columns, "name", "value") for df in parts])


def road_layer(m: Freight) -> DataFrame:
    """Map layer of roads with a geometry and their newest state; not capped."""
    now = A.latest_per_road(m).select(F.col("road_id").alias("id"), "level", "state")
    rows = m.road.where("geom IS NOT NULL").join(now, "id", "left").withColumns({"kind": geometry_type(F.col("geom")), "shape": rings(F.col("geom"))})
    return features(rows, ["id", "name", "level", "state"], limit=None)


def district_layer(m: Freight) -> DataFrame:
    """Map layer of district centres with volume."""
    rows = A.district_profiles(m).withColumns({"kind": F.lit("POINT"), "shape": point_shape()}).orderBy("district_id")
    return features(rows, ["district_id", "name", "objects", "incidents"])


def incident_layer(m: Freight, state: str = "", cargo: bool = False, limit: int | None = MAP_MAX_FEATURES) -> DataFrame:
    """Map layer of incidents with a place, the latest first; only open ones or those that affect cargo if asked for."""
    rows = m.incident.where("resolved_at IS NULL") if state == "open" else m.incident
    rows = rows.where("affects_cargo") if cargo else rows
    rows = rows.withColumns({"kind": F.lit("POINT"), "shape": point_shape(), "is_open": F.col("resolved_at").isNull()}).where("shape IS NOT NULL")
    return features(rows.orderBy(F.desc("reported_at"), F.desc("id")), ["id", "incident_type", "severity", "is_open"], limit=limit)


def route_layer(m: Freight, every: int = 2, limit: int | None = MAP_MAX_FEATURES) -> DataFrame:
    """Map layer of routes with a geometry, every other vertex and the last of it."""
    rows = m.route.where("geom IS NOT NULL").withColumns({"kind": geometry_type(F.col("geom")), "shape": F.array(thinned(vertices(rings(F.col("geom"))), every))})
    return features(rows.orderBy("id"), ["id", "route_type", "trucks"], limit=limit)


def area_layer(m: Freight) -> DataFrame:
    """Map layer of district boundaries, all parts with their holes."""
    rows = m.boundary.where("geom IS NOT NULL")
    return rows.select(feature(wkt_to_geojson(F.col("geom")), F.to_json(F.struct("id", "name"))).alias("feature"))


def feature(geometry: Column, properties: Column) -> Column:
    """One GeoJSON feature."""
    return F.concat(F.lit('{"type":"Feature","geometry":'), geometry, F.lit(',"properties":'), properties, F.lit("}"))


def titled_features(df: DataFrame, titles: dict[str, str], geom: str = "geom") -> DataFrame:
    """Features of a GeoJSON file: all columns as text under their titles; rows without a geometry are left out."""
    kinds, body = dict(df.dtypes), wkt_to_geojson(F.col(geom))
    properties = F.to_json(F.struct(*[as_text(c, kinds[c]).alias(t) for c, t in titles.items()]))
    return df.withColumn("_geometry", body).where("_geometry IS NOT NULL").select(feature(F.col("_geometry"), properties).alias("feature"))


def file_head(features: DataFrame, title: str, system: str, now: Column) -> DataFrame:
    """What stands before the features of a GeoJSON file: its name, reference system, and the number of features."""
    crs = "urn:ogc:def:crs:OGC:1.3:CRS84"
    return features.agg(F.count(F.lit(1)).alias("count")).select(F.to_json(F.struct(
        F.lit("FeatureCollection").alias("type"), F.lit(title).alias("name"), F.struct(F.lit("name").alias("type"), F.struct(F.lit(crs).alias("name")).alias("properties")).alias("crs"),
        F.struct(F.lit(system).alias("system"), F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss").alias("generated_at"), "count").alias("metadata"),
    )).alias("head"))


def forecast_chart(m: Freight, district: int | None = None, horizon: int = 6) -> DataFrame:
    """Facts and forecast on one axis of months, as one row of JSON. Where one series has no value it has a null; the forecast begins at the last fact."""
    from freightlens.plans.analytics import forecast

    facts = A.flow_timeseries(m, district).select("month", F.col("volume").alias("fact"))
    ahead = forecast(m, district, horizon).select("month", F.lit(None).cast("double").alias("fact"), F.col("forecast").alias("predicted"))
    last = facts.agg(F.max("month").alias("month")).withColumn("is_last", F.lit(True))
    shown = facts.join(last, "month", "left").select("month", "fact", F.when(F.col("is_last"), F.col("fact")).alias("predicted")).unionByName(ahead)
    rows = F.array_sort(F.collect_list(F.struct("month", "fact", "predicted")))  # one row a month
    values = lambda name: F.transform("rows", lambda x: x[name].cast("decimal(20,2)"))
    return shown.agg(rows.alias("rows")).select(F.to_json(F.struct(F.transform("rows", lambda x: F.date_format(x["month"], "MM.yy")).alias("labels"), values("fact").alias("fact"), values("predicted").alias("predicted"))).alias("chart"))


def collection(layer: DataFrame, limit: int = MAP_MAX_FEATURES) -> DataFrame:
    """One FeatureCollection of at most ``limit`` features, with their count; larger layers are written as lines of features (``file_head``)."""
    layer = layer.limit(limit)
    body = F.array_join(F.collect_list("feature"), ",")
    return layer.agg(F.concat(F.lit('{"type":"FeatureCollection","count":'), F.count(F.lit(1)).cast("string"), F.lit(',"features":['), body, F.lit("]}")).alias("collection"))


def expired(ledger: DataFrame, now: Column, days: int) -> DataFrame:
    """Exports in the ledger that are older than so many days."""
    return ledger.where(F.col("created_at") < now - F.expr(f"INTERVAL '{int(days)}' DAY"))


def export_summary(m: Freight) -> DataFrame:
    """Totals under the report of facilities."""
    return m.facility.agg(F.count(F.lit(1)).alias("objects"), A.amount("capacity_tons").alias("capacity"), F.count_if(d.round_the_clock(F.col("operating_hours"))).alias("whole_day"))
