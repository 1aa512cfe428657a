"""Geometry over WGS-84 longitudes and latitudes as plain column expressions.

A geometry column is text (WKT or EWKT); parsed, it's an array of rings of
points ``struct<lon, lat>`` (points and lines have one ring). Nothing here leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
KM_PER_DEGREE = 111.0
_NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
_POINT = rf"({_NUMBER})\s+({_NUMBER})(?:\s+{_NUMBER})*"
_RING = rf"{_POINT}(?:\s*,\s*{_POINT})*"
_WKT = rf"^\s*(?:SRID\s*=\s*\d+\s*;)?\s*(POINT|LINESTRING|POLYGON|MULTIPOLYGON)\s*\(.*\)\s*$"


def geometry_type(wkt: Column) -> Column:
    """POINT, LINESTRING, POLYGON or MULTIPOLYGON; null for anything else."""
    return F.nullif(F.upper(F.regexp_extract(wkt, f"(?i){_WKT}", 1)), F.lit(""))


def srid(wkt: Column) -> Column:
    """The reference system, 4326 if none is given."""
    return F.coalesce(F.nullif(F.regexp_extract(wkt, r"(?i)^\s*SRID\s*=\s*(\d+)", 1), F.lit("")).try_cast("int"), F.lit(4326))


def _ring_list(text: Column) -> Column:
    """The rings written in a text, in order."""
    def point(text: Column) -> Column:
        part = F.split(F.trim(text), r"\s+")
        return F.struct(part[0].cast("double").alias("lon"), part[1].cast("double").alias("lat"))

    return F.transform(
        F.regexp_extract_all(text, F.lit(rf"\(({_RING})\)"), F.lit(0)), lambda ring: F.transform(F.split(F.regexp_replace(ring, r"[()]", ""), ","), point),
    )


def rings(wkt: Column) -> Column:
    """Rings of points, those of all parts in order; null for text that isn't a geometry of the four types."""
    found = _ring_list(wkt)
    return F.when(geometry_type(wkt).isNotNull() & (F.size(found) > 0), found)


def polygons(wkt: Column) -> Column:
    """Parts of a polygon or multipolygon, each with its outer ring and its holes; null for other text."""
    kind, found = geometry_type(wkt), rings(wkt)
    texts = F.transform(F.split(wkt, r"\)\s*\)\s*,\s*\(\s*\("), lambda t: F.concat(F.lit("("), F.regexp_replace(t, r"^[^\d.+-]*\(+|\)+\s*$", ""), F.lit(")")))
    return F.when(kind == "POLYGON", F.array(found)).when((kind == "MULTIPOLYGON") & found.isNotNull(), F.transform(texts, _ring_list))


def polygons_to_wkt(parts: Column) -> Column:
    """WKT of parts with holes; one part is a polygon."""
    def part(rings: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(rings, _ring_text), ", "), F.lit(")"))

    return F.when(F.size(parts) == 1, F.concat(F.lit("POLYGON "), part(parts[0]))).when(F.size(parts) > 1, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(parts, part), ", "), F.lit(")")))


def polygons_to_geojson(parts: Column) -> Column:
    """GeoJSON geometry of parts with holes; one part is a polygon."""
    pairs = F.transform(parts, lambda p: F.transform(p, lambda r: F.transform(r, lambda x: F.array(x["lon"], x["lat"]))))
    return F.when(F.size(parts) == 1, F.concat(F.lit('{"type":"Polygon","coordinates":'), F.to_json(pairs[0]), F.lit("}"))).when(
        F.size(parts) > 1, F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(pairs), F.lit("}")),
    )


def vertices(shape: Column) -> Column:
    """All points in order."""
    return F.flatten(shape)


def bounds(shape: Column) -> Column:
    """Struct of the least and greatest longitude and latitude; null without points."""
    points = vertices(shape)
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.when(F.size(points) > 0, F.struct(F.array_min(lon).alias("min_lon"), F.array_min(lat).alias("min_lat"), F.array_max(lon).alias("max_lon"), F.array_max(lat).alias("max_lat")))


def vertex_mean(shape: Column) -> Column:
    """Mean of all vertices, a ring's closing vertex included."""
    points = vertices(shape)

    def mean(axis: str) -> Column:
        return F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]) / F.size(points)

    return F.when(F.size(points) > 0, F.struct(mean("lon").alias("lon"), mean("lat").alias("lat")))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle kilometres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def length_km(shape: Column) -> Column:
    """Length along all vertices in order; a point has 0."""
    points = vertices(shape)
    n = F.size(points)
    steps = F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda p, q: haversine(p["lon"], p["lat"], q["lon"], q["lat"]))
    return F.when(n > 1, F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)).when(n == 1, F.lit(0.0))


def thinned(points: Column, every: int) -> Column:
    """Every n-th vertex and the last; three or fewer stay as they are."""
    kept = F.filter(points, lambda _, i: i % every == 0)
    last = F.element_at(points, -1)
    return F.when((F.size(points) <= 3) | F.lit(every <= 1), points).when(F.element_at(kept, -1) == last, kept).otherwise(F.concat(kept, F.array(last)))


def _decimal(x: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.6f", x), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(text == "-0", "0").otherwise(text)


def _ring_text(points: Column) -> Column:
    return F.concat(F.lit("("), F.array_join(F.transform(points, lambda p: F.concat_ws(" ", _decimal(p["lon"]), _decimal(p["lat"]))), ", "), F.lit(")"))


def to_wkt(kind: Column, shape: Column) -> Column:
    """WKT with at most six decimals; the rings of a multipolygon are its parts' outer rings (``polygons_to_wkt`` keeps holes)."""
    texts = F.transform(shape, _ring_text)
    return (
        F.when(kind.isin("POINT", "LINESTRING"), F.concat_ws(" ", kind, texts[0]))
        .when(kind == "POLYGON", F.concat(kind, F.lit(" ("), F.array_join(texts, ", "), F.lit(")")))
        .when(kind == "MULTIPOLYGON", F.concat(kind, F.lit(" (("), F.array_join(texts, "), ("), F.lit("))")))
    )


def to_geojson(kind: Column, shape: Column) -> Column:
    """GeoJSON geometry text of parsed rings; null without a shape. A multipolygon's rings are its parts' outer rings (``wkt_to_geojson`` keeps holes)."""
    names = {"POINT": "Point", "LINESTRING": "LineString", "POLYGON": "Polygon", "MULTIPOLYGON": "MultiPolygon"}
    pairs = F.transform(shape, lambda r: F.transform(r, lambda p: F.array(p["lon"], p["lat"])))
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for code, name in names.items():
        body = {"POINT": F.to_json(pairs[0][0]), "LINESTRING": F.to_json(pairs[0]), "POLYGON": F.to_json(pairs), "MULTIPOLYGON": F.to_json(F.transform(pairs, lambda r: F.array(r)))}[code]
        out = out.when((kind == code) & shape.isNotNull(), F.concat(F.lit(f'{{"type":"{name}","coordinates":'), body, F.lit("}")))
    return out


def wkt_to_geojson(wkt: Column) -> Column:
    """GeoJSON geometry of any of the four types; a multipolygon keeps its parts and their holes."""
    kind, shape = geometry_type(wkt), rings(wkt)
    pairs = F.transform(polygons(wkt), lambda p: F.transform(p, lambda r: F.transform(r, lambda x: F.array(x["lon"], x["lat"]))))
    many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":'), F.to_json(pairs), F.lit("}"))
    return F.when(kind == "MULTIPOLYGON", F.when(shape.isNotNull(), many)).otherwise(to_geojson(kind, shape))


def map_centre(centre: Column, boundary: Column) -> Column:
    """Where a district is marked: its centre, else the vertex mean of its boundary, else nowhere."""
    return F.coalesce(vertex_mean(rings(centre)), vertex_mean(rings(boundary)))


def from_geojson(text: Column) -> Column:
    """WKT of a GeoJSON point, line, polygon or multipolygon, bare or inside a feature; null for anything else."""
    body = F.coalesce(F.get_json_object(text, "$.geometry"), text)
    kind, raw = F.get_json_object(body, "$.type"), F.get_json_object(body, "$.coordinates")
    read = lambda depth: F.from_json(raw, "array<" * depth + "double" + ">" * depth)
    pair = lambda p: F.struct(p[0].alias("lon"), p[1].alias("lat"))
    line = lambda r: F.transform(r, pair)
    part = lambda p: F.transform(p, line)
    return (
        F.when(kind == "Point", F.concat(F.lit("POINT "), _ring_text(F.array(pair(read(1))))))
        .when(kind == "LineString", F.concat(F.lit("LINESTRING "), _ring_text(line(read(2)))))
        .when(kind == "Polygon", polygons_to_wkt(F.array(part(read(3)))))
        .when(kind == "MultiPolygon", polygons_to_wkt(F.transform(read(4), part)))
    )


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether a point lies in (min lon, min lat, max lon, max lat), edges included."""
    return lon.between(box[0], box[2]) & lat.between(box[1], box[3])


def meets_box(own: Column, box: tuple[float, float, float, float]) -> Column:
    """Whether bounds meet a box, edges included."""
    return (own["min_lon"] <= box[2]) & (own["max_lon"] >= box[0]) & (own["min_lat"] <= box[3]) & (own["max_lat"] >= box[1])


def of_shape(df: DataFrame, wkt: str) -> DataFrame:
    """Add ``lon`` and ``lat``, the vertex mean of a geometry of any kind, and ``box``, its bounds; both null without one."""
    shape = rings(F.col(wkt))
    mid = vertex_mean(shape)
    return df.withColumns({"lon": mid["lon"], "lat": mid["lat"], "box": bounds(shape)})


def nearest(df: DataFrame, lon: float, lat: float, radius_km: float, limit: int, key: str = "id") -> DataFrame:
    """Rows within a radius by distance: a box that the scan can use, the distance, then a top-k."""
    import math

    dy = radius_km / KM_PER_DEGREE
    dx = radius_km / max(KM_PER_DEGREE * math.cos(math.radians(lat)), 1e-6)
    near = df.where(in_box(F.col("lon"), F.col("lat"), (lon - dx, lat - dy, lon + dx, lat + dy)))
    near = near.withColumn("distance_km", haversine(F.lit(lon), F.lit(lat), F.col("lon"), F.col("lat"))).where(F.col("distance_km") <= radius_km)
    return near.orderBy("distance_km", key).limit(limit)


def extent(df: DataFrame) -> DataFrame:
    """Bounds of all rows with a place; nulls without any."""
    return df.agg(F.min("lon").alias("min_lon"), F.min("lat").alias("min_lat"), F.max("lon").alias("max_lon"), F.max("lat").alias("max_lat"))
