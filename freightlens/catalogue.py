"""All registered queries over the freight model, and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.functions import derived as d
from freightlens.functions import geometry as g
from freightlens.operators import aggregates as A
from freightlens.operators import filters as P
from freightlens.operators import paging, spatial_index, trigrams
from freightlens.oracles import ORACLES
from freightlens.plans import analytics as M
from freightlens.plans import incremental
from freightlens.plans.endpoints import ask, listed
from freightlens.sources import seed_script
from freightlens.sources import sinks as K
from freightlens.sources.model import Freight
from freightlens.sources.workspace import built
from freightlens.streaming import live

CENTRE = (37.6173, 55.7558)
BOX = (37.4, 55.6, 37.7, 55.8)
FACILITY_SORTS = {"capacity": [("capacity_tons", True), ("name", False)], "name": [("name", False)], "area": [("area_sq_m", True)]}


def scan_project(m: Freight) -> DataFrame:
    return m.facility.select("id", "name", "type")


def point_lookup(m: Freight) -> DataFrame:
    return m.facility.where("id = 42").select("id", "name", "type", "district_id")


def filter_optional(m: Freight) -> DataFrame:
    return P.equal_if_given(m.facility, district_id=7, type="", source_id=None).select("id", "district_id")


def search_or(m: Freight) -> DataFrame:
    return P.search(m.facility, " ROUND ", "name", "address", "operating_hours").select("id")


def search_wildcards(m: Freight) -> DataFrame:
    return P.search(m.facility, "t_1%", "name", "address").select("id")


def search_parts(m: Freight) -> DataFrame:
    return P.search(m.table("part"), "Red", "p_name", "p_type", "p_brand").select("p_partkey")


def filter_threshold(m: Freight) -> DataFrame:
    return m.incident.where("severity >= 4").select("id", "severity")


def filter_range(m: Freight) -> DataFrame:
    rows = m.flow_lines.where(F.col("period_date").between(F.to_date(F.lit("1996-02-01")), F.to_date(F.lit("1996-03-15"))))
    return rows.select("id", "period_date", F.col("volume_tons").cast("double").alias("volume"))


def filter_asof(m: Freight) -> DataFrame:
    return m.incident.where(P.since("reported_at", m.now(), 5)).select("id", "severity")


def filter_null(m: Freight) -> DataFrame:
    return m.incident.where("resolved_at IS NULL").select("id")


def filter_flags(m: Freight) -> DataFrame:
    return m.incident.where("affects_cargo AND resolved_at IS NOT NULL").select("id", "severity")


def filter_located(m: Freight) -> DataFrame:
    return m.facility.where("lon IS NOT NULL").select("id")


def filter_whole_day(m: Freight) -> DataFrame:
    return m.facility.where(d.round_the_clock(F.col("operating_hours"))).select("id", "operating_hours")


def filter_empty_address(m: Freight) -> DataFrame:
    return m.facility.where(P.null_or_empty("address")).select("id")


def fk_path_filter(m: Freight) -> DataFrame:
    roads = m.road.where("district_id = 7").select(F.col("id").alias("road_id"), "name")
    return m.incident.join(roads, "road_id").select("id", "road_id", "name")


def filter_keys(m: Freight) -> DataFrame:
    keys = m.road.where("lanes = 6").select(F.col("id").alias("road_id"))
    return m.condition.join(keys, "road_id", "left_semi").select("id", "road_id", "level")


def sort_whitelist(m: Freight) -> DataFrame:
    return P.sorted_by(m.facility, "capacity", FACILITY_SORTS, "name").limit(100).select("id", "name", F.col("capacity_tons").cast("double").alias("capacity"))


def page_window(m: Freight) -> DataFrame:
    return P.paged(m.facility, [F.col("name"), F.col("id")], 25, 3).select("id", "name")


def page_envelope(m: Freight) -> DataFrame:
    return P.envelope(m.facility.where("district_id = 7"), 25, 2)


def default_orders(m: Freight) -> DataFrame:
    """The first five rows of every entity in its default order."""
    parts = []
    for entity in P.ORDERINGS:
        best = P.in_default_order(getattr(m, entity), entity).limit(5).agg(F.collect_list(F.col("id").cast("long")).alias("ids"))  # five rows, in order
        parts.append(best.select(F.lit(entity).alias("entity"), F.posexplode("ids").alias("place", "id")))
    return reduce(DataFrame.unionByName, parts)


def district_types(m: Freight) -> DataFrame:
    """A district's facilities by type, with the district's name among the group's labels."""
    names = m.district.where("id = 7").select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    return m.facility.join(names, "district_id").groupBy("district", "type").agg(F.count(F.lit(1)).alias("objects"), A.amount("capacity_tons").alias("capacity")).orderBy(F.desc("objects"), "type")


def top_objects(m: Freight) -> DataFrame:
    return m.facility.orderBy(F.desc_nulls_last("capacity_tons"), "id").limit(8).select("id", F.col("capacity_tons").cast("double").alias("capacity"))


def recent_incidents(m: Freight) -> DataFrame:
    return m.incident.orderBy(F.desc("reported_at"), F.desc("id")).limit(8).select("id", "severity", "incident_type")


def same_district_objects(m: Freight) -> DataFrame:
    """For every facility the six largest others of its district; seven a district suffice, so no pairs of all facilities are formed."""
    f = m.facility.select("id", "district_id", F.coalesce("capacity_tons", F.lit(-1)).cast("double").alias("c"))
    best = P.top_per_group(f.select(F.col("id").alias("other_id"), "district_id", "c"), "district_id", [F.desc("c"), F.col("other_id")], 7, "r").drop("r")
    pairs = f.select("id", "district_id").join(best, "district_id").where("id <> other_id")
    return P.top_per_group(pairs, "id", [F.desc("c"), F.col("other_id")], 6).select("id", "other_id", "rank")


def derived_ratios(m: Freight) -> DataFrame:
    return m.facility.select("id", d.quotient(F.col("capacity_tons"), F.col("area_sq_m")).alias("utilization"))


def route_ratios(m: Freight) -> DataFrame:
    return m.route.select("id", d.quotient(F.col("distance_km"), F.col("duration_h")).alias("speed"), d.product(F.col("trucks"), F.col("distance_km")).alias("truck_km"))


def flow_loads(m: Freight) -> DataFrame:
    return m.flow_lines.select("id", d.quotient(F.col("volume_tons"), F.col("vehicle_count")).alias("load"))


def congestion_states(m: Freight) -> DataFrame:
    return m.condition.groupBy(d.congestion_state(F.col("level")).alias("state"), d.congestion_tone(F.col("level")).alias("tone")).agg(F.count(F.lit(1)).alias("n"), F.min("level").alias("low"), F.max("level").alias("high"))


def severity_states(m: Freight) -> DataFrame:
    return m.incident.groupBy(d.severity_label(F.col("severity")).alias("label"), d.severity_tone(F.col("severity")).alias("tone")).agg(F.count(F.lit(1)).alias("n"))


def speed_ratios(m: Freight) -> DataFrame:
    roads = m.road.select(F.col("id").alias("road_id"), "speed_limit_kmh")
    return m.condition.join(roads, "road_id").select("id", d.speed_ratio(F.col("speed"), F.col("speed_limit_kmh")).alias("ratio"))


def durations(m: Freight) -> DataFrame:
    return m.incident.select("id", F.col("resolved_at").isNull().alias("is_open"), d.hours_between(F.col("reported_at"), F.coalesce("resolved_at", m.now())).alias("hours"))


def error_rates(m: Freight) -> DataFrame:
    return m.run.select("id", d.error_rate(F.col("records_errors"), F.col("records_loaded")).alias("error_percent"))


def text_functions(m: Freight) -> DataFrame:
    p = m.table("part")
    name = F.col("p_name")
    return p.select("p_partkey", d.slug(F.concat_ws(" ", "p_type", name)).alias("slug"), d.shortened(name, 12).alias("short"), d.yes_no(F.col("p_size") > 25).alias("large"), d.plain_decimal(F.col("p_retailprice").cast("decimal(10,2)")).alias("price"))


def month_labels(m: Freight) -> DataFrame:
    return A.flow_timeseries(m).select(F.date_format("month", "MM.yy").alias("label"), F.col("volume"))


def fk_labels(m: Freight) -> DataFrame:
    names = m.district.select(F.col("id").alias("district_id"), F.col("name").alias("district"))
    sources = m.source.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    return m.facility.join(names, "district_id").join(sources, "source_id", "left").select("id", "district", "source")


def roads_latest(m: Freight) -> DataFrame:
    now = A.latest_per_road(m).select("road_id", "level", "state")
    return m.road.withColumnRenamed("id", "road_id").join(now, "road_id", "left").select("road_id", "name", "level", "state")


def category_shares(m: Freight) -> DataFrame:
    from pyspark.sql.window import Window

    by = m.flow_parts.groupBy("category").agg(F.sum("volume_tons").cast("double").alias("volume"), F.sum("flows").alias("flows"))
    return by.withColumn("flow_share", F.col("flows").cast("double") / F.sum("flows").over(Window.partitionBy()))


def bbox_filter(m: Freight) -> DataFrame:
    return m.facility.where(g.in_box(F.col("lon"), F.col("lat"), BOX)).select("id", "lon", "lat")


def nearest_radius(m: Freight) -> DataFrame:
    return g.nearest(m.facility, *CENTRE, radius_km=8, limit=20).select("id", F.round("distance_km", 2).alias("distance_km"))


def district_distances(m: Freight) -> DataFrame:
    a = m.district.select(F.col("id").alias("a"), "lon", "lat", "region_id")
    b = m.district.select(F.col("id").alias("b"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"), "region_id")
    return a.join(b, "region_id").where("a < b").select("a", "b", F.round(g.haversine(F.col("lon"), F.col("lat"), F.col("lon2"), F.col("lat2")), 2).alias("km"))


def extent(m: Freight) -> DataFrame:
    return g.extent(m.facility)


def line_metrics(m: Freight) -> DataFrame:
    """Lines drawn from district centres, written as text and parsed back."""
    x, y = F.col("lon"), F.col("lat")
    wkt = F.concat(F.lit("LINESTRING ("), F.concat_ws(", ", *[F.concat_ws(" ", F.format_string("%.2f", x + dx), F.format_string("%.2f", y + dy)) for dx, dy in ((0, 0), (0.1, 0.1), (0.3, 0.1), (0.3, 0.4))]), F.lit(")"))
    shape = g.rings(F.col("wkt"))
    box, mid = g.bounds(shape), g.vertex_mean(shape)
    return m.district.withColumn("wkt", wkt).select("id", F.round(g.length_km(shape), 2).alias("km"), F.round(mid["lon"], 4).alias("mid_lon"), F.round(mid["lat"], 4).alias("mid_lat"), box["min_lon"].alias("min_lon"), box["max_lat"].alias("max_lat"), F.size(g.thinned(g.vertices(shape), 3)).cast("long").alias("thin"))


def wkt_roundtrip(m: Freight) -> DataFrame:
    wkt = F.concat(F.lit("SRID=4326;point("), F.format_string("%.6f", F.col("lon")), F.lit("   "), F.format_string("%.6f", F.col("lat")), F.lit(")"))
    return m.facility.where("lon IS NOT NULL").select("id", g.to_wkt(g.geometry_type(wkt), g.rings(wkt)).alias("wkt"), g.srid(wkt).alias("srid"))


def minmax(m: Freight) -> DataFrame:
    return M.min_max(m.facility.select("id", "capacity_tons"), ["capacity_tons"]).select("id", "capacity_tons_norm")


def zscore(m: Freight) -> DataFrame:
    return M.z_scores(m.facility.select("id", F.col("capacity_tons").cast("double").alias("c")), ["c"]).select("id", F.round("c_z", 6).alias("z"))


PAGE_ORDER = [("capacity_tons", True), ("id", False)]


def _pages(m: Freight) -> paging.Pages:
    rows = m.facility.select("id", "name", "capacity_tons")
    return paging.Pages(m.spark, built(m.spark, "pages", m.sf_dir, lambda path: paging.write_pages(rows, path, PAGE_ORDER, ranges=16)), PAGE_ORDER)


def deep_page(m: Freight, which: str) -> DataFrame:
    """The first, the middle or the last page of all facilities by capacity."""
    pages = _pages(m)
    number = {"first": 1, "middle": (pages.last(25) + 1) // 2, "last": pages.last(25)}[which]
    return pages.page(25, number).select("id", "name", F.col("capacity_tons").cast("double").alias("capacity"))


def _points(m: Freight) -> spatial_index.SpatialIndex:
    rows = m.facility.select("id", "name", "lon", "lat")
    return spatial_index.SpatialIndex(m.spark, built(m.spark, "facility_cells", m.sf_dir, lambda path: spatial_index.write_indexed(rows, path, spatial_index.point_bounds())))


def box_indexed(m: Freight) -> DataFrame:
    return _points(m).in_box(BOX).select("id", "lon", "lat")


def nearest_indexed(m: Freight) -> DataFrame:
    return _points(m).nearest(*CENTRE, radius_km=8, limit=20).select("id", F.round("distance_km", 2).alias("distance_km"))


def roads_in_box(m: Freight) -> DataFrame:
    """Roads whose bounds meet a box, by an index over their lines."""
    build = lambda path: spatial_index.write_indexed(m.road.select("id", "name", "geom"), path, g.bounds(g.rings(F.col("geom"))))
    return spatial_index.SpatialIndex(m.spark, built(m.spark, "road_cells", m.sf_dir, build)).in_box(BOX).select("id", "name")


def trigram_search(m: Freight) -> DataFrame:
    """Facilities with a term in their name or address, by the trigram index."""
    rows = m.facility.select("id", "name", "address")
    path = built(m.spark, "facility_trigrams", m.sf_dir, lambda path: trigrams.write_trigrams(rows, path, "id", ["name", "address"]))
    return trigrams.TrigramIndex(m.spark, path).search(rows, "EET 4", "id", "name", "address").select("id", "name", "address")


def monthly_incremental(m: Freight) -> DataFrame:
    """The monthly series from sums that are kept by file; here the first refresh reads all files."""
    def build(path: str) -> None:
        incremental.MonthlySums(m.spark, f"{m.sf_dir}/lineitem.parquet", path).refresh()

    return incremental.MonthlySums(m.spark, f"{m.sf_dir}/lineitem.parquet", built(m.spark, "monthly_sums", m.sf_dir, build)).series()


def congestion_episodes(m: Freight) -> DataFrame:
    return live.episodes(m.condition).select("road_id", F.col("began").cast("timestamp_ntz").alias("began"), F.col("ends").cast("timestamp_ntz").alias("ends"), "samples", "worst")


def script_roundtrip(m: Freight) -> DataFrame:
    """Roads written as INSERT statements over several lines each and read back by the splitting reader."""
    quoted = F.concat(F.lit("'"), F.replace(F.col("name"), F.lit("'"), F.lit("''")), F.lit("'"))
    line = F.concat(F.lit("INSERT INTO road_segments (id, name, lanes,\n  length_km, district_id) VALUES ("), F.concat_ws(", ", F.col("id").cast("string"), quoted, F.col("lanes").cast("string"), F.col("length_km").cast("string"), F.coalesce(F.col("district_id").cast("string"), F.lit("NULL"))), F.lit(");"))
    path = built(m.spark, "road_script", m.sf_dir, lambda path: m.road.select(line).write.mode("overwrite").text(path))
    rows = seed_script.typed_table(seed_script.read_statements(m.spark, path, 4096), "road_segments")
    return rows.select("id", "name", "lanes", F.col("length_km").cast("double").alias("length_km"), "district_id")


def export_objects(m: Freight) -> DataFrame:
    return K.export_objects(m, kind="MACHINERY", q="street 1")


_QUERIES: dict[str, Callable[[Freight], DataFrame]] = {
    f.__name__: f
    for f in (
        scan_project, point_lookup, filter_optional, search_or, search_wildcards, search_parts, filter_threshold, filter_range, filter_asof, filter_null,
        filter_flags, filter_located, filter_whole_day, filter_empty_address, fk_path_filter, filter_keys, sort_whitelist, page_window, page_envelope,
        default_orders, district_types, top_objects, recent_incidents, same_district_objects, derived_ratios, route_ratios, flow_loads, congestion_states, severity_states, speed_ratios,
        durations, error_rates, text_functions, month_labels, fk_labels, roads_latest, category_shares, bbox_filter, nearest_radius, district_distances,
        extent, line_metrics, wkt_roundtrip, minmax, zscore, export_objects, monthly_incremental, congestion_episodes, script_roundtrip, box_indexed, nearest_indexed, roads_in_box, trigram_search,
    )
} | {
    "deep_page_first": lambda m: deep_page(m, "first"), "deep_page_middle": lambda m: deep_page(m, "middle"), "deep_page_last": lambda m: deep_page(m, "last"),
    "dashboard_summary": A.dashboard, "district_profile": lambda m: A.district_profiles(m).withColumn("area_sq_km", F.col("area_sq_km").cast("double")), "latest_per_road": A.latest_per_road, "current_congestion": A.current_congestion,
    "state_distribution": A.state_distribution, "flow_timeseries": A.flow_timeseries, "flow_by_category": A.flow_by_category, "flow_by_direction": A.flow_by_direction,
    "flow_timeseries_filtered": lambda m: A.flow_timeseries(m, district=7, direction="R"), "objects_by_type": A.objects_by_type, "incident_stats": A.incident_statistics,
    "incidents_by_district": A.incidents_by_district, "daily_profile_dense": A.daily_profile, "peak_hour": A.peak_hour, "etl_health": A.etl_health,
    "source_usage": A.source_usage, "coverage": A.coverage, "road_stats": A.road_stats, "weekly_stats": A.weekly_stats, "routes_by_type": A.routes_by_type,
    "related_counts_zero": A.related_counts, "interval_window": A.incident_window, "self_similar_topk": A.similar_routes, "subscription_match": A.subscription_matches,
    "left_semi_keys": A.roads_with_incidents, "left_anti_orphans": A.roads_without_incidents, "growth": A.growth, "quality_checks": A.quality_checks,
    "constraint_checks": A.constraint_checks, "load_index": M.load_index, "index_summary": M.index_summary, "regression": lambda m: M.monthly_regression(m).select("n", F.round("slope", 3).alias("slope"), F.round("intercept", 1).alias("intercept"), F.round("r2", 6).alias("r2")), "forecast": M.forecast,
    "forecast_quality": M.forecast_quality, "scenario": M.scenario, "scenario_summary": M.scenario_summary, "compare": lambda m: M.compare(m, [3, 12, 3, 99, 7]),
    "typology": M.typology, "typology_clusters": M.typology_clusters, "kmeans_assign": M.embedding_clusters, "export_summary": K.export_summary, "chart_series": K.chart_series, "facility_layer": K.facility_layer,
    "road_layer": K.road_layer, "district_layer": K.district_layer, "incident_layer": K.incident_layer, "route_layer": K.route_layer, "layer_collection": lambda m: K.collection(K.district_layer(m)), "area_layer": K.area_layer, "forecast_chart": K.forecast_chart, "report_note": lambda m: K.report_note(m.run), "open_incident_layer": lambda m: K.incident_layer(m, state="open", cargo=True),
    "titled_features": lambda m: K.titled_features(m.road, {"name": "Name", "lanes": "Lanes", "length_km": "Length, km"}), "run_states": lambda m: m.run.groupBy("status").agg(F.count(F.lit(1)).alias("runs")),
    "geojson_head": lambda m: K.file_head(K.titled_features(m.road, {"name": "Name"}), "Roads", "freightlens", m.now()),
    "export_districts": K.export_districts, "export_roads": K.export_roads, "export_incidents": K.export_incidents, "export_flows": K.export_flows, "export_routes": K.export_routes, "export_totals": K.export_totals,
    "same_road_incidents": A.same_road_incidents, "reference_counts": A.reference_counts, "quality_total": A.quality_total,
    "api_district_summary": lambda m: ask(m, "districts/summary").withColumn("area_sq_km", F.col("area_sq_km").cast("double")), "api_types": lambda m: ask(m, "types"), "api_sources": lambda m: ask(m, "sources"),
    "api_cargo_categories": lambda m: ask(m, "cargo-categories"), "api_object_detail": lambda m: ask(m, "objects/detail", id="42"),
    "api_load_index": lambda m: ask(m, "analytics/load-index"), "api_object_list": lambda m: listed(m, "objects", page="2", page_size="20"), "api_typology": lambda m: ask(m, "analytics/typology", k="3"),
    "api_districts": lambda m: ask(m, "districts"), "api_objects": lambda m: ask(m, "objects", q="street 1", page="2", page_size="20"),
    "api_nearby": lambda m: ask(m, "objects/nearby", lon="37.6", lat="55.7", radius="99", limit="30"), "api_roads": lambda m: ask(m, "roads", **{"class": "arterial"}),
    "api_incidents": lambda m: ask(m, "incidents", state="open", severity="3", cargo="1"), "api_routes": lambda m: ask(m, "routes", type="transit", page_size="9999"),
    "api_flows": lambda m: ask(m, "flows", direction="R", period_from="1996-01-01", period_to="1996-12-31", page_size="100"), "api_etl_runs": lambda m: ask(m, "etl-runs"),
    "api_traffic_current": lambda m: ask(m, "traffic/current", district="7"), "api_forecast_district": lambda m: ask(m, "analytics/forecast", district="7", horizon="4"),
}


def _bound(plan: Callable[[Freight], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: plan(Freight(spark, sf_dir))


#: Every query by name; each takes (spark, sf_dir).
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: _bound(plan) for name, plan in _QUERIES.items()}

__all__ = ["ORACLES", "QUERIES"]
