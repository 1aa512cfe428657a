"""Aggregates, windows and joins over the freight model. Sums of tonnage are decimals until the end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from freightlens.functions import derived as d
from freightlens.operators.filters import latest, null_or_empty, since, top_per_group
from freightlens.operators.intervals import first_in_windows
from freightlens.sources.model import DIRECTIONS, LOCAL_ZONE, Freight


def amount(column: str, zero: bool = True) -> Column:
    """Sum as a double; 0 for no rows if asked for."""
    total = F.sum(column).cast("double")
    return F.coalesce(total, F.lit(0.0)) if zero else total


def latest_per_road(m: Freight) -> DataFrame:
    """The newest measurement of every road, with state."""
    return latest(m.condition, "road_id", "recorded_at").withColumn("state", d.congestion_state(F.col("level")))


def current_congestion(m: Freight) -> DataFrame:
    """Mean level of the newest measurements; 0 without any."""
    agg = latest_per_road(m).agg(F.sum("level").alias("s"), F.count("level").alias("n"))
    return agg.select(F.coalesce(d.rounded_mean(F.col("s"), F.col("n")), F.lit(0.0)).alias("congestion"))


def state_distribution(m: Freight) -> DataFrame:
    """Roads by state of their newest measurement."""
    return latest_per_road(m).groupBy("state").agg(F.count(F.lit(1)).alias("roads"))


def dashboard(m: Freight) -> DataFrame:
    """Totals of five tables as one row; each table is reduced to a row first."""
    parts = [
        m.facility.agg(F.count(F.lit(1)).alias("facilities"), amount("capacity_tons").alias("capacity_tons"), F.count("lon").alias("located")),
        m.road.agg(F.count(F.lit(1)).alias("roads"), amount("length_km").alias("road_km")),
        m.flow_lines.agg(amount("volume_tons").alias("volume_tons"), F.coalesce(F.sum("vehicle_count"), F.lit(0)).alias("vehicles"), F.min("period_date").alias("first_day"), F.max("period_date").alias("last_day")),
        m.incident.agg(F.count(F.lit(1)).alias("incidents"), F.count_if(F.col("resolved_at").isNull()).alias("open_incidents"), F.count_if(F.col("affects_cargo")).alias("cargo_incidents")),
        m.run.agg(F.count(F.lit(1)).alias("runs"), F.coalesce(F.sum("records_loaded"), F.lit(0)).alias("records")),
    ]
    return reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)


def incidents_by_district(m: Freight) -> DataFrame:
    """Incidents of each district's roads."""
    roads = m.road.where("district_id IS NOT NULL").select(F.col("id").alias("road_id"), "district_id")
    return m.incident.where("road_id IS NOT NULL").join(roads, "road_id").groupBy("district_id").agg(F.count(F.lit(1)).alias("incidents"))


def district_profiles(m: Freight) -> DataFrame:
    """Measures of every district: each fact is reduced to its district before the joins, so nothing fans out."""
    objects = m.facility.groupBy("district_id").agg(F.count(F.lit(1)).alias("objects"), F.sum("capacity_tons").cast("double").alias("capacity"))
    roads = m.road.where("district_id IS NOT NULL").groupBy("district_id").agg(F.count(F.lit(1)).alias("roads"), F.sum("length_km").cast("double").alias("road_km"))
    flows = m.flow_orders.groupBy("district_id").agg(F.sum("volume_tons").cast("double").alias("volume"), F.sum("vehicle_count").alias("vehicles"))
    of_road = m.road.where("district_id IS NOT NULL").select(F.col("id").alias("road_id"), "district_id")
    levels = m.condition.join(of_road, "road_id").groupBy("district_id").agg(F.sum("level").alias("s"), F.count("level").alias("n"))
    levels = levels.select("district_id", d.rounded_mean(F.col("s"), F.col("n")).alias("congestion"))
    base = m.district.withColumnRenamed("id", "district_id")
    joined = reduce(lambda a, b: a.join(b, "district_id", "left"), [objects, roads, flows, levels, incidents_by_district(m)], base)
    zero = {c: 0 for c in ("objects", "roads", "vehicles", "incidents")} | {c: 0.0 for c in ("capacity", "road_km", "volume")}
    return joined.fillna(zero).withColumn("density", d.quotient(F.col("population"), F.col("area_sq_km")))


def flow_timeseries(m: Freight, district: int | None = None, category: str | None = None, direction: str | None = None) -> DataFrame:
    """Monthly volume, vehicles and mean speed (one decimal)."""
    from freightlens.operators.filters import equal_if_given

    base = m.flow if category else m.flow_core if district else m.flow_lines  # no more joins than the filters need
    rows = equal_if_given(base, district_id=district, category=category, direction=direction).where("period_date IS NOT NULL")
    by = rows.groupBy(F.trunc("period_date", "MM").alias("month")).agg(
        F.sum("volume_tons").cast("double").alias("volume"), F.sum("vehicle_count").alias("vehicles"), F.sum("avg_speed_kmh").alias("s"), F.count("avg_speed_kmh").alias("n"),
    )
    return by.select("month", "volume", "vehicles", d.rounded_mean(F.col("s"), F.col("n"), 10).alias("speed"))


def flow_by_category(m: Freight, limit: int = 10) -> DataFrame:
    """The categories with the most volume."""
    by = m.flow_parts.groupBy("category").agg(F.sum("volume_tons").alias("v"), F.sum("vehicle_count").alias("vehicles"))
    return by.orderBy(F.desc("v"), "category").limit(limit).select("category", F.col("v").cast("double").alias("volume"), "vehicles")


def flow_by_direction(m: Freight) -> DataFrame:
    """Volume and rows by direction, with labels."""
    label = F.element_at(F.create_map(*[F.lit(x) for pair in DIRECTIONS.items() for x in pair]), F.col("direction"))
    return m.flow_lines.groupBy("direction").agg(F.sum("volume_tons").cast("double").alias("volume"), F.count(F.lit(1)).alias("flows")).withColumn("label", label)


def objects_by_type(m: Freight) -> DataFrame:
    """Facilities and capacity by type."""
    return m.facility.groupBy("type").agg(F.count(F.lit(1)).alias("objects"), amount("capacity_tons").alias("capacity"))


def incident_statistics(m: Freight, days: int = 30) -> DataFrame:
    """Counts in the window: in all, by type, by severity; one pass with grouping sets."""
    rows = m.incident.where(since("reported_at", m.now(), days)).withColumns({"open": F.col("resolved_at").isNull()})
    sets = rows.groupingSets([[], ["incident_type"], ["severity"]], "incident_type", "severity")
    out = sets.agg(F.count(F.lit(1)).alias("total"), F.count_if("open").alias("open"), F.count_if("affects_cargo").alias("cargo"), F.grouping_id().alias("g"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "type").otherwise("severity")
    return out.select(kind.alias("kind"), F.coalesce("incident_type", F.col("severity").cast("string"), F.lit("all")).alias("value"), "total", "open", "cargo")


def daily_profile(m: Freight, days: int = 14, zone: str = LOCAL_ZONE) -> DataFrame:
    """Mean level and samples of each local hour of the day, all 24 of them; an hour without samples has no mean."""
    local = F.hour(F.from_utc_timestamp(F.col("recorded_at").cast("timestamp"), zone)).cast("int")
    by = m.condition.where(since("recorded_at", m.now(), days)).groupBy(local.alias("hour")).agg(F.sum("level").alias("s"), F.count("level").alias("n"))
    hours = m.spark.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(F.broadcast(by), "hour", "left").select("hour", d.rounded_mean(F.col("s"), F.col("n")).alias("level"), F.coalesce("n", F.lit(0)).alias("samples"))


def peak_hour(m: Freight) -> DataFrame:
    """The hour with the highest mean level, the first among equals."""
    return daily_profile(m).where("samples > 0").agg(F.max_by("hour", F.struct("level", -F.col("hour"))).alias("hour"), F.max("level").alias("level"))


def etl_health(m: Freight) -> DataFrame:
    """Runs, records and success percentage; 0 without runs."""
    agg = m.run.agg(
        F.count(F.lit(1)).alias("runs"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("status") == "success").alias("ok"),
        F.coalesce(F.sum("records_loaded"), F.lit(0)).alias("loaded"), F.coalesce(F.sum("records_errors"), F.lit(0)).alias("errors"),
    )
    return agg.select("runs", "failed", "loaded", "errors", F.coalesce(d.rounded_mean(100 * F.col("ok"), F.col("runs"), 10), F.lit(0.0)).alias("success_percent"))


def source_usage(m: Freight) -> DataFrame:
    """Run statistics of every source, those without any included, and its uses in six tables.

    Each table is reduced to a row a source before the joins, in one pass a table.
    """
    runs = m.run.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("records_loaded").alias("loaded"), F.sum("records_errors").alias("errors"), F.max("started_at").alias("last_run"),
    )
    used = {"facilities": m.facility, "roads": m.road, "routes": m.route, "flows": m.flow_lines, "conditions": m.condition, "incidents": m.incident}
    counts = [df.where("source_id IS NOT NULL").groupBy("source_id").agg(F.count(F.lit(1)).alias(name)) for name, df in used.items()]
    base = m.source.withColumnRenamed("id", "source_id")
    out = reduce(lambda a, b: a.join(b, "source_id", "left"), [runs, *counts], base).fillna(0, ["runs", "loaded", "errors", *used])
    return out.withColumn("error_percent", d.error_rate(F.col("errors"), F.col("loaded")))


def coverage(m: Freight) -> DataFrame:
    """Rows of six tables and those with a geometry; tables without geometry have no such number."""
    def counted(name: str, df: DataFrame, place: Column | None) -> DataFrame:
        located = F.lit(None) if place is None else F.count_if(place)
        return df.agg(F.count(F.lit(1)).alias("total"), located.cast("long").alias("located")).withColumn("table", F.lit(name))

    routes = m.route.join(m.district.select(F.col("id").alias("origin_id"), F.col("lon").alias("from_lon")), "origin_id", "left")
    parts = [
        ("facility", m.facility, F.col("lon").isNotNull()), ("road", m.road, F.col("geom").isNotNull()), ("route", routes, F.col("from_lon").isNotNull()),
        ("incident", m.incident, F.col("lon").isNotNull()), ("flow", m.flow_lines, None), ("condition", m.condition, None),
    ]
    return reduce(DataFrame.unionByName, [counted(*p) for p in parts])


def road_stats(m: Freight) -> DataFrame:
    """Measurements of every road: means, maximum, count, and the speed ratio."""
    by = m.condition.groupBy("road_id").agg(F.sum("level").alias("s"), F.sum("speed").alias("v"), F.max("level").alias("max_level"), F.count(F.lit(1)).alias("n"))
    roads = m.road.select(F.col("id").alias("road_id"), "speed_limit_kmh", "lanes")
    mean = lambda c: d.rounded_mean(F.col(c), F.col("n"))
    return roads.join(by, "road_id").select("road_id", mean("s").alias("level"), mean("v").alias("speed"), "max_level", "n", d.product(F.col("lanes"), F.col("speed_limit_kmh")).alias("capacity_index"))


def weekly_stats(m: Freight) -> DataFrame:
    """Sums of the last week's measurements."""
    return m.condition.where(since("recorded_at", m.now(), 7)).agg(
        F.count(F.lit(1)).alias("n"), (F.sum("level").cast("double") / F.count("level")).alias("level"), (F.sum("speed").cast("double") / F.count("speed")).alias("speed"),
    )


def routes_by_type(m: Freight) -> DataFrame:
    """Routes, trucks and distance by type, with each type's share of trucks."""
    by = m.route.groupBy("route_type").agg(F.count(F.lit(1)).alias("routes"), F.sum("trucks").alias("trucks"), F.sum("distance_km").cast("long").alias("distance"))
    return by.withColumn("share", F.col("trucks").cast("double") / F.sum("trucks").over(Window.partitionBy()))


def related_counts(m: Freight) -> DataFrame:
    """Facilities of every district, all of them and those open round the clock, zero included."""
    f = m.facility.select("district_id", F.col("id").alias("facility_id"), "operating_hours")
    return m.district.join(f, F.col("id") == F.col("district_id"), "left").groupBy("id", "name").agg(
        F.count("facility_id").alias("facilities"), F.count_if(d.round_the_clock(F.col("operating_hours")) & F.col("facility_id").isNotNull()).alias("whole_day"),
    )


def incident_window(m: Freight, hours: int = 6, most: int = 120) -> DataFrame:
    """The first measurements of each incident's road from some hours before it to some hours after its end."""
    gap = F.expr(f"INTERVAL '{hours}' HOUR")
    windows = m.incident.select(F.col("id").alias("window_id"), "road_id", (F.col("reported_at") - gap).alias("low"), (F.coalesce("resolved_at", m.now()) + gap).alias("high"))
    # the level travels with the id, which decides the order
    points = m.condition.select(F.struct(F.col("id"), F.col("level")).alias("point_id"), "road_id", F.col("recorded_at").alias("at"))
    windows = windows.withColumn("window_id", F.struct(F.col("window_id").alias("id"), F.lit(None).cast("int").alias("level")))
    found = first_in_windows(windows, points, "road_id", most)
    return found.select(F.col("window_id.id").alias("incident_id"), F.col("point_id.id").alias("condition_id"), F.col("at").alias("recorded_at"), F.col("point_id.level").alias("level"), "rank")


def same_road_incidents(m: Freight, k: int = 6) -> DataFrame:
    """For every incident the k latest others of its road; the k + 1 latest of each road suffice."""
    i = m.incident.where("road_id IS NOT NULL").select("id", "road_id", "reported_at")
    best = top_per_group(i.select(F.col("id").alias("other_id"), "road_id", F.col("reported_at").alias("at")), "road_id", [F.desc("at"), F.desc("other_id")], k + 1, "r").drop("r")
    pairs = i.select("id", "road_id").join(best, "road_id").where("id <> other_id")
    return top_per_group(pairs, "id", [F.desc("at"), F.desc("other_id")], k).select("id", "other_id", "rank")


def reference_counts(m: Freight) -> DataFrame:
    """Rows of each dimension."""
    parts = {"districts": m.district, "types": m.facility.select("type").distinct(), "categories": m.category, "sources": m.source}
    return reduce(DataFrame.unionByName, [df.agg(F.count(F.lit(1)).alias("total")).withColumn("dimension", F.lit(name)) for name, df in parts.items()])


def similar_routes(m: Freight, k: int = 6) -> DataFrame:
    """For every route the k routes of its type with the most trucks, itself excluded.

    The k + 1 busiest routes of each type suffice, so no pair of all routes is formed.
    """
    best = top_per_group(m.route.select(F.col("id").alias("other_id"), "route_type", F.col("trucks").alias("other_trucks")), "route_type", [F.desc("other_trucks"), F.col("other_id")], k + 1, "r").drop("r")
    pairs = m.route.select("id", "route_type").join(best, "route_type").where("id <> other_id")
    return top_per_group(pairs, "id", [F.desc("other_trucks"), F.col("other_id")], k).select("id", "other_id", "other_trucks", "rank")


def subscription_matches(m: Freight) -> DataFrame:
    """Incidents that each active subscription wants, counted.

    The incidents are first counted by district, severity and cargo flag, a bounded grid, and only then matched.
    """
    roads = m.road.select(F.col("id").alias("road_id"), F.col("district_id").alias("incident_district"))
    grid = m.incident.join(roads, "road_id", "left").groupBy("incident_district", "severity", "affects_cargo").agg(F.count(F.lit(1)).alias("n"))
    s = m.subscription.where("is_active")
    hit = (F.col("severity") >= F.col("min_severity")) & (~F.col("cargo_only") | F.col("affects_cargo")) & (F.col("district_id").isNull() | (F.col("district_id") == F.col("incident_district")))
    return s.join(F.broadcast(grid), hit, "left").groupBy("id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"))


def roads_with_incidents(m: Freight) -> DataFrame:
    """Roads that had an incident (semi-join)."""
    return m.road.join(m.incident.select(F.col("road_id").alias("id")), "id", "left_semi").select("id", "name", "road_class")


def roads_without_incidents(m: Freight) -> DataFrame:
    """Roads that had none (anti-join)."""
    return m.road.join(m.incident.where("road_id IS NOT NULL").select(F.col("road_id").alias("id")), "id", "left_anti").select("id", "name", "road_class")


def growth(m: Freight) -> DataFrame:
    """Last month's volume against the first in percent (null for one month or none), and the mean load of a vehicle."""
    agg = flow_timeseries(m).agg(
        F.min_by("volume", "month").alias("first"), F.max_by("volume", "month").alias("last"), F.count(F.lit(1)).alias("months"),
        F.sum(F.col("volume").cast("decimal(30,2)")).cast("double").alias("volume"), F.sum("vehicles").alias("vehicles"),
    )
    percent = F.when(F.col("months") > 1, (F.col("last").cast("double") / d.or_null(F.col("first")) - 1) * 100)
    return agg.select("first", "last", percent.alias("growth"), "vehicles", d.quotient(F.col("volume"), F.col("vehicles")).alias("load"))


def quality_checks(m: Freight) -> DataFrame:
    """Each rule's findings, rows checked and percentage (one decimal, 0 for no rows); one pass a table."""
    now = m.now()
    rules = {
        "facility": (m.facility, {"facility without place": F.col("lon").isNull(), "facility without capacity": F.col("capacity_tons").isNull(), "facility without address": null_or_empty("address"), "facility without source": F.col("source_id").isNull()}, None),
        "road": (m.road, {"road without geometry": F.col("geom").isNull()}, None),
        "incident": (m.incident, {"incident without road": F.col("road_id").isNull()}, None),
        "open": (m.incident.where("resolved_at IS NULL"), {"open incident over 30 days": F.col("reported_at") < now - F.expr("INTERVAL '30' DAY")}, None),
    }
    parts = []
    for df, checks, _ in rules.values():
        row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in checks.items()])
        parts.append(row.unpivot(["total"], list(checks), "rule", "found"))
    out = reduce(DataFrame.unionByName, parts)
    return out.select("rule", "found", "total", F.coalesce(d.rounded_mean(100 * F.col("found"), F.col("total"), 10), F.lit(0.0)).alias("share"))


def quality_total(m: Freight) -> DataFrame:
    """Findings of all rules together."""
    return quality_checks(m).agg(F.sum("found").alias("issues_total"))


def constraint_checks(m: Freight) -> DataFrame:
    """Rows that break a declared range or vocabulary."""
    parts = [
        m.condition.agg(F.count_if(~F.col("level").between(0, 10)).alias("found")).withColumn("rule", F.lit("level 0 to 10")),
        m.incident.agg(F.count_if(~F.col("severity").between(1, 5)).alias("found")).withColumn("rule", F.lit("severity 1 to 5")),
        m.flow_lines.agg(F.count_if(~F.col("direction").isin(*DIRECTIONS)).alias("found")).withColumn("rule", F.lit("known direction")),
        m.incident.agg(F.count_if(F.col("resolved_at") < F.col("reported_at")).alias("found")).withColumn("rule", F.lit("end after start")),
        m.route.agg(F.count_if(F.col("origin_id") == F.col("destination_id")).alias("found")).withColumn("rule", F.lit("two different ends")),
    ]
    return reduce(DataFrame.unionByName, parts).select("rule", "found")
