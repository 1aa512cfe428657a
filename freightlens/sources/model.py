"""The freight model: explicit types, fixed vocabularies, and views that map the shared tables onto it.

Every view is a lazy plan over Parquet, so filters and column choices of a
query reach the scans. The views inject missing values by key so that
null paths are exercised; the instant "now" is always the latest event.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed vocabularies of the model, and the zone of its local times.
LOCAL_ZONE = "Europe/Moscow"
ROAD_CLASSES = ("highway", "arterial", "collector")
ROUTE_TYPES = ("inbound", "outbound", "transit")
DIRECTIONS = {"A": "arrival", "N": "transfer", "R": "return"}
RUN_STATUS = {"F": "success", "O": "failed", "P": "partial"}
CONGESTION_STATES = ((9, "jam", "crit"), (7, "heavy", "alert"), (5, "moderate", "warn"), (3, "light", "ok"))
SEVERITIES = {1: "minor", 2: "moderate", 3: "serious", 4: "severe", 5: "critical"}

_D = T.DecimalType
SCHEMAS = {
    "districts": "id int, name string, short_name string, area_sq_km decimal(10,2), population int, geom string, center string",
    "infrastructure_types": "id int, code string, name string, description string",
    "cargo_categories": "id int, code string, name string, hazard_class int",
    "data_sources": "id int, code string, name string, source_type string, url string, update_frequency string, is_active boolean",
    "infrastructure_objects": "id int, type_id int, district_id int, name string, address string, capacity_tons decimal(12,2), area_sq_m decimal(12,2), operating_hours string, geom string, source_id int, created_at timestamp, updated_at timestamp",
    "road_segments": "id int, name string, road_class string, lanes int, length_km decimal(8,2), speed_limit_kmh int, district_id int, geom string, source_id int",
    "cargo_routes": "id int, name string, route_type string, origin_region string, destination string, distance_km decimal(10,2), avg_duration_h decimal(8,2), truck_count_day int, geom string, source_id int",
    "freight_flow_stats": "id int, period_date date, period_type string, route_id int, district_id int, cargo_cat_id int, direction string, volume_tons decimal(14,2), vehicle_count int, avg_speed_kmh decimal(6,2), source_id int",
    "traffic_conditions": "id int, recorded_at timestamp, road_id int, congestion_level int, avg_speed_kmh decimal(6,2), travel_time_min decimal(8,2), vehicle_density int, incident_flag boolean, source_id int",
    "traffic_incidents": "id int, reported_at timestamp, resolved_at timestamp, incident_type string, severity int, road_id int, description string, geom string, affects_cargo boolean, source_id int",
    "etl_log": "id int, started_at timestamp, finished_at timestamp, source_id int, target_table string, records_loaded int, records_errors int, status string, error_message string",
}


def null_if(condition: Column, value: Column) -> Column:
    """The value, or null where the condition holds."""
    return F.when(~condition, value)


def pick(values: tuple, index: Column) -> Column:
    """The value at a 0-based index."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


class Freight:
    """Lazy views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        self._schemas: dict[str, T.StructType] = {}

    def table(self, name: str) -> DataFrame:
        """A stored table; its footer is read for the schema once, however many views use it."""
        path = f"{self.sf_dir}/{name}.parquet"
        if name in self._schemas:
            return self.spark.read.schema(self._schemas[name]).parquet(path)
        found = self.spark.read.parquet(path)
        self._schemas[name] = found.schema
        return found

    @cached_property
    def district(self) -> DataFrame:
        n = F.col("n_nationkey")
        return self.table("nation").select(
            n.cast("int").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("int").alias("region_id"),
            (30 + (n * 37) % 1000).cast("decimal(10,2)").alias("area_sq_km"), null_if(n % 7 == 3, (100000 + n * 7919).cast("int")).alias("population"),
            (F.lit(37.3) + (n % 5).cast("double") * F.lit(0.12)).alias("lon"), (F.lit(55.5) + F.floor(n / 5).cast("double") * F.lit(0.1)).alias("lat"),
        )

    @cached_property
    def facility(self) -> DataFrame:
        k = F.col("c_custkey")
        def place(by: int, low: float, wide: float) -> Column:
            return null_if(k % 17 == 0, F.lit(low) + ((k * by) % 1000).cast("double") / F.lit(1000.0) * F.lit(wide))

        return self.table("customer").select(
            k.alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("type"), F.col("c_nationkey").cast("int").alias("district_id"),
            null_if(k % 11 == 0, F.abs("c_acctbal").cast("decimal(12,2)")).alias("capacity_tons"),
            null_if(k % 13 == 0, (500 + (k * 31) % 4000).cast("decimal(12,2)")).alias("area_sq_m"),
            pick(("00:00-24:00", "Round the clock", "09:00-18:00"), k % 3).alias("operating_hours"),
            F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, F.lit("")).otherwise(F.concat(F.lit("Street "), (k % 97).cast("string"))).alias("address"),
            place(7919, 37.3, 0.6).alias("lon"), place(104729, 55.5, 0.5).alias("lat"), null_if(k % 10 == 9, (k % 8).cast("int")).alias("source_id"),
        )

    @cached_property
    def flow_lines(self) -> DataFrame:
        """Flows without district and category: the stored lines alone, no join."""
        return self.table("lineitem").select(
            (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("period_date"),
            F.col("l_returnflag").alias("direction"), F.col("l_extendedprice").cast("decimal(14,2)").alias("volume_tons"),
            F.col("l_quantity").cast("long").alias("vehicle_count"), (30 + F.col("l_linenumber") * 5).cast("int").alias("avg_speed_kmh"), "l_orderkey", "l_partkey",
            null_if(F.col("l_linenumber") == 7, (F.col("l_suppkey") % 8).cast("int")).alias("source_id"),
        )

    @cached_property
    def flow_parts(self) -> DataFrame:
        """Lines with a category, reduced to their part before the join: no order or customer is needed for it."""
        lines = self.flow_lines.where(F.col("l_partkey") % 23 != 0).groupBy("l_partkey").agg(
            F.sum("volume_tons").alias("volume_tons"), F.sum("vehicle_count").alias("vehicle_count"), F.count(F.lit(1)).alias("flows"),
        )
        return lines.join(self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category")), "l_partkey")

    @cached_property
    def category(self) -> DataFrame:
        """Cargo categories with a hazard class from 0 to 9."""
        return self.table("part").select(F.col("p_type").alias("name")).distinct().select("name", (F.length("name") % 10).alias("hazard_class"))

    @cached_property
    def flow_orders(self) -> DataFrame:
        """Sums of each order's lines with the order's district: lines are reduced by the key that the join deals them by."""
        lines = self.flow_lines.groupBy("l_orderkey").agg(F.sum("volume_tons").alias("volume_tons"), F.sum("vehicle_count").alias("vehicle_count"))
        return lines.join(self._district_of_order, "l_orderkey")

    @cached_property
    def _district_of_order(self) -> DataFrame:
        orders = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        customers = self.table("customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("int").alias("district_id"))
        return orders.join(customers, "o_custkey").drop("o_custkey")

    @cached_property
    def flow_core(self) -> DataFrame:
        """Flows with their district; orders and customers are reduced to district by order first."""
        return self.flow_lines.join(self._district_of_order, "l_orderkey")

    @cached_property
    def flow(self) -> DataFrame:
        """Flows with district and category. Every line has its order, customer and part, so the shorter views have the same rows."""
        parts = self.table("part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type"))
        category = null_if(F.col("l_partkey") % 23 == 0, F.col("p_type")).alias("category")
        return self.flow_core.join(parts, "l_partkey").select("id", "period_date", "district_id", category, "direction", "volume_tons", "vehicle_count", "avg_speed_kmh")

    @cached_property
    def road(self) -> DataFrame:
        u = F.col("user_id")
        return self.table("events").select("user_id").distinct().select(
            u.alias("id"), F.concat(F.lit("Road "), u.cast("string")).alias("name"), pick(ROAD_CLASSES, u % 3).alias("road_class"),
            null_if(u % 29 == 0, (u % 25).cast("int")).alias("district_id"), (1 + u % 6).cast("int").alias("lanes"),
            (40 + 10 * (u % 7)).cast("int").alias("speed_limit_kmh"), (1 + u % 40).cast("decimal(8,2)").alias("length_km"),
            null_if(u % 13 == 5, F.format_string("LINESTRING (37.%d 55.%d, 37.%d 55.%d)", 30 + u % 60, 50 + u % 40, 31 + u % 60, 51 + u % 40)).alias("geom"),
            null_if(u % 9 == 8, (u % 8).cast("int")).alias("source_id"),
        )

    @cached_property
    def condition(self) -> DataFrame:
        level = F.least(F.lit(10), F.floor(F.col("value") / 20).cast("int"))
        return self.table("events").select(
            F.col("event_id").alias("id"), F.col("user_id").alias("road_id"), F.col("ts").alias("recorded_at"), level.alias("level"), null_if(F.col("event_id") % 11 == 7, (F.col("event_id") % 8).cast("int")).alias("source_id"),
        ).withColumn("speed", (60 - 4 * F.col("level")).cast("int"))

    @cached_property
    def incident(self) -> DataFrame:
        e, k = F.col("event_id"), F.get_json_object("props", "$.k").cast("int")
        return self.table("events").where("event_type = 'error'").withColumn("k", k).select(
            e.alias("id"), F.col("ts").alias("reported_at"), null_if(e % 4 == 0, F.expr("ts + make_dt_interval(0, k)")).alias("resolved_at"),
            F.concat(F.lit("type "), (F.col("k") % 6).cast("string")).alias("incident_type"), (1 + F.col("k") % 5).cast("int").alias("severity"),
            null_if(e % 31 == 0, F.col("user_id")).alias("road_id"), (F.col("k") % 2 == 1).alias("affects_cargo"),
            null_if(e % 37 == 0, F.lit(37.3) + ((e * 7919) % 1000).cast("double") / F.lit(1000.0) * F.lit(0.6)).alias("lon"),
            null_if(e % 37 == 0, F.lit(55.5) + ((e * 104729) % 1000).cast("double") / F.lit(1000.0) * F.lit(0.5)).alias("lat"), null_if(e % 5 == 4, (e % 8).cast("int")).alias("source_id"),
        )

    @cached_property
    def run(self) -> DataFrame:
        status = F.element_at(F.create_map(*[F.lit(x) for pair in RUN_STATUS.items() for x in pair]), F.col("o_orderstatus"))
        return self.table("orders").select(
            F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 8).cast("int").alias("source_id"), F.col("o_orderdate").alias("started_at"),
            status.alias("status"), F.floor("o_totalprice").cast("long").alias("records_loaded"), (F.col("o_orderkey") % 13).cast("long").alias("records_errors"),
        )

    @cached_property
    def route(self) -> DataFrame:
        lines, orders = self.table("lineitem").select("l_orderkey", "l_suppkey"), self.table("orders").select("o_orderkey", "o_custkey")
        customers, suppliers = self.table("customer").select("c_custkey", "c_nationkey"), self.table("supplier").select("s_suppkey", "s_nationkey")
        pairs = (
            lines.join(orders, lines.l_orderkey == orders.o_orderkey).join(customers, F.col("o_custkey") == F.col("c_custkey"))
            .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("c_nationkey", "s_nationkey").agg(F.count(F.lit(1)).alias("trucks"))
        )
        c, s = F.col("c_nationkey").cast("int"), F.col("s_nationkey").cast("int")
        # a line of five vertices between the ends' centres, every other one beside the straight line
        x = lambda n: F.lit(37.3) + (n % 5).cast("double") * F.lit(0.12)
        y = lambda n: F.lit(55.5) + F.floor(n / 5).cast("double") * F.lit(0.1)
        way = [(x(c) + (x(s) - x(c)) * F.lit(i / 4), y(c) + (y(s) - y(c)) * F.lit(i / 4) + F.lit(0.01 * (i % 2))) for i in range(5)]
        line = F.format_string("LINESTRING (" + ", ".join(["%.4f %.4f"] * 5) + ")", *[v for point in way for v in point])
        return pairs.select(
            (c * 100 + s).alias("id"), c.alias("origin_id"), s.alias("destination_id"), pick(ROUTE_TYPES, (c + s) % 3).alias("route_type"),
            (50 + (c * s * 13) % 900).alias("distance_km"), (null_if((c + s) % 9 == 4, 2 + (c + s) % 12)).alias("duration_h"), F.col("trucks"),
            null_if((c * 7 + s) % 11 == 3, line).alias("geom"), null_if((c * s) % 7 == 6, ((c + s) % 8).cast("int")).alias("source_id"),
        )

    @cached_property
    def subscription(self) -> DataFrame:
        n, s = F.col("n_nationkey").cast("int"), F.col("s")
        grid = self.table("nation").select("n_nationkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("s"))
        return grid.select(
            (n * 5 + s).alias("id"), null_if((n * 5 + s) % 5 == 0, n).alias("district_id"), s.alias("min_severity"),
            (n % 2 == 1).alias("cargo_only"), (n % 3 != 0).alias("is_active"),
        )

    @cached_property
    def source(self) -> DataFrame:
        """The sources that the loader's runs name."""
        i = (F.col("o_custkey") % 8).cast("int")
        return self.table("orders").select(i.alias("id")).distinct().select("id", F.concat(F.lit("source "), F.col("id").cast("string")).alias("name"), (F.col("id") != 5).alias("is_active"))

    @cached_property
    def boundary(self) -> DataFrame:
        """Districts with a boundary: squares around the centre, every third with a hole, every fourth of two parts, some without."""
        n, x, y = F.col("n_nationkey"), F.lit(37.3) + (F.col("n_nationkey") % 5).cast("double") * F.lit(0.12), F.lit(55.5) + F.floor(F.col("n_nationkey") / 5).cast("double") * F.lit(0.1)

        def square(shift: float, half: float) -> Column:
            corners = [(-half, -half), (half, -half), (half, half), (-half, half), (-half, -half)]
            return F.format_string("(" + ", ".join(["%.4f %.4f"] * 5) + ")", *[v for dx, dy in corners for v in (x + F.lit(shift + dx), y + F.lit(dy))])

        first = F.when(n % 3 == 0, F.concat_ws(", ", square(0.0, 0.03), square(0.0, 0.01))).otherwise(square(0.0, 0.03))
        parts = F.when(n % 4 == 0, F.concat(F.lit("("), first, F.lit("), ("), square(0.05, 0.01), F.lit(")"))).otherwise(F.concat(F.lit("("), first, F.lit(")")))
        return self.table("nation").select(n.cast("int").alias("id"), F.col("n_name").alias("name"), null_if(n % 8 == 7, F.concat(F.lit("MULTIPOLYGON ("), parts, F.lit(")"))).alias("geom"))

    def now(self) -> Column:
        """The latest event's instant, as a scalar subquery."""
        return self.table("events").agg(F.max("ts")).scalar()
