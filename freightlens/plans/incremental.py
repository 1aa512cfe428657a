"""Monthly sums kept up to date file by file.

Each input file's sums by month are kept as Parquet under a name made of the file's path, size and time of change. A refresh reads only
files whose name isn't there yet; a manifest of the current names decides which sums count, so a rewritten or removed file's old sums drop out.
A manifest is written whole and becomes the current one when it's complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from freightlens.functions import derived as d

SUMS = "version string, month date, volume decimal(38,2), vehicles long, speed long, n long"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """``file, version`` of all files of a Parquet folder; no column of them is read."""
    meta = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_modification_time").alias("at")).distinct()
    return meta.select("file", F.sha2(F.concat_ws("|", "file", F.col("size").cast("string"), F.unix_micros("at").cast("string")), 256).alias("version"))


def monthly_sums(lines: DataFrame) -> DataFrame:
    """Sums by month and version of ``lines`` (version, period_date, volume_tons, vehicle_count, avg_speed_kmh)."""
    return lines.where("period_date IS NOT NULL").groupBy("version", F.trunc("period_date", "MM").alias("month")).agg(
        F.sum("volume_tons").cast("decimal(38,2)").alias("volume"), F.sum("vehicle_count").cast("long").alias("vehicles"), F.sum("avg_speed_kmh").cast("long").alias("speed"), F.count("avg_speed_kmh").alias("n"),
    )


class MonthlySums:
    """The sums of one Parquet folder of flow lines, kept in another folder."""

    def __init__(self, spark: SparkSession, source: str, path: str) -> None:
        self.spark, self.source, self.path = spark, source, path.rstrip("/")

    def _numbers(self) -> list[int]:
        """Numbers of the complete manifests, ascending."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifest=*/_SUCCESS")
        found = folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(folder)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def manifest(self, number: int | None) -> DataFrame:
        """``file, version`` of a manifest; none for no number."""
        if number is None:
            return self.spark.createDataFrame([], "file string, version string")
        return self.spark.read.schema("file string, version string").parquet(f"{self.path}/manifest={number}")

    def refresh(self) -> int:
        """Read the files that are new or changed; returns how many these were."""
        numbers = self._numbers()
        last = numbers[-1] if numbers else None
        now = versions(self.spark, self.source).persist()
        fresh = now.join(self.manifest(last), ["file", "version"], "left_anti")
        changed = fresh.count()
        if changed:
            # at first the whole folder is read; later only the changed files, whose names the driver holds
            folder = [self.source] if last is None else [r["file"] for r in fresh.select("file").collect()]
            rows = self.spark.read.parquet(*folder).select("*", F.col("_metadata.file_path").alias("file")).join(fresh.select("file", "version"), "file")
            lines = rows.select(
                "version", F.col("l_shipdate").cast("date").alias("period_date"), F.col("l_extendedprice").cast("decimal(14,2)").alias("volume_tons"),
                F.col("l_quantity").cast("long").alias("vehicle_count"), (30 + F.col("l_linenumber") * 5).cast("long").alias("avg_speed_kmh"),
            )
            monthly_sums(lines).repartition("version").write.mode("append").parquet(f"{self.path}/sums")
        now.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest={(last or 0) + 1}")
        now.unpersist()
        return changed

    def series(self) -> DataFrame:
        """``month, volume, vehicles, speed`` as the full query gives them, from the kept sums."""
        numbers = self._numbers()
        kept = self.spark.read.schema(SUMS).parquet(f"{self.path}/sums").distinct()  # a refresh that was cut short may have written sums twice
        current = kept.join(self.manifest(numbers[-1] if numbers else None).select("version"), "version", "left_semi")
        by = current.groupBy("month").agg(F.sum("volume").cast("double").alias("volume"), F.sum("vehicles").alias("vehicles"), F.sum("speed").alias("s"), F.sum("n").alias("n"))
        return by.select("month", "volume", "vehicles", d.rounded_mean(F.col("s"), F.col("n"), 10).alias("speed"))
