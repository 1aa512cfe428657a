"""Shards by jump consistent hashing, with gapless slots; DataFrame functions only.

A row's shard follows from its key and the number of shards alone (law
``key``): no ring table is kept, and appending a shard moves only the rows that
land in the new one. The generator's 64-bit products are computed as
decimals, as integer products that overflow are errors in ANSI mode.

Slots count the rows of a shard from 0 without a gap. A shard would be too
large for one window, so it's dealt into sub-buckets by a hash of key, text checksum and size, so
that rows which share a key don't meet unless they are equal; rows
are numbered within (shard, sub-bucket) and shifted by the number of rows in
the sub-buckets before. The table of shifts has at most
``shards * sub_buckets`` rows whatever the input, which bounds its broadcast.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

SHARDS = 24
SUB_BUCKETS = 4096

# Fixed values of the published generator: multiplier, then the powers it uses.
MULTIPLIER = 2862933555777941757
TWO_64 = 18446744073709551616
TWO_33 = 8589934592
TWO_31 = 2147483648


def stable_key(column: str | Column) -> Column:
    """A 60-bit key: the first 15 hexadecimal digits of the MD5 of the value as text (null: empty)."""
    column = F.col(column) if isinstance(column, str) else column
    digest = F.md5(F.encode(F.coalesce(column.cast("string"), F.lit("")), "UTF-8"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def jump(key: Column, shards: int) -> Column:
    """Struct of ``shard`` (0 to shards-1) and ``grown``, the shard if there is one more."""
    if shards < 1:
        raise ValueError("at least one shard is needed")

    def advance(k: Column) -> Column:
        return ((k * F.lit(Decimal(MULTIPLIER)) + 1) % F.lit(Decimal(TWO_64))).cast("decimal(20,0)")

    def step(s: Column, _: Column) -> Column:
        top = F.floor(s["k"] / F.lit(Decimal(TWO_33))).cast("double")
        moved = F.struct(
            s["j"].alias("b"),
            F.floor((s["j"] + 1).cast("double") * (F.lit(float(TWO_31)) / (top + 1))).cast("long").alias("j"),
            advance(s["k"]).alias("k"),
        )
        return F.when(s["j"] < shards, moved).otherwise(s)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"), advance(key.cast("decimal(20,0)")).alias("k"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(shards)), start, step,
        lambda s: F.struct(
            s["b"].cast("int").alias("shard"),
            F.when(s["j"] == shards, F.lit(shards)).otherwise(s["b"]).cast("int").alias("grown"),
        ),
    )


def shard_rows(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, sub_buckets: int = SUB_BUCKETS) -> DataFrame:
    """Deal the rows of ``df`` into shards and number them there.

    Returns the key column, ``size`` (UTF-8 bytes of the text plus 8; null: 8),
    ``text_crc32`` (unsigned; null: of the empty text), ``law`` = ``key``,
    ``shard``, ``slot`` and ``grown_shard``. Within a shard, slots follow the
    sub-bucket, then the key, then the text's crc32 and size.
    Repeated keys share a shard; rows equal in all of this are
    interchangeable and get successive slots. A null key is one key of its
    own. An empty table gives no rows. Other columns are ignored.
    """
    hashed = stable_key(key)
    body = F.coalesce(F.encode(F.col(text).cast("string"), "UTF-8"), F.lit(b""))
    rows = df.select(
        F.col(key), (F.octet_length(body) + 8).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        jump(hashed, shards).alias("to"),
    ).select(key, "size", "text_crc32", "to.shard", F.col("to.grown").alias("grown_shard"))
    rows = rows.withColumn("sub", F.pmod(F.xxhash64(key, "text_crc32", "size"), F.lit(sub_buckets)).cast("int"))
    counts = rows.groupBy("shard", "sub").count()
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("shard", "sub", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    within = Window.partitionBy("shard", "sub").orderBy(F.col(key).asc_nulls_first(), "text_crc32", "size")
    numbered = rows.withColumn("place", F.row_number().over(within) - 1)
    return numbered.join(F.broadcast(shifts), ["shard", "sub"], "left").select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("shift") + F.col("place")).alias("slot"), "grown_shard",
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: shard and slot of every document among 24 shards."""
    return shard_rows(table(spark, sf_dir, "documents")).withColumn("doc_id", F.col("doc_id").cast("long"))
