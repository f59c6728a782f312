"""Trips, zones and demand derived from the events, nation and region tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def raw_trips(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        *keep,
        F.col("ts").alias("pickup_datetime"),
        F.expr("ts + make_dt_interval(0, 0, 0, floor(value * 20))").cast("timestamp_ntz").alias("dropoff_datetime"),
        (F.col("user_id") % 30 + 1).cast("long").alias("pu_location_id"),
        (F.col("event_id") * 31 % 270).cast("long").alias("do_location_id"),
        (F.col("event_id") % 5 + 1).cast("long").alias("passenger_count"),
        (F.col("value") / 4).alias("trip_distance"),
        (F.col("value") - 2).alias("fare_amount"),
        (F.col("value") + 3).alias("total_amount"),
    )


def dirty_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trips with times as text, of which some break each cleaning rule, chosen by event_id modulo 40."""
    e = raw_trips(spark, sf_dir, keep=("event_id",))
    k = F.col("event_id") % 40
    when = lambda c: F.when(k == 3, F.concat(F.lit("2002"), F.substring(F.col(c).cast("string"), 5, 40))).otherwise(F.col(c).cast("string"))
    rows = e.select(
        k.alias("k"),
        F.when(k == 1, None).when(k == 2, "no time").otherwise(when("pickup_datetime")).alias("pickup_datetime"),
        when("dropoff_datetime").alias("dropoff_datetime"),
        F.when(k == 4, None).when(k == 5, F.lit(float("nan"))).when(k == 6, 1.5).otherwise(F.col("pu_location_id").cast("double")).alias("pu_location_id"),
        "do_location_id",
        "trip_distance",
        "fare_amount",
    )
    return rows.unionByName(rows.filter("k = 7")).drop("k")


def long_demand(spark: SparkSession, sf_dir: str, hours: int = 30_000) -> DataFrame:
    """Sparse hourly demand of two zones over more than three years."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.expr(f"timestamp_ntz'2020-01-01 00:00:00' + make_dt_interval(0, cast(event_id * 7919 % {hours} as int))")
    return e.groupBy(hour.cast("timestamp_ntz").alias("pickup_hour"), (F.col("user_id") % 2 + 1).cast("long").alias("zone_id")).agg(F.count("*").alias("trips"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 25-row lookup; zones 26 to 30 have no row."""
    n, r = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/region.parquet")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        (F.col("n_nationkey") + 1).cast("long").alias("location_id"),
        F.col("r_name").alias("borough"),
        F.col("n_name").alias("zone"),
        F.concat(F.lit("Z"), F.col("n_regionkey").cast("string")).alias("service_zone"),
    )


def demand(spark: SparkSession, sf_dir: str, n_zones: int = 5) -> DataFrame:
    """Hourly demand of a few dense zones, straight from the events."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return e.groupBy(hour.alias("pickup_hour"), (F.col("user_id") % n_zones + 1).cast("long").alias("zone_id")).agg(F.count("*").alias("trips"))
