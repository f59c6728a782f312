"""Batch aggregates of clean trips."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def zone_hour_demand(trips: DataFrame) -> DataFrame:
    """pickup_hour, zone_id, trips: the aggregate that the analyses work on."""
    return trips.groupBy("pickup_hour", F.col("pu_location_id").alias("zone_id")).agg(F.count("*").alias("trips"))


def zone_daily_demand(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_date", F.col("pu_location_id").alias("zone_id")).agg(F.count("*").alias("trips"))


def hourly_totals(trips: DataFrame) -> DataFrame:
    return trips.groupBy("pickup_hour").agg(F.count("*").alias("trips"))


def busiest_zones(trips: DataFrame, k: int = 10, since=None, until=None, zones: DataFrame | None = None) -> DataFrame:
    """The k zones with most trips, ties to the smaller id.

    since and until bound the truncated hour, both inclusive.  With a lookup
    the result has zone_name and borough, `<unknown>` where it has no row.
    Trips are counted before the join, which meets k rows.
    """
    if since is not None:
        trips = trips.filter(F.col("pickup_hour") >= F.lit(str(since)).cast("timestamp_ntz"))
    if until is not None:
        trips = trips.filter(F.col("pickup_hour") <= F.lit(str(until)).cast("timestamp_ntz"))
    top = trips.groupBy(F.col("pu_location_id").alias("zone_id")).agg(F.count("*").alias("trips")).orderBy(F.desc("trips"), "zone_id").limit(max(0, k))
    if zones is None:
        return top
    named = top.join(zones, top.zone_id == zones.location_id, "left")
    unknown = lambda c: F.coalesce(c, F.lit("<unknown>"))
    return named.select("zone_id", unknown(F.col("zone")).alias("zone_name"), unknown(F.col("borough")).alias("borough"), "trips").orderBy(F.desc("trips"), "zone_id")


def demand_distribution(trips: DataFrame) -> DataFrame:
    """Per zone, statistics of its hours with trips; hours without any are not counted."""
    n = F.col("trips")
    return zone_hour_demand(trips).groupBy("zone_id").agg(F.count("*").alias("hours_observed"), F.avg(n).alias("mean_trips"), F.stddev_pop(n).alias("std_trips"), F.min(n).alias("min_trips"), F.max(n).alias("max_trips"))
