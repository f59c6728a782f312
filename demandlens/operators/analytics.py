"""Business questions over clean trips and the zone lookup.

Trips are aggregated by zone before the lookup is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .aggregate import busiest_zones

# Lower-case patterns of airport zones, and the borough, whose name must be exact.
AIRPORTS = ("%jfk%", "%la guardia%")
ISLAND = "Manhattan"


def weekday_weekend_demand(trips: DataFrame) -> DataFrame:
    """day_type, hour, trips."""
    kind = F.when(F.weekday("pickup_datetime") >= 5, "weekend").otherwise("weekday")
    return trips.groupBy(kind.alias("day_type"), F.hour("pickup_datetime").cast("long").alias("hour")).agg(F.count("*").alias("trips"))


def airport_vs_manhattan(trips: DataFrame, zones: DataFrame, airports: tuple[str, ...] = AIRPORTS, island: str = ISLAND) -> DataFrame:
    """segment, day, trips, avg_distance, avg_fare; zones without a lookup row are `other`.  Patterns meet lower-case zone names."""
    sums = trips.groupBy("pu_location_id", "pickup_date").agg(F.count("*").alias("n"), *(f(c).alias(f"{c}_{k}") for c in ("trip_distance", "fare_amount") for k, f in (("s", F.sum), ("c", F.count))))
    name = F.lower("zone")
    flying = F.lit(False)
    for p in airports:
        flying |= name.like(p)
    segment = F.when(flying, "airport").when(F.col("borough") == island, "manhattan").otherwise("other")
    joined = sums.join(zones, F.col("pu_location_id") == F.col("location_id"), "left")
    mean = lambda c: F.sum(f"{c}_s") / F.nullif(F.sum(f"{c}_c"), F.lit(0))
    return joined.groupBy(segment.alias("segment"), F.col("pickup_date").alias("day")).agg(F.sum("n").alias("trips"), mean("trip_distance").alias("avg_distance"), mean("fare_amount").alias("avg_fare"))


def top_origin_destination_pairs(trips: DataFrame, k: int = 20, min_trip_distance: float = 0.5) -> DataFrame:
    pairs = trips.filter(F.col("trip_distance") >= min_trip_distance).groupBy(F.col("pu_location_id").alias("origin_id"), F.col("do_location_id").alias("destination_id"))
    return pairs.agg(F.count("*").alias("trips"), F.avg("trip_distance").alias("avg_distance"), F.avg("total_amount").alias("avg_total")).orderBy(F.desc("trips"), "origin_id", "destination_id").limit(max(0, k))


def borough_flow_matrix(trips: DataFrame, zones: DataFrame) -> DataFrame:
    """origin_borough, destination_borough, trips; `Unknown` without a lookup row."""
    pairs = trips.groupBy("pu_location_id", "do_location_id").agg(F.count("*").alias("n"))
    end = lambda id_, name: zones.select(F.col("location_id").alias(id_), F.col("borough").alias(name))
    both = pairs.join(end("pu_location_id", "pb"), "pu_location_id", "left").join(end("do_location_id", "db"), "do_location_id", "left")
    unknown = lambda c: F.coalesce(F.col(c), F.lit("Unknown"))
    return both.groupBy(unknown("pb").alias("origin_borough"), unknown("db").alias("destination_borough")).agg(F.sum("n").alias("trips"))


def zone_hour_heatmap(trips: DataFrame, top_k_zones: int = 20) -> DataFrame:
    """zone_id, hour, trips of the busiest zones; hours without trips are absent."""
    top = busiest_zones(trips, top_k_zones).select(F.col("zone_id").alias("pu_location_id"))
    hours = trips.groupBy("pu_location_id", F.hour("pickup_datetime").cast("long").alias("hour")).agg(F.count("*").alias("trips"))
    return hours.join(top, "pu_location_id", "left_semi").withColumnRenamed("pu_location_id", "zone_id")


def avg_fare_distance_by_zone(trips: DataFrame, zones: DataFrame) -> DataFrame:
    means = trips.groupBy(F.col("pu_location_id").alias("zone_id")).agg(F.count("*").alias("trips"), F.avg("trip_distance").alias("avg_distance"), F.avg("fare_amount").alias("avg_fare"), F.avg("total_amount").alias("avg_total"), (F.avg("trip_duration_sec") / 60).alias("avg_minutes"))
    named = means.join(zones, means.zone_id == zones.location_id, "left")
    return named.select("zone_id", F.coalesce("zone", F.lit("")).alias("zone_name"), F.coalesce("borough", F.lit("")).alias("borough"), "trips", "avg_distance", "avg_fare", "avg_total", "avg_minutes")
