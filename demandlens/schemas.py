"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the stored tables.
TRIPS = T.StructType([
    T.StructField("pickup_datetime", T.TimestampNTZType(), False),
    T.StructField("dropoff_datetime", T.TimestampNTZType(), False),
    T.StructField("pu_location_id", T.LongType(), False),
    T.StructField("do_location_id", T.LongType(), False),
    T.StructField("passenger_count", T.LongType()),
    T.StructField("trip_distance", T.DoubleType()),
    T.StructField("fare_amount", T.DoubleType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("trip_duration_sec", T.LongType(), False),
    T.StructField("pickup_hour", T.TimestampNTZType(), False),
    T.StructField("pickup_date", T.DateType(), False),
])

ZONES = T.StructType([
    T.StructField("location_id", T.LongType(), False),
    T.StructField("borough", T.StringType()),
    T.StructField("zone", T.StringType()),
    T.StructField("service_zone", T.StringType()),
])

# Column names of the public trip-record files and zone lookup.
RAW_COLUMNS = {
    "tpep_pickup_datetime": "pickup_datetime",
    "tpep_dropoff_datetime": "dropoff_datetime",
    "passenger_count": "passenger_count",
    "trip_distance": "trip_distance",
    "PULocationID": "pu_location_id",
    "DOLocationID": "do_location_id",
    "fare_amount": "fare_amount",
    "total_amount": "total_amount",
}
LOOKUP_COLUMNS = {"LocationID": "location_id", "Borough": "borough", "Zone": "zone", "service_zone": "service_zone"}
