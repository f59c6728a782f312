"""Cleaning trips with a full account of dropped rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at_least, floor_hour, in_range, seconds_between

REASONS = ("missing_required", "bad_datetime", "bad_duration", "bad_date", "bad_zone", "bad_fare_distance", "duplicates")
REQUIRED = ("pickup_datetime", "dropoff_datetime", "pu_location_id", "do_location_id")


@dataclass(frozen=True)
class Rules:
    # The bounds of the public cleaning rules.
    min_zone: int = 1
    max_zone: int = 263
    min_seconds: float = 30
    max_seconds: float = 21_600
    max_miles: float = 100
    min_year: int = 2010


def _times(df: DataFrame) -> DataFrame:
    return df.withColumns({f"_{c}": F.col(c).try_cast("timestamp_ntz") for c in REQUIRED[:2]} | {f"_{c}": F.col(c).try_cast("double") for c in REQUIRED[2:]})


def drop_reason(df: DataFrame, rules: Rules = Rules()) -> Column:
    """First rule that a row of _times(df) breaks, or null."""
    seconds = seconds_between(F.col("_pickup_datetime"), F.col("_dropoff_datetime"))
    whole = lambda c: in_range(c, rules.min_zone, rules.max_zone) & (c == F.floor(c))
    fare = F.lit(True)
    if "trip_distance" in df.columns:
        miles = F.col("trip_distance").try_cast("double")
        fare &= at_least(miles, 0) & in_range(miles, 0, rules.max_miles)
    if "fare_amount" in df.columns:
        fare &= at_least(F.col("fare_amount").try_cast("double"), 0)
    missing = F.lit(False)
    for c in REQUIRED:
        missing |= F.col(c).isNull()
    for c in REQUIRED[2:]:
        missing |= F.coalesce(F.isnan(f"_{c}"), F.lit(False))
    return (
        F.when(missing, "missing_required")
        .when(F.col("_pickup_datetime").isNull() | F.col("_dropoff_datetime").isNull(), "bad_datetime")
        .when(~in_range(seconds, rules.min_seconds, rules.max_seconds), "bad_duration")
        .when(F.year("_pickup_datetime") < rules.min_year, "bad_date")
        .when(~(whole(F.col("_pu_location_id")) & whole(F.col("_do_location_id"))), "bad_zone")
        .when(~fare, "bad_fare_distance")
    )


def _survivors(df: DataFrame, rules: Rules) -> DataFrame:
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"trips lack {', '.join(missing)}")
    good = _times(df).withColumn("_reason", drop_reason(df, rules)).filter("_reason is null")
    kinds = dict.fromkeys(REQUIRED[:2], "timestamp_ntz") | dict.fromkeys(REQUIRED[2:], "long")
    return good.select(*(F.col(f"_{c}").cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns))


def clean_trips(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Valid, distinct trips (over the columns present) with duration, hour and date.  Cleaning twice changes nothing."""
    good = _survivors(df, rules).dropDuplicates()
    return good.withColumns({
        "trip_duration_sec": F.floor(seconds_between(F.col("pickup_datetime"), F.col("dropoff_datetime"))).cast("long"),
        "pickup_hour": floor_hour(F.col("pickup_datetime")),
        "pickup_date": F.to_date("pickup_datetime"),
    })


def cleaning_report(df: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row: input_rows, output_rows, total_dropped and dropped_<reason> of every step.

    Two aggregations, of reasons and of distinct survivors, whatever the number of steps.
    """
    reasons = _times(df).select(drop_reason(df, rules).alias("r"))
    counts = reasons.agg(F.count("*").alias("input_rows"), F.count_if(F.col("r").isNull()).alias("valid"), *(F.count_if(F.col("r") == r).alias(f"dropped_{r}") for r in REASONS[:-1]))
    kept = _survivors(df, rules).dropDuplicates().agg(F.count("*").alias("output_rows"))
    both = counts.crossJoin(F.broadcast(kept))  # one row each
    return both.select(
        "input_rows",
        "output_rows",
        (F.col("input_rows") - F.col("output_rows")).alias("total_dropped"),
        *(f"dropped_{r}" for r in REASONS[:-1]),
        (F.col("valid") - F.col("output_rows")).alias("dropped_duplicates"),
    )
