"""Demand anomalies: z-scores, robust z-scores, EWMA residuals, consensus.

Baselines use the hours that have trips; EWMA uses the dense panel.  Scores
are rounded to six decimals before they meet a threshold, so that the order
of floating-point sums can't flip a flag.  A threshold counts on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ewm, hour_of_week
from .forecast import hourly_panel

#: Makes the median absolute deviation comparable to a standard deviation.
MAD_SCALE = 1.4826
KEYS = ["zone_id", "hour_of_week"]


def _bucketed(demand: DataFrame) -> DataFrame:
    return demand.withColumn("hour_of_week", hour_of_week(F.col("pickup_hour")))


def fit_baseline(demand: DataFrame) -> DataFrame:
    """zone_id, hour_of_week, mean, std (population), n."""
    return _bucketed(demand).groupBy(*KEYS).agg(F.avg("trips").alias("mean"), F.stddev_pop("trips").alias("std"), F.count("*").alias("n"))


def lookup(baseline: DataFrame, zone_id: int, how: int) -> tuple | None:
    """(mean, std, n) of one bucket."""
    row = baseline.filter((F.col("zone_id") == zone_id) & (F.col("hour_of_week") == how)).select("mean", "std", "n").first()
    return tuple(row) if row else None


def z_scores(demand: DataFrame, baseline: DataFrame, min_std: float = 1.0) -> DataFrame:
    """pickup_hour, zone_id, trips, hour_of_week, mean, std, z; z is null without a bucket or below min_std."""
    joined = _bucketed(demand).join(baseline, KEYS, "left")
    z = F.when(F.col("std") >= min_std, F.round((F.col("trips") - F.col("mean")) / F.col("std"), 6))
    return joined.select("pickup_hour", "zone_id", "trips", "hour_of_week", "mean", "std", z.alias("z"))


def detect_anomalies(demand: DataFrame, baseline: DataFrame, threshold: float = 3.0, min_std: float = 1.0) -> DataFrame:
    return z_scores(demand, baseline, min_std).filter(F.abs("z") >= threshold).orderBy(F.desc("z"), "pickup_hour", "zone_id")


def fit_robust_baseline(demand: DataFrame) -> DataFrame:
    """zone_id, hour_of_week, median, mad, n.

    One aggregation: a bucket has one count a week, so its counts fit an array.
    """
    rows = _bucketed(demand).groupBy(*KEYS).agg(F.sort_array(F.collect_list(F.col("trips").cast("double"))).alias("x"), F.count("*").alias("n"))
    rows = rows.withColumn("median", _median(F.col("x")))
    apart = F.sort_array(F.transform("x", lambda v: F.abs(v - F.col("median"))))
    return rows.withColumn("x", apart).select(*KEYS, "median", _median(F.col("x")).alias("mad"), "n")


def _median(x: Column) -> Column:
    """Of a sorted array; null of an empty one."""
    n = F.size(x)
    middle = lambda k: F.get(x, F.floor(k / 2).cast("int"))
    return (middle(n - 1) + middle(n)) / 2


def robust_z_scores(demand: DataFrame, baseline: DataFrame | None = None, min_mad: float = 1.0) -> DataFrame:
    """pickup_hour, zone_id, trips, hour_of_week, median, mad, robust_z.  Without a baseline the demand is its own."""
    joined = _bucketed(demand).join(baseline if baseline is not None else fit_robust_baseline(demand), KEYS, "left")
    z = F.when(F.col("mad") >= min_mad, F.round((F.col("trips") - F.col("median")) / (MAD_SCALE * F.col("mad")), 6))
    return joined.select("pickup_hour", "zone_id", "trips", "hour_of_week", "median", "mad", z.alias("robust_z"))


def ewma_residual_scores(demand: DataFrame, halflife: float = 24, span_std: int = 168, min_std: float = 1.0, least: int = 8) -> DataFrame:
    """pickup_hour, zone_id, trips, baseline, residual, sd, ewma_z on the dense panel.

    baseline is the exponential mean of the hours before; sd the population
    deviation of up to span_std residuals before, null under `least` of them.
    """
    order = W.partitionBy("zone_id").orderBy("pickup_hour")
    rows = hourly_panel(demand).withColumn("t", F.row_number().over(order) - 1)
    rows = rows.withColumn("baseline", ewm(F.col("trips"), F.col("t"), "zone_id", halflife)).withColumn("residual", F.col("trips") - F.col("baseline"))
    span = order.rowsBetween(-span_std, -1)
    rows = rows.withColumn("sd", F.when(F.count("residual").over(span) >= least, F.stddev_pop("residual").over(span)))
    z = F.when(F.col("sd") >= min_std, F.round(F.col("residual") / F.col("sd"), 6))
    return rows.select("pickup_hour", "zone_id", "trips", "baseline", "residual", "sd", z.alias("ewma_z"))


def detect_consensus_anomalies(demand: DataFrame, robust_threshold: float = 3.5, ewma_threshold: float = 3.0, min_votes: int = 2) -> DataFrame:
    """Cells that at least min_votes detectors flag, by severity (the larger absolute score)."""
    keys = ["pickup_hour", "zone_id", "trips"]
    both = robust_z_scores(demand).select(*keys, "robust_z").join(ewma_residual_scores(demand).select(*keys, "ewma_z"), keys, "full_outer")
    flag = lambda z, t: F.coalesce(F.abs(z) >= t, F.lit(False))
    both = both.withColumns({"robust_flag": flag("robust_z", robust_threshold), "ewma_flag": flag("ewma_z", ewma_threshold)})
    votes: Column = F.col("robust_flag").cast("long") + F.col("ewma_flag").cast("long")
    both = both.withColumn("votes", votes).withColumn("severity", F.greatest(F.abs("robust_z"), F.abs("ewma_z")))
    return both.filter(F.col("votes") >= min_votes).orderBy(F.desc("severity"), "pickup_hour", "zone_id")
