"""The dense hourly panel, one-step forecasts, their backtest and horizons."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.columns import ewm

COLUMNS = ("pickup_hour", "zone_id", "trips")


def hourly_panel(demand: DataFrame, full_grid: bool = True, start=None, end=None) -> DataFrame:
    """Every zone seen x every hour from the first to the last (or start to end), zero where there is no row.

    Rows that share zone and hour raise when the panel is computed.  Bounds
    given by the caller keep a stray old time from inflating the grid.
    """
    if missing := [c for c in COLUMNS if c not in demand.columns]:
        raise ValueError(f"demand lacks {', '.join(missing)}")
    if not full_grid:
        return demand.select(*COLUMNS).orderBy("zone_id", "pickup_hour")
    cells = demand.groupBy("zone_id", "pickup_hour").agg(F.first("trips").alias("trips"), F.count("*").alias("n"))
    cells = cells.select("zone_id", "pickup_hour", F.when(F.col("n") == 1, F.col("trips")).otherwise(F.raise_error(F.lit("a zone has two rows for one hour")).cast("long")).alias("trips"))
    # One row a zone, so a window over all of them is small; hours are made where a zone's rows are.
    spans = demand.groupBy("zone_id").agg(F.min("pickup_hour").alias("a"), F.max("pickup_hour").alias("b"))
    low = F.lit(str(start)).cast("timestamp_ntz") if start else F.min("a").over(W.partitionBy())
    high = F.lit(str(end)).cast("timestamp_ntz") if end else F.max("b").over(W.partitionBy())
    spans = spans.select("zone_id", low.alias("a"), high.alias("b")).filter("a is not null").repartition("zone_id")
    grid = spans.select("zone_id", F.explode(F.expr("sequence(a, b, interval 1 hour)")).alias("pickup_hour"))
    return grid.join(cells, ["zone_id", "pickup_hour"], "left").select("pickup_hour", "zone_id", F.coalesce("trips", F.lit(0)).cast("long").alias("trips"))


def _order() -> WindowSpec:
    return W.partitionBy("zone_id").orderBy("pickup_hour")


def _numbered(panel: DataFrame) -> DataFrame:
    return panel.withColumn("t", F.row_number().over(_order()) - 1)


def seasonal_naive(lag: int = 24) -> Column:
    return F.lag("trips", lag).over(_order()).cast("double")


def moving_average(window: int = 24, min_periods: int = 1) -> Column:
    before = _order().rowsBetween(-window, -1)
    return F.when(F.count("trips").over(before) >= min_periods, F.avg("trips").over(before))


def ewm_level(halflife: float = 12) -> Column:
    return ewm(F.col("trips"), F.col("t"), "zone_id", halflife)


METHODS: dict[str, Callable[[], Column]] = {
    "seasonal_naive_24": lambda: seasonal_naive(24),
    "seasonal_naive_168": lambda: seasonal_naive(168),
    "moving_average_24": lambda: moving_average(24),
    "moving_average_168": lambda: moving_average(168),
    "ewm_12": lambda: ewm_level(12),
    "ewm_24": lambda: ewm_level(24),
}


def _forecast(demand: DataFrame, yhat: Column, method: str) -> DataFrame:
    return _numbered(hourly_panel(demand)).select("pickup_hour", "zone_id", F.col("trips").alias("y"), yhat.alias("yhat"), F.lit(method).alias("method"))


def seasonal_naive_forecast(demand: DataFrame, seasonal_lag: int = 24) -> DataFrame:
    """pickup_hour, zone_id, y, yhat, method."""
    return _forecast(demand, seasonal_naive(seasonal_lag), f"seasonal_naive_lag_{seasonal_lag}")


def moving_average_forecast(demand: DataFrame, window: int = 24, min_periods: int = 1) -> DataFrame:
    return _forecast(demand, moving_average(window, min_periods), f"moving_average_{window}")


def ewm_forecast(demand: DataFrame, halflife: float = 12) -> DataFrame:
    return _forecast(demand, ewm_level(halflife), f"ewm_halflife_{halflife:g}")


def forecast_metrics(rows: DataFrame, *keys: str) -> DataFrame:
    """mae, rmse, mape (percent, without zero actuals), coverage and n_forecasts of rows (y, yhat)."""
    e = F.col("y") - F.col("yhat")
    ape = F.abs(e) / F.nullif(F.col("y").cast("double"), F.lit(0.0))
    n = F.count(e)
    aggs = [F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(ape)).alias("mape"), (n / F.count("*")).alias("coverage"), n.alias("n_forecasts")]
    return rows.groupBy(*keys).agg(*aggs)


def backtest_zone_forecasts(demand: DataFrame, methods: list[str] | None = None, holdout_hours: int = 168) -> DataFrame:
    """method, mae, rmse, mape, coverage, n_forecasts, holdout_hours over the last holdout_hours, by rmse and mae.

    All methods are columns of one pass over the panel; forecasts look one
    hour ahead from actual counts.
    """
    names = list(METHODS) if methods is None else list(methods)
    if unknown := [m for m in names if m not in METHODS]:
        raise KeyError(unknown[0])
    span = demand.agg(F.min("pickup_hour").alias("start"), F.max("pickup_hour").alias("end")).first()
    n = int((span["end"] - span["start"]).total_seconds()) // 3600 + 1 if span["end"] else 0
    if n <= holdout_hours:
        raise ValueError(f"{n} hours are too few for a holdout of {holdout_hours}")
    rows = _numbered(hourly_panel(demand)).select("pickup_hour", "trips", *(METHODS[m]().alias(m) for m in names))
    rows = rows.filter(F.col("pickup_hour") > F.lit(span["end"]).cast("timestamp_ntz") - F.expr(f"interval {holdout_hours} hours"))
    long = rows.select(F.col("trips").alias("y"), F.explode(F.array(*(F.struct(F.lit(m).alias("method"), F.col(m).alias("yhat")) for m in names))).alias("f")).select("y", "f.*")
    return forecast_metrics(long, "method").withColumn("holdout_hours", F.lit(holdout_hours).cast("long")).orderBy("rmse", "mae", "method")


def _steps(horizon: int) -> Column:
    return F.explode(F.sequence(F.lit(1), F.lit(horizon)))


def forecast_next_horizon(demand: DataFrame, method: str = "seasonal_naive_24", horizon: int = 24) -> DataFrame:
    """pickup_hour, zone_id, step, yhat (at least 0), method: each step built on the ones before.

    A zone's needed tail is one array: a season, an averaging window or a
    single level; the recursion is a fold over it.
    """
    if method not in METHODS:
        raise KeyError(method)
    kind, _, size = method.rpartition("_")
    size = int(size)
    panel = _numbered(hourly_panel(demand))
    if kind == "ewm":
        level = ewm(F.col("trips"), F.col("t"), "zone_id", size, current=True)
        tail = panel.select("zone_id", "pickup_hour", level.alias("v")).groupBy("zone_id").agg(F.max("pickup_hour").alias("last"), F.array(F.max_by("v", "pickup_hour")).alias("h"))
        steps = F.array_repeat(F.col("h")[0], horizon)
    else:
        last = W.partitionBy("zone_id").orderBy(F.desc("pickup_hour"))
        recent = panel.withColumn("k", F.row_number().over(last)).filter(F.col("k") <= size)
        tail = recent.groupBy("zone_id").agg(F.max("pickup_hour").alias("last"), F.sort_array(F.collect_list(F.struct("pickup_hour", F.col("trips").cast("double").alias("v")))).alias("h"))
        tail = tail.withColumn("h", F.col("h")["v"])
        if kind == "moving_average":
            nxt = lambda a: F.aggregate(F.slice(a, F.greatest(F.size(a) - size + 1, F.lit(1)), F.lit(size)), F.lit(0.0), lambda s, x: s + x) / F.least(F.size(a), F.lit(size))
        else:
            nxt = lambda a: F.element_at(a, F.greatest(F.size(a) - size + 1, F.lit(0)).cast("int") + F.when(F.size(a) < size, F.size(a)).otherwise(0))
        grown = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("h"), lambda a, _: F.concat(a, F.array(nxt(a))))
        steps = F.slice(grown, F.size("h") + 1, F.lit(horizon))
    out = tail.select("zone_id", "last", F.posexplode(steps).alias("p", "yhat"))
    hour = F.expr("last + make_dt_interval(0, p + 1)").cast("timestamp_ntz")
    return out.select(hour.alias("pickup_hour"), "zone_id", (F.col("p") + 1).cast("long").alias("step"), F.greatest(F.col("yhat"), F.lit(0.0)).alias("yhat"), F.lit(method).alias("method")).orderBy("step", "zone_id")


def ewm_by_zone(panel: DataFrame, halflife: float) -> DataFrame:
    """As ewm_level, in pandas: pickup_hour, zone_id, trips, level, a zone to a task."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pickup_hour")
        return rows.assign(level=rows["trips"].ewm(halflife=halflife, adjust=False).mean().shift(1))[["pickup_hour", "zone_id", "trips", "level"]]

    return panel.select(*COLUMNS).groupBy("zone_id").applyInPandas(fold, "pickup_hour timestamp_ntz, zone_id long, trips long, level double")
