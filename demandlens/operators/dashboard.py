"""The aggregates behind a demand dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..charts import Panel, draw


def city_series(demand: DataFrame) -> DataFrame:
    return demand.groupBy("pickup_hour").agg(F.sum("trips").alias("trips"))


def zone_totals(demand: DataFrame, k: int = 10) -> DataFrame:
    return demand.groupBy("zone_id").agg(F.sum("trips").alias("trips")).orderBy(F.desc("trips"), "zone_id").limit(k)


def anomalies_per_hour(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("pickup_hour").agg(F.count("*").alias("anomalies"))


def forecast_vs_actual(demand: DataFrame, forecast: DataFrame) -> DataFrame:
    """pickup_hour, actual, forecast of the busiest zone, full outer."""
    best = F.broadcast(zone_totals(demand, 1).select("zone_id"))
    actual = demand.join(best, "zone_id").select("pickup_hour", F.col("trips").alias("actual"))
    told = forecast.join(best, "zone_id").select("pickup_hour", F.col("yhat").alias("forecast"))
    return actual.join(told, "pickup_hour", "full_outer")


def hotspot_pivot(demand: DataFrame, zones: list[int]) -> DataFrame:
    """pickup_hour and a column zone_<id> for each zone, gaps filled with the last count."""
    wide = demand.groupBy("pickup_hour").pivot("zone_id", zones).agg(F.sum("trips"))
    # One row an hour, whatever the number of trips.
    back = W.orderBy("pickup_hour").rowsBetween(W.unboundedPreceding, 0)
    return wide.select("pickup_hour", *(F.last(F.col(f"`{z}`"), ignorenulls=True).over(back).alias(f"zone_{z}") for z in zones))


def build_dashboard(demand: DataFrame, path: str, anomalies: DataFrame | None = None, forecast: DataFrame | None = None) -> str:
    """Draw city demand, busiest zones, anomalies an hour and the forecast (or hotspots) to a file, SVG by its suffix.

    What reaches the driver has one row an hour or a zone.
    """
    panels = [panel("City demand", city_series(demand), "pickup_hour")]
    top = zone_totals(demand)
    panels.append(panel("Busiest zones", top, "zone_id", bars=True, sort=False))
    if anomalies is not None:
        panels.append(panel("Anomalies", anomalies_per_hour(anomalies), "pickup_hour", bars=True))
    if forecast is not None:
        panels.append(panel("Forecast of the busiest zone", forecast_vs_actual(demand, forecast), "pickup_hour"))
    else:
        panels.append(panel("Hotspots", hotspot_pivot(demand, [int(z) for z in panels[1].labels][:5]), "pickup_hour"))
    return draw(panels, path)


def panel(title: str, rows: DataFrame, label: str, bars: bool = False, sort: bool = True) -> Panel:
    """All other columns of report-sized rows against the label column."""
    got = (rows.orderBy(label) if sort else rows).collect()
    return Panel(title, [str(r[label]) for r in got], {c: [r[c] for r in got] for c in rows.columns if c != label}, bars)
