"""The engine's queries over the driver tables, and equivalent DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregate, analytics, anomaly, approximate, clean, dashboard, forecast, hotspot, mapreduce
from ..session import use_utc
from ..sources import files, store
from ..sources.adapters import demand, dirty_trips, long_demand, raw_trips, zones
from ..storage import scratch
from ..streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

RAW = """raw AS (SELECT ts AS pickup_datetime, ts + to_seconds(floor(value * 20)::BIGINT) AS dropoff_datetime,
    (user_id % 30 + 1)::BIGINT AS pu_location_id, (event_id * 31 % 270)::BIGINT AS do_location_id,
    (event_id % 5 + 1)::BIGINT AS passenger_count, value / 4 AS trip_distance, value - 2 AS fare_amount,
    value + 3 AS total_amount FROM events),
  judged AS (SELECT *, CASE
    WHEN epoch_us(dropoff_datetime) - epoch_us(pickup_datetime) NOT BETWEEN 30000000 AND 21600000000 THEN 'bad_duration'
    WHEN year(pickup_datetime) < 2010 THEN 'bad_date'
    WHEN pu_location_id NOT BETWEEN 1 AND 263 OR do_location_id NOT BETWEEN 1 AND 263 THEN 'bad_zone'
    WHEN trip_distance NOT BETWEEN 0 AND 100 OR fare_amount < 0 THEN 'bad_fare_distance' END AS reason FROM raw),
  trips AS (SELECT DISTINCT * EXCLUDE (reason), ((epoch_us(dropoff_datetime) - epoch_us(pickup_datetime)) // 1000000)::BIGINT AS trip_duration_sec,
    date_trunc('hour', pickup_datetime)::TIMESTAMP AS pickup_hour, pickup_datetime::DATE AS pickup_date FROM judged WHERE reason IS NULL),
  zones AS (SELECT (n_nationkey + 1)::BIGINT AS location_id, r_name AS borough, n_name AS zone, 'Z' || n_regionkey AS service_zone
    FROM nation JOIN region ON n_regionkey = r_regionkey)"""
DEMAND = """demand AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS pickup_hour, (user_id % 5 + 1)::BIGINT AS zone_id, count(*) AS trips
    FROM events GROUP BY ALL),
  how AS (SELECT *, ((isodow(pickup_hour) - 1) * 24 + hour(pickup_hour))::BIGINT AS hour_of_week FROM demand),
  hours AS (SELECT unnest(generate_series(min(pickup_hour), max(pickup_hour), INTERVAL 1 HOUR)) AS pickup_hour FROM demand),
  panel AS (SELECT h.pickup_hour, z.zone_id, coalesce(d.trips, 0)::BIGINT AS trips, row_number() OVER (PARTITION BY z.zone_id ORDER BY h.pickup_hour) - 1 AS t
    FROM hours h CROSS JOIN (SELECT DISTINCT zone_id FROM demand) z LEFT JOIN demand d ON d.pickup_hour = h.pickup_hour AND d.zone_id = z.zone_id)"""
#: Where the anomaly queries end the baseline and begin to score.
CUTOFF = "2024-01-22"


def _ewm_sql(halflife: int) -> str:
    q = f"pow(0.5, 1.0 / {halflife})"
    weight = f"CASE WHEN t = 0 THEN 1.0 ELSE (1 - {q}) * pow({q}, -t) END"
    return f"pow({q}, t - 1) * sum({weight} * trips) OVER (PARTITION BY zone_id ORDER BY pickup_hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


def _ma_sql(n: int) -> str:
    return f"avg(trips) OVER (PARTITION BY zone_id ORDER BY pickup_hour ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


def _lag_sql(n: int) -> str:
    return f"lag(trips, {n}) OVER (PARTITION BY zone_id ORDER BY pickup_hour)::DOUBLE"


METHOD_SQL = {"seasonal_naive_24": _lag_sql(24), "seasonal_naive_168": _lag_sql(168), "moving_average_24": _ma_sql(24), "moving_average_168": _ma_sql(168), "ewm_12": _ewm_sql(12), "ewm_24": _ewm_sql(24)}


def query(sql: str | None = None, name: str | None = None):
    """Register a query; doubles are rounded to six decimals, counts are long."""

    def wrap(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(use_utc(spark), sf_dir)
            kind = {"double": lambda c: F.round(F.col(c), 6).alias(c), "int": lambda c: F.col(c).cast("long").alias(c)}
            return df.select(*(kind[t](c) if t in kind else F.col(c) for c, t in df.dtypes))

        QUERIES[name or f.__name__] = run
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return wrap


def trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.clean_trips(raw_trips(spark, sf_dir))


@query(f"WITH {RAW} SELECT * REPLACE (round(trip_distance, 6) AS trip_distance, round(fare_amount, 6) AS fare_amount, round(total_amount, 6) AS total_amount) FROM trips")
def clean_trips(spark, sf_dir):
    return trips(spark, sf_dir)


@query(f"""WITH {RAW}, n AS (SELECT count(*) AS o FROM trips) SELECT count(*) AS input_rows, any_value(o) AS output_rows, count(*) - any_value(o) AS total_dropped,
  {', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS dropped_{r}" for r in clean.REASONS[:-1])},
  count(*) FILTER (WHERE reason IS NULL) - any_value(o) AS dropped_duplicates FROM judged, n""")
def cleaning_report(spark, sf_dir):
    return clean.cleaning_report(raw_trips(spark, sf_dir))


@query(f"WITH {RAW} SELECT pickup_hour, pu_location_id AS zone_id, count(*) AS trips FROM trips GROUP BY ALL")
def zone_hour_demand(spark, sf_dir):
    return aggregate.zone_hour_demand(trips(spark, sf_dir))


@query(f"WITH {RAW} SELECT pickup_date, pu_location_id AS zone_id, count(*) AS trips FROM trips GROUP BY ALL")
def zone_daily_demand(spark, sf_dir):
    return aggregate.zone_daily_demand(trips(spark, sf_dir))


@query(f"WITH {RAW} SELECT pickup_hour, count(*) AS trips FROM trips GROUP BY ALL")
def hourly_totals(spark, sf_dir):
    return aggregate.hourly_totals(trips(spark, sf_dir))


_TOP = "SELECT pu_location_id AS zone_id, count(*) AS trips FROM trips {} GROUP BY ALL ORDER BY trips DESC, zone_id LIMIT {}"
_NAMED = "SELECT zone_id, coalesce(zone, '<unknown>') AS zone_name, coalesce(borough, '<unknown>') AS borough, trips FROM top LEFT JOIN zones ON zone_id = location_id"


@query(f"WITH {RAW}, top AS ({_TOP.format('', 10)}) {_NAMED}")
def busiest_zones(spark, sf_dir):
    return aggregate.busiest_zones(trips(spark, sf_dir), 10, zones=zones(spark, sf_dir))


@query(f"WITH {RAW}, top AS ({_TOP.format('''WHERE pickup_hour BETWEEN '2024-01-08' AND '2024-01-15 00:30' ''', 12)}) {_NAMED}")
def busiest_zones_range(spark, sf_dir):
    return aggregate.busiest_zones(trips(spark, sf_dir), 12, "2024-01-08 00:00:00", "2024-01-15 00:30:00", zones(spark, sf_dir))


@query(f"WITH {RAW} {_TOP.format('', 10)}")
def busiest_zones_no_lookup(spark, sf_dir):
    return aggregate.busiest_zones(trips(spark, sf_dir), 10)


@query(f"""WITH {RAW}, d AS (SELECT pickup_hour, pu_location_id AS zone_id, count(*) AS trips FROM trips GROUP BY ALL)
  SELECT zone_id, count(*) AS hours_observed, round(avg(trips), 6) AS mean_trips, round(stddev_pop(trips), 6) AS std_trips, min(trips) AS min_trips, max(trips) AS max_trips FROM d GROUP BY ALL""")
def demand_distribution(spark, sf_dir):
    return aggregate.demand_distribution(trips(spark, sf_dir))


@query(f"WITH {RAW} SELECT CASE WHEN isodow(pickup_datetime) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, hour(pickup_datetime) AS hour, count(*) AS trips FROM trips GROUP BY ALL")
def weekday_weekend(spark, sf_dir):
    return analytics.weekday_weekend_demand(trips(spark, sf_dir))


@query(f"""WITH {RAW} SELECT CASE WHEN lower(zone) LIKE '%united%' OR lower(zone) LIKE '%japan%' THEN 'airport' WHEN borough = 'ASIA' THEN 'manhattan' ELSE 'other' END AS segment,
  pickup_date AS day, count(*) AS trips, round(avg(trip_distance), 6) AS avg_distance, round(avg(fare_amount), 6) AS avg_fare FROM trips LEFT JOIN zones ON pu_location_id = location_id GROUP BY ALL""")
def segment_by_day(spark, sf_dir):
    return analytics.airport_vs_manhattan(trips(spark, sf_dir), zones(spark, sf_dir), ("%united%", "%japan%"), "ASIA")


@query(f"""WITH {RAW} SELECT pu_location_id AS origin_id, do_location_id AS destination_id, count(*) AS trips, round(avg(trip_distance), 6) AS avg_distance, round(avg(total_amount), 6) AS avg_total
  FROM trips WHERE trip_distance >= 0.5 GROUP BY ALL ORDER BY trips DESC, origin_id, destination_id LIMIT 20""")
def top_od_pairs(spark, sf_dir):
    return analytics.top_origin_destination_pairs(trips(spark, sf_dir))


@query(f"""WITH {RAW} SELECT coalesce(p.borough, 'Unknown') AS origin_borough, coalesce(d.borough, 'Unknown') AS destination_borough, count(*) AS trips
  FROM trips LEFT JOIN zones p ON pu_location_id = p.location_id LEFT JOIN zones d ON do_location_id = d.location_id GROUP BY ALL""")
def borough_flow(spark, sf_dir):
    return analytics.borough_flow_matrix(trips(spark, sf_dir), zones(spark, sf_dir))


@query(f"WITH {RAW}, top AS ({_TOP.format('', 20)}) SELECT pu_location_id AS zone_id, hour(pickup_datetime) AS hour, count(*) AS trips FROM trips WHERE pu_location_id IN (SELECT zone_id FROM top) GROUP BY ALL")
def zone_hour_heatmap(spark, sf_dir):
    return analytics.zone_hour_heatmap(trips(spark, sf_dir))


@query(f"""WITH {RAW} SELECT pu_location_id AS zone_id, coalesce(any_value(zone), '') AS zone_name, coalesce(any_value(borough), '') AS borough, count(*) AS trips, round(avg(trip_distance), 6) AS avg_distance,
  round(avg(fare_amount), 6) AS avg_fare, round(avg(total_amount), 6) AS avg_total, round(avg(trip_duration_sec) / 60, 6) AS avg_minutes FROM trips LEFT JOIN zones ON pu_location_id = location_id GROUP BY 1""")
def zone_summary(spark, sf_dir):
    return analytics.avg_fare_distance_by_zone(trips(spark, sf_dir), zones(spark, sf_dir))


@query(f"WITH {DEMAND}, c AS (SELECT zone_id, sum(trips)::BIGINT AS trips FROM demand GROUP BY ALL) SELECT row_number() OVER (ORDER BY trips DESC, zone_id) AS rank, zone_id, trips FROM c ORDER BY trips DESC, zone_id LIMIT 3")
def top_k(spark, sf_dir):
    return hotspot.top_k(demand(spark, sf_dir).groupBy("zone_id").agg(F.sum("trips").alias("trips")), 3)


@query(f"WITH {RAW}, d AS (SELECT pickup_hour, pu_location_id AS zone_id, count(*) AS trips FROM trips GROUP BY ALL) SELECT pickup_hour, row_number() OVER (PARTITION BY pickup_hour ORDER BY trips DESC, zone_id) AS rank, zone_id, trips FROM d QUALIFY rank <= 3")
def top_k_per_window(spark, sf_dir):
    return hotspot.top_k_per_window(aggregate.zone_hour_demand(trips(spark, sf_dir)), 3)


def _split(spark, sf_dir):
    d = demand(spark, sf_dir)
    cut = F.lit(CUTOFF).cast("timestamp_ntz")
    return d.filter(F.col("pickup_hour") < cut), d.filter(F.col("pickup_hour") >= cut)


_BASE = f"base AS (SELECT zone_id, hour_of_week, avg(trips) AS mean, stddev_pop(trips) AS std, count(*) AS n FROM how WHERE pickup_hour < '{CUTOFF}' GROUP BY ALL)"
_Z = f"z AS (SELECT pickup_hour, h.zone_id, trips, h.hour_of_week, round(mean, 6) AS mean, round(std, 6) AS std, CASE WHEN std >= 1 THEN round((trips - mean) / std, 6) END AS z FROM how h LEFT JOIN base b ON h.zone_id = b.zone_id AND h.hour_of_week = b.hour_of_week WHERE pickup_hour >= '{CUTOFF}')"


@query(f"WITH {DEMAND}, {_BASE} SELECT zone_id, hour_of_week, round(mean, 6) AS mean, round(std, 6) AS std, n FROM base")
def baseline(spark, sf_dir):
    return anomaly.fit_baseline(_split(spark, sf_dir)[0])


@query(f"WITH {DEMAND}, {_BASE}, {_Z} SELECT * FROM z")
def z_scores(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    return anomaly.z_scores(after, anomaly.fit_baseline(before))


@query(f"WITH {DEMAND}, {_BASE}, {_Z} SELECT * FROM z WHERE abs(z) >= 3")
def anomalies(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    return anomaly.detect_anomalies(after, anomaly.fit_baseline(before))


_ROBUST = "rb AS (SELECT zone_id, hour_of_week, median(trips) AS median, mad(trips) AS mad, count(*) AS n FROM how GROUP BY ALL), rz AS (SELECT pickup_hour, h.zone_id, trips, h.hour_of_week, median, mad, CASE WHEN mad >= 1 THEN round((trips - median) / (1.4826 * mad), 6) END AS robust_z FROM how h LEFT JOIN rb ON h.zone_id = rb.zone_id AND h.hour_of_week = rb.hour_of_week)"
_EWMA = f"e0 AS (SELECT *, {_ewm_sql(24)} AS baseline FROM panel), e1 AS (SELECT *, trips - baseline AS residual FROM e0), e2 AS (SELECT *, CASE WHEN count(residual) OVER w >= 8 THEN stddev_pop(residual) OVER w END AS sd FROM e1 WINDOW w AS (PARTITION BY zone_id ORDER BY pickup_hour ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)), ez AS (SELECT pickup_hour, zone_id, trips, baseline, residual, sd, CASE WHEN sd >= 1 THEN round(residual / sd, 6) END AS ewma_z FROM e2)"


@query(f"WITH {DEMAND}, {_ROBUST} SELECT zone_id, hour_of_week, round(median, 6) AS median, round(mad, 6) AS mad, n FROM rb")
def robust_baseline(spark, sf_dir):
    return anomaly.fit_robust_baseline(demand(spark, sf_dir))


@query(f"WITH {DEMAND}, {_ROBUST} SELECT * FROM rz")
def robust_z(spark, sf_dir):
    return anomaly.robust_z_scores(demand(spark, sf_dir))


@query(f"WITH {DEMAND}, {_EWMA} SELECT pickup_hour, zone_id, trips, round(baseline, 6) AS baseline, round(residual, 6) AS residual, round(sd, 6) AS sd, ewma_z FROM ez")
def ewma_residual(spark, sf_dir):
    return anomaly.ewma_residual_scores(demand(spark, sf_dir))


@query(f"""WITH {DEMAND}, {_ROBUST}, {_EWMA}, b AS (SELECT coalesce(r.pickup_hour, e.pickup_hour) AS pickup_hour, coalesce(r.zone_id, e.zone_id) AS zone_id, coalesce(r.trips, e.trips) AS trips, robust_z, ewma_z,
  coalesce(abs(robust_z) >= 3.5, false) AS robust_flag, coalesce(abs(ewma_z) >= 3, false) AS ewma_flag FROM rz r FULL JOIN ez e ON r.pickup_hour = e.pickup_hour AND r.zone_id = e.zone_id AND r.trips = e.trips)
  SELECT *, robust_flag::BIGINT + ewma_flag::BIGINT AS votes, greatest(abs(robust_z), abs(ewma_z)) AS severity FROM b WHERE robust_flag AND ewma_flag""")
def consensus(spark, sf_dir):
    return anomaly.detect_consensus_anomalies(demand(spark, sf_dir))


@query(f"WITH {DEMAND} SELECT pickup_hour, zone_id, trips FROM panel")
def hourly_panel(spark, sf_dir):
    return forecast.hourly_panel(demand(spark, sf_dir))


def _forecast_sql(expr: str, method: str) -> str:
    return f"WITH {DEMAND} SELECT pickup_hour, zone_id, trips AS y, round({expr}, 6) AS yhat, '{method}' AS method FROM panel"


@query(_forecast_sql(_lag_sql(24), "seasonal_naive_lag_24"))
def seasonal_naive(spark, sf_dir):
    return forecast.seasonal_naive_forecast(demand(spark, sf_dir))


@query(_forecast_sql(_ma_sql(24), "moving_average_24"))
def moving_average(spark, sf_dir):
    return forecast.moving_average_forecast(demand(spark, sf_dir))


@query(_forecast_sql(_ewm_sql(12), "ewm_halflife_12"))
def ewm(spark, sf_dir):
    return forecast.ewm_forecast(demand(spark, sf_dir))


@query(f"""WITH {DEMAND}, f AS (SELECT pickup_hour, trips, {', '.join(f'{s} AS {m}' for m, s in METHOD_SQL.items())} FROM panel),
  l AS ({' UNION ALL '.join(f"SELECT pickup_hour, trips, '{m}' AS method, {m} AS yhat FROM f" for m in METHOD_SQL)}),
  h AS (SELECT * FROM l WHERE pickup_hour > (SELECT max(pickup_hour) FROM demand) - INTERVAL 168 HOUR)
  SELECT method, round(avg(abs(trips - yhat)), 6) AS mae, round(sqrt(avg((trips - yhat) * (trips - yhat))), 6) AS rmse, round(100 * avg(abs(trips - yhat) / nullif(trips, 0)), 6) AS mape,
  round(count(yhat) / count(*), 6) AS coverage, count(yhat) AS n_forecasts, 168::BIGINT AS holdout_hours FROM h GROUP BY ALL""")
def backtest(spark, sf_dir):
    return forecast.backtest_zone_forecasts(demand(spark, sf_dir))


_LAST = "l AS (SELECT zone_id, max(t) AS top, max(pickup_hour) AS last FROM panel GROUP BY ALL), s AS (SELECT unnest(range(1, 31)) AS step)"


def _horizon(method: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: forecast.forecast_next_horizon(demand(spark, sf_dir), method, 30)


for _n in (24, 168):
    query(f"""WITH {DEMAND}, {_LAST} SELECT last + to_hours(step::BIGINT) AS pickup_hour, l.zone_id, step::BIGINT AS step, trips::DOUBLE AS yhat, 'seasonal_naive_{_n}' AS method
      FROM l CROSS JOIN s JOIN panel p ON p.zone_id = l.zone_id AND p.t = top - {_n - 1} + (step - 1) % {_n}""", f"horizon_seasonal_{_n}")(_horizon(f"seasonal_naive_{_n}"))
    query(f"""WITH RECURSIVE {DEMAND}, {_LAST}, g AS (SELECT l.zone_id, 0 AS step, any_value(last) AS last, list(trips::DOUBLE ORDER BY t) AS h FROM l JOIN panel p ON p.zone_id = l.zone_id AND t > top - {_n} GROUP BY l.zone_id
      UNION ALL SELECT zone_id, step + 1, last, list_append(h[2:], list_sum(h) / {_n}) FROM g WHERE step < 30)
      SELECT last + to_hours(step::BIGINT) AS pickup_hour, zone_id, step::BIGINT AS step, round(h[{_n}], 6) AS yhat, 'moving_average_{_n}' AS method FROM g WHERE step > 0""", f"horizon_ma_{_n}")(_horizon(f"moving_average_{_n}"))
for _n in (12, 24):
    query(f"""WITH {DEMAND}, {_LAST}, w AS (SELECT p.zone_id, any_value(last) AS last, sum(CASE WHEN t = 0 THEN 1.0 ELSE 1 - pow(0.5, 1.0 / {_n}) END * pow(pow(0.5, 1.0 / {_n}), top - t) * trips) AS v FROM panel p JOIN l ON p.zone_id = l.zone_id GROUP BY p.zone_id)
      SELECT last + to_hours(step::BIGINT) AS pickup_hour, zone_id, step::BIGINT AS step, round(v, 6) AS yhat, 'ewm_{_n}' AS method FROM w CROSS JOIN s""", f"horizon_ewm_{_n}")(_horizon(f"ewm_{_n}"))


# Over 30 000 hours; terms of more than 60 half-lives ago are below any rounding.
_LONG = DEMAND.replace("date_trunc('hour', ts)::TIMESTAMP AS pickup_hour, (user_id % 5 + 1)", "TIMESTAMP '2020-01-01' + to_hours(event_id * 7919 % 30000) AS pickup_hour, (user_id % 2 + 1)")


@query(f"""WITH {_LONG}, q AS (SELECT pow(0.5, 1.0 / 12) AS q), e AS (SELECT a.pickup_hour, a.zone_id, sum(CASE WHEN b.t = 0 THEN 1.0 ELSE 1 - q END * pow(q, a.t - 1 - b.t) * b.trips) AS v
  FROM panel a JOIN panel b ON a.zone_id = b.zone_id AND b.t BETWEEN a.t - 720 AND a.t - 1 CROSS JOIN q GROUP BY ALL)
  SELECT p.pickup_hour, p.zone_id, trips AS y, round(v, 6) AS yhat, 'ewm_halflife_12' AS method FROM panel p LEFT JOIN e ON e.pickup_hour = p.pickup_hour AND e.zone_id = p.zone_id""")
def ewm_long(spark, sf_dir):
    return forecast.ewm_forecast(long_demand(spark, sf_dir))


@query(f"WITH {DEMAND} SELECT pickup_hour, zone_id, trips FROM demand")
def hourly_panel_sparse(spark, sf_dir):
    return forecast.hourly_panel(demand(spark, sf_dir), full_grid=False)


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", (F.col("user_id") % 30 + 1).cast("long").alias("zone_id"))


_EV = "ev AS (SELECT event_id, (user_id % 30 + 1)::BIGINT AS zone_id FROM events)"
_RES = f"{_EV}, smp AS (SELECT * FROM ev ORDER BY ('0x' || substr(md5('42:' || event_id), 1, 8))::BIGINT, event_id LIMIT 500), est AS (SELECT zone_id, count(*) * (SELECT count(*) FROM ev) / (SELECT count(*) FROM smp) AS estimate FROM smp GROUP BY ALL)"
_CMS = f"{_EV}, it AS (SELECT zone_id, count(*) AS w FROM ev GROUP BY ALL), cell AS (SELECT zone_id, w, r.row, ('0x' || substr(md5('42-' || r.row || ':' || zone_id), 1, 8))::BIGINT % 64 AS col FROM it CROSS JOIN (SELECT unnest(range(5)) AS row) r), cms AS (SELECT row, col, sum(w)::BIGINT AS n FROM cell GROUP BY ALL), cest AS (SELECT zone_id, min(n) AS estimate FROM cell JOIN cms USING (row, col) GROUP BY ALL)"


@query(f"WITH {_RES} SELECT zone_id, round(estimate, 6) AS estimate FROM est")
def reservoir_counts(spark, sf_dir):
    return approximate.reservoir_estimates(_events(spark, sf_dir), 500, "event_id")


@query(f"WITH {_CMS} SELECT * FROM cms")
def cms_table(spark, sf_dir):
    return approximate.cms_table(_events(spark, sf_dir), width=64)


@query(f"WITH {_CMS} SELECT * FROM cest")
def cms_estimates(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return approximate.cms_estimates(approximate.cms_table(ev, width=64), ev, width=64)


@query(f"""WITH {_CMS}, e AS (SELECT zone_id, row_number() OVER (ORDER BY w DESC, zone_id) AS re FROM it QUALIFY re <= 10), a AS (SELECT zone_id, row_number() OVER (ORDER BY estimate DESC, zone_id) AS ra FROM cest QUALIFY ra <= 10),
  b AS (SELECT e.re, a.ra FROM e FULL JOIN a ON e.zone_id = a.zone_id), c AS (SELECT count(*) AS u, count(*) FILTER (WHERE re IS NOT NULL AND ra IS NOT NULL) AS o, coalesce(sum((re - ra) * (re - ra)), 0) AS d FROM b)
  SELECT o AS overlap, round(o / u, 6) AS jaccard, round(CASE WHEN o = 0 THEN 0 WHEN o = 1 THEN 1 ELSE 1 - 6.0 * d / (o * (o * o - 1)) END, 6)::DOUBLE AS spearman FROM c""")
def compare_topk(spark, sf_dir):
    ev = _events(spark, sf_dir)
    exact = hotspot.top_k(approximate.exact_counts(ev), 10)
    return approximate.compare_topk(exact, approximate.cms_top_k(approximate.cms_table(ev, width=64), ev, 10, width=64))


@query(f"WITH {RAW}, c AS (SELECT pu_location_id AS zone_id, count(*) AS trips FROM trips GROUP BY ALL) SELECT row_number() OVER (ORDER BY trips DESC, zone_id) AS rank, * FROM c ORDER BY trips DESC, zone_id LIMIT 10")
def map_reduce_topk(spark, sf_dir):
    return mapreduce.reduce_top_k(mapreduce.map_zone_counts(raw_trips(spark, sf_dir)), 10)


@query(f"WITH {_EV} SELECT zone_id, count(*) AS trips FROM ev GROUP BY ALL")
def stream_counts(spark, sf_dir):
    return monitor.drain(monitor.cumulative_counts(monitor.event_stream(spark, sf_dir)), "stream_counts")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, (user_id % 30 + 1)::BIGINT AS zone_id, count(*) AS trips FROM events GROUP BY ALL")
def stream_window_counts(spark, sf_dir):
    out = monitor.drain(monitor.windowed_counts(monitor.event_stream(spark, sf_dir)), "stream_window_counts")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(f"WITH {_EV}, c AS (SELECT zone_id, count(*) AS trips FROM ev GROUP BY ALL) SELECT row_number() OVER (ORDER BY trips DESC, zone_id) AS rank, * FROM c ORDER BY trips DESC, zone_id LIMIT 10")
def stream_topk(spark, sf_dir):
    return hotspot.top_k(monitor.drain(monitor.cumulative_counts(monitor.event_stream(spark, sf_dir)), "stream_topk"), 10)


@query("SELECT (user_id % 30 + 1)::BIGINT AS zone_id, count(*) AS trips FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOUR GROUP BY ALL")
def monitor_window(spark, sf_dir):
    m = monitor.StreamingMonitor(spark, timedelta(hours=24))
    m.update_batch(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 30 + 1).cast("long").alias("zone_id")))
    return m.window_frame()


@query(f"WITH {DEMAND} SELECT pickup_hour, sum(trips)::BIGINT AS trips FROM demand GROUP BY ALL")
def city_series(spark, sf_dir):
    return dashboard.city_series(demand(spark, sf_dir))


@query(f"WITH {DEMAND}, w AS (SELECT pickup_hour, {', '.join(f'sum(trips) FILTER (WHERE zone_id = {z})::BIGINT AS z{z}' for z in range(1, 6))} FROM demand GROUP BY ALL) SELECT pickup_hour, {', '.join(f'last_value(z{z} IGNORE NULLS) OVER (ORDER BY pickup_hour ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS zone_{z}' for z in range(1, 6))} FROM w")
def hotspot_pivot(spark, sf_dir):
    return dashboard.hotspot_pivot(demand(spark, sf_dir), [1, 2, 3, 4, 5])


@query(f"WITH {DEMAND}, {_BASE}, {_Z} SELECT pickup_hour, count(*) AS anomalies FROM z WHERE abs(z) >= 1.5 GROUP BY ALL")
def anomalies_per_hour(spark, sf_dir):
    before, after = _split(spark, sf_dir)
    return dashboard.anomalies_per_hour(anomaly.detect_anomalies(after, anomaly.fit_baseline(before), 1.5))


@query(f"WITH {DEMAND}, b AS (SELECT zone_id FROM demand GROUP BY ALL ORDER BY sum(trips) DESC, zone_id LIMIT 1), a AS (SELECT pickup_hour, trips AS actual FROM demand WHERE zone_id IN (FROM b)), f AS (SELECT pickup_hour, zone_id, {_lag_sql(24)} AS forecast FROM panel), g AS (SELECT pickup_hour, forecast FROM f WHERE zone_id IN (FROM b)) SELECT coalesce(a.pickup_hour, g.pickup_hour) AS pickup_hour, actual, forecast FROM a FULL JOIN g ON a.pickup_hour = g.pickup_hour")
def forecast_vs_actual(spark, sf_dir):
    d = demand(spark, sf_dir)
    return dashboard.forecast_vs_actual(d, forecast.seasonal_naive_forecast(d))


@query("""WITH rows AS (SELECT event_id % 40 AS k, ts, ts + to_seconds(floor(value * 20)::BIGINT) AS drop_ts, (user_id % 30 + 1)::DOUBLE AS pu, event_id * 31 % 270 AS dz, value / 4 AS miles, value - 2 AS fare FROM events),
  times AS (SELECT k, CASE WHEN k IN (1, 2) THEN NULL WHEN k = 3 THEN ('2002' || substr(ts::VARCHAR, 5))::TIMESTAMP ELSE ts END AS p, CASE WHEN k = 3 THEN ('2002' || substr(drop_ts::VARCHAR, 5))::TIMESTAMP ELSE drop_ts END AS d, CASE k WHEN 4 THEN NULL WHEN 5 THEN NULL WHEN 6 THEN 1.5 ELSE pu END AS pu, dz, miles, fare FROM rows),
  twice AS (SELECT * FROM times UNION ALL SELECT * FROM times WHERE k = 7),
  judged AS (SELECT *, CASE WHEN k IN (1, 4, 5) THEN 'missing_required' WHEN k = 2 THEN 'bad_datetime' WHEN epoch_us(d) - epoch_us(p) NOT BETWEEN 30000000 AND 21600000000 THEN 'bad_duration'
    WHEN year(p) < 2010 THEN 'bad_date' WHEN pu NOT BETWEEN 1 AND 263 OR pu <> floor(pu) OR dz NOT BETWEEN 1 AND 263 THEN 'bad_zone' WHEN miles NOT BETWEEN 0 AND 100 OR fare < 0 THEN 'bad_fare_distance' END AS reason FROM twice),
  n AS (SELECT count(*) AS o FROM (SELECT DISTINCT p, d, pu, dz, miles, fare FROM judged WHERE reason IS NULL))
  SELECT count(*) AS input_rows, any_value(o) AS output_rows, count(*) - any_value(o) AS total_dropped, """ + ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS dropped_{r}" for r in clean.REASONS[:-1]) + ", count(*) FILTER (WHERE reason IS NULL) - any_value(o) AS dropped_duplicates FROM judged, n")
def dirty_report(spark, sf_dir):
    return clean.cleaning_report(dirty_trips(spark, sf_dir))


@query("SELECT event_id, user_id, value FROM events")
def load_trips(spark, sf_dir):
    return files.load_trips(spark, f"{sf_dir}/events.parquet", columns=["event_id", "user_id", "value", "none"])


@query(f"WITH {RAW} SELECT location_id, borough, zone, service_zone FROM zones")
def load_zones(spark, sf_dir):
    path = scratch(spark, "lookup")
    zones(spark, sf_dir).toDF("LocationID", "Borough", "Zone", "service_zone").write.option("header", True).csv(path)
    return files.load_zones(spark, path)


@query(f"WITH {RAW} SELECT * REPLACE (round(trip_distance, 6) AS trip_distance, round(fare_amount, 6) AS fare_amount, round(total_amount, 6) AS total_amount) FROM trips")
def stored_trips(spark, sf_dir):
    """Clean trips through the store, in a database of their own."""
    place = scratch(spark, "store")
    name = "demand_" + place.rpartition("-")[2]
    spark.sql(f"CREATE DATABASE {name} LOCATION '{place}'")
    before = spark.catalog.currentDatabase()
    spark.catalog.setCurrentDatabase(name)
    try:
        store.insert_clean_trips(trips(spark, sf_dir))
    finally:
        spark.catalog.setCurrentDatabase(before)
    return spark.table(f"{name}.clean_trips")


@query(f"WITH {_RES}, r AS (SELECT zone_id, round_even(estimate, 0)::BIGINT AS estimate FROM est) SELECT row_number() OVER (ORDER BY estimate DESC, zone_id) AS rank, zone_id, estimate FROM r ORDER BY estimate DESC, zone_id LIMIT 10")
def reservoir_topk(spark, sf_dir):
    return approximate.reservoir_top_k(_events(spark, sf_dir), 500, 10, "event_id")


@query(f"WITH {_CMS} SELECT * FROM cms")
def cms_merged(spark, sf_dir):
    ev = _events(spark, sf_dir)
    return approximate.cms_merge(*(approximate.cms_table(ev.filter(F.col("event_id") % 3 == k), width=64) for k in range(3)))


@query(f"WITH {_CMS.replace('count(*) AS w FROM ev', 'sum(event_id % 7)::BIGINT AS w FROM ev')} SELECT * FROM cms")
def cms_weighted(spark, sf_dir):
    ev = _events(spark, sf_dir).withColumn("w", F.col("event_id") % 7)
    return approximate.cms_table(ev, width=64, count_col="w")


@query("SELECT event_id, ((row_number() OVER (ORDER BY ts, event_id) - 1) // 1000)::BIGINT AS batch FROM events")
def replay_batches(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id")
    return approximate.batches(e, 1000, "ts", "event_id").select("event_id", "batch")


@query("SELECT (user_id % 30 + 1)::BIGINT AS zone_id, count(*) AS trips FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 12 HOUR GROUP BY ALL")
def stream_trailing(spark, sf_dir):
    return monitor.trailing_counts(monitor.event_stream(spark, sf_dir), timedelta(hours=12))


@query(f"WITH {DEMAND} SELECT zone_id, sum(trips)::BIGINT AS trips FROM demand GROUP BY ALL ORDER BY trips DESC, zone_id LIMIT 3")
def zone_totals(spark, sf_dir):
    return dashboard.zone_totals(demand(spark, sf_dir), 3)
