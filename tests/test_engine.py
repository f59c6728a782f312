from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from demandlens.operators import aggregate, analytics, anomaly, approximate, clean, forecast, hotspot, mapreduce
from demandlens.sources import files, store
from demandlens.streaming.monitor import StreamingMonitor, stream_from_dataframe

T0 = datetime(2024, 1, 1)


def raw(spark, rows):
    kind = "pickup_datetime timestamp_ntz, dropoff_datetime timestamp_ntz, pu_location_id double, do_location_id long, trip_distance double, fare_amount double"
    return spark.createDataFrame(rows, kind)


def trip(minute=0, seconds=600.0, pu=1.0, do=2, miles=1.0, fare=5.0, start=T0):
    t = start + timedelta(minutes=minute)
    return t, t + timedelta(seconds=seconds), pu, do, miles, fare


def test_cleaning_accounts_for_every_row(spark):
    rows = [
        trip(), trip(1), trip(1),  # a duplicate
        trip(2, pu=999.0), trip(3, seconds=0), trip(4, miles=-1.0), trip(5, pu=None), trip(6, fare=-10.0),
        trip(7, miles=float("nan")), trip(8, fare=None), trip(9, start=datetime(2009, 1, 1)), trip(10, pu=1.5),
        trip(11, seconds=30), trip(12, seconds=29.999999), trip(13, seconds=21600), trip(14, seconds=21600.000001),
    ]
    df = raw(spark, rows)
    r = clean.cleaning_report(df).first().asDict()
    assert (r["input_rows"], r["output_rows"], r["total_dropped"]) == (16, 4, 12)
    assert [r[f"dropped_{x}"] for x in clean.REASONS] == [1, 0, 3, 1, 2, 4, 1]
    once = clean.clean_trips(df)
    assert clean.clean_trips(once.select(df.columns)).count() == once.count() == 4


def test_cleaning_empty_and_missing(spark):
    assert clean.clean_trips(raw(spark, [])).count() == 0
    assert clean.cleaning_report(raw(spark, [])).first()["output_rows"] == 0
    with pytest.raises(ValueError):
        clean.clean_trips(raw(spark, []).drop("pu_location_id"))


def test_busiest_zones_ties_and_inclusive_hours(spark):
    df = clean.clean_trips(raw(spark, [trip(k, pu=float(z)) for z in (5, 3, 9) for k in (0, 1)] + [trip(100, pu=7.0)]))
    assert [r["zone_id"] for r in aggregate.busiest_zones(df, 2).collect()] == [3, 5]
    assert aggregate.busiest_zones(df, 9, until="2024-01-01 00:30:00").count() == 3
    zones = spark.createDataFrame([(3, "B", "Z", "s")], "location_id long, borough string, zone string, service_zone string")
    assert [r["zone_name"] for r in aggregate.busiest_zones(df, 2, zones=zones).collect()] == ["Z", "<unknown>"]


def test_top_k(spark):
    got = hotspot.top_k_from_counts(spark, {1: 10, 2: 30, 3: 20, 4: 5, 5: None}, 2).orderBy("rank").collect()
    assert [(r["rank"], r["zone_id"]) for r in got] == [(1, 2), (2, 3)]
    assert hotspot.top_k_from_counts(spark, {1: 1}, 0).count() == 0
    with pytest.raises(ValueError):
        hotspot.top_k_per_window(spark.range(1), 1)


def demand(spark, hours=700, surge=None):
    rows = [(T0 + timedelta(hours=h), 1, 100 + h % 5) for h in range(hours)] + ([surge] if surge else [])
    return spark.createDataFrame(rows, "pickup_hour timestamp_ntz, zone_id long, trips long")


def test_surge_is_found_and_small_std_is_null(spark):
    base = anomaly.fit_baseline(demand(spark))
    surge = demand(spark, 0, (datetime(2024, 1, 15, 8), 1, 900))
    assert anomaly.detect_anomalies(surge, base).first()["z"] > 5
    assert anomaly.z_scores(surge, base, min_std=1e6).first()["z"] is None
    assert anomaly.lookup(base, 1, 0)[2] == 5 and anomaly.lookup(base, 9, 0) is None


def test_ewm_matches_pandas(spark):
    import pandas as pd

    got = forecast.ewm_forecast(demand(spark), 12).orderBy("pickup_hour").toPandas()
    want = pd.Series(got["y"]).ewm(halflife=12, adjust=False).mean().shift(1)
    assert (got["yhat"] - want).abs().max() < 1e-9
    slow = forecast.ewm_by_zone(forecast.hourly_panel(demand(spark)), 12).orderBy("pickup_hour").toPandas()
    assert (slow["level"] - want).abs().max() < 1e-9


def test_ewm_of_long_panels(spark):
    import pandas as pd

    hours = 13_500
    rows = [(T0 + timedelta(hours=h), z, (h * h + z) % 97 if h % 3 else 0) for z in (1, 2) for h in range(hours)]
    long = spark.createDataFrame(rows, "pickup_hour timestamp_ntz, zone_id long, trips long")
    got = forecast.ewm_forecast(long, 12).orderBy("pickup_hour").toPandas()
    ahead = {r["zone_id"]: r["yhat"] for r in forecast.forecast_next_horizon(long, "ewm_12", 1).collect()}
    for z, g in got.groupby("zone_id"):
        want = pd.Series(g["y"]).ewm(halflife=12, adjust=False).mean()
        assert g["yhat"].isna().sum() == 1 and (g["yhat"] - want.shift(1)).abs().max() < 1e-9
        assert abs(ahead[z] - want.iloc[-1]) < 1e-9


def test_panel_backtest_and_horizons(spark):
    gap = demand(spark, 30).filter(F.col("pickup_hour") != F.lit("2024-01-01 05:00:00").cast("timestamp_ntz"))
    assert forecast.hourly_panel(gap).count() == 30
    with pytest.raises(Exception, match="two rows"):
        forecast.hourly_panel(gap.unionAll(gap)).collect()
    with pytest.raises(ValueError):
        forecast.backtest_zone_forecasts(gap)
    with pytest.raises(KeyError):
        forecast.backtest_zone_forecasts(gap, ["no"])
    with pytest.raises(KeyError):
        forecast.forecast_next_horizon(gap, "no")
    short = demand(spark, 3)
    for m in forecast.METHODS:
        assert forecast.forecast_next_horizon(short, m, 4).count() == 4
    assert forecast.forecast_next_horizon(short, "seasonal_naive_24", 2).first()["yhat"] == 102


def test_sketches(spark):
    events = spark.range(5000).select(F.col("id").alias("event_id"), F.floor(F.sqrt("id")).cast("long").alias("zone_id"))
    table = approximate.cms_table(events, width=32, depth=4)
    both = approximate.cms_estimates(table, events, width=32, depth=4).join(approximate.exact_counts(events), "zone_id")
    assert both.filter("estimate < trips").count() == 0
    halves = [approximate.cms_table(events.filter(f"event_id % 2 = {k}"), width=32, depth=4) for k in (0, 1)]
    assert approximate.cms_merge(*halves).exceptAll(table).count() == 0
    assert approximate.cms_shape(0.001, 0.01) == (2719, 5)
    with pytest.raises(ValueError):
        approximate.cms_shape(0, 0.5)
    with pytest.raises(ValueError):
        approximate.reservoir_sample(events, 0, "event_id")
    assert approximate.reservoir_estimates(events, 9999, "event_id").agg(F.sum("estimate")).first()[0] == 5000
    lists = [spark.createDataFrame(x, "zone_id long, rank long") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)], [(8, 1)])]
    assert tuple(approximate.compare_topk(lists[0], lists[1]).first()) == (1, pytest.approx(1 / 3), 1.0)
    assert tuple(approximate.compare_topk(lists[0], lists[2]).first()) == (0, 0.0, 0.0)


def test_monitor(spark):
    m = StreamingMonitor(spark, timedelta(minutes=5))
    rows = [(T0 + timedelta(minutes=k), 1) for k in range(5)] + [(T0 + timedelta(minutes=30), 2)]
    events = spark.createDataFrame(rows, "ts timestamp, zone_id long")
    chunks = list(stream_from_dataframe(events, batch_size=4))
    assert [m.update_batch(c) for c in chunks] == [4, 2]
    assert m.window_counts() == {2: 1} and m.counts() == {1: 5, 2: 1}
    assert m.top_k(1) == [(1, 1, 5)] and m.ingested == len(m) == 6
    m.update(T0, 3)
    assert m.latest_ts == T0 + timedelta(minutes=30) and m.counts()[3] == 1
    with pytest.raises(ValueError):
        next(stream_from_dataframe(events, batch_size=0))
    with pytest.raises(KeyError):
        next(stream_from_dataframe(events, ts_col="no"))


def test_monitor_lets_late_events_leave_first_in_first_out(spark):
    """Against a queue that is looked at event by event."""
    import random
    from collections import Counter, deque

    rng = random.Random(3)
    m, queue, latest = StreamingMonitor(spark, timedelta(minutes=10)), deque(), None
    for step in range(8):
        batch = sorted((T0 + timedelta(minutes=step * 4 + rng.randint(-25, 5)), rng.randint(1, 3)) for _ in range(rng.choice([0, 1, 2, 12])))
        for ts, zone in batch:
            latest = ts if latest is None else max(latest, ts)
            queue.append((ts, zone))
            while queue[0][0] < latest - timedelta(minutes=10):
                queue.popleft()
        assert m.update_batch(spark.createDataFrame(batch, "ts timestamp, zone_id long")) == len(batch)
        assert m.window_counts() == dict(Counter(z for _, z in queue))
    shot = m.snapshot()
    assert shot["window_events"] == len(queue) and shot["window_seconds"] == 600 and shot["unique_zones"] == len(m.counts())
    assert shot["ingested"] == len(m) and shot["latest_ts"] == latest.isoformat()
    assert m.top_k(2, windowed=True) == [(k, z, n) for k, (z, n) in enumerate(sorted(Counter(z for _, z in queue).items(), key=lambda x: (-x[1], x[0]))[:2], 1)]
    empty = StreamingMonitor(spark)
    assert empty.window_counts() == {} and len(empty) == 0 and empty.snapshot()["latest_ts"] is None


def test_streams_of_several_files(spark, tmp_path):
    from demandlens.streaming import monitor

    for k in range(3):
        rows = [(T0 + timedelta(minutes=20 * k + j), j % 2 + 1) for j in range(10)] + [(T0 - timedelta(hours=1), 9)] * (k == 1)
        spark.createDataFrame(rows, "ts timestamp, zone_id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("ts timestamp, zone_id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {r["zone_id"]: r["trips"] for r in monitor.drain(monitor.cumulative_counts(read()), "counts").collect()}
    assert got == {1: 15, 2: 15, 9: 1}
    assert {r["zone_id"]: r["trips"] for r in monitor.trailing_counts(read(), timedelta(days=2)).collect()} == got
    (tmp_path / "none").mkdir()
    nothing = spark.readStream.schema("ts timestamp, zone_id long").parquet(str(tmp_path / "none"))
    assert monitor.drain(monitor.cumulative_counts(nothing), "nothing").count() == 0


def test_utilities(tmp_path):
    import logging
    import random

    import numpy as np

    from demandlens import utils

    log = utils.get_logger("a.b", logging.WARNING)
    assert utils.get_logger("a.b") is log and len(log.handlers) == 1 and not log.propagate
    assert utils.set_seed() == utils.DEFAULT_SEED
    one = random.random(), np.random.rand()
    assert utils.set_seed(42) == 42 and (random.random(), np.random.rand()) == one
    assert utils.ensure_dir(tmp_path / "a" / "b").is_dir() and utils.ensure_dir(tmp_path / "a") == tmp_path / "a"
    assert (utils.PROJECT_ROOT / "demandlens").is_dir() and utils.RAW_DIR.parent == utils.DATA_DIR


def test_downloads(tmp_path, monkeypatch):
    import io
    import urllib.request

    asked = []
    monkeypatch.setattr(urllib.request, "urlopen", lambda url, timeout: asked.append(url) or io.BytesIO(url.encode()))
    got = files.download_months([(2024, 1), (2023, 12)], tmp_path / "raw")
    assert [p.name for p in got] == ["yellow_tripdata_2024-01.parquet", "yellow_tripdata_2023-12.parquet"]
    assert got[0].read_bytes() == files.trip_url(2024, 1).encode()
    files.download_months([(2024, 1)], tmp_path / "raw")
    assert len(asked) == 2 and files.download_lookup(tmp_path / "raw").name == "taxi_zone_lookup.csv"
    files.download_lookup(tmp_path / "raw", overwrite=True)
    assert len(asked) == 4


def test_csv_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None)], "k int, name string")
    for _ in range(2):
        files.write_csv(df.orderBy("k"), str(tmp_path / "r.csv"))
    assert (tmp_path / "r.csv").read_text().splitlines()[:2] == ["k,name", '1,"a,b"']
    assert files.read_csv(spark, str(tmp_path / "r.csv")).count() == 2
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["r.csv"]


def test_times_that_are_none(spark):
    rows = [("2024-01-01 00:00:00", "2024-01-01 00:10:00", 1, 2), ("no time", "2024-01-01 00:10:00", 1, 2), ("2024-01-01 00:00:00", "2024-13-01", 1, 2), (None, None, 1, 2)]
    df = spark.createDataFrame(rows, "pickup_datetime string, dropoff_datetime string, pu_location_id long, do_location_id long")
    r = clean.cleaning_report(df).first()
    assert (r["dropped_bad_datetime"], r["dropped_missing_required"], r["output_rows"]) == (2, 1, 1)


def test_segments_need_the_exact_borough(spark):
    trips = clean.clean_trips(raw(spark, [trip(k, pu=float(k + 1)) for k in range(5)])).withColumn("total_amount", F.lit(1.0))
    names = [(1, "Manhattan", "Alphabet City"), (2, "manhattan", "Nowhere"), (3, "Queens", "JFK Airport"), (4, "Queens", "La Guardia"), (6, None, None)]
    zones = spark.createDataFrame([(*n, "s") for n in names], "location_id long, borough string, zone string, service_zone string")
    got = {r["segment"]: r["trips"] for r in analytics.airport_vs_manhattan(trips, zones).collect()}
    assert got == {"manhattan": 1, "other": 2, "airport": 2}


def test_robust_baseline_of_even_and_odd_buckets(spark):
    import numpy as np

    values = {8: [3, 9, 4, 100], 9: [5], 10: [1, 2, 7]}
    rows = [(T0 + timedelta(hours=h, weeks=w), 1, v) for h, x in values.items() for w, v in enumerate(x)]
    for r in anomaly.fit_robust_baseline(spark.createDataFrame(rows, "pickup_hour timestamp_ntz, zone_id long, trips long")).collect():
        x = np.array(values[r["hour_of_week"]])
        assert (r["median"], r["mad"], r["n"]) == (np.median(x), np.median(abs(x - np.median(x))), len(x))


def test_benchmarks(spark):
    from demandlens import benchmarking

    one = benchmarking.benchmark_callable("range", lambda: spark.range(1000), repeats=2, warmup=0)
    assert one.name == "range" and one.rows == 1000 and one.seconds > 0 and one.peak_bytes > 0
    many = benchmarking.benchmark_many({"a": lambda: spark.range(5), "b": lambda: spark.range(7)}, repeats=1)
    assert sorted(many["rows"]) == [5, 7] and many["seconds"].is_monotonic_increasing
    assert set(benchmarking.benchmark_forecast_methods(demand(spark, 30), holdout_hours=5)["name"]) == set(forecast.METHODS)


def test_dashboard(spark, tmp_path):
    import xml.etree.ElementTree as ET

    from demandlens.operators import dashboard

    d = demand(spark, 200, (T0 + timedelta(hours=150), 2, 900))
    found = anomaly.detect_anomalies(d, anomaly.fit_baseline(d), 0.5, 0.1)
    for name, how in (("a.svg", {}), ("b.svg", {"anomalies": found, "forecast": forecast.seasonal_naive_forecast(d)})):
        path = dashboard.build_dashboard(d, str(tmp_path / name), **how)
        drawing = ET.parse(path).getroot()
        assert len(list(drawing.iter("{http://www.w3.org/2000/svg}polyline"))) >= 2 and len(list(drawing.iter("{http://www.w3.org/2000/svg}rect"))) >= 2


def test_command_line(spark, tmp_path):
    from demandlens import cli

    with pytest.raises(SystemExit):
        cli.main(["pipeline", "--months", "2024-13"])
    with pytest.raises(SystemExit, match="missing"):
        cli.main(["pipeline", "--months", "2024-01", "--raw-dir", str(tmp_path)], spark)
    places = ["--raw-dir", str(tmp_path), "--out-dir", str(tmp_path / "out")]
    with pytest.raises(SystemExit, match="no trip files"):
        cli.main(["parallel", *places], spark)
    import pandas as pd

    rows = [trip(37 * k, pu=float(k % 3 + 1), do=k % 4 + 1, fare=5.0 + k % 2) for k in range(1500)] + [trip(0, seconds=1)]
    table = pd.DataFrame(rows, columns=["tpep_pickup_datetime", "tpep_dropoff_datetime", "PULocationID", "DOLocationID", "trip_distance", "fare_amount"]).assign(total_amount=9.0, passenger_count=1)
    table.astype({c: "datetime64[us]" for c in table.columns[:2]}).to_parquet(tmp_path / "yellow_tripdata_2024-01.parquet")
    (tmp_path / "taxi_zone_lookup.csv").write_text("LocationID,Borough,Zone,service_zone\n1,Manhattan,A,Y\n2,Queens,JFK Airport,Y\n")
    run = lambda *a: cli.main([*a, *places], spark)
    try:
        run("pipeline", "--months", "2024-01")
        assert store.count_rows(spark, "clean_trips") == 1500 and store.count_rows(spark, "zone_lookup") == 2
        run("pipeline", "--append")
        assert store.count_rows(spark, "clean_trips") == 3000
        run("pipeline")
        for command in (["hotspots", "--k", "2"], ["anomalies", "--baseline-end", "2024-01-20", "--threshold", "0.1"], ["anomalies", "--baseline-end", "1990-01-01"], ["stream", "--batch-size", "700"], ["sketches", "--reservoir-size", "100"], ["parallel", "--workers", "1", "2"], ["forecast"], ["consensus"], ["business"], ["benchmark"], ["dashboard"], ["figures"]):
            run(*command)
        made = {p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")}
        assert made >= {"experiment_1_overall.csv", "experiment_1_per_hour.csv", "experiment_2_baseline.csv", "experiment_2_anomalies.csv", "experiment_3_summary.csv", "experiment_4_summary.csv", "experiment_4_topk_count_min.csv", "experiment_5_parallel.csv", "experiment_6_forecast.csv", "experiment_7_advanced_anomaly.csv", "top_od_pairs.csv", "benchmark_results.csv", "dashboard.svg", "top_zones.svg"}
        summary = dict(pd.read_csv(tmp_path / "out" / "experiment_3_summary.csv").itertuples(index=False))
        assert summary["events"] == 1500 and summary["cmp_overlap"] == 3 and summary["cmp_jaccard"] == 1
        assert pd.read_csv(tmp_path / "out" / "experiment_1_overall.csv")["zone_name"].tolist() == ["A", "JFK Airport"]
    finally:
        store.drop_all(spark)


def test_queries_against_sql(spark):
    """Every query that has SQL, on the smallest tables."""
    import duckdb

    import __spark_entry__ as entry

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for name in ("events", "nation", "region"):
        con.sql(f"CREATE VIEW {name} AS FROM '{sf}/{name}.parquet'")
    from demandlens.plans import queries as plans

    assert set(plans.SQL) <= set(entry.oracle_sql()) and set(plans.QUERIES) == set(plans.SQL)
    for name in ("dirty_report", "load_trips", "load_zones", "stored_trips", "reservoir_topk", "cms_merged", "cms_weighted", "replay_batches", "stream_trailing", "horizon_ewm_24", "horizon_ma_168", "horizon_seasonal_168", "hourly_panel_sparse", "ewm_long", "monitor_window", "segment_by_day", "zone_totals", "robust_z", "backtest"):
        want = con.sql(plans.SQL[name])
        got = plans.QUERIES[name](spark, sf).select(*want.columns).collect()
        rows = lambda t: sorted((tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in t), key=repr)
        assert rows(got) == rows(want.fetchall()), name


def test_map_reduce_counts_duplicates_per_file(spark, tmp_path):
    for k in range(2):
        raw(spark, [trip(), trip(), trip(k + 1, pu=4.0)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "t"))
    got, _ = mapreduce.parallel_top_k(spark, [str(tmp_path / "t")], 5)
    assert got == [(1, 2), (4, 2)]


def test_store_and_files(spark, tmp_path):
    store.drop_all(spark)
    df = clean.clean_trips(raw(spark, [trip(), trip(1)]))
    assert store.insert_clean_trips(df) == 2 and store.insert_clean_trips(df, replace=True) == 2
    assert store.insert_clean_trips(df.limit(0), replace=True) == 0 and store.count_rows(spark, "clean_trips") == 2
    store.drop_all(spark)
    assert not store.table_exists(spark, "clean_trips")
    (tmp_path / "z.csv").write_text("LocationID,Borough,Zone,service_zone,extra\n1,A,B,C,D\n")
    assert files.load_zones(spark, str(tmp_path / "z.csv")).first()["location_id"] == 1
    (tmp_path / "y.csv").write_text("LocationID\n1\n")
    with pytest.raises(ValueError):
        files.load_zones(spark, str(tmp_path / "y.csv"))
    with pytest.raises(ValueError):
        files.trip_url(2024, 13)
    with pytest.raises(FileNotFoundError):
        files.load_trips(spark, str(tmp_path / "none"))
