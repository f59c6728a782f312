"""The command line: python -m demandlens COMMAND.

`download` fetches trip files, `pipeline` cleans them into the store; the
other commands report on the store or the files as CSV or figures.
"""

from __future__ import annotations

import argparse
import calendar
import re
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmarking, charts
from .operators import aggregate, analytics, anomaly, approximate, clean, dashboard, forecast, hotspot, mapreduce
from .session import connect
from .sources import files, store
from .storage import materialise
from .streaming.monitor import StreamingMonitor, stream_from_dataframe
from .utils import RAW_DIR, REPORTS_DIR, STORE_DIR, ensure_dir, get_logger

log = get_logger("demandlens")


def month(text: str) -> tuple[int, int]:
    if not re.fullmatch(r"\d{4}-(0[1-9]|1[0-2])", text):
        raise argparse.ArgumentTypeError(f"{text!r} is not of the form YYYY-MM")
    return int(text[:4]), int(text[5:])


def trip_file(folder: str, when: tuple[int, int]) -> str:
    path = Path(folder) / files.trip_url(*when).rpartition("/")[2]
    if not path.exists():
        raise SystemExit(f"{path} is missing; run download first")
    return str(path)


def _report(df: DataFrame, args: argparse.Namespace, name: str) -> None:
    log.info("%s", files.write_csv(df, str(ensure_dir(args.out_dir) / f"{name}.csv")))


def _demand(spark: SparkSession) -> DataFrame:
    return aggregate.zone_hour_demand(spark.table("clean_trips"))


def download(args: argparse.Namespace) -> None:
    for path in [*files.download_months(args.months, args.raw_dir, args.overwrite), files.download_lookup(args.raw_dir, args.overwrite)]:
        log.info("%s (%d MB)", path, path.stat().st_size >> 20)


def pipeline(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Cleans the months' files into the store; a summary with an account of every month."""
    paths = {m: trip_file(args.raw_dir, m) for m in args.months}
    if not args.append:
        store.drop_all(spark)
    store.init_schema(spark)
    lookup = Path(args.raw_dir) / files.LOOKUP_URL.rpartition("/")[2]
    if lookup.exists():
        log.info("%d zones", store.insert_zone_lookup(files.load_zones(spark, str(lookup))))
    else:
        log.warning("no zone lookup at %s", lookup)
    months = []
    for (y, m), path in paths.items():
        raw = files.load_trips(spark, path)
        store.insert_clean_trips(clean.clean_trips(raw))
        months.append({"month": f"{y}-{m:02d}"} | clean.cleaning_report(raw).first().asDict())
    summary = {k: sum(r[k] for r in months) for k in ("input_rows", "output_rows")}
    summary |= {"months": months, "clean_trips": store.count_rows(spark, "clean_trips")}
    for k, v in summary.items():
        log.info("%s: %s", k, v)
    return summary


def hotspots(spark: SparkSession, args: argparse.Namespace) -> None:
    zones = spark.table("zone_lookup")
    _report(aggregate.busiest_zones(spark.table("clean_trips"), args.k, zones=zones), args, "experiment_1_overall")
    _report(hotspot.top_k_per_window(_demand(spark), args.k).orderBy("pickup_hour", "rank"), args, "experiment_1_per_hour")


def anomalies(spark: SparkSession, args: argparse.Namespace) -> None:
    cut = F.lit(args.baseline_end).cast("timestamp_ntz")
    before, after = (_demand(spark).filter(c) for c in (F.col("pickup_hour") < cut, F.col("pickup_hour") >= cut))
    if before.isEmpty() or after.isEmpty():
        log.warning("demand is needed before and after %s", args.baseline_end)
        return
    base = anomaly.fit_baseline(before)
    _report(base.orderBy("zone_id", "hour_of_week"), args, "experiment_2_baseline")
    _report(anomaly.detect_anomalies(after, base, args.threshold), args, "experiment_2_anomalies")


def stream(spark: SparkSession, args: argparse.Namespace) -> None:
    """Replays a month through the monitor, against the same top k from the store."""
    trips = clean.clean_trips(files.load_trips(spark, trip_file(args.raw_dir, args.month)))
    monitor, took = StreamingMonitor(spark), []
    began = time.perf_counter()
    for batch in stream_from_dataframe(trips, "pickup_datetime", "pu_location_id", args.batch_size):
        at = time.perf_counter()
        monitor.update_batch(batch)
        took.append(time.perf_counter() - at)
    streamed = time.perf_counter() - began
    y, m = args.month
    bounds = f"{y}-{m:02d}-01 00:00:00", f"{y}-{m:02d}-{calendar.monthrange(y, m)[1]:02d} 23:59:59"
    began = time.perf_counter()
    best = aggregate.busiest_zones(spark.table("clean_trips"), args.k, *bounds).collect()
    batch_seconds = time.perf_counter() - began
    ranked = lambda rows: spark.createDataFrame(rows, "rank long, zone_id long, trips long")
    alike = approximate.compare_topk(ranked([(k, r["zone_id"], r["trips"]) for k, r in enumerate(best, 1)]), ranked(monitor.top_k(args.k))).first()
    rows = [("stream_total_sec", streamed), ("batch_total_sec", batch_seconds), ("events", float(len(monitor)))]
    rows += [("mean_batch_latency_ms", 1000 * sum(took) / max(1, len(took))), ("cmp_overlap", float(alike["overlap"])), ("cmp_jaccard", alike["jaccard"]), ("cmp_rank_correlation", alike["spearman"])]
    _report(spark.createDataFrame(rows, "metric string, value double"), args, "experiment_3_summary")


def sketches(spark: SparkSession, args: argparse.Namespace) -> None:
    """Exact counts, a sample and a sketch of one month's zones."""
    trips = clean.clean_trips(files.load_trips(spark, trip_file(args.raw_dir, args.month)))
    events = materialise(trips.select(F.col("pu_location_id").alias("zone_id"), F.monotonically_increasing_id().alias("event_id")), "events")
    shape = {"width": args.cms_width, "depth": args.cms_depth}
    make: dict[str, Callable[[], DataFrame]] = {
        "exact": lambda: hotspot.top_k(approximate.exact_counts(events), args.k),
        "reservoir": lambda: approximate.reservoir_top_k(events, args.reservoir_size, args.k, "event_id"),
        "count_min": lambda: approximate.cms_top_k(approximate.cms_table(events, **shape), events, args.k, **shape),
    }
    zones = events.select("zone_id").distinct().count()
    # Two numbers a zone, the sample's two columns, the sketch's cells.
    memory = {"exact": 16 * zones, "reservoir": 16 * args.reservoir_size, "count_min": approximate.cms_memory_bytes(**shape)}
    rows, exact = [], None
    for name, f in make.items():
        began = time.perf_counter()
        got = spark.createDataFrame(f().collect(), f().schema)
        seconds = time.perf_counter() - began
        exact = exact or got
        rows.append((name, seconds, memory[name], *approximate.compare_topk(exact, got).first()))
        _report(got.orderBy("rank"), args, f"experiment_4_topk_{name}")
    _report(spark.createDataFrame(rows, "method string, runtime_sec double, memory_bytes long, overlap_with_exact long, jaccard double, rank_corr double"), args, "experiment_4_summary")


def parallel(spark: SparkSession, args: argparse.Namespace) -> None:
    paths = sorted(map(str, Path(args.raw_dir).glob("*_tripdata_*.parquet")))
    if not paths:
        raise SystemExit(f"no trip files in {args.raw_dir}; run download first")
    made = mapreduce.benchmark(spark, paths, args.k, tuple(args.workers))
    _report(spark.createDataFrame(made), args, "experiment_5_parallel")


def forecasts(spark: SparkSession, args: argparse.Namespace) -> None:
    _report(forecast.backtest_zone_forecasts(_demand(spark), holdout_hours=args.holdout_hours), args, "experiment_6_forecast")


def consensus(spark: SparkSession, args: argparse.Namespace) -> None:
    _report(anomaly.detect_consensus_anomalies(_demand(spark)), args, "experiment_7_advanced_anomaly")


def business(spark: SparkSession, args: argparse.Namespace) -> None:
    trips, zones = spark.table("clean_trips"), spark.table("zone_lookup")
    _report(analytics.weekday_weekend_demand(trips).orderBy("day_type", "hour"), args, "weekday_weekend_demand")
    _report(analytics.top_origin_destination_pairs(trips), args, "top_od_pairs")
    _report(analytics.airport_vs_manhattan(trips, zones).orderBy("segment", "day"), args, "airport_vs_manhattan")


def benchmark(spark: SparkSession, args: argparse.Namespace) -> None:
    demand = materialise(_demand(spark), "demand")
    _report(spark.createDataFrame(benchmarking.benchmark_forecast_and_anomaly(demand)), args, "benchmark_results")


def show(spark: SparkSession, args: argparse.Namespace) -> None:
    demand = materialise(_demand(spark), "demand")
    dashboard.build_dashboard(demand, str(ensure_dir(args.out_dir) / f"dashboard.{args.format}"))


#: Figure: its report, label column, value columns, and whether it has bars.
FIGURES = {
    "top_zones": ("experiment_1_overall", "zone_name", ["trips"], True),
    "stream_vs_batch": ("experiment_3_summary", "metric", ["value"], True),
    "exact_vs_approx": ("experiment_4_summary", "method", ["runtime_sec", "memory_bytes"], True),
    "parallel_speedup": ("experiment_5_parallel", "workers", ["wall_sec", "speedup"], False),
    "forecast_errors": ("experiment_6_forecast", "method", ["mae", "rmse"], True),
    "weekday_weekend": ("weekday_weekend_demand", "hour", ["trips"], True),
}


def figures(spark: SparkSession, args: argparse.Namespace) -> None:
    """Draws each report that is there."""
    for name, (report, label, columns, bars) in FIGURES.items():
        path = Path(args.out_dir) / f"{report}.csv"
        if not path.exists():
            log.warning("no %s, so no figure of it", path)
            continue
        rows = files.read_csv(spark, str(path)).select(label, *columns)
        panels = [dashboard.panel(f"{name}: {c}", rows.select(label, c), label, bars, sort=False) for c in columns]
        log.info("%s", charts.draw(panels, Path(args.out_dir) / f"{name}.{args.format}"))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="demandlens", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, run: Callable, *options: tuple[str, dict]) -> None:
        p = commands.add_parser(name, help=(run.__doc__ or "").strip() or None)
        p.set_defaults(run=run)
        p.add_argument("--raw-dir", default=str(RAW_DIR), help="folder of the downloaded files")
        p.add_argument("--store", default=str(STORE_DIR), help="folder of the stored tables")
        p.add_argument("--out-dir", default=str(REPORTS_DIR), help="folder of the reports")
        for flag, how in options:
            p.add_argument(flag, **how)

    k = ("--k", {"type": int, "default": 10})
    one = ("--month", {"type": month, "default": (2024, 1), "metavar": "YYYY-MM"})
    form = ("--format", {"choices": ("svg", "png"), "default": "svg"})
    months = {"type": month, "nargs": "+", "metavar": "YYYY-MM"}
    add("download", download, ("--months", months | {"default": [(2023, 11), (2023, 12), (2024, 1)]}), ("--overwrite", {"action": "store_true"}))
    add("pipeline", pipeline, ("--months", months | {"default": [(2024, 1)]}), ("--append", {"action": "store_true"}))
    add("hotspots", hotspots, k)
    add("anomalies", anomalies, ("--baseline-end", {"default": "2024-01-01"}), ("--threshold", {"type": float, "default": 3.0}))
    add("stream", stream, one, k, ("--batch-size", {"type": int, "default": 10_000}))
    add("sketches", sketches, one, k, ("--reservoir-size", {"type": int, "default": 100_000}), ("--cms-width", {"type": int, "default": 2048}), ("--cms-depth", {"type": int, "default": 5}))
    add("parallel", parallel, k, ("--workers", {"type": int, "nargs": "+", "default": [1, 2, 4, 8]}))
    add("forecast", forecasts, ("--holdout-hours", {"type": int, "default": 168}))
    add("consensus", consensus)
    add("business", business)
    add("benchmark", benchmark)
    add("dashboard", show, form)
    add("figures", figures, form)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "download":
        args.run(args)
    else:
        args.run(spark or connect(store=args.store), args)
    return 0
