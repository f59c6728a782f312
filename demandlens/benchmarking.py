"""Timing of operators by a forced action."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .operators import anomaly, forecast
from .utils import get_logger

log = get_logger(__name__)


@dataclass(frozen=True)
class Timing:
    """Best time of the repeats, the driver JVM's peak heap in that run, and the rows that it made."""

    name: str
    seconds: float
    peak_bytes: int
    rows: int


def _heap_pools(spark: SparkSession) -> list:
    jvm = spark.sparkContext._jvm
    pools = jvm.java.lang.management.ManagementFactory.getMemoryPoolMXBeans()
    return [p for p in pools if p.getType().name() == "HEAP"]


def benchmark_callable(name: str, make: Callable[[], DataFrame], repeats: int = 3, warmup: int = 1) -> Timing:
    """Times computing all columns of what make returns, planning included.

    Peak memory is that of the driver's JVM, in local mode all there is.
    """
    best: Timing | None = None
    for k in range(max(0, warmup) + max(1, repeats)):
        pools = _heap_pools(SparkSession.active())
        for pool in pools:
            pool.resetPeakUsage()
        seen = Observation()
        began = time.perf_counter()
        make().observe(seen, F.count(F.lit(1)).alias("rows")).write.format("noop").mode("overwrite").save()
        seconds = time.perf_counter() - began
        if k >= max(0, warmup) and (best is None or seconds < best.seconds):
            best = Timing(name, seconds, sum(p.getPeakUsage().getUsed() for p in pools), seen.get["rows"])
    return best


def benchmark_many(cases: dict[str, Callable[[], DataFrame]], repeats: int = 3, warmup: int = 1) -> pd.DataFrame:
    """name, seconds, peak_bytes, rows of every case, the fastest first."""
    made = [benchmark_callable(n, f, repeats, warmup) for n, f in cases.items()]
    return pd.DataFrame(made, columns=["name", "seconds", "peak_bytes", "rows"]).sort_values("seconds", ignore_index=True)


def benchmark_anomaly_methods(demand: DataFrame, repeats: int = 3) -> pd.DataFrame:
    out = benchmark_many({
        "zscore_detect": lambda: anomaly.detect_anomalies(demand, anomaly.fit_baseline(demand)),
        "robust_zscore": lambda: anomaly.robust_z_scores(demand),
        "ewma_residual": lambda: anomaly.ewma_residual_scores(demand),
        "consensus": lambda: anomaly.detect_consensus_anomalies(demand),
    }, repeats)
    log.info("timed %d anomaly methods", len(out))
    return out


def benchmark_forecast_methods(demand: DataFrame, holdout_hours: int = 168) -> pd.DataFrame:
    """Each method's backtest, once."""
    return benchmark_many({m: lambda m=m: forecast.backtest_zone_forecasts(demand, [m], holdout_hours) for m in forecast.METHODS}, repeats=1)


def benchmark_forecast_and_anomaly(demand: DataFrame) -> pd.DataFrame:
    return pd.concat([benchmark_anomaly_methods(demand), benchmark_forecast_methods(demand)], ignore_index=True)
