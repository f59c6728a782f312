"""Per-file counting of many trip files in one job."""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.files import load_trips
from .clean import clean_trips
from .hotspot import top_k


def map_zone_counts(trips: DataFrame) -> DataFrame:
    """file, zone_id, trips: valid trips of each file; duplicates count within a file only."""
    rows = clean_trips(trips.withColumn("file", F.input_file_name()))
    return rows.groupBy("file", F.col("pu_location_id").alias("zone_id")).agg(F.count("*").alias("trips"))


def reduce_top_k(partials: DataFrame, k: int = 10) -> DataFrame:
    return top_k(partials.groupBy("zone_id").agg(F.sum("trips").alias("trips")), k)


def parallel_top_k(spark: SparkSession, paths: list[str], k: int = 10) -> tuple[list[tuple[int, int]], float]:
    """((zone, trips) of the k busiest zones over all files, seconds)."""
    began = time.perf_counter()
    rows = reduce_top_k(map_zone_counts(load_trips(spark, *paths)), k).orderBy("rank").collect()
    return [(r["zone_id"], r["trips"]) for r in rows], time.perf_counter() - began


def benchmark(spark: SparkSession, paths: list[str], k: int = 10, worker_counts: tuple[int, ...] = (1, 2, 4)) -> pd.DataFrame:
    """workers, wall_sec, speedup (against the first): the files as jobs of their own, so many at a time.

    What a job hands back has one row a zone.
    """
    out = []
    for n in worker_counts:
        began = time.perf_counter()
        with ThreadPoolExecutor(max(1, n)) as pool:
            parts = list(pool.map(lambda path: map_zone_counts(load_trips(spark, path)).collect(), paths))
        reduce_top_k(spark.createDataFrame([r for p in parts for r in p], "file string, zone_id long, trips long"), k).collect()
        out.append((n, round(time.perf_counter() - began, 3)))
    return pd.DataFrame([(n, s, round(out[0][1] / s, 2) if s else None) for n, s in out], columns=["workers", "wall_sec", "speedup"])
