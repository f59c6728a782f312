"""Top-k reports."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_k(counts: DataFrame, k: int, zone_col: str = "zone_id", count_col: str = "trips") -> DataFrame:
    """rank, zone, count of the k largest counts, ties to the smaller zone; null counts are left out, k <= 0 gives none.

    Repeated zones are not merged.  Only the k rows that the limit leaves are numbered.
    """
    best = counts.filter(F.col(count_col).isNotNull()).select(zone_col, count_col).orderBy(F.desc(count_col), zone_col).limit(max(0, k))
    return best.select(F.row_number().over(W.orderBy(F.desc(count_col), zone_col)).cast("long").alias("rank"), zone_col, count_col)


def top_k_from_counts(spark: SparkSession, counts: Mapping[int, int | None], k: int) -> DataFrame:
    return top_k(spark.createDataFrame(list(counts.items()), "zone_id long, trips long"), k)


def top_k_per_window(demand: DataFrame, k: int, window_col: str = "pickup_hour", zone_col: str = "zone_id", count_col: str = "trips") -> DataFrame:
    """window, rank, zone, count of each window's k largest counts."""
    if missing := [c for c in (window_col, zone_col, count_col) if c not in demand.columns]:
        raise ValueError(f"demand lacks {', '.join(missing)}")
    rank = F.row_number().over(W.partitionBy(window_col).orderBy(F.desc(count_col), zone_col))
    return demand.filter(F.col(count_col).isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= k).select(window_col, F.col("rank").cast("long").alias("rank"), zone_col, count_col)
