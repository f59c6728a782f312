"""Shared helpers: words, prefix sums, and tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import materialise, scratch

__all__ = ["WORD", "checked_broadcast", "materialise", "n_words", "running_totals", "scratch"]

#: Words are runs of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def running_totals(df: DataFrame, keys: list[str], bucket: str, order: list[str], values: dict[str, str]) -> DataFrame:
    """Exclusive running totals of integer columns, per keys, in (bucket, order).

    values maps an input column to the name of its total.  No task sees more
    than one bucket's rows or 1024 buckets' sums, however large a key is, so
    callers choose buckets of a few hundred rows.  keys must not be null.
    """
    inner = W.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = df.groupBy(*keys, bucket).agg(*(F.sum(v).alias(f"_sum_{v}") for v in values))
    sums = sums.withColumn("_super", F.floor(F.col(bucket) / F.lit(1024)))
    tops = sums.groupBy(*keys, "_super").agg(*(F.sum(f"_sum_{v}").alias(f"_top_{v}") for v in values))
    top_w = W.partitionBy(*keys).orderBy("_super").rowsBetween(W.unboundedPreceding, -1) if keys else W.orderBy("_super").rowsBetween(W.unboundedPreceding, -1)
    tops = tops.select(*keys, "_super", *(F.coalesce(F.sum(f"_top_{v}").over(top_w), F.lit(0)).alias(f"_top_{v}") for v in values))
    mid_w = W.partitionBy(*keys, "_super").orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    mids = sums.select(*keys, "_super", bucket, *(F.coalesce(F.sum(f"_sum_{v}").over(mid_w), F.lit(0)).alias(f"_mid_{v}") for v in values))
    base = mids.join(tops, [*keys, "_super"]).select(*keys, bucket, *((F.col(f"_mid_{v}") + F.col(f"_top_{v}")).alias(f"_base_{v}") for v in values))
    own = df.select("*", *(F.coalesce(F.sum(v).over(inner), F.lit(0)).alias(f"_own_{v}") for v in values))
    out = own.join(base, [*keys, bucket])
    return out.select(*(out[c] for c in df.columns), *((F.col(f"_own_{v}") + F.col(f"_base_{v}")).cast("long").alias(to) for v, to in values.items()))


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def checked_broadcast(df: DataFrame, rows: int, most: int = 10_000) -> DataFrame:
    """df, marked for broadcast if its known number of narrow rows is small."""
    return F.broadcast(df) if rows <= most else df
