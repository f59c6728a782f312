"""Approximate counts: a mergeable uniform sample and a Count-Min sketch.

The sample keeps the k rows of smallest seeded hash, which any partition can
compute alone; the sketch is a table of cells (row, col, n).  Hashes are MD5
prefixes, so results don't depend on partitions, and SQL can repeat them.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .hotspot import top_k


def seeded_hash(value: Column, seed: int | Column) -> Column:
    """32 bits of MD5 of "seed:value"."""
    s = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.conv(F.substring(F.md5(F.concat(s, F.lit(":"), value.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def reservoir_sample(events: DataFrame, k: int, id_col: str, seed: int = 42) -> DataFrame:
    """A uniform sample of k rows (all, if there are fewer)."""
    if k <= 0:
        raise ValueError("k must be positive")
    return events.orderBy(seeded_hash(F.col(id_col), seed), id_col).limit(k)


def reservoir_estimates(events: DataFrame, k: int, id_col: str, item_col: str = "zone_id", seed: int = 42) -> DataFrame:
    """item, estimate: sample counts scaled to the number of rows."""
    sample = reservoir_sample(events, k, id_col, seed)
    counts = sample.groupBy(item_col).agg(F.count("*").alias("c"))
    n, size = events.agg(F.count("*").alias("n")), sample.agg(F.count("*").alias("m"))
    scale = F.broadcast(n.crossJoin(size))  # one row
    return counts.crossJoin(scale).select(item_col, (F.col("c") * F.col("n") / F.col("m")).alias("estimate"))


def reservoir_top_k(events: DataFrame, k_sample: int, k: int, id_col: str, item_col: str = "zone_id", seed: int = 42) -> DataFrame:
    """Ranks by estimates rounded half to even."""
    rows = reservoir_estimates(events, k_sample, id_col, item_col, seed)
    return top_k(rows.select(item_col, F.bround("estimate").cast("long").alias("estimate")), k, item_col, "estimate")


def cms_shape(eps: float, delta: float) -> tuple[int, int]:
    """(width, depth) for an error of eps * n with probability 1 - delta."""
    if not (0 < eps < 1 and 0 < delta < 1):
        raise ValueError("eps and delta must lie between 0 and 1")
    return math.ceil(math.e / eps), math.ceil(math.log(1 / delta))


def _cells(df: DataFrame, item_col: str, width: int, depth: int, seed: int) -> DataFrame:
    if width <= 0 or depth <= 0:
        raise ValueError("width and depth must be positive")
    rows = df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(depth - 1))))
    key = F.concat(F.lit(f"{seed}-"), F.col("row").cast("string"))
    return rows.withColumn("col", seeded_hash(F.col(item_col), key) % width).withColumn("row", F.col("row").cast("long"))


def cms_table(events: DataFrame, item_col: str = "zone_id", width: int = 2048, depth: int = 5, seed: int = 42, count_col: str | None = None) -> DataFrame:
    """row, col, n: the cells that are not zero.  Items are counted (or count_col summed) before they are spread over rows."""
    items = events.groupBy(item_col).agg((F.sum(count_col) if count_col else F.count("*")).alias("w"))
    return _cells(items, item_col, width, depth, seed).groupBy("row", "col").agg(F.sum("w").alias("n"))


def cms_merge(*tables: DataFrame) -> DataFrame:
    """The sketch of all events of sketches with one shape and seed."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out.groupBy("row", "col").agg(F.sum("n").alias("n"))


def cms_estimates(table: DataFrame, items: DataFrame, item_col: str = "zone_id", width: int = 2048, depth: int = 5, seed: int = 42) -> DataFrame:
    """item, estimate (never below the count) of the distinct items."""
    asked = _cells(items.select(item_col).distinct(), item_col, width, depth, seed)
    cells = asked.join(table, ["row", "col"], "left").select(item_col, F.coalesce("n", F.lit(0)).alias("n"))
    return cells.groupBy(item_col).agg(F.min("n").alias("estimate"))


def cms_top_k(table: DataFrame, items: DataFrame, k: int, item_col: str = "zone_id", **shape) -> DataFrame:
    return top_k(cms_estimates(table, items, item_col, **shape), k, item_col, "estimate")


def cms_memory_bytes(width: int = 2048, depth: int = 5) -> int:
    return width * depth * 8


def compare_topk(exact: DataFrame, approx: DataFrame, item_col: str = "zone_id") -> DataFrame:
    """One row: overlap, jaccard and spearman of two ranked lists (rank, item).

    Spearman uses the positions in the full lists; 1 with one common item, 0
    with none.
    """
    e, a = exact.select(item_col, F.col("rank").alias("re")), approx.select(item_col, F.col("rank").alias("ra"))
    both = e.join(a, item_col, "full_outer")
    common = F.count_if(F.col("re").isNotNull() & F.col("ra").isNotNull())
    d2 = F.sum((F.col("re") - F.col("ra")) * (F.col("re") - F.col("ra")))
    rho = F.when(common == 0, 0.0).when(common == 1, 1.0).otherwise(1 - 6.0 * d2 / (common * (common * common - 1)))
    jaccard = F.when((F.count("re") == 0) | (F.count("ra") == 0), 0.0).otherwise(common / F.count("*"))
    return both.agg(common.alias("overlap"), F.coalesce(jaccard, F.lit(0.0)).alias("jaccard"), rho.alias("spearman"))


def exact_counts(events: DataFrame, item_col: str = "zone_id") -> DataFrame:
    return events.groupBy(item_col).agg(F.count("*").alias("trips"))


def batches(events: DataFrame, size: int, ts_col: str, *ties: str) -> DataFrame:
    """events with the number of the batch they fall in when replayed in time order."""
    if size <= 0:
        raise ValueError("batches need a positive size")
    if missing := [c for c in (ts_col, *ties) if c not in events.columns]:
        raise KeyError(missing[0])
    day = W.partitionBy("_day").orderBy(ts_col, *ties)
    rows = events.withColumn("_day", F.to_date(ts_col)).withColumn("_k", F.row_number().over(day))
    days = rows.groupBy("_day").agg(F.count("*").alias("_n"))
    before = days.select("_day", F.coalesce(F.sum("_n").over(W.orderBy("_day").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return rows.join(before, "_day").withColumn("batch", F.floor((F.col("_before") + F.col("_k") - 1) / size).cast("long")).drop("_day", "_k", "_before")
