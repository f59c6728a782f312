"""Column functions shared by the operators."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def floor_hour(ts: Column) -> Column:
    return F.date_trunc("hour", ts).cast("timestamp_ntz")


def hour_of_week(ts: Column) -> Column:
    """0 for Monday 00:00 to 167 for Sunday 23:00."""
    return (F.weekday(ts) * 24 + F.hour(ts)).cast("long")


def seconds_between(start: Column, end: Column) -> Column:
    """Exact fractional seconds between two zoneless times."""
    micros = lambda c: F.unix_micros(F.to_timestamp(c))
    return (micros(end) - micros(start)) / F.lit(1_000_000)


def at_least(x: Column, low: float) -> Column:
    """x >= low, false for null and NaN (NaN compares greater than all numbers)."""
    return F.coalesce(~F.isnan(x) & (x >= low), F.lit(False))


def in_range(x: Column, low: float, high: float) -> Column:
    return F.coalesce(x.between(low, high), F.lit(False))


#: Half-lives in a block of ewm: weights in it stay below 2 ** BLOCK, rows two blocks back weigh less than 2 ** -BLOCK.
BLOCK = 500


def ewm(value: Column, position: Column, by: str, halflife: float, current: bool = False) -> Column:
    """Recursive exponential mean of the rows before each one (with it, if current), per `by`.

    position counts from 0.  The running sum begins anew in each block, and the
    block before is added whole, so that no weight overflows at any length.
    """
    q = F.lit(0.5 ** (1.0 / halflife))
    size = math.ceil(BLOCK * halflife)
    block = F.floor(position / size)
    place = position - block * size
    term = F.when(position == 0, F.lit(1.0)).otherwise(1 - q) * F.pow(q, -place) * value
    here = F.sum(term).over(W.partitionBy(by, block).orderBy(position).rowsBetween(W.unboundedPreceding, 0 if current else -1))
    before = F.sum(term).over(W.partitionBy(by).orderBy(block).rangeBetween(-1, -1))
    at = place if current else place - 1
    level = F.pow(q, at) * F.coalesce(here, F.lit(0.0)) + F.pow(q, at + size) * F.coalesce(before, F.lit(0.0))
    return level if current else F.when(position > 0, level)
