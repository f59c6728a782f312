"""Minimax contiguous sharding of atomic groups, in SQL functions.

Documents of equal text form a group.  Groups are ordered by the hash of their
text and gathered in 2**CELL_BITS cells by its top bits; a cell never splits a
group.  Cells are the units that are cut: a table of at most 65 536 sizes
however large the corpus, on which the driver binary-searches the smallest
capacity for which a greedy sweep needs no more than n shards, and cuts there.
At n shards the result exceeds the best cut of single groups by at most one
cell, 1/65 536 of the corpus unless a group is larger.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELL_BITS = 16


def cuts(sizes: list[int], capacity: int) -> list[int]:
    """Greedy cuts: positions at which a new shard begins, the first left out."""
    out, ends = [], list(accumulate(sizes))
    begin = 0
    while True:
        at = bisect_right(ends, begin + capacity)
        if at >= len(sizes):
            return out
        begin = ends[at - 1]
        out.append(at)


def smallest_capacity(sizes: list[int], shards: int) -> int:
    """Least capacity for which contiguous greedy filling needs at most `shards` shards."""
    low, high = max(max(sizes, default=0), -(-sum(sizes) // shards)), max(sum(sizes), 1)
    while low < high:
        mid = (low + high) // 2
        if len(cuts(sizes, mid)) < shards:
            high = mid
        else:
            low = mid + 1
    return low


def assign(sizes: list[int], shards: int) -> list[int]:
    """Shard of each unit.

    No shard exceeds the smallest capacity; within it, each cut is put as near
    to an equal share of what is left as the shards after it allow.
    """
    capacity, ends = smallest_capacity(sizes, shards), list(accumulate(sizes))
    out: list[int] = []
    begin = 0
    for left in range(shards, 0, -1):
        done = ends[begin - 1] if begin else 0
        most = bisect_right(ends, done + capacity)
        near = bisect_right(ends, done + (sum(sizes) - done) // left)
        if near < most and abs(ends[near] - done - (ends[-1] - done) / left) < abs((ends[near - 1] if near else 0) - done - (ends[-1] - done) / left):
            near += 1
        near = min(max(near, begin), most)
        while left > 1 and near < most and len(cuts(sizes[near:], capacity)) >= left - 1:
            near += 1
        end = near if left > 1 else len(sizes)
        out += [shards - left] * (end - begin)
        begin = end
    return out


def shard_documents(docs: DataFrame, shards: int = 40, overhead: int = 16, per: int = 512) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row.

    size is the text's UTF-8 bytes plus `overhead`.  A null text counts as an
    empty one.  slot numbers a shard's rows from 0, in order of cell, a hash
    bucket of the id within large cells, and id.  Rows alike in all columns
    take slots in any order.  With fewer cells than shards some stay empty.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - CELL_BITS).alias("cell"),
    )
    cells = rows.groupBy("cell").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("cell").collect()
    shard = assign([c["size"] for c in cells], shards)
    plan, before, at = [], 0, -1
    for c, s in zip(cells, shard, strict=True):
        before, at = (before, at) if s == at else (0, s)
        plan.append((c["cell"], s, before, max(1, c["n"] // per)))
        before += c["n"]
    # At most 2**CELL_BITS rows, so a broadcast is safe at any scale.
    table = F.broadcast(docs.sparkSession.createDataFrame(plan, "cell long, shard int, before long, parts long"))
    rows = rows.join(table, "cell").withColumn("part", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("parts")))
    counts = rows.groupBy("cell", "part").agg(F.count("*").alias("n"))
    base = counts.select("cell", "part", F.coalesce(F.sum("n").over(W.partitionBy("cell").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rows = rows.withColumn("k", F.row_number().over(W.partitionBy("cell", "part").orderBy("doc_id", "text_crc32")))
    out = rows.join(base, ["cell", "part"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("base") + F.col("k") - 1).cast("long").alias("slot"))
