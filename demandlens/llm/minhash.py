"""Near-duplicate classes by b-bit MinHash, confirmed on full shingle sets.

A text's set holds its distinct runs of `shingle` words (ASCII-lower-cased; a
shorter text is one shingle).  Equal sets are folded into one class first, so
groups of copies cost one row each later on.  Minima under BANDS * ROWS hash
functions make band keys; of each minimum the low two bits are packed into
longs.  Classes have ids of their own, so documents without an id, and texts
that share one, are told apart; document ids come in again at the end.  Work
on the classes:

1. Every band bucket of two classes or more elects a hub, its smallest id;
   (class, hub) edges, without regard to similarity, join into coarse blocks.
   Classes that share a bucket share the hub, hence the block.
2. Each class is compared with the HUBS hubs that it shares most bands with:
   by the collision-corrected estimate from the bit counts, and on full sets
   where that is near enough.  Links found make provisional components.  In a group of near
   copies nearly all meet here, at a cost linear in the group.
3. Within a block, classes outside its main component meet those of any other
   component with which they share one of their rarest shingles, early enough
   for a link (`_apart`), again by the estimate and then on full sets.  So no link is lost
   to step 2's choice of hubs, nothing is capped, and members of one component
   are never paired.

A pair of similarity exactly 0.8 shares no band with probability 3e-7, and its
estimate is too low (by six deviations) with less.  Lower similarities than
0.78 or so would need more bands and are refused.  Joins whose one side has
many rows for a hub carry single rows of the other side, and skewed partitions
of them are split by adaptive execution.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

BANDS, ROWS = 64, 7
PERMS = BANDS * ROWS
#: Two bits of each minimum, 32 to a long.
LANES = PERMS // 32
HUBS = 6
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(1, 2**32, PERMS, dtype=np.uint64).astype(np.uint32) | np.uint32(1))[None, :]
_B = _rng.integers(0, 2**32, PERMS, dtype=np.uint64).astype(np.uint32)[None, :]
_MIX = _rng.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WIDTH = np.arange(64, dtype=np.uint64) * _C1
_SHIFTS = (2 * np.arange(32)).astype(np.uint64)


def _scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, shingle: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles of a whole text."""
    words = text.encode("utf-8", "replace").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    width = min(shingle, len(words))
    out = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        out = _scramble(out * _C2 + h[k : len(h) - width + 1 + k] + _WIDTH[width])
    out.sort()
    return out[np.append(True, out[1:] != out[:-1])]


def signature(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (int64) and packed low bits (int64) of a non-empty set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(PERMS, np.uint32(0xFFFFFFFF))
    for k in range(0, len(x), 512):
        part = x[k : k + 512, None] * _A
        part += _B
        np.minimum(least, part.min(0), out=least)
    wide = least.astype(np.uint64)
    keys = _scramble((wide.reshape(BANDS, ROWS) * _MIX).sum(1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _C1)
    bits = ((wide.reshape(LANES, 32) & np.uint64(3)) << _SHIFTS).sum(1, dtype=np.uint64)
    return keys.view(np.int64), bits.view(np.int64)


SIGNED = "doc_id long, age long, text_hash long, n_shingles long, low long, high long, keys array<long>, bits array<long>"


def _signed(shingle: int):
    def run(batches):
        for batch in batches:
            n, low, high, keys, bits = [], [], [], [], []
            for text in batch.column(3):
                s = shingle_set(text.as_py(), shingle)
                n.append(len(s))
                if len(s):
                    k, b = signature(s)
                    both = xxhash.xxh3_128_intdigest(s.tobytes())
                    low.append(both & (2**63 - 1))
                    high.append(both >> 65)
                    keys.append(k)
                    bits.append(b)
                else:
                    low.append(None), high.append(None), keys.append(None), bits.append(None)
            t = pa.list_(pa.int64())
            made = [pa.array(n, pa.int64()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(keys, t), pa.array(bits, t)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *made], [c.split()[0] for c in SIGNED.split(", ")])

    return run


def _sets(shingle: int):
    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["id", "set"])

    return run


def estimate(a: list[Column], b: list[Column]) -> Column:
    """Similarity of two packed signatures: equal pairs of bits, less chance hits."""
    differ = None
    for x, y in zip(a, b, strict=True):
        d = x.bitwiseXOR(y)
        c = F.bit_count(d.bitwiseOR(F.shiftrightunsigned(d, 1)).bitwiseAND(F.lit(0x5555555555555555)))
        differ = c if differ is None else differ + c
    return (1 - differ / F.lit(PERMS) - 0.25) / 0.75


def least_estimate(percent: int) -> float:
    """Six deviations below `percent`: what the estimate of a pair that is to be linked hardly ever falls short of."""
    s = percent / 100
    if not 0 < s <= 1 or (1 - s**ROWS) ** BANDS > 1e-5:
        raise ValueError(f"pairs of {percent} percent may share no band")
    hit = 0.25 + 0.75 * s
    return s - 6 * math.sqrt(hit * (1 - hit) / PERMS) / 0.75


def _screened(pairs: DataFrame, bits: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b), those whose estimate is at least `least`."""
    both = pairs.select("a", "b").join(bits.select(F.col("id").alias("a"), F.col("bits").alias("x")), "a").join(bits.select(F.col("id").alias("b"), F.col("bits").alias("y")), "b")
    close = estimate([F.col("x")[k] for k in range(LANES)], [F.col("y")[k] for k in range(LANES)]) >= least
    return both.filter(close).select("a", "b")


#: Edges that one task joins up, whatever the size of the table; more take turns of all tasks.
FEW = 4096


def _united(batches):
    """(a, p): for every id on an edge the smallest id it reaches, of all edges in one task."""
    above: dict[int, int] = {}
    for batch in batches:
        for ends in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            tops = []
            for x in ends:
                while (up := above.setdefault(x, x)) != x:
                    above[x] = x = above[up]
                tops.append(x)
            above[max(tops)] = min(tops)
    for x in sorted(above):  # what stands above x is less than x, and done
        above[x] = above[above[x]]
    yield pa.RecordBatch.from_arrays([pa.array(list(v), pa.int64()) for v in (above.keys(), above.values())], ["a", "p"])


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id on an edge (a, b): the smallest id it reaches.

    Each turn hooks every root to its smallest neighbour, halves the paths
    twice and contracts the edges; rows only shrink, and the last FEW edges are
    joined up in one task.  Keys are aggregated by min, so a hub of any degree
    costs one row a task.
    """
    ends = lambda e: e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = materialise(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b").distinct(), "edges")
    turns: list[DataFrame] = []
    while edges.count() > FEW:
        up = ends(edges).groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p"))
        for _ in range(2):
            above = up.select(F.col("a").alias("p"), F.col("p").alias("q"))
            up = up.join(above, "p").select("a", F.col("q").alias("p"))
        up = materialise(up, "parents")
        turns.append(up)
        one = edges.join(up, "a").select(F.col("p").alias("x"), "b")
        edges = one.join(up.withColumnRenamed("a", "b"), "b").select(F.least("x", "p").alias("a"), F.greatest("x", "p").alias("b"))
        edges = materialise(edges.filter("a <> b").distinct(), "edges")
    turns.append(materialise(edges.coalesce(1).mapInArrow(_united, "a long, p long"), "parents"))
    roots = turns[0].select(F.col("a").alias("id"), F.col("p").alias("root"))
    for up in turns[1:]:
        roots = roots.join(up, F.col("root") == F.col("a"), "left").select("id", F.coalesce("p", "root").alias("root"))
    return materialise(roots, "roots") if len(turns) > 1 else roots


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= percent * union."""
    left = pairs.select("a", "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b")


def _apart(member: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of one block but two components, not both in a main one, that may be linked.

    Shingles of a block are ordered, rarest first.  Linked sets share so many
    that their first common one stands within a prefix of either, with enough
    places after it.  The members of a group of near copies that lie just
    apart begin with shingles of their own, so they meet hardly anyone here,
    and no link is lost.
    """
    words = member.join(sets, "id").select("block", "id", "root", "main", F.size("set").cast("long").alias("n"), F.explode("set").alias("t"))
    often = words.groupBy("block", "t").agg(F.count("*").alias("often"))
    rank = F.row_number().over(W.partitionBy("block", "id").orderBy("often", "t"))
    prefix = F.col("n") - F.ceil(percent * F.col("n") / 100) + 1
    words = words.join(often, ["block", "t"]).withColumn("p", rank).filter((F.col("p") <= prefix) & (F.col("often") > 1))
    words = materialise(words.select("block", "t", "id", "root", "main", "n", "p"), "prefixes")
    one = words.filter("root <> main").select("block", "t", F.col("id").alias("a"), F.col("root").alias("ra"), F.col("n").alias("na"), F.col("p").alias("pa"))
    two = words.select("block", "t", F.col("id").alias("b"), F.col("root").alias("rb"), (F.col("root") == F.col("main")).alias("in_main"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    both = (one["block"] == two["block"]) & (one["t"] == two["t"]) & (F.col("ra") != F.col("rb")) & (F.col("in_main") | (F.col("a") < F.col("b")))
    room = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    enough = (100 + percent) * room >= percent * (F.col("na") + F.col("nb"))
    return one.join(two, both & enough).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, age_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Links are pairs with 100 * |A & B| >= percent * |A | B|; component_id is
    the smallest id reachable.  Null, empty and blank texts have no set and
    link with nothing.  Every row counts for itself: rows that share an id but
    not the text may lie in different components, and rows alike in both come
    out alike.  Rows without an id come out with the smallest id reachable,
    null (and kept) where there is none.  Other columns are not read, but for
    age_col: an integer, by default the id, by which the oldest text of a group
    is told.  It changes no result; it makes hubs of texts that others copy.
    """
    least = least_estimate(percent)
    text = F.col(text_col)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(age_col or id_col).cast("long").alias("age"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = materialise(docs.mapInArrow(_signed(shingle), SIGNED), "signatures")
    # A class is known by its set; its head is the row of it with the largest id, and that row's text.
    same = ["n_shingles", "low", "high"]
    head = F.max_by("text_hash", F.coalesce("doc_id", F.lit(-(2**63))))
    classes = signed.filter("n_shingles > 0").groupBy(*same).agg(F.min("doc_id").alias("doc"), F.min("age").alias("age"), F.max("doc_id").alias("last"), head.alias("text_hash"))
    # Ids rise with age, so hubs and roots are the oldest of a group, of which the others are likely copies.
    classes = classes.orderBy(F.asc_nulls_last("age"), "low", "high").withColumn("id", F.monotonically_increasing_id())
    classes = materialise(classes, "classes")
    on = [*(signed[c] == classes[c] for c in [*same, "text_hash"]), signed["doc_id"].eqNullSafe(classes["last"])]
    heads = signed.join(classes, on).select("id", "keys", "bits").dropDuplicates(["id"])
    heads = materialise(heads, "heads")
    bits = heads.select("id", "bits")

    banded = heads.select("id", F.explode("keys").alias("key"))
    shared = banded.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("n")).filter("n > 1").select("key", "hub")
    stars = banded.join(shared, "key").filter("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("bands"))
    stars = materialise(stars, "stars").select(F.col("id").alias("a"), F.col("hub").alias("b"), "bands")
    blocks = components(stars)
    nearest = W.partitionBy("a").orderBy(F.desc("bands"), "b")
    near = stars.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= HUBS)
    near = materialise(_screened(near, bits, least), "near")

    wanted = blocks.select("id").join(classes, "id").select("id", "last", F.col("text_hash").alias("hash"))
    texts = docs.join(wanted, (docs["text_hash"] == wanted["hash"]) & docs["doc_id"].eqNullSafe(wanted["last"])).select("id", "text").dropDuplicates(["id"])
    sets = materialise(texts.mapInArrow(_sets(shingle), "id long, set array<long>"), "sets")
    links = materialise(_confirmed(near, sets, percent), "links")
    first = components(links)

    member = blocks.withColumnRenamed("root", "block").join(first, "id", "left").select("id", "block", F.coalesce("root", "id").alias("root"))
    member = materialise(member, "members")
    sizes = member.groupBy("block", "root").agg(F.count("*").alias("n"))
    main = sizes.groupBy("block").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("block", "main")
    pairs = _screened(_apart(member.join(main, "block"), sets, percent), bits, least)
    late = materialise(_confirmed(pairs, sets, percent), "late")

    step = first.select("id", "root")
    joined = late.join(step.withColumnRenamed("id", "a").withColumnRenamed("root", "x"), "a", "left").join(step.withColumnRenamed("id", "b").withColumnRenamed("root", "y"), "b", "left")
    second = components(joined.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    final = member.select("id", "root").join(second.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").select("id", F.coalesce("top", "root").alias("top"))
    topped = materialise(classes.join(final, "id", "left").select(*same, "doc", F.coalesce("top", "id").alias("top")), "tops")
    least_ids = topped.groupBy("top").agg(F.min("doc").alias("component_id"))
    named = topped.join(least_ids, "top").select(*same, "component_id")
    out = signed.select("doc_id", *same).join(named, same, "left")
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
