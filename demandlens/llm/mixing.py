"""Mixing sources to target weights in fixed-length blocks of words.

Each source's words, in a fixed pseudorandom order of its documents, are cut
into blocks of `block` words.  The mix is a sequence of slots, dealt evenly to
`shards` output shards; per shard a multinomial draw says how many slots a
source gets.  Draws use what is left of each source's quota as weights, so the
shards vary but the sources' totals are their quotas.  The j-th slot of a
source goes through a keyed permutation of that source's block numbers (a
Feistel network with cycle walking, another key for each round over the
source), and a further one deals a shard's slots.

The permutations can be inverted, so blocks and slots are joined by index
without a table of slots: a block of a document finds the slots that take it,
where the document lies.  All of it depends on the seed and the rows alone.

Driver and plan hold one number for each source and shard; the number of
sources is that of a catalogue, not of the corpus.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, checked_broadcast, materialise, n_words, running_totals


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Target words of each source.

    Sources in code-point order, null last, take the weights in turn and share
    `share` times all words; none passes `most` times its own words, and the
    excess is shared again by weight among the rest.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: float(weights[k % len(weights)]) for k, s in enumerate(order)}
    left, out, free = share * sum(sizes.values()), {}, list(order)
    while free:
        total = sum(weight[s] for s in free)
        full = [s for s in free if left * weight[s] / total >= most * sizes[s]]
        if not full:
            out |= {s: left * weight[s] / total for s in free}
            break
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        free = [s for s in free if s not in out]
        left = max(left, 0.0)
    return out


def draw(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Slots of each source (columns) in each of `shards` shards (rows) of equal size, give or take one.

    A shard's counts are multinomial, with what is left of the quotas as
    weights; what a draw takes beyond a quota is drawn again from the others.
    """
    rng, left = np.random.default_rng(seed), quotas.astype(np.int64).copy()
    total, out = int(left.sum()), np.zeros((shards, len(quotas)), np.int64)
    for k in range(shards):
        short = total * (k + 1) // shards - total * k // shards
        while short > 0:
            room = left - out[k]
            got = np.minimum(rng.multinomial(short, room / room.sum()), room)
            out[k] += got
            short -= int(got.sum())
        left -= out[k]
    return out


def _mixed(right: np.ndarray, key: np.ndarray, turn: int, mask: np.ndarray) -> np.ndarray:
    f = (right + key + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    f = (f ^ (f >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (f >> np.uint64(32)) & mask


def _forth(v, key, half, mask):
    left, right = v >> half, v & mask
    for turn in range(4):
        left, right = right, left ^ _mixed(right, key, turn, mask)
    return (left << half) | right


def _back(v, key, half, mask):
    left, right = v >> half, v & mask
    for turn in (3, 2, 1, 0):
        left, right = right ^ _mixed(left, key, turn, mask), left
    return (left << half) | right


def permute(x: np.ndarray, n: np.ndarray, key: np.ndarray, back: bool = False) -> np.ndarray:
    """Images of x under keyed permutations of 0..n-1, elementwise; with `back`, under their inverses."""
    half = np.maximum(1, np.ceil(np.log2(np.maximum(n, 2)) / 2)).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x, n, key, once = x.astype(np.uint64), n.astype(np.uint64), key.astype(np.uint64), _back if back else _forth
    out = once(x, key, half, mask)
    while len(bad := np.flatnonzero(out >= n)):
        out[bad] = once(out[bad], key[bad], half[bad], mask[bad])
    return out.astype(np.int64)


@dataclass
class Plan:
    """Of each source its blocks and quota of slots; of each shard its draw. All arrays but `block` and `seed`."""

    block: int
    seed: int
    blocks: np.ndarray
    quotas: np.ndarray
    draws: np.ndarray

    def key(self, source: np.ndarray, turn: int) -> np.ndarray:
        return (source.astype(np.uint64) * np.uint64(1_000_003) + np.uint64(self.seed)) * np.uint64(0xD1342543DE82EF95) + np.uint64(turn)

    def slots(self, source: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, turn, j) of every slot that takes one of the blocks: the j-th of its source."""
        n, quota = self.blocks[source], self.quotas[source]
        found = []
        for turn in range(int(np.max(-(-quota // np.maximum(n, 1)), initial=0))):
            at = np.flatnonzero(turn * n < quota)
            j = turn * n[at] + permute(block[at], n[at], self.key(source[at], turn), back=True)
            ok = j < quota[at]
            found.append((at[ok], np.full(int(ok.sum()), turn), j[ok]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def places(self, source: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of the j-th slot of a source, and the place in that shard."""
        ends, base, total = self._sums
        shard = np.zeros(len(j), np.int64)
        for s in np.unique(source):
            shard[source == s] = np.searchsorted(ends[:, s], j[source == s], "right")
        return shard, permute(base[shard, source] + j, total[shard], shard + self.seed)

    @functools.cached_property
    def _sums(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of a source up to each shard, what turns its j into a place there, and a shard's slots."""
        ends = self.draws.cumsum(0)
        return ends, self.draws.cumsum(1) - ends, self.draws.sum(1)


USES = "array<struct<start:long,length:long,turn:int,shard:int,slot:long>>"


def _used(plan: Plan):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("turn", pa.int32()), ("shard", pa.int32()), ("slot", pa.int64())]))

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                some = batch.slice(k, 2048)
                source, begin, size = (some.column(c).to_numpy() for c in ("source_no", "begin", "size"))
                first, last = begin // plan.block, (begin + size - 1) // plan.block
                count = np.where(size > 0, last - first + 1, 0)
                row = np.repeat(np.arange(len(size)), count)
                block = first[row] + np.arange(len(row)) - (np.cumsum(count) - count)[row]
                at, turn, j = plan.slots(source[row], block)
                order = np.lexsort((turn, at))
                at, turn, j = at[order], turn[order], j[order]
                row, block = row[at], block[at]
                shard, slot = plan.places(source[row], j)
                low = np.maximum(block * plan.block, begin[row])
                high = np.minimum((block + 1) * plan.block, begin[row] + size[row])
                fields = [pa.array(low - begin[row]), pa.array(high - low), pa.array(turn, pa.int32()), pa.array(shard, pa.int32()), pa.array(slot)]
                ends = np.searchsorted(row, np.arange(len(size) + 1)).astype(np.int32)
                uses = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(fields, fields=list(kind.value_type)))
                yield pa.RecordBatch.from_arrays([some.column("uid"), some.column("doc_id"), some.column("source_no"), some.column("size"), uses], ["uid", "doc_id", "source_no", "size", "uses"])

    return run


@dataclass
class Mix:
    """uses: uid, doc_id, source_no, size and the runs of words (USES) that the
    mix takes of every row, by start and turn. sources: number -> (name, size, target)."""

    uses: DataFrame
    plan: Plan
    sources: list[tuple[str | None, int, float]]

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        names = self.uses.sparkSession.createDataFrame([(k, size, float(target)) for k, (_, size, target) in enumerate(self.sources)], "source_no long, source_size long, target double")
        out = self.uses.join(checked_broadcast(names, len(self.sources)), "source_no")
        words = F.aggregate("uses", F.lit(0).cast("long"), lambda a, u: a + u["length"])
        return out.select("doc_id", "size", "source_size", "target", words.alias("taken"))

    def placements(self) -> DataFrame:
        """shard, slot, source_no, uid, doc_id, start, length: what lies in every slot of the mix; a block may hold the ends of several documents."""
        return self.uses.select("source_no", "uid", "doc_id", F.explode("uses").alias("u")).select("u.shard", "u.slot", "source_no", "uid", "doc_id", "u.start", "u.length")


def _mix(rows: DataFrame, weights: tuple[float, ...], share: float, most: float, block: int, shards: int, seed: int) -> Mix:
    """rows: uid, doc_id, source, text_hash, size, from a written table."""
    spark = rows.sparkSession
    found = {r["source"]: (r["size"], r["n"]) for r in rows.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
    goal = targets({s: size for s, (size, _) in found.items()}, weights, share, most)
    order = sorted(found, key=lambda s: (s is None, s or ""))
    numbers = checked_broadcast(spark.createDataFrame([(s, k) for k, s in enumerate(order)], "name string, source_no long"), len(order))
    sizes = rows.join(numbers, rows["source"].eqNullSafe(numbers["name"])).select("uid", "doc_id", "text_hash", "source_no", "size")
    total = sum(n for _, n in found.values())
    bucket = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(max(1, total // 512)))
    placed = running_totals(sizes.withColumn("bucket", bucket), ["source_no"], "bucket", ["doc_id", "text_hash", "uid"], {"size": "begin"})
    blocks = np.array([-(-found[s][0] // block) for s in order], np.int64)
    quotas = np.array([round(goal[s] / found[s][0] * n) if found[s][0] else 0 for s, n in zip(order, blocks.tolist(), strict=True)], np.int64)
    plan = Plan(block, seed, blocks, quotas, draw(quotas, shards, seed))
    uses = placed.select("uid", "doc_id", "source_no", "size", "begin").mapInArrow(_used(plan), f"uid long, doc_id long, source_no long, size long, uses {USES}")
    return Mix(uses, plan, [(s, found[s][0], goal[s]) for s in order])


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shards: int = 256, seed: int = 11) -> Mix:
    """Plan the mix of all documents.

    Null and blank texts have no words and are never taken; a null source is a
    source of its own; rows that repeat a doc_id, and rows without one, are
    rows of their own, ordered by the hashes of their texts.  An empty table
    gives an empty mix.  Other columns are not read.
    """
    text = F.col("text")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), F.xxhash64(text).alias("text_hash"), n_words(text).alias("size"))
    return _mix(materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "sizes"), weights, share, most, block, shards, seed)


def _rewrite(batches):
    find = re.compile(WORD).finditer
    names = ("doc_id", "lang", "source", "text")
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            out: list[tuple] = []
            for row in batch.slice(k, 256).to_pylist():
                text, spans = row["text"], None
                turns: dict[int, list[list[int]]] = {}
                for u in row["uses"]:
                    runs = turns.setdefault(u["turn"], [])
                    if runs and runs[-1][1] == u["start"]:
                        runs[-1][1] += u["length"]
                    else:
                        runs.append([u["start"], u["start"] + u["length"]])
                for _, runs in sorted(turns.items()):
                    if runs == [[0, row["size"]]]:
                        out.append((row["doc_id"], row["lang"], row["source"], text))
                        continue
                    spans = spans or [m.span() for m in find(text)]
                    out.append((row["doc_id"], row["lang"], row["source"], "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)))
            cols = list(zip(*out, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if name == "doc_id" else pa.string()) for c, name in zip(cols, names, strict=True)], list(names))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, block: int = 64, shards: int = 256, seed: int = 11) -> DataFrame:
    """The mix as documents: one row for each time round a document, with the
    words taken then; the whole text where that is all of them, else the runs
    taken, joined by line feeds.  Columns doc_id, text, lang, source, n_chars
    (of the new text); rows are treated as in mix().
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.monotonically_increasing_id().alias("uid"))
    docs = materialise(docs.withColumns({"size": n_words(F.col("text")), "text_hash": F.xxhash64("text")}), "mixed")
    plan = _mix(docs.select("uid", "doc_id", "source", "text_hash", "size"), weights, share, most, block, shards, seed)
    uses = plan.uses.filter(F.size("uses") > 0).select("uid", "uses")
    out = docs.join(uses, "uid").select("doc_id", "lang", "source", "text", "size", "uses").mapInArrow(_rewrite, "doc_id long, lang string, source string, text string")
    return out.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
