"""Packing token sequences by non-negative least squares over a length histogram.

Documents become token ids once, in a table of the shared folder; a task that
makes them numbers its rests of each length, so that ranks over all documents
need the counts of tasks alone and no token is shuffled.  Whole windows are cut
off each document's start; the rest, of 0 < r < window tokens, is packed: shallow combinations of up to three lengths that fill a window are
enumerated, their repeat counts solved against the histogram of r (at most
window - 1 numbers, whatever the corpus) and rounded down, so every combination
is a full sequence of uncut pieces.  What is left over is packed greedily,
longest first and end to end, cut where a window ends; the tail that fills no
window is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import functools
import sys
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

#: White space in one run that the merges are not asked to take.
RUN = 100_000
#: Tasks whose counts may be broadcast, at most 17 KB each; beyond it they are joined by task.
PARTS = 1 << 10
#: Ids of sequences that hold one whole window begin at WHOLE << 40.
WHOLE = 1


# Fixed value: the pattern that cuts texts into pre-tokens in this vocabulary.
PRETOKEN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _ranked(tokenizer):
    """The tokenizer's vocabulary as merge ranks of byte strings, as an encode function; None where tiktoken is absent."""
    try:
        import tiktoken
    except ImportError:
        return None
    # The byte alphabet shows printable Latin-1 characters as themselves and the rest, in order, from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    ranks = {bytes(letters[c] for c in token): k for token, k in tokenizer.get_vocab(True).items() if token not in special}
    return tiktoken.Encoding("ranked", pat_str=PRETOKEN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


@functools.lru_cache(2)
def _encoder(path: str):
    """encode(texts) -> ids as little-endian uint32 bytes.

    Texts go through the same merges in tiktoken, several times faster, if it
    agrees with the tokenizer on a set of probes; else through the tokenizer,
    as does a text that spells out an added token (such as an end-of-text
    mark), which is one id, or has a run of white space that is too long for
    the pattern's stack.
    """
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    added = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
    run = re.compile(rf"\s{{{RUN}}}").search

    def plain(text: str) -> bytes:
        return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    probes = [*"aé中🙂", "The quick brown fox's 123 jumps!\n\n  over\t<|x|>", " naïve  déjà-vu  ÜBER ", "x" * 300, "\x00\x1c\u2028~ \x85 \t\r\n  \u3000a"]
    merge = _ranked(tokenizer)

    def merged(text: str) -> bytes:
        return array("I", merge(text)).tobytes()

    try:
        fast = merged if merge and sys.byteorder == "little" and all(merged(p) == plain(p) for p in probes) else plain
    except (KeyError, ValueError):
        fast = plain

    def encode(texts: list[str]) -> list[bytes]:
        return [plain(t) if any(a in t for a in added) or len(t) > RUN and run(t) else fast(t) for t in texts]

    return encode


TOKENS = "doc_id long, uid long, n long, first long, part int, local long, ids binary"


def _tokenised(path: str, end: int, window: int):
    def run(batches):
        encode, part = _encoder(path), TaskContext.get().partitionId()
        row = whole = 0
        stop = np.array([end], "<u4").tobytes()
        seen = np.zeros(window, np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                ids = [x + stop for x in encode([t or "" for t in some.column(1).to_pylist()])]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                uid = (part << 40) + row + np.arange(len(n), dtype=np.int64)
                full, r = n // window, n % window
                first = ((part + WHOLE) << 40) + whole + np.cumsum(full) - full
                order = np.argsort(r, kind="stable")
                begins = np.searchsorted(r[order], r[order])
                local = np.empty(len(n), np.int64)
                local[order] = seen[r[order]] + np.arange(len(n)) - begins
                np.add.at(seen, r, 1)
                row, whole = row + len(n), whole + int(full.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(uid), pa.array(n), pa.array(first), pa.array(np.full(len(n), part, np.int32)), pa.array(local), pa.array(ids, pa.binary())], [c.split()[0] for c in TOKENS.split(", ")])

    return run


def tokenise(docs: DataFrame, tokenizer_path: str, end_id: int = 0, window: int = 1024) -> DataFrame:
    """TOKENS of whole texts, in the shared folder; null texts are empty.

    ids are little-endian uint32 bytes; uid tells apart rows that share a
    doc_id; `local` counts the rows before it in task `part` that leave as many
    tokens after whole windows, the first of which has sequence id `first`.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return materialise(rows.mapInArrow(_tokenised(tokenizer_path, end_id, window), TOKENS), "tokens")


def combinations(window: int, lengths: np.ndarray) -> np.ndarray:
    """Sorted triples of lengths in use (0: none) that sum to window."""
    have = np.zeros(window + 1, bool)
    have[lengths] = True
    found = []
    for a in lengths[::-1]:
        if a < (window + 2) // 3:
            break
        b = np.arange(min(a, window - a), (window - a - 1) // 2, -1)
        c = window - a - b
        ok = have[b] & (have[c] | (c == 0)) & (b > 0) & (c <= b)
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], 1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)


def solve(window: int, histogram: np.ndarray, turns: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Combinations and whole repeat counts that never exceed the histogram.

    min |A x - h| with x >= 0 by multiplicative updates (A counts lengths in
    combinations, all non-negative), then rounded down; a last sweep takes what
    whole repeats the residual still allows, most tokens first.
    """
    combos = combinations(window, np.flatnonzero(histogram))
    if not len(combos):
        return combos, np.zeros(0, np.int64)
    h = histogram.astype(float)
    h[0] = 0
    x = np.minimum.reduce([np.where(combos[:, k] > 0, h[combos[:, k]], np.inf) for k in range(3)]) / 8
    gather = lambda v: v[combos].sum(1)  # noqa: E731  v[0] is 0
    target = gather(h)
    for _ in range(turns):
        fill = np.bincount(combos.ravel(), np.repeat(x, 3), window + 1)
        fill[0] = 0
        x *= target / np.maximum(gather(fill), 1e-9)
    repeats = np.floor(x).astype(np.int64)
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    used = np.bincount(combos.ravel(), np.repeat(repeats, 3).astype(float), window + 1).astype(np.int64)
    over = np.ones(window + 1)
    np.divide(histogram, used, out=over, where=used > histogram)
    over[0] = 1
    repeats = np.floor(repeats * over[combos].min(1)).astype(np.int64)
    used = np.bincount(combos.ravel(), np.repeat(repeats, 3).astype(float), window + 1).astype(np.int64)
    used[0] = 0
    left -= used
    for k in np.argsort(-x, kind="stable"):
        own = combos[k][combos[k] > 0]
        lengths, times = np.unique(own, return_counts=True)
        more = int((left[lengths] // times).min())
        if more > 0:
            repeats[k] += more
            left[lengths] -= more * times
    keep = repeats > 0
    return combos[keep], repeats[keep]


class Plan:
    """Where the k-th rest of length r goes; sized by the window, not the corpus."""

    def __init__(self, window: int, histogram: np.ndarray):
        combos, repeats = solve(window, histogram)
        self.window, slots = window, [[] for _ in range(window)]
        base = 0
        taken = np.zeros(window, np.int64)
        for combo, n in zip(combos.tolist(), repeats.tolist(), strict=True):
            offset = 0
            for r in combo:
                if r:
                    slots[r].append((int(taken[r]), base, offset))
                    taken[r] += n
                    offset += r
            base += n
        self.slots = [np.array(s, np.int64).reshape(-1, 3) for s in slots]
        self.taken, self.base = taken, base
        left = histogram[:window].astype(np.int64) - taken
        left[0] = 0
        after = (left * np.arange(window))[::-1].cumsum()[::-1]
        self.start = np.append(after[1:], 0)
        self.total = int(after[0])
        tail, at = self.total % window, self.total - self.total % window
        self.cuts, seq = [], base + self.total // window
        for bit in range(window.bit_length(), -1, -1):
            if tail >> bit & 1:
                self.cuts.append((at, at + (1 << bit), seq))
                at, seq = at + (1 << bit), seq + 1

    def pieces(self, r: int, k: int) -> list[tuple[int, int, int, int]]:
        """(start in the rest, length, sequence, offset) of its pieces."""
        if k < self.taken[r]:
            s = self.slots[r]
            first, base, offset = s[np.searchsorted(s[:, 0], k, "right") - 1].tolist()
            return [(0, r, base + k - first, offset)]
        at = int(self.start[r]) + (k - int(self.taken[r])) * r
        end, begin, out = at + r, at, []
        while at < end:
            if at < self.total - self.total % self.window:
                stop = min(end, (at // self.window + 1) * self.window)
                out.append((at - begin, stop - at, self.base + at // self.window, at % self.window))
            else:
                low, high, seq = next(c for c in self.cuts if c[0] <= at < c[1])
                stop = min(end, high)
                out.append((at - begin, stop - at, seq, at - low))
            at = stop
        return out


def _placed(plan: Plan):
    def run(batches):
        w = plan.window
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                cols = {c: [] for c in ("doc_id", "uid", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}
                for doc, uid, n, first, ids, rank in zip(*(some.column(c).to_pylist() for c in ("doc_id", "uid", "n", "first", "ids", "rank")), strict=True):
                    cut = [(j * w, w, first + j, 0) for j in range(n // w)]
                    if n % w:
                        cut += [(n - n % w + s, *more) for s, *more in plan.pieces(n % w, rank)]
                    for start, length, seq, offset in cut:
                        for c, v in zip(cols, (doc, uid, start, length, ids[4 * start : 4 * (start + length)], n, seq, offset), strict=True):
                            cols[c].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.binary() if c == "ids" else pa.int64()) for c, v in cols.items()], list(cols))

    return run


def ranked(tokens: DataFrame, counts: DataFrame, parts: int) -> DataFrame:
    """tokens with rank: how many rests of its length come before it, by task and place in the task.

    counts has part, r, n.  The running sums have one row for a task and
    length; tokens meet them by task, without a shuffle up to PARTS tasks.
    """
    before = F.coalesce(F.sum("n").over(W.partitionBy("r").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    bases = counts.select("part", "r", before.alias("base")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("r", "base"))).alias("bases"))
    bases = F.broadcast(bases) if parts <= PARTS else bases
    return tokens.join(bases, "part").withColumn("rank", F.col("local") + F.col("bases")[F.col("r")])


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0) -> DataFrame:
    """Pieces of all documents: doc_id, uid, start, length, ids, doc_tokens, sequence_id, offset.

    ids are the piece's tokens (little-endian uint32 bytes); uid tells apart
    rows that share a doc_id, so repeated rows are packed each for itself.
    Null and empty texts hold the end token alone; null doc_ids stay null; an
    empty table gives no pieces.  Nothing is dropped or padded; only the
    columns doc_id and text are read, whatever others there are.
    """
    tokens = tokenise(docs, tokenizer_path, end_id, window).withColumn("r", (F.col("n") % window).cast("int"))
    counts = materialise(tokens.groupBy("part", "r").agg(F.count("*").alias("n")), "rests")
    histogram = np.zeros(window + 1, np.int64)
    for r in counts.groupBy("r").agg(F.sum("n").alias("n")).collect():
        histogram[r["r"]] = r["n"]
    parts = counts.select("part").distinct().count()
    out = ranked(tokens, counts, parts).select("doc_id", "uid", "n", "first", "ids", "rank")
    return out.mapInArrow(_placed(Plan(window, histogram)), "doc_id long, uid long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids instead of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
