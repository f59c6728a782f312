"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text is compiled to a dense table.
A text is parsed greedily into phrases, each the longest match in that text;
the language whose automaton needs the fewest phrases, normalised by
log2(sample length) / text length, wins.  Whole texts are parsed, in blocks of
`BLOCK` bytes that each begin a new phrase, so that thousands of blocks walk
the tables side by side in numpy.

The labelled sample is bounded: `docs_per_lang` rows a language by hash, a
slice of at most `slice_bytes` of each.  Everything else covers all rows.  The
tables, some 12 MB a language, are built once on the driver and broadcast;
workers drop them with their next task of another kind.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 256
#: Blocks that walk the tables together.
LANES = 4096


def suffix_automaton(data: bytes) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of data; state 0 is the root."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in data:
        cur = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = cur
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return moves


class Model:
    """Tables of all languages; entries hold 2 * (next state * classes) + (1 if a phrase begins)."""

    def __init__(self, samples: tuple[tuple[str, bytes], ...]):
        self.langs = [lang for lang, _ in samples]
        self.cost = np.array([math.log2(max(2, len(b))) for _, b in samples])
        seen = sorted(set(b"".join(b for _, b in samples)))
        self.classes = len(seen) + 2  # 0: unseen byte, last: padding
        self.code = np.zeros(256, np.uint8)
        self.code[seen] = np.arange(1, len(seen) + 1)
        # An automaton of n bytes has fewer than 2 n + 2 states; rows that are not used are never touched.
        most = sum(2 * len(b) + 3 for _, b in samples)
        table, starts, base = np.empty((most, self.classes), np.int32), [], 0
        for _, sample in samples:
            moves = suffix_automaton(sample)
            n = len(moves)
            row = np.full(self.classes, 2 * ((base + n) * self.classes) + 1, np.int32)
            for c, to in moves[0].items():
                row[self.code[c]] = 2 * ((base + to) * self.classes) + 1
            row[-1] = 2 * ((base + n) * self.classes)
            table[base : base + n + 1] = row
            for state in range(1, n):
                here = table[base + state]
                for c, to in moves[state].items():
                    here[self.code[c]] = 2 * ((base + to) * self.classes)
                moves[state] = None
            starts.append((base + n) * self.classes)
            base += n + 1
        self.table = table[:base].ravel()
        self.starts = np.array(starts, np.int32)

    def __getstate__(self):
        return self.__dict__ | {"table": self.table.copy()}  # without the rows that are not used

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Number of phrases of each text (rows) in each language (columns)."""
        n_blocks = np.array([-(-len(t) // BLOCK) for t in texts])
        total = np.zeros((len(texts), len(self.langs)), np.int64)
        owner = np.repeat(np.arange(len(texts)), n_blocks)
        padded = b"".join(t.ljust(int(n) * BLOCK, b"\0") for t, n in zip(texts, n_blocks, strict=True))
        x = self.code[np.frombuffer(padded, np.uint8)].reshape(-1, BLOCK)
        last = np.cumsum(n_blocks) - 1
        for t, k in zip(texts, last, strict=True):
            if len(t) % BLOCK:
                x[k, len(t) % BLOCK :] = self.classes - 1
        for k in range(0, len(x), LANES):
            part = np.ascontiguousarray(x[k : k + LANES].T).astype(np.int32)
            state = np.repeat(self.starts[:, None], part.shape[1], 1)
            count = np.zeros(state.shape, np.int32)
            for column in part:
                v = self.table[state + column]
                count += v & 1
                state = v >> 1
            np.add.at(total, owner[k : k + LANES], count.T)
        return total

    def predict(self, texts: list[bytes]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per byte of non-empty texts.  Ties go to the first language by name."""
        n = np.array([len(t) for t in texts])
        bits = self.phrases(texts) * self.cost / n[:, None]
        best = bits.argmin(1)
        low = bits[np.arange(len(n)), best]
        rest = bits.copy()
        rest[np.arange(len(n)), best] = np.inf
        second = np.where(np.isfinite(rest.min(1)), rest.min(1), 2 * low)
        return [self.langs[k] for k in best], np.clip(1 - low / np.maximum(second, 1e-12), 0, 1), low


def learn(train: DataFrame, docs_per_lang: int = 128, slice_bytes: int = 256, min_letters: int = 40) -> tuple[tuple[str, bytes], ...]:
    """Labelled samples (lang, bytes), at most docs_per_lang * slice_bytes of each language.

    Rows with a null lang or id, or a text without a letter, teach nothing;
    texts shorter than min_letters are taken where a language has too few
    others.  Rows that share an id but not the text are rows of their own;
    rows alike in both teach once.
    """
    text = F.col("text")
    place = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), F.length(text) - slice_bytes)) + 1
    rows = train.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.rlike(text, F.lit(r"\p{L}")))
    rows = rows.select("lang", (F.length(text) < min_letters).alias("short"), F.xxhash64("doc_id", text).alias("h"), F.lower(F.substring(text, place.cast("int"), F.lit(slice_bytes))).alias("cut"))
    first = W.partitionBy("lang").orderBy("short", "h", "cut")
    picked = rows.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= docs_per_lang)
    found: dict[str, dict[tuple, bytes]] = {}
    for r in picked.select("lang", "h", "cut").distinct().collect():
        found.setdefault(r["lang"], {})[r["h"], r["cut"]] = r["cut"].encode("utf-8", "replace")[:slice_bytes]
    return tuple((lang, b"\n".join(found[lang][k] for k in sorted(found[lang]))) for lang in sorted(found))


def _predict(shared):
    def run(batches):
        model = shared.value if shared else None
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                some = batch.slice(k, 1024)
                texts = [t.encode("utf-8", "replace") if t else b"" for t in some.column(1).to_pylist()]
                at = [j for j, t in enumerate(texts) if t]
                lang, score, bits = ["und"] * len(texts), [0.0] * len(texts), [None] * len(texts)
                if at and model:
                    for j, x, s, b in zip(at, *model.predict([texts[j] for j in at]), strict=True):
                        lang[j], score[j], bits[j] = x, float(s), float(b)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(bits, pa.float64())], ["row", "lang_pred", "score", "bits"])

    return run


def identify(docs: DataFrame, samples: tuple[tuple[str, bytes], ...], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of docs with lang_pred, score (0 to 1) and bits (a byte, null for und).

    `und`, score 0: the text is null, empty or has no letter, or nothing was
    learned.  Every row comes out once; repeated rows and null ids are rows
    like others, and columns of docs that are not kept are not read.
    """
    text = F.when(F.rlike(F.col("text"), F.lit(r"\p{L}")), F.lower("text"))
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Model(samples)) if samples else None
    return rows.mapInArrow(_predict(shared), f"row {kind}, lang_pred string, score double, bits double").select("row.*", "lang_pred", "score", "bits")


def held_out(docs: DataFrame):
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
