"""Media columns: GIF streams, their decoder and colour-histogram columns.

`encode` stores bytes as the palette indices of a GIF89a animation, in LZW
codes of the longest strings known; `decode` reads any GIF: it unpacks and
expands the codes, applies global or local palettes,
interlacing, transparency and the disposal methods, and yields each frame's
indices, canvas and time.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a row, and rows of a frame, of what encode writes.
WIDTH, HEIGHT = 576, 64
#: Hundredths of a second that it shows a frame.
DELAY = 10
_GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


#: Codes have at most this many bits.
MOST_BITS = 12


def _lzw_codes(data: bytes) -> np.ndarray:
    """Codes of 8-bit LZW with longest known strings; the table is cleared when it is full."""
    # Codes stand 256 times larger, so that one and an index make a key by a single operation.
    first, end = 258 << 8, 4096 << 8
    codes = [256 << 8]
    emit = codes.append
    table: dict[int, int] = {}
    get, size, w = table.get, first, data[0] << 8
    for b in data[1:]:
        key = w | b
        c = get(key)
        if c:
            w = c
            continue
        emit(w)
        w = b << 8
        table[key] = size
        size += 256
        if size > end:
            emit(256 << 8)
            table.clear()
            size = first
    emit(w)
    emit(257 << 8)
    return np.array(codes, np.int64) >> 8


def _widths(min_bits: int) -> np.ndarray:
    """Bits of the k-th code after a clear code, as long as the table grows."""
    end = (1 << min_bits) + 1
    return np.array([min(MOST_BITS, max(min_bits + 1, (end + max(k - 1, 0)).bit_length())) for k in range(1, 4097 - end)], np.int64)


_EIGHT = np.append(_widths(8), np.full(8, MOST_BITS))


def lzw_encode(data: bytes) -> bytes:
    """An LZW stream of 8-bit indices, its codes as a bit stream, low bits first."""
    code = _lzw_codes(data)
    clears = np.flatnonzero(code == 256)
    spans = np.diff(np.append(clears, len(code) - 1))
    width = np.concatenate([[9], *(_EIGHT[:n] for n in spans.tolist())])
    ends = np.cumsum(width)
    at = ends - width
    # A code lies in three bytes at most, and no two codes share a bit.
    parts, size = code << (at & 7), int(ends[-1] + 7 >> 3)
    out = sum(np.bincount((at >> 3) + k, parts >> 8 * k & 255, size + 2) for k in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _grown(codes: np.ndarray, clear: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
    """What codes stand for from a clear code until the table is full, and whether all are sound.

    Gives up to `most` indices and, of each code, where its string begins and
    how long it is.  The k-th code adds the string of the code before it, and
    one index more, to the table.  So entry j is the output from where code j
    begins, one index longer than code j, and a code that names it copies from
    there.  Lengths follow from chains of such codes, indices from chains of
    copies; both are found by pointer doubling.
    """
    entry = codes - (clear + 2)
    named = np.arange(len(codes), dtype=np.int32)
    literal = codes < clear
    wrong = np.flatnonzero(~literal & (entry >= named))
    sound = not len(wrong)
    if not sound:
        codes, literal, entry, named = (x[: wrong[0]] for x in (codes, literal, entry, named))
    named = np.where(literal, named, entry)
    length, at = (~literal).astype(np.int32), named
    while (more := length[at]).any():
        length, at = length + more, at[at]
    length += 1
    ends = np.cumsum(length, dtype=np.int32)
    use = int(np.searchsorted(ends, most)) + 1
    begins = (ends - length)[:use]
    source = np.arange(ends[use - 1] if use <= len(ends) else ends[-1] if len(ends) else 0, dtype=np.int32)
    source -= np.repeat(begins - begins[named[:use]], length[:use])
    while ((more := source[source]) != source).any():
        source = more
    first = np.zeros(len(source), np.uint8)
    roots = begins[literal[:use]]
    first[roots] = codes[:use][literal[:use]]
    return first[source][:most], begins, length, sound


@functools.lru_cache(16)
def _layout(min_bits: int, full: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the codes that are unpacked at once: first bit, bit after the last, mask; `full` from when the table is full."""
    widths = np.full(4096, MOST_BITS) if full else np.append(_widths(min_bits), np.full(8, MOST_BITS))
    ends = np.cumsum(widths)
    return (ends - widths).astype(np.int32), ends.astype(np.int32), ((1 << widths) - 1).astype(np.uint32)


def lzw_decode(stream: bytes, min_bits: int, most: int) -> bytes:
    """Up to `most` indices of an LZW stream; a cut or faulty stream gives what it holds.

    Between clear codes, the width of the n-th code depends on n alone, so
    codes are unpacked many at once.  With a full table they go on at twelve
    bits until the clear code that the encoder puts off; their strings are
    copied from what filled the table, 4096 codes at a time.
    """
    if not 1 <= min_bits <= 8:
        return b""
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    limit, done, bit = len(stream) * 8, 0, 0
    out: list[np.ndarray] = []
    table: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
    while bit < limit and done < most:
        starts, ends, masks = _layout(min_bits, table is not None)
        use = int(np.searchsorted(ends, limit - bit, "right"))
        if not use:
            break
        at = starts[:use] + (bit & 7)
        here = raw[bit >> 3 : (bit >> 3) + (int(at[-1]) >> 3) + 3]
        k = at >> 3
        codes = ((here[k] | here[k + 1] << 8 | here[k + 2] << 16) >> (at & 7).astype(np.uint32) & masks[:use]).astype(np.int32)
        stop = np.flatnonzero((codes & -2) == clear)  # the clear code or the end
        n = int(stop[0]) if len(stop) else use
        bit += int(ends[min(n, use - 1)])
        sound = True
        if n and table is None:
            part, begins, length, sound = _grown(codes[:n], clear, most - done)
            if not len(stop):  # strings of the literals, two places that no code names, those of the entries
                pool = np.concatenate([np.arange(clear, dtype=np.uint8), part])
                table = pool, np.concatenate([np.arange(clear), [0, 0], clear + begins]), np.concatenate([np.ones(clear + 2, np.int64), length[: len(begins)] + 1])
        elif n:
            pool, begins, length = table
            size = length[codes[:n]]
            ends = np.cumsum(size)
            enough = int(np.searchsorted(ends, most - done)) + 1
            size, ends = size[:enough], ends[:enough]
            part = pool[np.arange(ends[-1]) - np.repeat(ends - size - begins[codes[: len(size)]], size)][: most - done]
        else:
            part = np.zeros(0, np.uint8)
        out.append(part)
        done += len(part)
        if not sound:
            break
        if len(stop):
            if codes[stop[0]] == end:
                break
            table = None
    return b"".join(x.tobytes() for x in out)


def _chunks(data: bytes) -> bytes:
    out = bytearray()
    for k in range(0, len(data), 255):
        part = data[k : k + 255]
        out += bytes([len(part)]) + part
    return bytes(out + b"\0")


def encode(samples: bytes, width: int = WIDTH, height: int = HEIGHT, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the samples in order, `width * height` to a frame, the last one lower.

    The samples' number must be a positive multiple of width.
    """
    if not samples or len(samples) % width:
        raise ValueError("samples must fill rows")
    rows = len(samples) // width
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", width, min(rows, height), 0xF7, 0, 0) + _GREY)
    for k in range(0, rows, height):
        part = samples[k * width : (k + height) * width]
        out += b"\x21\xf9\x04\x04" + struct.pack("<H", delay) + b"\0\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, width, len(part) // width, 0) + b"\x08" + _chunks(lzw_encode(part))
    return bytes(out + b"\x3b")


@dataclass
class Frame:
    """indices: as stored, in row order. canvas: height x width x RGBA after this frame is drawn."""

    index: int
    time_ms: int
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    indices: bytes
    palette: np.ndarray
    transparent: int | None
    disposal: int
    canvas: np.ndarray | None


def decode(media: bytes, canvas: bool = True) -> Iterator[Frame]:
    """Frames of a GIF.  A stream that is no GIF raises ValueError; one cut short ends early."""
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack("<HHB", media[6:11])
    at, table = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        table = np.frombuffer(media[at : at + 3 * n], np.uint8).reshape(-1, 3)
        at += 3 * n
    screen = np.zeros((height, width, 4), np.uint8) if canvas else None
    index = clock = 0
    delay, transparent, disposal = 0, None, 0

    def blocks(k: int) -> tuple[bytes, int]:
        got = bytearray()
        while k < len(media) and media[k]:
            got += media[k + 1 : k + 1 + media[k]]
            k += 1 + media[k]
        return bytes(got), k + 1

    while at < len(media) and media[at] != 0x3B:
        if media[at] == 0x21:
            kind = media[at + 1] if at + 1 < len(media) else 0
            body, at = blocks(at + 2)
            if kind == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * struct.unpack("<H", body[1:3])[0]
                transparent = body[3] if body[0] & 1 else None
            continue
        if media[at] != 0x2C or at + 10 > len(media):
            return
        left, top, w, h, flags = struct.unpack("<HHHHB", media[at + 1 : at + 10])
        at += 10
        palette = table
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(media[at : at + 3 * n], np.uint8).reshape(-1, 3)
            at += 3 * n
        if at >= len(media):
            return
        min_bits = media[at]
        body, at = blocks(at + 1)
        indices = lzw_decode(body, min_bits, w * h)
        if flags & 0x40 and len(indices) == w * h:
            order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)]
            rows = np.empty((h, w), np.uint8)
            rows[order] = np.frombuffer(indices, np.uint8).reshape(h, w)
            indices = rows.tobytes()
        palette = palette if palette is not None else np.repeat(np.arange(256, dtype=np.uint8), 3).reshape(-1, 3)
        shown = None
        if screen is not None:
            before = screen.copy() if disposal == 3 else None
            flat = np.frombuffer(indices.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            mask = np.zeros(w * h, bool)
            mask[: len(indices)] = True
            mask = mask.reshape(h, w) & (flat < len(palette))
            if transparent is not None:
                mask &= flat != transparent
            part = screen[top : top + h, left : left + w]
            mask, flat = mask[: part.shape[0], : part.shape[1]], flat[: part.shape[0], : part.shape[1]]
            part[mask, :3] = palette[flat[mask]]
            part[mask, 3] = 255
            shown = screen.copy()
        yield Frame(index, clock, delay, left, top, w, h, indices, palette, transparent, disposal, shown)
        if screen is not None:
            if disposal == 2:
                screen[top : top + h, left : left + w] = 0
            elif disposal == 3:
                screen = before
        index, clock = index + 1, clock + delay
        delay, transparent, disposal = 0, None, 0


def colours(canvas: np.ndarray) -> list[int]:
    """Opaque pixels of a shown frame in 16 classes of red, then of green, then of blue."""
    shown = canvas[canvas[..., 3] > 0]
    return np.concatenate([np.bincount(shown[:, c] >> 4, minlength=16) for c in range(3)]).tolist()


def _stored(unit: int, fill: int):
    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 128):
                some = batch.slice(k, 128)
                n, media = [], []
                for t in some.column(1).to_pylist():
                    b = (t or "").encode("utf-8", "replace")
                    n.append(len(b))
                    media.append(encode(b + bytes([fill]) * (-len(b) % unit or (0 if b else unit))))
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return run


def store_texts(docs: DataFrame, unit: int = WIDTH, fill: int = 255) -> DataFrame:
    """doc_id, n_bytes, media: texts (null: empty) padded with `fill` to a positive multiple of unit, as GIFs."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(_stored(unit, fill), "doc_id long, n_bytes long, media binary")


FRAMES = "array<struct<index:int,time_ms:long,delay_ms:int,width:int,height:int,histogram:array<long>,pixels:binary>>"


#: Bytes of shown frames after which a batch of rows is handed on.
PIXELS = 1 << 24


def _read(batches):
    kind = pa.list_(pa.struct([("index", pa.int32()), ("time_ms", pa.int64()), ("delay_ms", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64())), ("pixels", pa.binary())]))
    types = (kind, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    for batch in batches:
        start, held, cols = 0, 0, [[] for _ in range(6)]
        for k in range(batch.num_rows):
            media = batch.column(1)[k].as_py()
            frames, digest, tail, size = [], hashlib.sha256(), b"", 0
            try:
                for f in decode(media or b""):
                    frames.append({"index": f.index, "time_ms": f.time_ms, "delay_ms": f.delay_ms, "width": f.canvas.shape[1], "height": f.canvas.shape[0], "histogram": colours(f.canvas), "pixels": f.canvas.tobytes()})
                    digest.update(f.indices)
                    size += len(f.indices)
                    held += f.canvas.nbytes
                    tail = (tail + f.indices[-32:])[-32:]
            except ValueError:
                frames = None
            row = (frames, size, digest.hexdigest(), zlib.crc32(tail), len(media or b""), hashlib.sha256(media or b"").hexdigest())
            for c, v in zip(cols, row, strict=True):
                c.append(v)
            if k + 1 == batch.num_rows or k + 1 - start == 128 or held >= PIXELS:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, k + 1 - start), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["row", "frames", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"])
                start, held, cols = k + 1, 0, [[] for _ in range(6)]


def read_media(stored: DataFrame, keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """Decode the media column: timed frames as shown, and digests of the samples and the stored form.

    A frame is the canvas after it is drawn, by transparency and disposal: its
    size, colour histogram and RGBA rows.  The payload
    columns are of the stored indices.
    Null or faulty media have null frames and no samples.
    """
    rows = stored.select(F.struct(*keep).alias("row"), "media")
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_read, f"row {kind}, frames {FRAMES}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string").select("row.*", "frames", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
