"""WARC archives as a PySpark Python data source, format name "warc".

Writing: one file a task, rolled at `roll_bytes`; each record a gzip member
whose header carries its length in an `sl` extra field.  Files get unique
names and count only once the driver has written the manifest at commit, so
lost or repeated tasks leave nothing that is read.  The manifest says where a
record begins about every INDEX bytes.

Reading: ranges of files between such places are planned into partitions of
about `split_bytes`; files that no manifest lists are read whole, and only
where the folder has no manifest.  Filters on record_type, record_id,
target_uri, refers_to and payload_digest are pushed down and checked on a
record's headers, before its payload is inflated; members of other records are
stepped over by their `sl` length.  With option payload=false no payload is
read at all.  Gzip members without `sl` may hold any number of records.  A
record that is cut short or is none raises ValueError; with option
tolerant=true it ends its file quietly.

Paths are URIs that pyarrow.fs opens (file, hdfs, s3, gs), the same from all
executors.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

SCHEMA = "record_id string, record_type string, target_uri string, date string, payload_digest string, refers_to string, payload_length long, headers map<string,string>, payload binary"
_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("date", pa.string()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Column to WARC header.
NAMED = {"record_id": "WARC-Record-ID", "record_type": "WARC-Type", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To", "payload_length": "WARC-X-Payload-Length"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
#: Bytes between the places of a file that the manifest names.
INDEX = 16 << 20
#: Names of headers by their lower case; in archives any case will do.
CASED = {h.lower(): h for h in (*NAMED.values(), "Content-Type", "Content-Length", "WARC-Profile")}


def _safe(value: str) -> str:
    """A header value: control characters and blanks percent-encoded, which a URI needs anyway."""
    return "".join(f"%{ord(c):02X}" if ord(c) <= 32 or ord(c) == 127 else c for c in value)


def record_bytes(row: dict) -> bytes:
    """An uncompressed record.  Responses and revisits hold an HTTP message; a revisit's has no body."""
    payload = row.get("payload") or b""
    kind = row.get("record_type") or "resource"
    if kind in ("response", "revisit"):
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (payload if kind == "response" else b"")
        media = "application/http; msgtype=response"
    else:
        block, media = payload, "application/octet-stream"
    head = ["WARC/1.1"] + [f"{h}: {_safe(str(row[c]))}" for c, h in NAMED.items() if row.get(c) is not None]
    if kind == "revisit":
        head.append(f"WARC-Profile: {REVISIT}")
    known = {h.lower() for h in NAMED.values()} | {"content-type", "content-length", "warc-profile"}
    head += [f"{_safe(k)}: {_safe(v or '')}" for k, v in (row.get("headers") or []) if k.lower() not in known]
    head += [f"Content-Type: {media}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(record: bytes, level: int = 1) -> bytes:
    """A gzip member with its own length and the record's in the extra field `sl`."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    extra = b"sl" + struct.pack("<HII", 8, size & 0xFFFFFFFF, len(record) & 0xFFFFFFFF)
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def parse_headers(block: bytes) -> dict[str, str]:
    """Header lines of a record (after the version line); folded lines are joined.

    Names that this module knows come in its own case, others as they stand.
    """
    out: dict[str, str] = {}
    last = None
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            last = CASED.get(name.strip().lower(), name.strip())
            out[last] = value.strip()
    return out


class _Source:
    """Bytes of a stream, read ahead in pieces, with skipping."""

    def __init__(self, stream, piece: int = 1 << 20):
        self.stream, self.piece, self.have, self.at = stream, piece, b"", 0
        self.read_to = stream.tell()

    def place(self) -> int:
        return self.read_to - len(self.have) + self.at

    def peek(self, n: int) -> bytes:
        if len(self.have) - self.at < n:
            parts = [self.have[self.at :]]
            short = n - len(parts[0])
            while short > 0 and (more := self.stream.read(max(short, self.piece))):
                parts.append(more)
                short -= len(more)
                self.read_to += len(more)
            self.have, self.at = b"".join(parts), 0
        return self.have[self.at : self.at + n]

    def skip(self, n: int) -> None:
        """Step over n bytes; raises if there are fewer."""
        here = len(self.have) - self.at
        if n <= here:
            self.at += n
            return
        self.read_to += n - here - 1
        self.have, self.at = b"", 0
        self.stream.seek(self.read_to)
        if not self.peek(1):
            raise ValueError("a record is cut short")
        self.at = 1


class _Inflated:
    """The contents of gzip members one after the other, as a stream that goes forward."""

    def __init__(self, src: _Source):
        self.src, self.inflate, self.done = src, zlib.decompressobj(31), 0

    def tell(self) -> int:
        return self.done

    def read(self, n: int) -> bytes:
        out: list[bytes] = []
        while n > 0:
            if self.inflate.eof:
                self.inflate = zlib.decompressobj(31)
            data = self.src.peek(1 << 16)
            if not data:
                break
            try:
                more = self.inflate.decompress(data, n)
            except zlib.error as e:
                raise ValueError(f"not a gzip member: {e}") from None
            self.src.skip(len(data) - len(self.inflate.unused_data) - len(self.inflate.unconsumed_tail))
            out.append(more)
            n -= len(more)
        self.done += sum(map(len, out))
        return b"".join(out)

    def seek(self, to: int) -> None:
        while self.done < to and self.read(min(1 << 20, to - self.done)):
            pass


def _plain_records(src: _Source, wanted, payloads: bool, end: int | None):
    while end is None or src.place() < end:
        line = src.peek(1)
        while line in (b"\r", b"\n") and line:
            src.skip(1)
            line = src.peek(1)
        if not line:
            return
        n = 4096
        while (head := (block := src.peek(n)).find(b"\r\n\r\n")) < 0:
            if len(block) < n or not block.startswith(b"WARC/"):
                raise ValueError("a record's headers are cut short, or there is no record")
            n *= 2
        if not block.startswith(b"WARC/"):
            raise ValueError("there is no record where one should begin")
        headers = parse_headers(block[:head])
        length = int(headers.get("Content-Length", 0))
        src.skip(head + 4)
        ask = wanted(headers)
        if ask and payloads and len(src.peek(length)) < length:
            raise ValueError("a record is cut short")
        if ask:
            yield headers, src.peek(length) if payloads else None
        src.skip(length)


def _member_records(src: _Source, wanted, payloads: bool, end: int | None):
    """Records of members that carry their length; from the first that does not, all is inflated."""
    while (end is None or src.place() < end) and src.peek(1):
        top = src.peek(24)
        if len(top) < 20 or top[:2] != b"\x1f\x8b" or top[3] != 4 or top[12:14] != b"sl":
            yield from _plain_records(_Source(_Inflated(src)), wanted, payloads, None)
            return
        size = struct.unpack("<I", top[16:20])[0]
        piece = src.peek(size)
        if len(piece) < size:
            raise ValueError("a record is cut short")
        inflate = zlib.decompressobj(31)
        record, n = inflate.decompress(piece, 2048), 2048
        while (head := record.find(b"\r\n\r\n")) < 0 and inflate.unconsumed_tail:
            record += inflate.decompress(inflate.unconsumed_tail, n)
        if head < 0 or not record.startswith(b"WARC/"):
            raise ValueError("a member holds no record")
        headers = parse_headers(record[:head])
        if wanted(headers):
            block = None
            if payloads:
                if inflate.unconsumed_tail:
                    record += inflate.decompress(inflate.unconsumed_tail)
                length = int(headers.get("Content-Length", 0))
                block = record[head + 4 : head + 4 + length]
                if len(block) < length:
                    raise ValueError("a record is cut short")
            yield headers, block
        src.skip(size)


def read_records(stream, wanted=lambda headers: True, payloads: bool = True, end: int | None = None, tolerant: bool = False) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """(headers, block) of the wanted records of a plain or gzipped archive, of those that begin before `end`.

    A record cut short raises ValueError, or ends the archive if tolerant.
    """
    src = _Source(stream)
    try:
        yield from (_member_records if src.peek(2) == b"\x1f\x8b" else _plain_records)(src, wanted, payloads, end)
    except ValueError:
        if not tolerant:
            raise


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@dataclass
class _Written(WriterCommitMessage):
    files: dict[str, list[int]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool, roll: int):
        self.uri, self.overwrite, self.roll = uri, overwrite, roll

    def write(self, iterator):
        store, path = _open(self.uri)
        store.create_dir(path, recursive=True)
        files, out, size, name = {}, None, 0, ""
        for batch in iterator:
            for k in range(0, batch.num_rows, 64):
                for row in batch.slice(k, 64).to_pylist():
                    if out is None or size > self.roll:
                        if out is not None:
                            out.close()
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, size, files[name] = store.open_output_stream(f"{path}/{name}", compression=None), 0, []
                    if size >= INDEX * (len(files[name]) + 1):
                        files[name].append(size)
                    data = member(record_bytes(row))
                    out.write(data)
                    size += len(data)
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        store, path = _open(self.uri)
        store.create_dir(path, recursive=True)
        files = {} if self.overwrite else _manifest(store, path) or {}
        for m in messages:
            files |= m.files if m else {}
        with store.open_output_stream(f"{path}/{MANIFEST}") as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages):
        store, path = _open(self.uri)
        for f in (f for m in messages if m for f in m.files):
            store.delete_file(f"{path}/{f}")


def _manifest(store: fs.FileSystem, path: str) -> dict[str, list[int]] | None:
    """Files of a folder, each with places where records begin; None without a manifest."""
    if store.get_file_info(f"{path}/{MANIFEST}").type == fs.FileType.NotFound:
        return None
    with store.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


@dataclass
class _Ranges(InputPartition):
    """(file, first byte, byte before which the last record begins or None)."""

    ranges: list[tuple[str, int, int | None]]


class _Reader(DataSourceReader):
    def __init__(self, uri: str, payloads: bool, split: int, tolerant: bool):
        self.uri, self.payloads, self.split, self.tolerant, self.tests = uri, payloads, split, tolerant, []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if isinstance(f, EqualTo | In) else None
            if column in NAMED and column != "payload_length":
                self.tests.append((NAMED[column], {f.value} if isinstance(f, EqualTo) else set(f.value)))
            else:
                yield f

    def partitions(self):
        store, path = _open(self.uri)
        if store.get_file_info(path).type == fs.FileType.File:
            return [_Ranges([(path, 0, None)])]
        listed = _manifest(store, path)
        sizes = {i.path: i.size for i in store.get_file_info(fs.FileSelector(path)) if i.path.endswith((".warc", ".warc.gz"))}
        if listed is not None:
            sizes = {k: v for k, v in sizes.items() if k.rpartition("/")[2] in listed}
        parts: list[list[tuple[str, int, int | None]]] = []
        room = 0
        for k in sorted(sizes):
            begins = [0, *((listed or {}).get(k.rpartition("/")[2]) or [])]
            for low, high in zip(begins, [*begins[1:], None], strict=True):
                size = (sizes[k] if high is None else high) - low
                if size > room:
                    parts.append([])
                    room = self.split
                parts[-1].append((k, low, high))
                room -= size
        return [_Ranges(p) for p in parts] or [_Ranges([])]

    def read(self, partition):
        store, _ = _open(self.uri)
        wanted = lambda h: all(h.get(name) in values for name, values in self.tests)
        rows, size = [], 0
        for path, begin, end in partition.ranges:
            with store.open_input_file(path) as stream:
                stream.seek(begin)
                for headers, block in read_records(stream, wanted, self.payloads, end, self.tolerant):
                    payload = None
                    if block is not None and headers.get("WARC-Type") != "revisit":
                        payload = block.partition(b"\r\n\r\n")[2] if headers.get("Content-Type", "").startswith("application/http") else block
                    length = headers.get(NAMED["payload_length"])
                    row = {c: headers.get(h) for c, h in NAMED.items()}
                    rows.append(row | {"payload_length": int(length) if length else None, "headers": list(headers.items()), "payload": payload})
                    size += len(payload or b"") + 1000
                    if size > 8 << 20 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class WarcDataSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], self.options.get("payload", "true").lower() != "false", int(self.options.get("split_bytes", 128 << 20)), self.options.get("tolerant", "false").lower() == "true")

    def writer(self, schema, overwrite):
        return _Writer(self.options["path"], overwrite, int(self.options.get("roll_bytes", 1 << 30)))


def register(spark: SparkSession) -> None:
    """Make format("warc") known and let filters reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column."""
    digest, chars = F.sha1(data), []
    for k in range(8):
        twenty = F.conv(F.substring(digest, 5 * k + 1, 5), 16, 10).cast("int")
        chars += [F.substring(F.lit(ALPHABET), F.shiftright(twenty, 5 * (3 - j)).bitwiseAND(31) + 1, F.lit(1)) for j in range(4)]
    return F.concat(*chars)


def with_revisits(rows: DataFrame, least: int = 0) -> DataFrame:
    """rows (id long, target_uri, payload) with record_type, refers_to and digest.

    Of rows with equal payloads of at least `least` bytes the one with the
    largest id is the response and the others revisit it.  Rows that repeat
    that id are responses too; a null id never is referred to.  Only
    (digest, id) pairs are grouped; the digests that occur twice are written
    first, so that Spark sees their size when it plans the join.
    """
    from .common import materialise

    rows = rows.withColumn("digest", sha1_base32(F.col("payload")))
    twice = rows.filter(F.octet_length("payload") >= least).groupBy("digest").agg(F.max("id").alias("original"), F.count("*").alias("n")).filter("n > 1 and original is not null").select("digest", "original")
    twice = materialise(twice, "digests")
    out = rows.join(twice, "digest", "left")
    again = F.col("original").isNotNull() & ~F.col("id").eqNullSafe(F.col("original")) & (F.octet_length("payload") >= least)
    return out.select("id", "target_uri", "payload", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("original")).alias("refers_to"))


def urn(number: Column, kind: str = "page") -> Column:
    return F.concat(F.lit(f"<urn:{kind}:"), number.cast("string"), F.lit(">"))


def number(urn_column: Column) -> Column:
    return F.regexp_extract(urn_column, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def write_archives(rows: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write what with_revisits gives as WARC archives at path.  A null id gets a record id of its digest."""
    register(rows.sparkSession)
    records = rows.select(
        F.coalesce(urn(F.col("id")), F.concat(F.lit("<urn:sha1:"), "digest", F.lit(">"))).alias("record_id"),
        "record_type",
        "target_uri",
        F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        urn(F.col("refers_to")).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_length"),
        F.lit(None).cast("map<string,string>").alias("headers"),
        F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"),
    )
    records.write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True, tolerant: bool = False) -> DataFrame:
    """Records of the archives at path, in partitions of the size that the session has for files."""
    register(spark)
    number, unit = re.match(r"(\d+)([kmgt]?)", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    split = int(number) << 10 * "_kmgt".index(unit or "_")
    return spark.read.format("warc").option("payload", str(payload).lower()).option("tolerant", str(tolerant).lower()).option("split_bytes", split).load(path)
