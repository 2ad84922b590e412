"""WARC archives as a Spark data source: planned splits, predicates on headers, payloads decoded only where wanted."""

from __future__ import annotations

import gzip
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition,
                                    IsNotNull, StringStartsWith, WriterCommitMessage)

from .shared import new_folder

VERSION = b"WARC/1.1"
MANIFEST = "_manifest.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2000-01-01T00:00:00Z"
MIN_REVISIT = 1000  # bytes
ROWS_AT_ONCE = 256

#: Column of the source -> WARC header that it shows.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "record_date": "WARC-Date",
    "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest", "payload_bytes": "WARC-Payload-Length",
    "page": "WARC-Page-ID",
}
SCHEMA = ("record_type string, record_id string, target_uri string, record_date string, refers_to string, payload_digest string, "
          "payload_bytes long, page long, payload binary")
NUMBERS = ("payload_bytes", "page")
_COLUMN_OF = {h.lower(): c for c, h in HEADERS.items()}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def _clean(value: str) -> str:
    """A header value on one line: percent signs, line ends and control characters as %XX."""
    return "".join(c if c not in "%\r\n" and c >= " " else f"%{ord(c):02X}" for c in value)


def _plain(value: str) -> str:
    if "%" not in value:
        return value
    parts = value.split("%")
    return parts[0] + "".join(chr(int(p[:2], 16)) + p[2:] for p in parts[1:])


def record_bytes(headers: dict[str, object], block: bytes) -> bytes:
    lines = [VERSION] + [f"{k}: {_clean(str(v))}".encode() for k, v in headers.items() if v is not None]
    lines.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


def gzip_member(raw: bytes) -> bytes:
    """A gzip member of its own whose extra field "sl" holds its compressed and plain length, so readers can jump over it."""
    pack = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = pack.compress(raw) + pack.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<H", 8)
    return head + struct.pack("<II", len(head) + 8 + len(body) + 8, len(raw) & 0xFFFFFFFF) + body \
        + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def skip_length(data: bytes, at: int) -> int | None:
    """Compressed length of the gzip member at ``at`` from its "sl" field."""
    if data[at:at + 4] == b"\x1f\x8b\x08\x04" and data[at + 12:at + 14] == b"sl":
        return struct.unpack_from("<I", data, at + 16)[0]
    return None


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task writes archives of its own name; only files of committed tasks enter the manifest, so files that a lost
    executor leaves behind are never read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.gzip = options["path"], options.get("compression", "gzip") == "gzip"
        self.split = int(options.get("splitBytes", 8 << 20))
        self.roll = int(options.get("fileBytes", 1 << 30))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files, out, at, splits = [], None, 0, []
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    name = f"part-{uuid.uuid4().hex}.warc" + (".gz" if self.gzip else "")
                    out, at, splits = store.open_output_stream(f"{folder}/{name}", compression=None), 0, [0]
                payload = row.pop("payload")
                headers = {h: row[c] for c, h in HEADERS.items() if row[c] is not None}
                length = row["payload_bytes"]
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
                if row["record_type"] == "revisit":
                    headers["WARC-Profile"] = PROFILE
                    block = http
                else:
                    block = http + (payload or b"")
                headers["Content-Type"] = "application/http; msgtype=response"
                raw = record_bytes(headers, block)
                raw = gzip_member(raw) if self.gzip else raw
                if at - splits[-1] >= self.split:
                    splits.append(at)
                out.write(raw)
                at += len(raw)
                if at >= self.roll:
                    out.close()
                    files.append([name, at, splits])
                    out = None
        if out is not None:
            out.close()
            files.append([name, at, splits])
        return Written(files)

    def commit(self, messages) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        with store.open_output_stream(f"{folder}/{MANIFEST}", compression=None) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages) -> None:
        """Nothing to undo: without a manifest entry no file is read."""


class WarcReader(DataSourceReader):
    """``payload`` option: true (default) or false. Predicates on header columns are checked before a payload is read."""

    def __init__(self, options: dict[str, str]):
        self.path, self.payload = options["path"], options.get("payload", "true") == "true"
        self.checks: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column not in HEADERS:
                yield f
            elif isinstance(f, EqualTo):
                self.checks.append((column, "in", {f.value}))
            elif isinstance(f, In):
                self.checks.append((column, "in", set(f.value)))
            elif isinstance(f, StringStartsWith):
                self.checks.append((column, "starts", f.value))
            elif isinstance(f, IsNotNull):
                self.checks.append((column, "some", None))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        store, folder = _store(self.path)
        try:
            with store.open_input_stream(f"{folder}/{MANIFEST}", compression=None) as f:
                files = json.loads(f.read())
        except FileNotFoundError:
            found = store.get_file_info(pafs.FileSelector(folder, recursive=True))
            files = [[f.path[len(folder) + 1:], f.size, [0]] for f in found if f.path.endswith((".warc", ".warc.gz"))]
        return [InputPartition((name, a, b)) for name, size, splits in files for a, b in zip(splits, [*splits[1:], size])]

    def _wanted(self, row: dict) -> bool:
        for column, kind, value in self.checks:
            v = row[column]
            if v is None or kind == "in" and v not in value or kind == "starts" and not v.startswith(value):
                return False
        return True

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what Spark hands over when there is nothing to read
            return
        name, start, end = partition.value
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/{name}") as raw:
            known = name.endswith(".gz") and skip_length(raw.read_at(32, start), 0)
            raw.seek(start)
            if not name.endswith(".gz"):
                rows = self._rows(raw, end)
            elif not known:  # of another writer
                rows = self._rows(gzip.GzipFile(fileobj=raw), None)
            else:
                rows = self._member_rows(raw.read_at(end - start, start))
            held, size = [], 0
            for row in rows:
                held.append(row)
                size += len(row["payload"] or b"")
                if len(held) >= ROWS_AT_ONCE or size > 8 << 20:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        kinds = {**{c: pa.int64() if c in NUMBERS else pa.string() for c in HEADERS}, "payload": pa.binary()}
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds[c]) for c in kinds], list(kinds))

    @staticmethod
    def _headers(head: bytes) -> tuple[dict, int]:
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        row, length = dict.fromkeys([*HEADERS, "payload"]), 0
        for line in lines[1:]:
            k, _, v = line.partition(":")
            k, v = k.strip().lower(), v.strip()
            if k == "content-length":
                length = int(v)
            elif k in _COLUMN_OF:
                row[_COLUMN_OF[k]] = int(v) if _COLUMN_OF[k] in NUMBERS else _plain(v)
        return row, length

    @staticmethod
    def _payload(block: bytes) -> bytes:
        """What follows the HTTP header of a record's block."""
        return block.split(b"\r\n\r\n", 1)[1] if b"\r\n\r\n" in block else block

    def _member_rows(self, data: bytes) -> Iterator[dict]:
        """Records of members with known lengths: the headers are unpacked, the rest only where it is wanted."""
        at = 0
        while at < len(data):
            size = skip_length(data, at)
            if not size:
                raise ValueError("a gzip member without its length")
            unpack, head = zlib.decompressobj(31), b""
            tail = data[at:at + size]
            while b"\r\n\r\n" not in head:
                part = unpack.decompress(tail, 1024)
                if not part:
                    raise ValueError("an archive ends within a record's headers")
                head, tail = head + part, unpack.unconsumed_tail
            head, rest = head.split(b"\r\n\r\n", 1)
            row, length = self._headers(head)
            if self._wanted(row):
                if self.payload and row["record_type"] != "revisit":
                    row["payload"] = self._payload((rest + unpack.decompress(tail) + unpack.flush())[:length])
                yield row
            at += size

    def _rows(self, f, end: int | None) -> Iterator[dict]:
        """Records up to ``end``: headers first, then the payload or a jump over it."""
        buffered = b""
        while True:
            while b"\r\n\r\n" not in buffered:
                more = f.read(2048) if end is None or f.tell() < end else b""
                if not more:
                    if buffered.strip():
                        raise ValueError("an archive ends within a record's headers")
                    return
                buffered += more
                buffered = buffered.lstrip(b"\r\n") if not buffered.startswith(b"WARC/") else buffered
            head, buffered = buffered.split(b"\r\n\r\n", 1)
            row, length = self._headers(head)
            wanted = self._wanted(row)
            take = wanted and self.payload and row["record_type"] != "revisit"
            if take:
                if len(buffered) < length:
                    buffered += f.read(length - len(buffered))
                if len(buffered) < length:
                    raise ValueError("an archive ends within a record")
                row["payload"] = self._payload(buffered[:length])
                buffered = buffered[length:]
            elif len(buffered) >= length:
                buffered = buffered[length:]
            else:
                f.seek(length - len(buffered), 1)
                buffered = b""
            buffered = buffered[4:] if buffered.startswith(b"\r\n\r\n") else buffered
            if wanted:
                yield row
            if end is not None and f.tell() - len(buffered) >= end - 4:
                return


class WarcSource(DataSource):
    """``spark.read.format("vigilar_warc")``; columns of SCHEMA. Options: path, payload; writing: compression (gzip, none),
    splitBytes, fileBytes. A folder without a manifest is read whole, one split per file."""

    @classmethod
    def name(cls) -> str:
        return "vigilar_warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def record_name(page: Column) -> Column:
    return F.concat(F.lit("<urn:vigilar:page:"), F.coalesce(page.cast("string"), F.lit("null")), F.lit(">"))


def archive_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """One WARC record per row: of equal payloads of at least ``min_revisit`` bytes the one with the largest key is the
    response, the others revisit it. A null payload is empty. Rows that share that largest key are all responses; without
    any key all are. Counting copies is a pre-aggregation by digest; a hot digest is split by Spark's skew join."""
    body = F.coalesce(F.col(html).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(key).cast("long").alias("page"), F.col(url).cast("string").alias("target_uri"), body.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    slim = pages.select(F.col(key).cast("long").alias("page"), body.alias("payload")).filter(F.octet_length("payload") >= min_revisit)
    groups = slim.select("page", F.sha1("payload").alias("digest")).groupBy("digest") \
        .agg(F.max("page").alias("top"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").select("digest", "top")
    joined = rows.join(groups, (F.col("payload_digest") == F.col("digest")) & (F.col("payload_bytes") >= min_revisit), "left")
    revisit = F.col("top").isNotNull() & ~F.col("page").eqNullSafe(F.col("top"))
    return joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), record_name(F.col("page")).alias("record_id"), "target_uri",
        F.lit(DATE).alias("record_date"), F.when(revisit, record_name(F.col("top"))).alias("refers_to"), "payload_digest", "payload_bytes",
        "page", F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str, compression: str = "gzip", **columns: str) -> None:
    register(pages.sparkSession)
    archive_records(pages, **columns).write.format("vigilar_warc").mode("append").option("compression", compression).save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("vigilar_warc").option("payload", str(payload).lower()).load(path)


def round_trip(pages: DataFrame, **columns: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page from archives written for it.

    Responses are decoded and measured anew; revisits are read from headers alone.
    """
    spark = pages.sparkSession
    path = new_folder(spark, "warc")
    write_archives(pages, path, **columns)
    full = read_archives(spark, path).filter("record_type = 'response'") \
        .select("page", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    short = read_archives(spark, path, payload=False).filter("record_type = 'revisit'") \
        .select("page", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.union(short).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                                    F.regexp_extract("refers_to", r"page:(-?\d+)>", 1).try_cast("long").alias("refers_to"))
