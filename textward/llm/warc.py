"""WARC archives as a Spark data source, written and read.

    spark.dataSource.register(WarcSource)
    pages.write.format("warc").mode("overwrite").save(folder)
    spark.read.format("warc").schema("record_type string, target_uri string").load(folder)

Files are gzip members, one a record, as the format asks; each member's header
names its compressed length (extra field `sl`), so a reader can step over it.
The reader packs files into partitions by size, takes predicates on record
type and headers, inflates the start of a record until its headers are
complete, and only if they pass and the schema asks for it inflates the rest.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from .common import missing_columns

SCHEMA = ("record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, "
          "content_type string, content_length long, payload_bytes long, headers map<string,string>, payload binary, file string, offset long")
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
#: schema column to header (names fixed by the format)
HEADERS = {"record_id": "warc-record-id", "record_type": "warc-type", "target_uri": "warc-target-uri", "date": "warc-date",
           "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest", "content_type": "content-type"}
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MAGIC = b"\x1f\x8b\x08"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def open_folder(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


# ---------------------------------------------------------------- records

def member(data: bytes, level: int) -> bytes:
    """A gzip member that names its own length: field `sl` holds compressed and inflated length."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 12 + 12 + len(body) + 8
    return (_MAGIC + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + struct.pack("<HII", 8, length & 0xFFFFFFFF, len(data) & 0xFFFFFFFF)
            + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


def one_line(value: str) -> str:
    """Header values cannot hold line ends; they are written as URLs write them."""
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(kind: str, record_id: str, uri: str | None, date: str, payload: bytes, digest: str, n_bytes: int, refers_to: str | None) -> bytes:
    """A response or revisit; the HTTP head of a revisit keeps the length of the payload that it does not repeat."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Date: {date}"]
    if uri is not None:
        head.append(f"WARC-Target-URI: {one_line(uri)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(data: bytes) -> tuple[dict[str, str], int] | None:
    """Headers (names in lower case) and where the block starts; None while they are incomplete."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    name = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and name:
            headers[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            headers[name] = value.strip()
    return headers, end + 4


# ---------------------------------------------------------------- reading

@dataclass
class Files(InputPartition):
    paths: tuple[str, ...]


def packed(sizes: list[tuple[str, int]], most: int) -> list[tuple[str, ...]]:
    """Files in order, as many to a partition as stay within `most` bytes (at least one)."""
    out, now, size = [], [], 0
    for path, n in sizes:
        if now and size + n > most:
            out.append(tuple(now))
            now, size = [], 0
        now.append(path)
        size += n
    return [*out, tuple(now)] if now else out


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.filters: list[tuple] = []
        unknown = [n for n in schema.names if n not in NAMES]
        if unknown:
            raise ValueError(f"no column {', '.join(unknown)} in a WARC record")

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column in HEADERS and isinstance(f, EqualTo | In | IsNotNull | StringStartsWith):
                value = None if isinstance(f, IsNotNull) else set(f.value) if isinstance(f, In) else f.value
                self.filters.append((type(f).__name__, column, value))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        for kind, column, value in self.filters:
            x = row[column]
            if x is None or kind == "EqualTo" and x != value or kind == "In" and x not in value or kind == "StringStartsWith" and not x.startswith(value):
                return False
        return True

    def partitions(self):
        folder, root = open_folder(self.options["path"])
        info = folder.get_file_info(root)
        if info.type == fs.FileType.File:
            sizes = [(root, info.size)]
        else:
            found = {f.base_name: f for f in folder.get_file_info(fs.FileSelector(root))}
            if "_manifest.json" in found:
                with folder.open_input_stream(f"{root}/_manifest.json") as f:
                    names = json.loads(f.read())["files"]
                lost = [n for n in names if n not in found]
                if lost:
                    raise FileNotFoundError(f"{root} lacks {len(lost)} of its files, {lost[0]} for one")
            else:
                names = sorted(n for n in found if n.endswith((".warc", ".warc.gz")))
            sizes = [(found[n].path, found[n].size) for n in names]
        return [Files(p) for p in packed(sizes, int(self.options.get("maxPartitionBytes", 64 << 20)))]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        folder, _ = open_folder(self.options["path"])
        names = self.schema.names
        schema = pa.schema([(f.name, _arrow(f.dataType.simpleString())) for f in self.schema.fields])
        columns: list[list] = [[] for _ in names]
        size = 0
        for path in partition.paths:
            with folder.open_input_file(path) as f:
                for row in (gzip_records if path.endswith(".gz") else plain_records)(f, path, self):
                    for c, n in zip(columns, names, strict=True):
                        c.append(row[n])
                    size += 500 + len(row.get("payload") or b"")
                    if size > 8 << 20:
                        yield _batch(columns, schema)
                        columns, size = [[] for _ in names], 0
        yield _batch(columns, schema)

    def row(self, headers: dict, path: str, offset: int) -> dict:
        row = {c: headers.get(h) for c, h in HEADERS.items()}
        if row["payload_digest"] and row["payload_digest"].startswith("sha1:"):
            row["payload_digest"] = row["payload_digest"][5:]
        return row | {"headers": headers, "file": path, "offset": offset, "content_length": int(headers.get("content-length", 0)),
                      "payload_bytes": None, "payload": None}

    def wants_payload(self, row: dict) -> bool:
        names = self.schema.names
        return "payload" in names or "payload_bytes" in names or self.options.get("verify", "false").lower() == "true"

    def fill(self, row: dict, block: bytes) -> None:
        """Payload, its length and, if asked for, the proof of its digest."""
        http = row["content_type"] is not None and row["content_type"].startswith("application/http")
        at = block.find(b"\r\n\r\n") + 4 if http else 0
        payload = block[at:] if at >= 4 or not http else block
        row["payload_bytes"] = len(payload)
        if row["record_type"] == "revisit":
            head = block[:at].lower()
            told = head.partition(b"\r\ncontent-length:")[2].partition(b"\r\n")[0].strip()
            row["payload_bytes"] = int(told) if told.isdigit() else None
        else:
            row["payload"] = payload
            if self.options.get("verify", "false").lower() == "true" and row["payload_digest"] not in (None, digest_of(payload)):
                raise ValueError(f"{row['file']} at {row['offset']}: the payload of {row['record_id']} does not have its digest")


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}.get(kind) or pa.map_(pa.string(), pa.string())


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([list(x.items()) for x in c] if pa.types.is_map(t.type) else c, t.type)
                                       for c, t in zip(columns, schema, strict=True)], schema=schema)


def gzip_records(f, path: str, reader: WarcReader) -> Iterator[dict]:
    """Records of a file of gzip members.  What a member's headers rule out, or no column asks for, is not inflated."""
    at, end = 0, f.size()
    buffer, base = b"", 0

    def bytes_at(pos: int, n: int) -> bytes:
        nonlocal buffer, base
        if not (base <= pos and pos + n <= base + len(buffer)):
            f.seek(pos)
            buffer, base = f.read(max(n, 1 << 20)), pos
        return buffer[pos - base:pos - base + n]

    while at < end:
        start = bytes_at(at, min(64, end - at))
        length = _named_length(start)
        inflate = zlib.decompressobj(31)
        data, pos, head = b"", at, None
        while head is None:  # headers first
            chunk = bytes_at(pos, min(2048, end - pos))
            if not chunk:
                raise ValueError(f"{path} at {at}: the record ends within its headers")
            data += inflate.decompress(chunk)
            pos += len(chunk)
            head = parse_head(data)
            if inflate.eof and head is None:
                raise ValueError(f"{path} at {at}: no WARC headers")
        headers, body = head
        row = reader.row(headers, path, at)
        wanted = reader.passes(row)
        payload = wanted and reader.wants_payload(row)
        parts, inflated = [data], len(data)
        if payload or length is None:
            while not inflate.eof:
                chunk = bytes_at(pos, min(1 << 16, end - pos))
                if not chunk:
                    raise ValueError(f"{path} at {at}: the record is cut off")
                got = inflate.decompress(chunk)
                pos += len(chunk)
                inflated += len(got)
                if payload:
                    parts.append(got)
            length = pos - len(inflate.unused_data) - at
            if inflated > body + row["content_length"] + 4:
                raise ValueError(f"{path} at {at}: a member with more than one record; records must be compressed one by one")
        if payload:
            reader.fill(row, b"".join(parts)[body:body + row["content_length"]])
        if wanted:
            yield row
        at += length


def _named_length(start: bytes) -> int | None:
    if start[:3] != _MAGIC:
        raise ValueError("not a gzip member")
    if start[3] & 4 and start[12:14] == b"sl":
        return struct.unpack("<I", start[16:20])[0] or None
    return None


def plain_records(f, path: str, reader: WarcReader) -> Iterator[dict]:
    """Records of an uncompressed file; blocks that nobody asks for are stepped over."""
    at, end = 0, f.size()
    while at < end:
        data, head = b"", None
        while head is None:
            f.seek(at + len(data))
            chunk = f.read(4096)
            if not chunk:
                raise ValueError(f"{path} at {at}: the record ends within its headers")
            data += chunk
            head = parse_head(data)
        headers, body = head
        row = reader.row(headers, path, at)
        if reader.passes(row):
            if reader.wants_payload(row):
                f.seek(at + body)
                reader.fill(row, f.read(row["content_length"]))
            yield row
        at += body + row["content_length"] + 4


# ---------------------------------------------------------------- writing

@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class WarcWriter(DataSourceArrowWriter):
    """Columns record_id, record_type, target_uri, date, payload, payload_digest, payload_bytes, refers_to.

    Each attempt of a task writes files of names of its own; the manifest that
    the commit writes names those of the attempts that count, and the reader
    reads no others.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite = options, overwrite

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        folder, root = open_folder(self.options["path"])
        folder.create_dir(root, recursive=True)
        most, level = int(self.options.get("maxFileBytes", 64 << 20)), int(self.options.get("level", 4))
        files, out = [], None
        try:
            for batch in batches:
                for r in batch.to_pylist():
                    if out is None or out.tell() >= most:
                        if out is not None:
                            out.close()
                        files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                        out = folder.open_output_stream(f"{root}/{files[-1]}", compression=None)
                        out.write(member(info_record(files[-1]), level))
                    payload = r["payload"] or b""
                    out.write(member(record(r["record_type"], r["record_id"], r["target_uri"], r["date"], payload,
                                            r["payload_digest"], r["payload_bytes"], r["refers_to"]), level))
        finally:
            if out is not None:
                out.close()
        return Written(files)

    def commit(self, messages) -> None:
        folder, root = open_folder(self.options["path"])
        folder.create_dir(root, recursive=True)
        files = sorted(f for m in messages if m is not None for f in m.files)
        manifest = f"{root}/_manifest.json"
        if not self.overwrite and folder.get_file_info(manifest).type == fs.FileType.File:
            with folder.open_input_stream(manifest) as f:
                files = sorted({*files, *json.loads(f.read())["files"]})
        with folder.open_output_stream(manifest) as f:
            f.write(json.dumps({"files": files}).encode())

    def abort(self, messages) -> None:
        folder, root = open_folder(self.options["path"])
        for m in messages:
            for name in m.files if m is not None else ():
                folder.delete_file(f"{root}/{name}")


def info_record(name: str) -> bytes:
    block = b"software: textward\r\nformat: WARC File Format 1.1\r\n"
    head = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>",
            f"WARC-Date: {datetime.now(UTC):%Y-%m-%dT%H:%M:%SZ}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields",
            f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_warc(spark: SparkSession, path: str, columns: str = SCHEMA, **options) -> DataFrame:
    """Records below `path` (a file, a folder written here, or a folder of .warc and .warc.gz files).

    `columns` is a schema: without `payload` and `payload_bytes` no block is
    decoded.  `verify="true"` fails on a payload that does not have its digest.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)
    return spark.read.format("warc").schema(columns).options(**options).load(path)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", body: str = "html", min_bytes: int = 0,
               date: str = "2024-01-01T00:00:00Z") -> None:
    """A record per row.  Of rows with equal payloads of at least `min_bytes`, the one with the largest key is a response, others revisit it.

    NULL bodies are empty payloads, NULL URIs leave the header out.  Record ids
    are urn:key:<key>, so a revisit needs no lookup to name its response; rows
    that repeat a key of a kept payload are responses too.  Payloads are grouped
    by SHA-256, since different payloads of one SHA-1, the format's digest, can be made; the sums are formed before the shuffle, and the join that brings
    the largest key to each row is one whose hot keys Spark splits.
    """
    missing_columns(pages, key, uri, body)
    spark = pages.sparkSession
    spark.dataSource.register(WarcSource)
    rows = pages.select(F.col(key).alias("key"), F.col(uri).cast("string").alias("target_uri"),
                        F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"sha1": F.unhex(F.sha1("payload")), "sha256": F.unhex(F.sha2("payload", 256)),
                             "payload_bytes": F.octet_length("payload").cast("long")})
    repeated = (rows.where(F.col("payload_bytes") >= min_bytes).groupBy("sha256").agg(F.count("*").alias("n"), F.max("key").alias("keep"))
                .where("n > 1").drop("n"))
    named = rows.join(repeated, "sha256", "left")
    revisit = F.col("keep").isNotNull() & (F.col("payload_bytes") >= min_bytes) & ~F.col("key").eqNullSafe(F.col("keep"))
    name = lambda c: F.concat(F.lit("<urn:key:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    (named.select(name(F.col("key")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri",
                  F.lit(date).alias("date"), F.when(~revisit, F.col("payload")).alias("payload"), base32(F.col("sha1")).alias("payload_digest"),
                  "payload_bytes", F.when(revisit, name(F.col("keep"))).alias("refers_to"))
     .write.format("warc").mode("overwrite").save(path))


def base32(digest):
    """Base 32 of 20 bytes: eight groups of five bits from each 40, looked up in the alphabet."""
    alphabet = F.array(*[F.lit(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    out = []
    for i in range(4):
        word = F.conv(F.hex(F.substring(digest, 5 * i + 1, 5)), 16, 10).cast("long")
        out += [alphabet[F.shiftright(word, 35 - 5 * k).bitwiseAND(F.lit(31)).cast("int")] for k in range(8)]
    return F.concat(*out)


def key_of(record_id, kind: str = "long"):
    """The key in a record id made here; NULL for the empty key."""
    text = F.regexp_extract(record_id, "^<urn:key:(.*)>$", 1)
    return F.when(text != "", text).cast(kind)
