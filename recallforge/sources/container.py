"""The single-file container of entries as a Spark data source, for reading and writing.

Layout, little-endian: header length and a reserved word, header JSON, tokens
(length, bytes, number), entry count, entries (flags, payload length, key bits,
[vector block], payload JSON), extension blocks (name, bytes).
"""

from __future__ import annotations

import glob
import json
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

# Flag bits and limits of the format.
DELETED, BINVEC, COMPRESSED, ENCRYPTED, KIND_SHIFT, KIND_MASK = 0x1, 0x2, 0x4, 0x8, 4, 0xFF << 4
MAX_DIMS, MAX_ENTRIES, MAX_VOCAB, MAX_TOKEN, MAX_BLOCK = 8192, 10_000_000, 1_000_000, 1024, 64 << 20
READ_VERSION, WRITE_VERSION = 5, 4

SCHEMA = "path string, entry_id bigint, key_bits binary, payload string, deleted boolean, kind int, encrypted boolean, binvec binary, header string"


class FormatError(ValueError):
    """A container is malformed or incompatible."""


class _Cursor:
    def __init__(self, blob: bytes):
        self.blob, self.at = blob, 0

    def take(self, n: int, most: int | None = None, what: str = "block") -> bytes:
        if most is not None and n > most:
            raise FormatError(f"{what} too large: {n}")
        if self.at + n > len(self.blob):
            raise FormatError("truncated file")
        self.at += n
        return self.blob[self.at - n : self.at]

    def numbers(self, fmt: str) -> tuple:
        return struct.unpack("<" + fmt, self.take(struct.calcsize("<" + fmt)))


@dataclass
class Record:
    key_bits: bytes
    payload: str
    deleted: bool = False
    kind: int = 0
    encrypted: bool = False
    binvec: bytes = b""


def parse(blob: bytes) -> tuple[dict, list[Record], dict[str, bytes]]:
    """Header, entries and extension blocks; anything out of order raises FormatError."""
    c = _Cursor(blob)
    size, _ = c.numbers("II")
    try:
        header = json.loads(c.take(size).decode())
    except (UnicodeDecodeError, ValueError) as e:
        raise FormatError(f"bad header: {e}") from e
    if not isinstance(header, dict):
        raise FormatError("bad header")
    version, dims = header.get("version", 1), header.get("dims", 0)
    if not isinstance(version, int) or version > READ_VERSION:
        raise FormatError(f"unsupported version: {version}")
    if not isinstance(dims, int) or not 8 <= dims <= MAX_DIMS or dims % 8:
        raise FormatError(f"invalid dims: {dims}")
    (tokens,) = c.numbers("I")
    if tokens > MAX_VOCAB:
        raise FormatError(f"too many tokens: {tokens}")
    for _ in range(tokens):
        (n,) = c.numbers("I")
        c.take(n, MAX_TOKEN, "token")
        c.numbers("I")
    (entries,) = c.numbers("Q")
    if entries > MAX_ENTRIES:
        raise FormatError(f"too many entries: {entries}")
    found = []
    for _ in range(entries):
        flags, n = c.numbers("HI")
        if n > MAX_BLOCK:
            raise FormatError(f"payload too large: {n}")
        key = c.take(dims // 8)
        vec = c.take(c.numbers("I")[0], MAX_BLOCK, "vector block") if flags & BINVEC else b""
        body = c.take(n)
        if flags & COMPRESSED:
            body = _decompress(body)
        try:
            payload = body.decode()
        except UnicodeDecodeError as e:
            raise FormatError("bad payload") from e
        found.append(Record(key, payload, bool(flags & DELETED), (flags & KIND_MASK) >> KIND_SHIFT, bool(flags & ENCRYPTED), vec))
    (blocks,) = c.numbers("I")
    more = {}
    for _ in range(blocks):
        name = c.take(c.numbers("I")[0], MAX_BLOCK).decode()
        more[name] = c.take(c.numbers("I")[0], MAX_BLOCK)
    if c.at != len(blob):
        raise FormatError(f"trailing bytes: read {c.at} of {len(blob)}")
    return header, found, more


def _decompress(body: bytes) -> bytes:
    (size,) = struct.unpack_from("<I", body) if len(body) >= 4 else (MAX_BLOCK + 1,)
    if size > MAX_BLOCK:
        raise FormatError(f"decompressed payload too large: {size}")
    try:
        return pa.decompress(body[4:], decompressed_size=size, codec="lz4_raw", asbytes=True)
    except (pa.ArrowInvalid, OSError) as e:
        raise FormatError(f"bad compressed payload: {e}") from e


def compose(header: dict, records: list[Record], blocks: dict[str, bytes] | None = None, compress: bool = True) -> bytes:
    """A container's bytes; payloads of 128 bytes or more are compressed if that makes them smaller."""
    dims = header["dims"]
    head = json.dumps({"version": WRITE_VERSION, **header}, ensure_ascii=False, sort_keys=True).encode()
    out = [struct.pack("<II", len(head), 0), head, struct.pack("<I", 0), struct.pack("<Q", len(records))]
    for r in records:
        if len(r.key_bits) != dims // 8:
            raise FormatError(f"key is {len(r.key_bits)} bytes, expected {dims // 8}")
        body, flags = r.payload.encode(), (r.kind << KIND_SHIFT) & KIND_MASK
        if compress and len(body) >= 128:
            small = struct.pack("<I", len(body)) + pa.compress(body, codec="lz4_raw", asbytes=True)
            if len(small) < len(body):
                body, flags = small, flags | COMPRESSED
        flags |= (DELETED if r.deleted else 0) | (BINVEC if r.binvec else 0) | (ENCRYPTED if r.encrypted else 0)
        out.append(struct.pack("<HI", flags, len(body)) + r.key_bits)
        out += [struct.pack("<I", len(r.binvec)), r.binvec] if r.binvec else []
        out.append(body)
    out.append(struct.pack("<I", len(blocks or {})))
    for name, data in (blocks or {}).items():
        out += [struct.pack("<I", len(name.encode())), name.encode(), struct.pack("<I", len(data)), data]
    return b"".join(out)


def rows_of(path: str, blob: bytes) -> Iterator[tuple]:
    header, records, _ = parse(blob)
    head = json.dumps(header, sort_keys=True, ensure_ascii=False)
    for i, r in enumerate(records):
        yield path, i, r.key_bits, r.payload, r.deleted, r.kind, r.encrypted, r.binvec or None, head


def scan(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("session",), pattern: str = "*.cart"):
    """Entries of all containers below a folder, through Spark's file reader; files that don't parse give one row with ``error``.

    Names come from relative paths with ``/`` as ``__``; files with a stem in
    ``skip`` and containers of private types are left out.
    """
    from pyspark.sql import functions as F

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")
    schema = "cartridge string, " + SCHEMA + ", error string"
    root = folder.rstrip("/").split("://")[-1]

    def run(batches):
        import pandas as pd

        names = [f.strip().split()[0] for f in schema.split(", ")]
        for b in batches:
            rows = []
            for path, blob in zip(b["path"], b["content"], strict=True):
                rel = path.split(root, 1)[-1].lstrip("/")
                name = rel.rsplit(".", 1)[0].replace("/", "__")
                if rel.rsplit("/", 1)[-1].rsplit(".", 1)[0] in skip:
                    continue
                try:
                    header = parse(bytes(blob))[0]
                    kind = (header.get("extra") or {}).get("cartridge_type")
                    if kind not in ("vault", "agent"):
                        rows += [(name, *r, None) for r in rows_of(path, bytes(blob))]
                except FormatError as e:
                    rows.append((name, path, *[None] * 8, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return files.mapInPandas(run, schema).withColumn("entry_id", F.col("entry_id").cast("bigint"))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class ContainerReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from rows_of(partition.path, f.read())


@dataclass
class _Part(WriterCommitMessage):
    aside: str
    path: str
    rows: int


class ContainerWriter(DataSourceWriter):
    """One container a partition under the path: written aside by the tasks and renamed when all of them are done.

    Names hold the job's id, so appending adds files and never replaces those of
    an earlier job; what failed or repeated tasks wrote aside is taken away.
    """

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.names = options["path"], schema.fieldNames()
        self.header = json.loads(options.get("header", '{"dims": 1024}'))
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> _Part:
        from pyspark import TaskContext

        records = []
        for row in iterator:
            r = dict(zip(self.names, row, strict=True))
            records.append(Record(bytes(r["key_bits"]), r["payload"], bool(r.get("deleted")), int(r.get("kind") or 0), bool(r.get("encrypted")), bytes(r.get("binvec") or b"")))
        os.makedirs(self.folder, exist_ok=True)
        task = TaskContext.get()
        path = f"{self.folder}/part-{task.partitionId():05d}-{self.job}.cart"
        aside = f"{path}.{task.taskAttemptId()}.tmp"
        with open(aside, "wb") as f:
            f.write(compose(self.header, records))
        return _Part(aside, path, len(records))

    def commit(self, messages: list[_Part | None]) -> None:
        for m in filter(None, messages):
            os.replace(m.aside, m.path)
        self._clear()

    def abort(self, messages: list[_Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        for left in glob.glob(f"{glob.escape(self.folder)}/part-*-{self.job}.cart.*.tmp"):
            os.remove(left)


class ContainerSource(DataSource):
    """``spark.read.format("container").load(path)`` and ``df.write.format("container").mode("append").save(folder)``, on a file system that all machines mount."""

    @classmethod
    def name(cls) -> str:
        return "container"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ContainerReader:
        return ContainerReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> ContainerWriter:
        return ContainerWriter(self.options, schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ContainerSource)
