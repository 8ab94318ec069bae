"""Media columns: payloads as 8-bit greyscale PNG members of ZIP archives, and a data source
that reads them by byte ranges.

``store`` writes archives to the shared folder from the executors and returns what has been
committed; ``ArchiveSource`` plans partitions as byte ranges of the archives, without opening
them on the driver. A task reads an archive's central directory, takes the members whose
headers begin in its range, and streams them in Arrow batches; a member that can't be read or
fails its checksum is tried again by its own offset, whatever becomes of the others.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from netloom.llm.common import map_batches, materialise, scratch_path

WIDTH = 64
#: Bytes of media in an archive, at most but for the last member.
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
TRIES = 4
_PNG = b"\x89PNG\r\n\x1a\n"


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 of the text (null: empty) with zeros up to a positive multiple of 64; its length
    without them."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % WIDTH if raw else WIDTH), len(raw)


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, n_bytes: int) -> bytes:
    """One sample a byte, 64 to a row, unfiltered; the length without padding as text."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return b"".join(
        [_PNG, _chunk(b"IHDR", head), _chunk(b"tEXt", b"bytes\0" + str(n_bytes).encode()), _chunk(b"IDAT", zlib.compress(raw.tobytes(), 3)), _chunk(b"IEND", b"")]
    )


def decode_png(media: bytes) -> tuple[bytes, int]:
    """Payload and unpadded length of what ``encode_png`` made; chunks are checked."""
    if media[:8] != _PNG:
        raise ValueError("not a PNG file")
    at, data, n, size = 8, [], 0, (0, 0)
    while at < len(media):
        (length,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + length]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + length : at + 12 + length])[0]:
            raise ValueError(f"damaged chunk at byte {at}")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"bytes\0"):
            n = int(body[6:])
        at += 12 + length
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes(), n


def feature_of(payload: bytes) -> str:
    """Mean, deviation, entropy in bits, share of bytes over 127, and mean step of the samples."""
    x = np.frombuffer(payload, np.uint8)
    h = np.bincount(x, minlength=256)
    p = h[h > 0] / len(x)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    got = (x.mean(), x.std(), -(p * np.log2(p)).sum(), (x > 127).mean(), step)
    return ",".join(f"{v + 0.0:.6f}" for v in got)


class _Archives:
    """Archives that one task writes, and the rows that commit them."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.scheme = folder[: len(folder) - len(self.folder)] if folder.endswith(self.folder) else ""
        self.zip = None

    def add(self, name: str, media: bytes) -> None:
        if self.zip is None:
            self.path, self.n, self.bytes = f"{self.folder}/{uuid.uuid4().hex}.zip", 0, 0
            self.stream = self.fs.open_output_stream(self.path)
            self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)
        self.zip.writestr(zipfile.ZipInfo(name), media)
        self.n += 1
        self.bytes += len(media)

    def close(self) -> tuple[str, int, int]:
        self.zip.close()
        self.stream.close()
        self.zip = None
        return self.scheme + self.path, self.fs.get_file_info(self.path).size, self.n


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write every text's payload to archives below ``folder``; ``(path, bytes, members)`` of the
    committed ones. What a lost or repeated attempt has written is in no committed row."""

    def run(batches):
        out, done = _Archives(folder), []
        for pdf in batches:
            for doc, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                out.add("null" if pd.isna(doc) else str(int(doc)), encode_png(*payload_of(text)))
                if out.bytes >= ARCHIVE_BYTES:
                    done.append(out.close())
        if out.zip is not None:
            done.append(out.close())
        yield pd.DataFrame(done, columns=["path", "bytes", "members"])

    # ids as strings: a nullable integer would pass through floating point
    rows = docs.select(F.col("doc_id").cast("bigint").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(map_batches(rows, run, "path string, bytes bigint, members bigint"), "archives")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class ArchiveSource(DataSource):
    """``spark.read.format("netloom_archives").option("manifest", uri).load()``: members of the
    archives that the manifest lists (JSON lines of path and bytes)."""

    @classmethod
    def name(cls) -> str:
        return "netloom_archives"

    def schema(self) -> str:
        return "path string, offset bigint, member string, media binary"

    def reader(self, schema):
        return ArchiveReader(self.options)


class ArchiveReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.manifest = options["manifest"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self):
        fs, path = pyarrow.fs.FileSystem.from_uri(self.manifest)
        with fs.open_input_stream(path) as f:
            listed = [json.loads(x) for x in f.read().decode().splitlines()]
        return [ByteRange(x["path"], at, min(at + self.split, x["bytes"])) for x in listed for at in range(0, x["bytes"], self.split)] or [ByteRange("", 0, 0)]

    def read(self, partition):
        if not partition.path:
            return
        fs, path = pyarrow.fs.FileSystem.from_uri(partition.path)
        with fs.open_input_file(path) as f, zipfile.ZipFile(f) as z:
            mine = sorted((i for i in z.infolist() if partition.start <= i.header_offset < partition.end), key=lambda i: i.header_offset)
        rows: list[tuple] = []
        held = 0
        for info in mine:
            media = read_member(fs, path, info)
            rows.append((partition.path, info.header_offset, info.filename, media))
            held += len(media)
            if held >= BATCH_BYTES:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.binary())
    cols = [pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    return pa.RecordBatch.from_arrays(cols, ["path", "offset", "member", "media"])


def read_member(fs, path: str, info: zipfile.ZipInfo, tries: int = TRIES) -> bytes:
    """A stored member's bytes, by its offset; opened anew at each try."""
    for left in range(tries - 1, -1, -1):
        try:
            with fs.open_input_file(path) as f:
                f.seek(info.header_offset)
                head = f.read(30)
                if head[:4] != b"PK\x03\x04":
                    raise OSError("no member header")
                name, extra = struct.unpack("<HH", head[26:30])
                f.seek(info.header_offset + 30 + name + extra)
                data = f.read(info.file_size)
            if len(data) != info.file_size or zlib.crc32(data) != info.CRC:
                raise OSError("checksum differs")
            return data
        except OSError as e:
            if not left:
                raise OSError(f"{path}: member {info.filename} at byte {info.header_offset} can't be read: {e}") from e
    raise AssertionError


def load(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """The members of committed archives, through the data source."""
    spark.dataSource.register(ArchiveSource)
    uri = scratch_path(spark, "manifest.jsonl")
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as f:
        for r in archives.select("path", "bytes").orderBy("path").toLocalIterator():  # a row for each 64 MB
            f.write(json.dumps(r.asDict()).encode() + b"\n")
    return spark.read.format("netloom_archives").option("manifest", uri).load()


def digests(docs: DataFrame) -> DataFrame:
    """Store, read back and describe every text's payload: ``(doc_id, n_bytes, payload_bytes,
    payload_sha256, tail_crc32, media_bytes, media_sha256, feature)``, a row for a row.

    Null texts are as empty ones: 64 zero bytes. A null doc_id stays null. An empty table
    gives no rows. Equal texts give equal values. Other columns are ignored.
    """
    members = load(docs.sparkSession, store(docs, scratch_path(docs.sparkSession, "media")))

    def run(batches):
        for pdf in batches:
            out = []
            for member, media in zip(pdf["member"], pdf["media"], strict=True):
                media = bytes(media)
                payload, n = decode_png(media)
                out.append(
                    (member, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload))
                )
            yield pd.DataFrame(out, columns=["member", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    got = map_batches(
        members.select("member", "media"), run, "member string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    )
    return got.select(F.expr("try_cast(member AS bigint)").alias("doc_id"), *got.columns[1:])
