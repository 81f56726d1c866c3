"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

A payload is stored without loss as an 8-bit greyscale PNG of 64 samples a row. Its
name in the shard is the SHA-256 of the stored bytes. A task writes shards of its
own and stores equal payloads once in each, so a shard can be read by itself, in
order, wherever it is; rows carry digest, shard, offset and length. Nothing is
shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import fresh_dir, slices, text_of, written

WIDTH = 64
MAGIC = b"\x89PNG\r\n\x1a\n"  # fixed value of the format
HEADER = len(MAGIC) + 25 + 20  # signature, image header, the chunk with the unpadded length


def pad(data: bytes) -> bytes:
    """``data`` with zeros up to a positive multiple of WIDTH."""
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\0")


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, length: int, level: int = 1) -> bytes:
    """The payload as pixels, with its unpadded length in a private chunk before the data."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # each row begins with its filter, 0: none
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return MAGIC + _chunk(b"IHDR", head) + _chunk(b"txLn", struct.pack(">Q", length)) + _chunk(b"IDAT", zlib.compress(lines, level)) + _chunk(b"IEND", b"")


def png_header(data: bytes) -> dict[str, int]:
    """width, height, bit_depth, n_bytes (unpadded) from the first HEADER bytes."""
    if data[: len(MAGIC)] != MAGIC or data[12:16] != b"IHDR" or data[37:41] != b"txLn":
        raise ValueError("not a stored payload")
    width, height, depth = struct.unpack(">IIB", data[16:25])
    return {"width": width, "height": height, "bit_depth": depth, "n_bytes": struct.unpack(">Q", data[41:49])[0]}


def from_png(data: bytes) -> bytes:
    """The samples of a stored payload; checks every chunk's checksum."""
    head, at, packed = png_header(data), len(MAGIC), b""
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"bad checksum of chunk {kind!r}")
        if kind == b"IDAT":
            packed += body
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(head["height"], head["width"] + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows aren't written here")
    return lines[:, 1:].tobytes()


def features(samples: bytes) -> str:
    """Sample count, mean, deviation, entropy and share of zeros, as text of six places."""
    counts = np.bincount(np.frombuffer(samples, np.uint8), minlength=256)
    n, values = int(counts.sum()), np.arange(256)
    mean = int((counts * values).sum()) / n
    spread = max(0.0, int((counts * values * values).sum()) / n - mean * mean) ** 0.5
    shares = counts[counts > 0] / n
    return f"n={n};mean={mean:.6f};std={spread:.6f};entropy={float(-(shares * np.log2(shares)).sum()):.6f};zeros={int(counts[0]) / n:.6f}"


class ShardWriter:
    """Tar shards of one task, a new one at ``most`` bytes; equal media are stored once in a shard."""

    def __init__(self, folder: str, most: int = 256 << 20):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.scheme, self.most, self.file = folder[: len(folder) - len(self.folder)], most, None

    def add(self, media: bytes, digest: str) -> tuple[str, int, int]:
        """Shard, offset and length of the stored media."""
        if self.file is None:
            self.store.create_dir(self.folder, recursive=True)
            path = f"{self.folder}/{uuid.uuid4().hex}.tar"
            self.path, self.file, self.at, self.seen = self.scheme + path, self.store.open_output_stream(path, compression=None), 0, {}
        if (found := self.seen.get(digest)) is None:
            info = tarfile.TarInfo(f"{digest}.png")
            info.size = len(media)
            head = info.tobuf(tarfile.USTAR_FORMAT)
            self.file.write(head + media + bytes(-len(media) % 512))
            found = self.seen[digest] = self.path, self.at + len(head), len(media)
            self.at += len(head) + len(media) + -len(media) % 512
        if self.at >= self.most:
            self.close()
        return found

    def close(self) -> None:
        if self.file is not None:
            self.file.write(bytes(1024))
            self.file.close()
            self.file = None


class ShardReader:
    """Range reads; the shard read last stays open."""

    def __init__(self) -> None:
        self.path, self.file = None, None

    def read(self, path: str, offset: int, length: int) -> bytes:
        if path != self.path:
            self.close()
            store, inner = fs.FileSystem.from_uri(path)
            self.path, self.file = path, store.open_input_file(inner)
        data = self.file.read_at(length, offset)
        if len(data) != length:
            raise OSError(f"{path} ends before {offset + length}")
        return data

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.path = self.file = None


REFERENCE = [("media_sha256", T.StringType()), ("shard", T.StringType()), ("offset", T.LongType()), ("length", T.LongType())]


def _mapped(df: DataFrame, more: list[tuple[str, T.DataType]], start: Callable, rows: int) -> DataFrame:
    """``df`` with columns ``more``, made by start() -> (step(row) -> tuple, end())."""
    df = df.drop(*[n for n, _ in more])
    schema = T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in more]])
    arrow = {T.StringType(): pa.string(), T.LongType(): pa.int64(), T.IntegerType(): pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, end = start()
        for batch in batches:
            for part in slices(batch, rows):
                found = [step(r) for r in part.to_pylist()]
                new = [pa.array([x[i] for x in found], arrow[t]) for i, (_, t) in enumerate(more)]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=schema.names)
        end()

    return df.mapInArrow(run, schema)


def store_texts(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", level: int = 1) -> DataFrame:
    """Store every text's UTF-8 bytes, padded, in tar shards under ``folder``; returns the written index.

    One row for each row of ``docs``: its id, ``media_sha256``, ``shard``,
    ``offset``, ``length``. A null text is empty (64 zeros); repeated rows refer to
    the same bytes; other columns are left out; an empty table makes no shard.
    """
    kind = docs.schema[id_col]
    source = docs.select(id_col, text_of(text_col).alias("text"))
    schema = T.StructType([kind, *[T.StructField(n, t) for n, t in REFERENCE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ShardWriter(folder)
        for batch in batches:
            for part in slices(batch, 500):
                found = []
                for text in part.column(1).to_pylist():
                    data = text.encode()
                    media = to_png(pad(data), len(data), level)
                    digest = hashlib.sha256(media).hexdigest()
                    found.append((digest, *writer.add(media, digest)))
                new = [pa.array([x[i] for x in found], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays([part.column(0), *new], names=schema.names)
        writer.close()

    return written(source.mapInArrow(run, schema), "media-index")


def read_headers(index: DataFrame) -> DataFrame:
    """``index`` with n_bytes, width, height, bit_depth, payload_bytes, read from the first HEADER bytes of each medium."""
    more = [("n_bytes", T.LongType()), ("width", T.IntegerType()), ("height", T.IntegerType()), ("bit_depth", T.IntegerType()), ("payload_bytes", T.LongType())]

    def start():
        reader = ShardReader()

        def step(r: dict) -> tuple:
            h = png_header(reader.read(r["shard"], r["offset"], min(HEADER, r["length"])))
            return h["n_bytes"], h["width"], h["height"], h["bit_depth"], h["width"] * h["height"]

        return step, reader.close

    return _mapped(index, more, start, 1000)


def read_payloads(index: DataFrame) -> DataFrame:
    """``index`` with payload_sha256, tail_crc32 (of the last 64 samples), media_bytes, media_sha256 and feature, all from the stored bytes."""
    more = [("payload_sha256", T.StringType()), ("tail_crc32", T.LongType()), ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType())]

    def start():
        reader = ShardReader()

        def step(r: dict) -> tuple:
            media = reader.read(r["shard"], r["offset"], r["length"])
            samples = from_png(media)
            return hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(media), hashlib.sha256(media).hexdigest(), features(samples)

        return step, reader.close

    return _mapped(index, more, start, 500)


def dealt(index: DataFrame, most: int = 64 << 20, least: int = 2 << 20) -> DataFrame:
    """``index`` dealt by the bytes to read: about ``most`` a task, less (``least`` at the least) while cores are free; what a task reads lies together."""
    size = index.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, -(-size // most), min(-(-size // least), 2 * index.sparkSession.sparkContext.defaultParallelism))
    stretch = max(1, size // (8 * tasks))
    return index.repartition(int(tasks), "shard", F.floor(F.col("offset") / stretch)).sortWithinPartitions("shard", "offset")


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts stored in the shared folder, then every metadata column read back from the shards.

    The id, ``media_sha256``, ``shard``, ``offset``, ``length``, then the columns of
    ``read_headers`` and ``read_payloads``, one row for each row of ``docs``. A null
    and an empty text are 64 zeros; whole texts are stored, however long (one payload
    is in memory at a time); equal texts have equal media, stored once for each shard
    that a task writes, so that every shard can be read by itself; repeated rows and
    null ids stay as they are; other columns, whatever their names, are left out; an
    empty table gives an empty table.
    """
    index = store_texts(docs, fresh_dir(docs.sparkSession, "media"), id_col, text_col)
    return read_payloads(read_headers(dealt(index)))
