"""WARC archives with Zstandard: a dictionary in a leading skippable frame, one frame for each record.

The writer makes archives of its own for each task and returns an index of them;
the reader takes any such archives, loads each one's dictionary, decodes frame by
frame and validates headers and lengths. Memory holds one record at a time, and
while writing the few records from which a dictionary is trained.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strikeloom.llm.base import fresh_dir, join_keys, slices, text_of, written

DICTIONARY_FRAME = 0x184D2A5D  # fixed value of the format: the skippable frame that holds the dictionary
FRAME, DICTIONARY = b"\x28\xb5\x2f\xfd", b"\x37\xa4\x30\xec"  # fixed values: how frames and dictionaries begin
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    """What is wrong with a record, and where it begins if that is known."""

    at: int | None = None


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """A response record with its payload, or a revisit record with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}:{url}:{digest}")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines.append(f"WARC-Profile: {PROFILE}")
        if refers_to is not None:
            lines.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_headers(data: bytes) -> tuple[str, dict[str, str]]:
    """First line and headers (lower-case names); raises WarcError on a line that is neither."""
    first, *lines = data.decode("utf-8").split("\r\n")
    out = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise WarcError(f"bad header line {line[:40]!r}")
        if name.lower() in out:
            raise WarcError(f"header {name} twice")
        out[name.lower()] = value.strip()
    return first, out


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int]:
    """Headers, payload and the payload's length as stated; validates all lengths and the digest."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of headers")
    version, headers = parse_headers(head)
    if not re.fullmatch(r"WARC/1\.[01]", version):
        raise WarcError(f"bad version {version[:20]!r}")
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("content length doesn't hold")
    block = rest[:-4]
    kind = headers["warc-type"]
    if kind not in ("response", "revisit"):
        return headers, block, len(block)
    http, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        raise WarcError("no end of HTTP headers")
    status, said = parse_headers(http)
    if not status.startswith("HTTP/"):
        raise WarcError("no HTTP status line")
    size = int(said.get("content-length", len(payload)))
    if kind == "response":
        if size != len(payload):
            raise WarcError("HTTP content length doesn't hold")
        digest = headers.get("warc-payload-digest", "")
        if digest.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != digest[7:]:
            raise WarcError("payload digest doesn't hold")
    elif "warc-profile" not in headers:
        raise WarcError("a revisit without profile")
    return headers, payload, size


class ArchiveWriter:
    """Archives of one task: a dictionary trained on the first records, one frame for each record, a new file at ``most`` bytes."""

    def __init__(self, folder: str, most: int = 64 << 20, sample: int = 400, sample_bytes: int = 4 << 20, dictionary: int = 16 << 10, level: int = 3):
        self.store, self.folder = fs.FileSystem.from_uri(folder)
        self.scheme = folder[: len(folder) - len(self.folder)]
        self.most, self.sample, self.sample_bytes, self.dictionary, self.level = most, sample, sample_bytes, dictionary, level
        self.waiting: list[tuple[object, bytes]] = []
        self.waiting_bytes = 0
        self.file = None

    def open(self) -> None:
        samples = [x for _, x in self.waiting]
        try:
            trained = zstandard.train_dictionary(self.dictionary, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples: their own bytes serve as dictionary
            trained = b"".join(samples)[: self.dictionary].ljust(8, b" ")
        kind = zstandard.DICT_TYPE_FULLDICT if trained[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
        words = zstandard.ZstdCompressionDict(trained, dict_type=kind)
        self.frames = zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=True, write_content_size=True)
        self.store.create_dir(self.folder, recursive=True)
        path = f"{self.folder}/{uuid.uuid4().hex}.warc.zst"
        self.path, self.file = self.scheme + path, self.store.open_output_stream(path, compression=None)
        packed = zstandard.ZstdCompressor(level=9).compress(trained)
        self.file.write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
        self.at = 8 + len(packed)

    def add(self, tag: object, record: bytes) -> Iterator[tuple[object, str, int, int]]:
        """Take a record; gives (tag, file, offset, length) of each record that was written by this call."""
        if self.file is None:
            self.waiting.append((tag, record))
            self.waiting_bytes += len(record)
            if len(self.waiting) >= self.sample or self.waiting_bytes >= self.sample_bytes:
                yield from self.flush()
        else:
            yield self.put(tag, record)

    def put(self, tag: object, record: bytes) -> tuple[object, str, int, int]:
        frame = self.frames.compress(record)
        self.file.write(frame)
        found = tag, self.path, self.at, len(frame)
        self.at += len(frame)
        if self.at >= self.most:
            self.file.close()
            self.file, self.waiting, self.waiting_bytes = None, [], 0
        return found

    def flush(self) -> Iterator[tuple[object, str, int, int]]:
        if self.file is None and self.waiting:
            self.open()
            held, self.waiting = self.waiting, []
            for tag, record in held:
                if self.file is None:
                    self.open()
                yield self.put(tag, record)

    def close(self) -> Iterator[tuple[object, str, int, int]]:
        yield from self.flush()
        if self.file is not None:
            self.file.close()
            self.file = None


def dictionary_of(data: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary in the body of the leading frame, packed or plain."""
    if data[:4] == FRAME:
        data = zstandard.ZstdDecompressor().decompress(data)
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if data[:4] == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT)


def frames_of(uri: str, chunk: int = 1 << 16) -> Iterator[tuple[int, bytes]]:
    """Offset and decoded bytes of each frame of an archive; the dictionary frame comes first or not at all.

    What follows a frame in its chunk is copied, so chunks are small; the store is read in larger buffers.
    """
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path, compression=None, buffer_size=1 << 20) as file:
        data, at, words = file.read(8), 0, None
        if len(data) == 8 and struct.unpack("<I", data[:4])[0] == DICTIONARY_FRAME:
            size = struct.unpack("<I", data[4:])[0]
            body = file.read(size)
            if len(body) != size:
                raise WarcError("the dictionary is cut off")
            words, data, at = dictionary_of(body), b"", 8 + size
        decoder = zstandard.ZstdDecompressor(dict_data=words) if words else zstandard.ZstdDecompressor()
        while data or (data := file.read(chunk)):
            frame, parts, began = decoder.decompressobj(), [], at
            try:
                while True:
                    parts.append(frame.decompress(data))
                    if frame.eof:
                        at += len(data) - len(frame.unused_data)
                        data = frame.unused_data
                        break
                    at += len(data)
                    if not (data := file.read(chunk)):
                        raise WarcError("the last frame is cut off")
            except (WarcError, zstandard.ZstdError) as fault:
                error = WarcError(str(fault))
                error.at = began
                raise error from fault
            yield began, b"".join(parts)


INDEX = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("file", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
RECORD = T.StructType([T.StructField(n, t) for n, t in (("file", T.StringType()), ("offset", T.LongType()), ("page_id", T.LongType()), ("url", T.StringType()), ("record_type", T.StringType()), ("refers_to", T.LongType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("payload", T.BinaryType()), ("error", T.StringType()))])


def mark_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, payload_bytes, first_id of each row, and payload_digest.

    ``first_id`` is the smallest page_id among rows of the same payload, where
    that has at least ``least`` bytes and another row has it too, else null. Digests
    and ids alone are aggregated; only payloads that occur again are on the other
    side of the join, broadcast when they are counted and few, else joined with hot
    ones broadcast and the others shuffled. Smaller payloads never meet there.
    """
    html = text_of("html")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    again = rows.filter(F.col("payload_bytes") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n_")).filter("n_ > 1")
    again = written(again.withColumnRenamed("payload_digest", "key_"), "repeated-payloads")
    own = F.concat(F.lit("-"), F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("key_", F.when(F.col("payload_bytes") >= least, F.col("payload_digest")).otherwise(own))
    if again.count() <= MOST_DIGESTS:
        return rows.join(F.broadcast(again.drop("n_")), "key_", "left").drop("key_")
    return join_keys(rows, again, "key_", "n_", again.agg(F.sum("n_").alias("n")).first()["n"], "left").drop("key_")


#: Digests with an id that may be broadcast.
MOST_DIGESTS = 300_000


def write_archives(pages: DataFrame, folder: str, least: int = 100) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html); returns the index.

    Of equal payloads of at least ``least`` bytes, that of the smallest page_id is
    a response and the others revisit it; repeated rows of that page_id are
    responses too. A null html is empty, a null url or page_id leaves out its
    header (a null page_id comes after all others); other columns are left out; an
    empty table makes no archive. File names are new for each attempt of a task,
    and the index names only those of attempts that counted.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(folder)

        def batch(found: list[tuple[object, str, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(INDEX.names, x, strict=True)) for x in found], schema=pa.schema([("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

        for rows in batches:
            found = []
            for part in slices(rows, 500):
                for r in part.to_pylist():
                    first = r["first_id"]
                    revisit = first is not None and r["page_id"] != first
                    found += writer.add(r["page_id"], record_bytes(r["page_id"], r["url"], r["html"].encode(), r["payload_bytes"], r["payload_digest"], first, revisit))
            if found:
                yield batch(found)
        if rest := list(writer.close()):
            yield batch(rest)

    return written(mark_revisits(pages, least).mapInArrow(write, INDEX), "warc-index")


def read_archives(files: DataFrame, payloads: bool = True, strict: bool = False) -> DataFrame:
    """Every record of the archives in column ``file`` of ``files``, see RECORD.

    A record that isn't valid has its fault in ``error`` and nulls in the rest; a
    broken frame ends its archive with such a row, at the frame's own offset. With
    ``strict`` either raises WarcError instead. Files are dealt out evenly; a null
    or repeated name is read once or not at all; no file gives an empty table.
    """
    fields = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def number(text: str | None) -> int | None:
        return None if text is None else int(text)

    def rows_of(uri: str) -> Iterator[dict]:
        at = 0
        try:
            for at, data in frames_of(uri):
                try:
                    h, payload, size = parse_record(data)
                    yield {"file": uri, "offset": at, "page_id": number(h.get("x-page-id")), "url": h.get("warc-target-uri"), "record_type": h["warc-type"], "refers_to": number(h.get("x-refers-to-page-id")), "payload_bytes": size, "payload_digest": h.get("warc-payload-digest", "").removeprefix("sha256:"), "payload": payload if payloads else None}
                except ValueError as fault:
                    if strict:
                        raise WarcError(f"{uri} at {at}: {fault}") from fault
                    yield {"file": uri, "offset": at, "error": str(fault)}
        except WarcError as fault:
            if strict:
                raise WarcError(f"{uri} at {at if fault.at is None else fault.at}: {fault}") from fault
            yield {"file": uri, "offset": at if fault.at is None else fault.at, "error": str(fault)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(uri):
                    held.append(row)
                    size += len(row.get("payload") or b"") + 200
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema=fields)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=fields)

    names = written(files.select("file").filter("file is not null").distinct(), "warc-files")
    n = names.count()  # a task a file while there are few, beyond that several a task
    return names.repartition(max(1, min(n, max(4 * files.sparkSession.sparkContext.defaultParallelism, n // 16)))).mapInArrow(read, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` into archives in the shared folder and read every record back; a record that isn't valid fails the job."""
    index = write_archives(pages, fresh_dir(pages.sparkSession, "warc"))
    return read_archives(index, payloads=False, strict=True).drop("error")
