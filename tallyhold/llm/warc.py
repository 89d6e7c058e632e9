"""Zstandard web archives: written one frame for each record, read back frame by frame with their dictionary.

An archive begins with a skippable frame that holds a dictionary; then each WARC/1.1 record is a Zstandard frame of
its own, compressed with that dictionary. The reader loads the dictionary from the leading skippable frame (which
may itself be compressed), decodes one frame for each record, and checks version line, headers, Content-Length, the
closing blank lines and, where there is one, the payload's SHA-1 digest. A damaged archive raises ``ArchiveError``. It reads
others' archives as well as its own: records of any type, with any id, with or without a digest.

Of the pages whose payloads are equal and of at least ``least_bytes`` bytes, that with the smallest page_id is
written as a response; the others are revisits of it, without a payload.

Scale. Equal payloads are found by their digests, in rows without payloads: the smallest page is first taken for each digest
and salt, then for each digest, and goes back to the salts that have it. There are so many salts that a digest that all
pages have is spread over rows of about ``ROWS_A_SALT``. What comes out is the revisits alone; they meet the pages by a
broadcast up to ``BROADCAST_BYTES``, as measured, and then no payload is shuffled at all, else by a shuffle. A revisit's payload
goes no further than that. Each task writes one archive, under a name of its attempt that is moved to its final place at
the end. Reading streams; memory holds one record.

Edge cases. A null html is an empty payload, and a very long one a record of its own length, whole. A null url leaves out the target header; control characters and spaces
in urls are percent-encoded. Rows that repeat a page_id are records each, the first of equal ones the response.
A null page_id sorts last. An empty table writes nothing. Other columns are never read, whatever their names. ``pages`` must be a
table as read, so that its rows have the same numbers each time.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhold.llm.common import fresh_path, small_batches, staged, tidy

#: Fixed values of the formats: skippable-frame magic of the dictionary, magic of a frame, profile of revisits.
SKIPPABLE, FRAME = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Rows of one payload that meet at one key, and bytes of revisits' rows that are broadcast.
ROWS_A_SALT, BROADCAST_BYTES = 1_000_000, 32_000_000
END = b"\r\n\r\n"


class ArchiveError(ValueError):
    """An archive breaks the format: what, and the record's number where known."""


def digest32(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """A WARC record: header block, blank line, HTTP header and payload, two line ends; a revisit where there is no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block, kind = http + (payload or b""), "revisit" if payload is None else "response"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + END + block + END


def parse(raw: bytes, n: int) -> tuple[dict[str, str], bytes, bytes]:
    """Headers (names in lower case), HTTP header (empty where the block isn't HTTP) and payload of a decoded record; raises
    where it breaks the format."""
    head, gap, rest = raw.partition(END)
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ArchiveError(f"record {n}: no version line")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ArchiveError(f"record {n}: header without a colon")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ArchiveError(f"record {n}: no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + len(END) or not rest.endswith(END):
        raise ArchiveError(f"record {n}: its block is not of Content-Length bytes")
    block = rest[: -len(END)]
    http, _, payload = block.partition(END) if fields.get("content-type", "").startswith("application/http") else (b"", b"", block)
    algorithm, _, value = fields.get("warc-payload-digest", "").partition(":")
    if fields["warc-type"] != "revisit" and algorithm.lower() == "sha1" and value != digest32(payload):
        raise ArchiveError(f"record {n}: its payload has another digest")
    return fields, http, payload


def dictionary(samples: list[bytes], size: int = 16_384) -> bytes:
    """A dictionary for records like these; their first bytes where there are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(s[:1024] for s in samples[:8])


def frames(stream: BinaryIO, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Decoded frames of an archive, one at a time."""
    data = stream.read(8)
    held = zstandard.ZstdCompressionDict(b"")
    if data[:4] == SKIPPABLE:
        size = int.from_bytes(data[4:8], "little")
        content = stream.read(size)
        if len(content) < size:
            raise ArchiveError("the dictionary is cut off")
        if content[:4] == FRAME:
            content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
        held, data = zstandard.ZstdCompressionDict(content), b""
    opener = zstandard.ZstdDecompressor(dict_data=held)
    data = data or stream.read(chunk)
    while data:
        if len(data) >= 4 and data[:4] != FRAME:
            raise ArchiveError("not a frame where one should begin")
        one, parts = opener.decompressobj(), []
        try:
            while not one.eof:
                if not data:
                    raise ArchiveError("the last frame is cut off")
                parts.append(one.decompress(data))
                data = one.unused_data if one.eof else stream.read(chunk)
        except zstandard.ZstdError as e:
            raise ArchiveError(f"a frame can't be decoded: {e}") from e
        yield b"".join(parts)
        data = data or stream.read(chunk)


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (binary, null for revisits), size, digest (SHA-1, hex) and first_id (the response's page_id, of revisits) of every row;
    is_first tells responses."""
    rows = pages.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumns({"size": F.length("html").cast("long"), "digest": F.sha1("html")})
    salts = -(-pages.count() // ROWS_A_SALT)
    narrow = staged(rows.where(F.col("size") >= least_bytes).select("uid", "page_id", "digest", F.pmod(F.xxhash64("uid"), F.lit(max(1, salts))).alias("salt")), "payloads")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "uid")
    by_salt = narrow.groupBy("digest", "salt").agg(F.min(order).alias("low"), F.count("*").alias("n"))
    lowest = by_salt.groupBy("digest").agg(F.min("low").alias("first"), F.sum("n").alias("n")).where("n > 1")
    firsts = by_salt.select("digest", "salt").join(lowest, "digest").select("digest", "salt", "first")
    again = narrow.join(firsts, ["digest", "salt"]).where(F.col("first.uid") != F.col("uid")).select("uid", F.col("first.page_id").alias("first_id"), F.lit(True).alias("again"))
    again = staged(again, "revisits")
    rows = rows.join(F.broadcast(again) if again.count() * 32 <= BROADCAST_BYTES else again, "uid", "left")
    return rows.select("page_id", "url", F.when(F.col("again").isNull(), F.col("html")).alias("html"), "size", "digest", F.col("again").isNull().alias("is_first"), "first_id")


def write(pages: DataFrame, path: str | None = None, *, date: str = "2024-01-01T00:00:00Z", level: int = 3, **columns) -> DataFrame:
    """Write archives under ``path``; returns their paths and numbers of records (file, n_records)."""
    path = path or fresh_path(pages.sparkSession, "warc")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(path)
        task, file, packer, n = TaskContext.get(), None, None, 0
        name = f"{root}/part-{task.partitionId():06d}.warc.zst"
        own = f"{name}.{task.taskAttemptId()}"
        for b in small_batches(batches, 200):
            out = []
            for page_id, url, html, size, digest, first_id in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out.append(record(page_id, url, html, size, base64.b32encode(bytes.fromhex(digest)).decode(), first_id, date))
            if file is None:
                file = store.open_output_stream(own, compression=None)
                content = dictionary(out)
                file.write(SKIPPABLE + len(content).to_bytes(4, "little") + content)
                packer = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(content), write_checksum=True)
            for raw in out:
                file.write(packer.compress(raw))
            n += len(out)
        if file is not None:
            file.close()
            store.move(own, name)
            scheme = path.partition("://")
            uri = f"{path.rstrip('/')}/{name.rpartition('/')[2]}" if scheme[1] else name
            yield pa.RecordBatch.from_arrays([pa.array([uri], pa.string()), pa.array([n], pa.int64())], names=["file", "n_records"])

    store, root = fs.FileSystem.from_uri(path)
    store.create_dir(root, recursive=True)
    return staged(plan_records(pages, **columns).drop("is_first").mapInArrow(run, "file string, n_records long"), "warc-files")


def read(spark: SparkSession, files: DataFrame) -> DataFrame:
    """A row for each record of the archives that ``files`` names in its column ``file``.

    file, record (its number there), record_type, record_id, page_id (null for ids of another form), url, date, payload_digest
    (null without one), payload_bytes, refers_to (a page_id), refers_to_id, payload (null for revisits). payload_bytes of a
    revisit comes from the HTTP header it keeps, and is null where that doesn't say.
    """
    number = re.compile(r"<urn:page:(-?\d+)>")
    names = ["file", "record", "record_type", "record_id", "page_id", "url", "date", "payload_digest", "payload_bytes", "refers_to", "refers_to_id", "payload"]
    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def rows_of(uri: str) -> Iterator[tuple]:
        store, at = fs.FileSystem.from_uri(uri)
        with store.open_input_stream(at, compression=None) as stream:
            for n, raw in enumerate(frames(stream)):
                fields, http, payload = parse(raw, n)
                kind, digest = fields["warc-type"], fields.get("warc-payload-digest")
                size = len(payload)
                if kind == "revisit":
                    if payload:
                        raise ArchiveError(f"record {n}: a revisit with a payload")
                    length = re.search(rb"(?im)^Content-Length:\s*(\d+)", http)
                    size, payload = int(length[1]) if length else None, None
                own, other = fields["warc-record-id"], fields.get("warc-refers-to")
                page, refers = number.match(own), number.match(other or "")
                yield (uri, n, kind, own, int(page[1]) if page else None, fields.get("warc-target-uri"), fields["warc-date"], digest and digest.rpartition(":")[2], size, int(refers[1]) if refers else None, other, payload)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                held, size = [], 0
                for row in rows_of(uri):
                    held.append(row)
                    size += 200 + len(row[-1] or b"")
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds, strict=True)], names=names)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds, strict=True)], names=names)

    schema = "file string, record long, record_type string, record_id string, page_id long, url string, date string, payload_digest string, payload_bytes long, refers_to long, refers_to_id string, payload binary"
    tasks = max(1, files.count())
    return files.select("file").repartition(tasks, "file").mapInArrow(run, schema)


def digest(records: DataFrame) -> DataFrame:
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
