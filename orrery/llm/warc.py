"""WARC archives with a two-level capture index.

``write_archives`` writes one gzip member for each page, in files below a shared folder; equal payloads are stored once, as
the response of the least page id, and the others are revisit records. ``write_index`` sorts captures by URL key with
reversed host (``org,example,www)/path``) over range partitions, packs them into compressed blocks, and ends each index
file with a sparse directory of its blocks' first keys; the list of index files with their key ranges is the upper level.
``look_up`` finds the files that may hold a key by binary search, then in a file's directory the blocks, then in the block the
captures, reading only those byte ranges. ``fetch`` reads records by their ranges in archive order.

Tasks write files under names of their own attempt and return what they wrote; only what a committed task returned is ever
read, so lost executors and repeated tasks leave at most files that nothing refers to. Files are reached with
pyarrow's file systems, by the folder's URI. The list of index files is broadcast: one row for each index partition, checked.

A key with very many captures lies in several index files, cut by page id, so that several tasks read it. Record ids are
random; page ids are fields of their own, as they may repeat. Very long payloads are held one at a time.

Defined cases: null html is an empty payload; a null URL has an empty key and target; control characters in URLs are
percent-encoded; repeated rows with the least page id are responses each; a null page id revisits the least one, or is a
response if its payload has no page id at all; payloads shorter than ``min_bytes`` are never revisited; an empty table writes nothing.
Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch

BROADCAST_ROWS, BLOCK_LINES, FILE_BYTES, MAX_INDEX_FILES = 200_000, 1000, 1 << 30, 100_000
DATE = "2024-01-01T00:00:00Z"
_CAPTURES = "key string, page_id long, record_type string, digest string, file string, offset long, length long"
_RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")


def url_key(url: str | None) -> str:
    """The URL with its host reversed, so that a domain's captures are neighbours in the index."""
    quoted = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "")
    if not (m := re.match(r"(?s)[^:/?#]*://([^/?#]*)(.*)", quoted)):
        return quoted
    host = m[1].lower().rpartition("@")[2]
    host, colon, port = host.partition(":")
    return ",".join(reversed(host.split("."))) + colon + port + ")" + (m[2] or "/")


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed; with ``refers_to`` a revisit whose HTTP head still tells the payload's length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {DATE}", f"WARC-Page-ID: {'' if page_id is None else page_id}",
        "WARC-Target-URI: " + _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or ""), f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To-Page-ID: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The record in ``data``; a response's payload must have the stated length and digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?i)\r\ncontent-length: (\d+)", http)[1])
    number = lambda s: int(s) if s else None
    out = {
        "page_id": number(fields["WARC-Page-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": number(fields.get("WARC-Refers-To-Page-ID")), "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "payload_bytes": length, "payload": payload if fields["WARC-Type"] == "response" else None}
    if out["payload"] is not None and (len(payload) != length or payload_digest(payload) != out["payload_digest"]):
        raise ValueError(f"record {out['page_id']} does not hold its payload")
    return out


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Files:
    """Output files of one task attempt, a new one whenever the last is full."""

    def __init__(self, folder: str, suffix: str):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.suffix, self.out = suffix, None

    def add(self, data: bytes) -> tuple[str, int, int]:
        if self.out is None or self.at >= FILE_BYTES:
            self.close()
            self.name = f"{uuid.uuid4().hex}{self.suffix}"
            self.out, self.at = self.fs.open_output_stream(f"{self.folder}/{self.name}", compression=None), 0
        self.out.write(data)
        self.at += len(data)
        return self.name, self.at - len(data), len(data)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.out = None


def _first_of_payload(pages: DataFrame, scratch: Scratch, min_bytes: int) -> DataFrame:
    """``pages`` plus first: the least page id with an equal payload, null where no other page has it."""
    html = F.coalesce("html", F.lit(""))
    hashed = pages.withColumn("_sha1", F.sha1(html))
    same = hashed.where(F.octet_length(html) >= min_bytes).groupBy("_sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared, _ = scratch.put(same.select(F.col("_sha1").alias("_s"), "first"), "shared")
    small = shared.count() <= BROADCAST_ROWS
    return hashed.join(F.broadcast(shared) if small else shared, F.col("_sha1") == F.col("_s"), "left").select("page_id", "url", html.alias("html"), "first")


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0) -> DataFrame:
    """Writes the archives; returns the captures (key, page_id, record_type, digest, file, offset, length) as a table."""
    scratch = Scratch(pages.sparkSession, "warc-write")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(folder, ".warc.gz")
        for batch in batches:
            rows = []
            for page_id, url, html, first in zip(*batch.columns, strict=True):
                page_id, url, payload, first = page_id.as_py(), url.as_py(), html.as_py().encode(), first.as_py()
                refers = first if first is not None and first != page_id else None
                digest = payload_digest(payload)
                place = files.add(_gzip(record(page_id, url, payload, digest, refers)))
                rows.append((url_key(url), page_id, "response" if refers is None else "revisit", digest, *place))
            yield _batch(rows, _CAPTURES)
        files.close()

    decided = _first_of_payload(pages.select("page_id", "url", "html"), scratch, min_bytes)
    return scratch.put(decided.mapInArrow(write, _CAPTURES), "captures")[0]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def write_index(captures: DataFrame, folder: str, partitions: int | None = None) -> DataFrame:
    """Writes the index files, ``partitions`` or as many as Spark finds right for their size; returns the upper level (file, first_key, last_key, directory_offset, directory_length)."""
    schema = "file string, first_key string, last_key string, directory_offset long, directory_length long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, block, directory, last = _Files(folder, ".idx"), [], [], None

        def flush() -> None:
            if block:
                place = files.add(zlib.compress("\n".join(json.dumps(r) for r in block).encode()))
                directory.append([block[0][0], block[-1][0], *place[1:]])
                block.clear()

        def done() -> pa.RecordBatch:
            flush()
            name, offset, length = files.add(zlib.compress(json.dumps(directory).encode()))
            row = (name, directory[0][0], directory[-1][1], offset, length)
            files.close()
            directory.clear()
            return _batch([row], schema)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block.append(row)
                if len(block) == BLOCK_LINES:
                    flush()
                    if files.at >= FILE_BYTES // 2:
                        yield done()
        if block or directory:
            yield done()

    ranged = captures.repartitionByRange(*[partitions] * (partitions is not None), "key", "page_id").sortWithinPartitions("key", "page_id", "file", "offset")
    return Scratch(captures.sparkSession, "warc-index").put(ranged.mapInArrow(write, schema), "index")[0]


def look_up(urls: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """All captures of each of the distinct ``urls`` (column url), by binary search and range reads."""
    spark: SparkSession = urls.sparkSession
    files = [tuple(r) for r in index.orderBy("first_key", "last_key", "file").limit(MAX_INDEX_FILES + 1).collect()]
    if len(files) > MAX_INDEX_FILES:
        raise ValueError("too many index files for one upper level; write the index with fewer, larger partitions")
    shared = spark.sparkContext.broadcast(files)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = shared.value
        lasts = [f[2] for f in upper]  # ranges follow each other, so last keys are sorted too
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                key = url_key(url)
                at = bisect.bisect_left(lasts, key)
                while at < len(upper) and upper[at][1] <= key:
                    rows.append((key, upper[at][0], upper[at][3], upper[at][4]))
                    at += 1
            yield _batch(rows, "key string, file string, directory_offset long, directory_length long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        name = handle = block = None
        for batch in batches:
            rows: list[tuple] = []
            for key, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != name:
                    handle = store.open_input_file(f"{root}/{file}")
                    directory = json.loads(zlib.decompress(handle.read_at(length, offset)))
                    lasts, name, block = [d[1] for d in directory], file, None
                at = bisect.bisect_left(lasts, key)
                while at < len(directory) and directory[at][0] <= key:
                    if block != at:
                        lines = [json.loads(x) for x in zlib.decompress(handle.read_at(directory[at][3], directory[at][2])).decode().split("\n")]
                        keys, block = [x[0] for x in lines], at
                    rows += map(tuple, lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)])
                    at += 1
                    if len(rows) >= 10_000:  # a key may have any number of blocks
                        yield _batch(rows, _CAPTURES)
                        rows = []
            yield _batch(rows, _CAPTURES)

    keys = urls.select("url").distinct().mapInArrow(route, "key string, file string, directory_offset long, directory_length long").distinct()
    return keys.repartitionByRange("file", "key").sortWithinPartitions("file", "key").mapInArrow(read, _CAPTURES)


def fetch(captures: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of ``captures`` (file, offset, length), read in archive order; payload is null in revisits."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for file, places in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0]):
                with store.open_input_file(f"{root}/{file}") as handle:
                    for _, offset, length in places:
                        found = parse(zlib.decompress(handle.read_at(length, offset), 31))
                        if not payloads:
                            found["payload"] = None
                        rows.append(tuple(found.values()))
                        size += len(found["payload"] or b"")
                        if size > 16 << 20 or len(rows) >= 10_000:
                            yield _batch(rows, _RECORDS)
                            rows, size = [], 0
            yield _batch(rows, _RECORDS)

    # a number of partitions of its own: rows are small but each stands for a record to read
    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = captures.select("file", "offset", "length").repartitionByRange(parts, "file", "offset").sortWithinPartitions("file", "offset")
    return in_order.mapInArrow(read, _RECORDS)
