"""Members of zip and tar archives as rows, read by byte ranges.

An archive's directory comes first, a row for each member: of a zip from its central directory, of a tar from its header chain, neither of which
reads contents. Draws, filters and joins work on the directory; the members that are left are then dealt over tasks by blocks of bytes,
and each is read from its own range. So archives may have any size, several tasks share a large one, and what isn't
drawn is never read. A compressed tar has no ranges: one task reads it as a stream, twice, and keeps one member at a time.

Files are opened by pyarrow's file systems on the executors. Broken archives and members give a row with their error.
"""

from __future__ import annotations

import itertools
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity as I
from ..operators.ingest import with_metadata
from ..operators.sampling import seeded_sample
from ..schemas import MEDIA_SUFFIXES
from .tables import kept

MEMBERS = "archive_filename string, member_path string, media binary, error string"
#: kind: zip, tar or stream; method: how the range is packed; place: of the range, or of the member in a stream.
DIRECTORY = "path string, archive_filename string, member_path string, kind string, place long, stored long, size long, method int, crc long, error string"
#: Stored bytes that a task reads, and contents of one Arrow batch.
BLOCK_BYTES, BATCH_BYTES = 64 << 20, 8 << 20
MAX_MEMBER = (1 << 31) - (1 << 20)
FAILURES = (tarfile.TarError, zipfile.BadZipFile, zlib.error, struct.error, EOFError, OSError, ValueError, NotImplementedError)
#: Methods beside zip's own numbers: a member that tarfile has to put together.
STORED, DEFLATED, SPARSE = 0, 8, -1


def opened(path: str) -> pa.NativeFile:
    """A file for reading at any place."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def short(failure: Exception) -> str:
    return f"{type(failure).__name__}: {failure}"[:300]


def _headers(file: pa.NativeFile, mode: str) -> Iterator[tuple[int, tarfile.TarInfo, tarfile.TarFile]]:
    """(number, header, tar) of a tar's members, one at a time."""
    with tarfile.open(fileobj=file, mode=mode) as t:
        for number in itertools.count():
            entry = t.next()
            if entry is None:
                return
            yield number, entry, t
            t.members = []  # the chain isn't kept


def directory(path: str, suffixes: tuple[str, ...]) -> Iterator[dict]:
    """The directory rows of one archive: files with a fitting suffix; folders and MACOSX entries are left out."""
    fits = lambda name: name.lower().endswith(suffixes) and "MACOSX" not in name
    row = {"path": path, "archive_filename": path.rsplit("/", 1)[-1]}
    with opened(path) as file:
        if zipfile.is_zipfile(file):
            with zipfile.ZipFile(file) as z:
                for e in z.infolist():
                    if not e.is_dir() and fits(e.filename):
                        locked = "encrypted member" if e.flag_bits & 1 else None
                        yield row | {"member_path": e.filename, "kind": "zip", "place": e.header_offset, "stored": e.compress_size, "size": e.file_size, "method": e.compress_type, "crc": e.CRC, "error": locked}
            return
        file.seek(0)
        plain = file.read(512)[257:262] == b"ustar" or not file.size()
        file.seek(0)
        for number, e, _ in _headers(file, "r:" if plain else "r|*"):
            if e.isfile() and fits(e.name):
                place = (e.offset if e.sparse else e.offset_data) if plain else number
                yield row | {"member_path": e.name, "kind": "tar" if plain else "stream", "place": place, "stored": e.size, "size": e.size, "method": SPARSE if e.sparse else STORED}


def read_range(file: pa.NativeFile, row: dict) -> bytes:
    """One member of a zip or plain tar from its range."""
    if row["method"] == SPARSE:
        file.seek(row["place"])
        with tarfile.TarFile(fileobj=file) as t:
            return t.extractfile(t.next()).read()
    at = row["place"]
    if row["kind"] == "zip":
        file.seek(at)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04":
            raise zipfile.BadZipFile("no member where the directory says")
        at += 30 + sum(struct.unpack("<HH", head[26:30]))  # name and extra field
    file.seek(at)
    content = file.read(row["stored"])
    if len(content) < row["stored"]:
        raise EOFError("the archive ends inside a member")
    if row["method"] == DEFLATED:
        content = zlib.decompress(content, -15)
    elif row["method"] != STORED:
        raise NotImplementedError(f"packing method {row['method']}")
    if row["crc"] is not None and zlib.crc32(content) != row["crc"]:
        raise zipfile.BadZipFile("wrong checksum")
    return content


def contents(path: str, rows: list[dict]) -> Iterator[tuple[dict, bytes | None, str | None]]:
    """(row, content, error) of directory rows of one archive, in order of their place."""
    def one(row: dict, read) -> tuple[dict, bytes | None, str | None]:
        if row["error"] or row["size"] > MAX_MEMBER:
            return row, None, row["error"] or "member larger than a value may be"
        try:
            return row, read(), None
        except FAILURES as failure:
            return row, None, short(failure)

    ranges, streamed = [r for r in rows if r["kind"] != "stream"], {r["place"]: r for r in rows if r["kind"] == "stream"}
    try:
        with opened(path) as file:
            for row in ranges:
                yield one(row, lambda: read_range(file, row))  # noqa: B023  used at once
            if streamed:
                for number, entry, t in _headers(file, "r|*"):
                    row = streamed.pop(number, None)
                    if row:
                        yield one(row, lambda: t.extractfile(entry).read())  # noqa: B023
                    if not streamed:
                        break
    except FAILURES as failure:  # of the stream, or of opening
        for row in streamed.values() if streamed else rows:
            yield row, None, short(failure)


def _batched(found: Iterator[tuple[dict, bytes | None, str | None]], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded bytes."""
    schema = pa.schema([(c, pa.binary() if c == "media" else pa.string()) for c in columns])
    rows, size = [], 0
    for row, media, error in found:
        rows.append({**row, "media": media, "error": error})
        size += len(media or b"") + 200
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def list_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the zip and tar files below ``path``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(I.source_type(F.col("path")).isin("zip", "tar")).select("path", "length")


def member_directory(archives: DataFrame, modality: str) -> DataFrame:
    """A row for each member of the archives at ``path``; a broken archive gives one row with its error. Contents aren't read, except of compressed tars."""
    suffixes = MEDIA_SUFFIXES[modality]
    types = {"place": pa.int64(), "stored": pa.int64(), "size": pa.int64(), "method": pa.int32(), "crc": pa.int64()}
    names = [part.split(" ")[0] for part in DIRECTORY.split(", ")]
    schema = pa.schema([(n, types.get(n, pa.string())) for n in names])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for path in (p for batch in batches for p in batch.column(0).to_pylist()):
            rows = directory(path, suffixes)
            try:
                while part := list(itertools.islice(rows, 10_000)):
                    yield pa.RecordBatch.from_pylist(part, schema)
            except FAILURES as failure:
                yield pa.RecordBatch.from_pylist([{"path": path, "archive_filename": path.rsplit("/", 1)[-1], "error": short(failure)}], schema)

    return archives.select("path").mapInArrow(expand, DIRECTORY)


def read_members(members: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(archive_filename, member_path, media, error) of directory rows. Each task reads blocks of about ``block_bytes``; of a stream one reads all that is wanted."""
    members = kept(members)
    total = members.agg(F.coalesce(F.sum("stored"), F.lit(0))).first()[0]
    block = F.when(F.col("kind") == "stream", 0).otherwise(F.floor(F.col("place") / block_bytes))
    dealt = members.repartition(int(total // block_bytes) + 1, "path", block).sortWithinPartitions("path", "place")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in batch.to_pylist())
        found = (one for path, part in itertools.groupby(rows, key=lambda r: r["path"])
                 for one in (contents(path, list(part)) if path else ()))
        yield from _batched(found, ["archive_filename", "member_path", "media", "error"])

    broken = members.where("member_path is null").select("archive_filename", "member_path", F.lit(None).cast("binary").alias("media"), "error")
    return dealt.where("member_path is not null").mapInArrow(read, MEMBERS).union(broken)


def read_archives(spark: SparkSession, path: str, modality: str, per_archive: int = -1, seed: int = 42) -> DataFrame:
    """A row for each member; a broken archive gives one row with its error. ``per_archive`` -1 takes all members; otherwise so many
    are drawn from the directory, and only those are read."""
    found = member_directory(list_archives(spark, path), modality)
    return read_members(found if per_archive < 0 else seeded_sample(found, "archive_filename", "member_path", per_archive, seed).drop("rn"))


def read_archives_with_metadata(spark: SparkSession, path: str, modality: str, metadata: DataFrame, order: list[Column]) -> DataFrame:
    """Members left-joined with (archive_filename, member_path, ...); names lose the mark that a download adds."""
    plain = read_archives(spark, path, modality).withColumn("archive_filename", I.plain_archive_name(F.col("archive_filename")))
    return with_metadata(plain, metadata, ["archive_filename", "member_path"], order)


def read_raw(spark: SparkSession, path: str, modality: str, lazily: bool = False) -> DataFrame:
    """One file, one sample; ``lazily`` carries paths alone, to be joined with contents after sampling."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(I.has_suffix(F.col("path"), MEDIA_SUFFIXES[modality]) & ~F.contains("path", F.lit("MACOSX")))
    return files.select("path", "length") if lazily else files.select("path", "length", F.col("content").alias("media"))
