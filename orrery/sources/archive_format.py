"""One archive, or a folder of them, as a table: ``spark.read.format("archive")`` and the table function ``archive_members``.

The format plans its partitions on the driver: an archive of up to ``block_bytes`` is one, unopened; a larger one is cut by its directory at
members' places, and only the cuts are kept. For very many archives use ``archives.read_archives``, whose directories are a distributed table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import MEDIA_SUFFIXES
from .archives import BLOCK_BYTES, FAILURES, MEMBERS, _batched, contents, directory, short

COLUMNS = ["archive_filename", "member_path", "media", "error"]
KINDS = re.compile(r"\.(zip|tar|tgz|tar\.gz|tar_[a-f0-9]{8}\.gz)$")


@dataclass
class Part(InputPartition):
    """Members of an archive from one place up to another; None is open."""

    path: str
    start: int | None = None
    stop: int | None = None


def found(path: str, suffixes: tuple[str, ...], start: int | None = None, stop: int | None = None) -> Iterator[tuple[dict, bytes | None, str | None]]:
    """(row, content, error) of an archive's members in a range of places."""
    try:
        rows = [r | {"error": r.get("error"), "crc": r.get("crc")} for r in directory(path, suffixes) if (start is None or r["place"] >= start) and (stop is None or r["place"] < stop)]
    except FAILURES as failure:
        yield {"archive_filename": path.rsplit("/", 1)[-1], "member_path": None}, None, short(failure)
        return
    yield from contents(path, sorted(rows, key=lambda r: r["place"]))


def listed(path: str) -> Iterator[tuple[str, int]]:
    """(path, size) of the archives in a folder, or of one."""
    local = path.startswith(("file:", "/"))
    store, root = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(path)
    info = store.get_file_info(root)
    files = [info] if info.is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
    scheme = "" if local else path.split("://", 1)[0] + "://"
    return ((scheme + f.path, f.size) for f in files if f.is_file and KINDS.search(f.path.lower()))


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, modality: str, block_bytes: int):
        self.path, self.suffixes, self.block_bytes = path, MEDIA_SUFFIXES[modality], block_bytes

    def partitions(self) -> list[Part]:
        parts = []
        for path, size in listed(self.path):
            cuts: list[int] = []
            if size > self.block_bytes:
                try:
                    held = 0
                    for row in directory(path, self.suffixes):
                        if row["kind"] == "stream":
                            break
                        held += row["stored"]
                        if held > self.block_bytes:
                            cuts, held = [*cuts, row["place"]], row["stored"]
                except FAILURES:
                    cuts = []  # the task that reads it tells the error
            cuts = sorted(cuts)
            parts += [Part(path, a, b) for a, b in zip([None, *cuts], [*cuts, None], strict=True)]
        return parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _batched(found(partition.path, self.suffixes, partition.start, partition.stop), COLUMNS)


class ArchiveSource(DataSource):
    """Options: path, modality (image), block_bytes."""

    @classmethod
    def name(cls) -> str:
        return "archive"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options["path"], self.options.get("modality", "image"), int(self.options.get("block_bytes", BLOCK_BYTES)))


class ArchiveMembers:
    """The members of the archives that a table lists (column path; modality image unless it has another). Arrow table functions can't stand in a lateral
    join, so the listing is the argument: ``archive_members(TABLE(listed) PARTITION BY path)``."""

    def eval(self, listed: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in listed.to_pylist():
            if row["path"] is not None:
                yield from _batched(found(row["path"], MEDIA_SUFFIXES[row.get("modality") or "image"]), COLUMNS)


def register(spark: SparkSession) -> None:
    """Makes the format and the table function known to the session."""
    spark.dataSource.register(ArchiveSource)
    spark.udtf.register("archive_members", F.arrow_udtf(ArchiveMembers, returnType=MEMBERS))
