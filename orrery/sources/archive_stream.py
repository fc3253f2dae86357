"""Archives as they arrive: ``spark.readStream.format("archive_arrivals")``, each archive exactly once.

The source keeps a ledger beside the checkpoint: files that number the archives in the order in which they were found. An offset is a
position in the ledger. Entries are written before any offset that covers them, and never change, so a batch that is repeated after a
failure, at whatever point, reads the same archives; a folder's listing, which does change, is never read twice for one position.
Executors read the archives; the driver sees their names alone, those that are new.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from ..schemas import MEDIA_SUFFIXES
from .archive_format import COLUMNS, Part, found, listed
from .archives import MEMBERS, _batched


class Ledger:
    """Numbered archives: each file holds the paths from the position in its name on."""

    def __init__(self, folder: str):
        local = folder.startswith(("file:", "/"))
        self.store, self.root = (fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(folder)

    def files(self) -> list[tuple[int, str]]:
        found_ = self.store.get_file_info(fs.FileSelector(self.root, allow_not_found=True))
        return sorted((int(f.base_name.split(".")[0]), f.path) for f in found_ if f.base_name.endswith(".json"))

    def entries(self, start: int = 0, stop: int | None = None) -> list[str]:
        """The paths at positions [start, stop)."""
        out: list[str] = []
        files = self.files()
        ends = [at for at, _ in files[1:]] + [None]
        for (at, path), end in zip(files, ends, strict=False):  # no files, no ends
            if (end is not None and end <= start) or (stop is not None and at >= stop):
                continue
            with self.store.open_input_stream(path, compression=None) as f:
                paths = json.loads(f.read())
            out += paths[max(start - at, 0) : None if stop is None else stop - at]
        return out

    def append(self, paths: list[str]) -> int:
        """Adds paths that aren't there yet; returns the ledger's length. The file appears whole or not at all."""
        known = self.entries()
        new = sorted(set(paths) - set(known))
        if new:
            self.store.create_dir(self.root, recursive=True)
            name = f"{self.root}/{len(known):012d}"
            with self.store.open_output_stream(f"{name}.tmp", compression=None) as f:
                f.write(json.dumps(new).encode())
            self.store.move(f"{name}.tmp", f"{name}.json")
        return len(known) + len(new)


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, path: str, ledger: str, modality: str):
        self.path, self.ledger, self.suffixes = path, Ledger(ledger), MEDIA_SUFFIXES[modality]

    def initialOffset(self) -> dict:
        return {"position": 0}

    def latestOffset(self) -> dict:
        return {"position": self.ledger.append([path for path, _ in listed(self.path)])}

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return [Part(path) for path in self.ledger.entries(start["position"], end["position"])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        yield from _batched(found(partition.path, self.suffixes), COLUMNS)

    def commit(self, end: dict) -> None:
        """Nothing: the ledger is as it was."""


class ArrivalSource(DataSource):
    """Options: path (a folder of archives), ledger (a folder of its own), modality (image)."""

    @classmethod
    def name(cls) -> str:
        return "archive_arrivals"

    def schema(self) -> str:
        return MEMBERS

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(self.options["path"], self.options["ledger"], self.options.get("modality", "image"))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrivalSource)
