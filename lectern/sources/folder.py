"""A folder as a stream of new and changed files: a streaming source whose offsets are listings.

An offset names a listing (path, time of change and length of each supported file), kept beside the stream's
checkpoint. The next offset is a new listing if it differs; a batch is what is new or changed between two
listings, dealt out in partitions of a few files, whose bytes the workers read. Nothing of a file passes
the driver but its line in the listing, which is written and compared as a sorted stream of lines. A listing
is dropped once a later batch is committed, so a batch that was cut off is made again from the same two. A file
that goes before it is read gives no row; one that changes meanwhile is read as it is and is listed again.

The file system is Arrow's for the path: local and mounted folders, HDFS, S3 and others.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.text import FORMATS, PLAIN

FILES = "path string, modificationTime timestamp, length long, content binary"
EXTENSIONS = {x for found in FORMATS.values() for x in found} | set(PLAIN)
#: Files, and bytes of them, that one task reads at most (one file at least).
FILES_PER_TASK, BYTES_PER_TASK = 256, 16_000_000


def opened(path: str) -> tuple[arrow_fs.FileSystem, str, str]:
    """(the file system, the path in it, what stands before such paths in the names of files)."""
    if path.startswith("file:") or path.startswith("/"):
        return arrow_fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", path).strip("/"), "file:"
    system, inner = arrow_fs.FileSystem.from_uri(path)
    return system, inner.rstrip("/"), path[: path.index(inner.rstrip("/"))] if inner.rstrip("/") in path else ""


def listing(path: str) -> list[tuple[str, int, int]]:
    """Sorted (path, change in microseconds, length) of the supported files below a folder, as deep as it goes. Hidden ones don't count."""
    system, inner, before = opened(path)
    found = system.get_file_info(arrow_fs.FileSelector(inner, recursive=True, allow_not_found=True))
    shown = lambda p: not any(part[0] in "._" for part in p[len(inner) :].strip("/").split("/"))
    return sorted((before + f.path, f.mtime_ns // 1000, f.size) for f in found if f.is_file and f.extension.lower() in EXTENSIONS and shown(f.path))


class Listings:
    """Numbered listings as files of one JSON line for each entry."""

    def __init__(self, place: str):
        self.system, self.place, _ = opened(place)
        self.system.create_dir(self.place, recursive=True)

    def numbers(self) -> list[int]:
        found = self.system.get_file_info(arrow_fs.FileSelector(self.place))
        return sorted(int(f.base_name.split(".")[0]) for f in found if re.fullmatch(r"\d+\.jsonl", f.base_name))

    def read(self, number: int) -> Iterator[tuple[str, int, int]]:
        if number:
            with self.system.open_input_stream(f"{self.place}/{number}.jsonl") as f:
                rest = b""
                while data := f.read(1 << 20):
                    *lines, rest = (rest + data).split(b"\n")
                    yield from (tuple(json.loads(x)) for x in lines)

    def write(self, number: int, entries: list[tuple[str, int, int]]) -> None:
        with self.system.open_output_stream(f"{self.place}/{number}.part") as f:
            for e in entries:
                f.write(json.dumps(e).encode() + b"\n")
        self.system.move(f"{self.place}/{number}.part", f"{self.place}/{number}.jsonl")

    def drop_before(self, number: int) -> None:
        for n in self.numbers():
            if n < number:
                self.system.delete_file(f"{self.place}/{n}.jsonl")


def changed(old: Iterator[tuple[str, int, int]], new: Iterator[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """Entries of `new` that aren't in `old`, both sorted: one merge."""
    last = None
    for entry, side in heapq.merge(((e, 0) for e in old), ((e, 1) for e in new)):
        if side and entry != last:
            yield entry
        last = entry


class Some(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        super().__init__(None)
        self.files = files


class FolderReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.listings = options["path"], options["listings"]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"listing": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        held = Listings(self.listings)
        last = max(held.numbers(), default=0)
        now = listing(self.path)
        if list(held.read(last)) == now:
            return {"listing": last}
        held.write(last + 1, now)
        return {"listing": last + 1}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        held = Listings(self.listings)
        out, some, size = [], [], 0
        for entry in changed(held.read(start["listing"]), held.read(end["listing"])):
            if some and (len(some) >= FILES_PER_TASK or size + entry[2] > BYTES_PER_TASK):
                out.append(Some(some))
                some, size = [], 0
            some.append(entry)
            size += entry[2]
        return [*out, Some(some)] if some else out

    def read(self, partition: Some) -> Iterator[tuple]:
        system, _, before = opened(self.path)
        for path, _, _ in partition.files:
            inner = path.removeprefix(before)
            info = system.get_file_info(inner)
            if info.is_file:
                with system.open_input_stream(inner) as f:
                    yield path, datetime.fromtimestamp(info.mtime_ns / 1e9, timezone.utc), info.size, f.read()

    def commit(self, end: dict) -> None:
        Listings(self.listings).drop_before(end["listing"])


class Folder(DataSource):
    """spark.readStream.format("lectern_folder").option("path", …).option("listings", a folder of the stream's own)."""

    @classmethod
    def name(cls) -> str:
        return "lectern_folder"

    def schema(self) -> str:
        return FILES

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return FolderReader(dict(self.options))


def stream(spark: SparkSession, path: str, listings: str):
    """path, modificationTime, length, content of new and changed files, batch by batch."""
    spark.dataSource.register(Folder)
    return spark.readStream.format("lectern_folder").option("path", path).option("listings", listings).load()
