"""Watching a folder for new and changed files."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame

from ..sources import files, folder


def watch(library, path: str, then: Callable | None = None, once: bool = False, interval: str = "5 seconds"):
    """Indexes what is in the folder and what comes to it or changes in it, as a stream of files whose checkpoint lies
    in the library's folder: a watch that is started again goes on where it was cut off. The library skips texts that
    haven't changed, which makes a repeated batch harmless. Files that go stay indexed. `once`: ends when all there is
    has been seen."""
    place = f"{library.path}/watch-{zlib.crc32(path.encode())}"

    def tick(new: DataFrame, number: int) -> None:
        result = library.add(files.extract(new, library.extractors))
        if then and (result.documents or result.failed):
            then(result)

    writer = folder.stream(library.spark, path, f"{place}/listings").writeStream.foreachBatch(tick).option("checkpointLocation", place)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
