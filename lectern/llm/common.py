"""What the operators of this subpackage share: tables, scratch space, batches of texts."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker handles at once.
BYTES_PER_BLOCK = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only a session without that setting (tests, one machine) gets a local folder, once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet to the shared folder and read it back: what comes later
    starts from files that outlive any executor, not from a lineage or a local cache."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes materialized tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def held_bytes(df: DataFrame, width: F.Column, most: int) -> DataFrame:
    """`df`, marked to be sent to all executors if its rows, each of `width` bytes, have at most `most` bytes together."""
    return F.broadcast(df) if (df.agg(F.sum(width)).first()[0] or 0) <= most else df


def tagged(df: DataFrame, prefix: str = "__lt") -> str:
    """A column prefix that no column of `df` begins with, whatever its letter case."""
    names = [c.lower() for c in df.columns]
    while any(c.startswith(prefix) for c in names):
        prefix += "_"
    return prefix


def trim() -> None:
    """Gives memory that earlier work of this Python worker has freed back to the system: workers live as long as their executor."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = BYTES_PER_BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches of about `size` bytes of text (one row at least), with their texts (null: empty).

    The slices are cut by the texts' lengths before any of them becomes a Python string. What a worker freed before is
    given back when a task begins and when its rows end."""
    trim()
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < len(batch):
            held = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + size, "right")))
            some = batch.slice(start, stop - start)
            yield some, [t or "" for t in some.column(text).to_pylist()]
            start = stop
    trim()


def fold(column) -> F.Column:
    """crc32(doc_id as text) mod 4: rows with 2 are held out of all training."""
    return F.crc32(column.cast("string")) % 4


def per_process(key: object, make: Callable[[], object]):
    """What `make` gives, made once in each Python process: workers that run many tasks compile
    and load things once. Functions come to a worker anew with every task, so the place is a module."""
    held = sys.modules.setdefault("_lectern_held", types.ModuleType("_lectern_held")).__dict__.setdefault("held", {})
    if key not in held:
        held[key] = make()
    return held[key]
