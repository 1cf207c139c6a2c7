"""Labelled rows for the classifiers: a bounded sample, never from the held-out fold, fitted in one task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fold

#: Most labelled documents that a classifier is fitted on, and most bytes of their texts. Documents are
#: taken in the order of the digests of their ids, so the sample doesn't depend on partitions or on the order of rows.
MOST_LABELLED, MOST_BYTES = 12000, 200_000_000
#: Numbers that the first 60 bits of a digest can be.
DIGESTS = 1 << 60


def training_rows(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", most: int = MOST_LABELLED) -> DataFrame:
    """order, doc_id, label (0 or 1), text of at most `most` documents whose crc32(doc_id) mod 4 is not 2.

    A label that is null doesn't count; of several labels of a document the largest counts. A document
    that stands in `docs` more than once stands so in the sample. If there are more than `most`, the share
    of digests that is taken makes four standard deviations less than `most` of them on average. Rows of ids
    that stand there very often can still be more: then the first `most` in the order of digest, id and hash of
    the text are taken, by a key that ends them, so that only equal texts of one id can be exchanged for each other.
    """
    wanted = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    wanted = wanted.groupBy("doc_id").agg((F.max(label) > 0).cast("int").alias("label"))
    there = docs.select("doc_id").join(wanted, "doc_id").count()
    order = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 15), 16, 10).cast("long")
    wanted = wanted.withColumn("order", order)
    rows = docs.select("doc_id", F.col(text).alias("text"))
    if there > most:
        wanted = wanted.where(F.col("order") < int(DIGESTS * max(most - 4 * most**0.5, most / 2) / there))
        if docs.select("doc_id").join(wanted, "doc_id").count() > most:  # one id stands there very often
            keyed, key = rows.join(wanted, "doc_id").withColumn("hash", F.xxhash64("text")), ("order", "doc_id", "hash")
            last = keyed.select(*key).orderBy(*key).limit(most).agg(F.max(F.struct(*key))).first()[0]
            ends = F.struct(F.lit(last[0]), F.lit(last[1]).cast(docs.schema["doc_id"].dataType), F.lit(last[2]))
            return keyed.where(F.struct(*key) <= ends).select("order", "doc_id", "label", "text").limit(most)
    return rows.join(wanted, "doc_id").select("order", "doc_id", "label", "text").limit(most)


def fitted(rows: DataFrame, train: Callable[[list[str], list[int]], np.ndarray], most: int = MOST_BYTES) -> np.ndarray:
    """What `train` makes (float32) of the rows' texts and labels, in one task; only the weights come to the driver.

    The task holds at most `most` bytes of texts, the first in order (one text at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, held = [], [], 0
        for batch, some in blocks(batches, "text"):
            for t, y in zip(some, batch.column("label").to_pylist(), strict=True):
                held += len(t.encode())
                if texts and held > most:
                    break
                texts.append(t)
                labels.append(y)
        yield pa.RecordBatch.from_arrays([pa.array([train(texts, labels).astype(np.float32).tobytes()], pa.binary())], names=["weights"])

    one = rows.repartition(1).sortWithinPartitions("order", "doc_id", "text")
    found = one.mapInArrow(run, "weights binary").collect()
    return np.frombuffer(found[0][0], np.float32) if found else train([], []).astype(np.float32)
