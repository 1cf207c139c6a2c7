"""Document fingerprints from Lempel-Ziv phrases.

A text is parsed into the phrases of its own growing dictionary (each phrase is the shortest string
that isn't in the dictionary yet), the set of phrases is hashed, and the `SIZE` smallest hashes are
its fingerprint, written as hex. Two fingerprints' likeness estimates the Jaccard similarity of the
phrase sets: of the smallest hashes of both together, the share that both hold. It is exact for sets of
up to `SIZE` phrases. Equal texts have equal fingerprints; the empty text's is empty and is like
another empty one only.

The comparison with each document's successor sorts by id without a global sort of texts: ids alone
give the bounds of many small ranges, each text moves once, to its range, and the first document of a
range moves to the range before it as well. Null ids come last, as the largest descending rank; rows
with one id stand in the order of a hash of their texts, then of the texts, descending, null last; equal rows follow
each other. An id of more rows than two ranges should hold, null among them, is cut into ranges by that hash, so a
third of all rows may have one id. Null text: empty. A very long text is parsed whole, in time and memory in
proportion to its length. A single document is its own next one. Columns of other names aren't read. An empty table
gives no rows. Rows that are equal in id and text share a range and so a task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes in a fingerprint.
SIZE = 128
#: Ranges of ids for each shuffle partition.
RANGES = 16


def parse(text: str, phrases: dict[str, None], begun: str = "") -> str:
    """Adds the phrases of `text` to `phrases`, in order; returns the unfinished one, which comes in as `begun`."""
    w = begun
    for c in text:
        w += c
        if w not in phrases:
            phrases[w] = None
            w = ""
    return w


def hashes(phrases: list[str]) -> np.ndarray:
    """32-bit hashes: a checksum, then a finaliser that spreads its bits."""
    h = np.fromiter(map(zlib.crc32, map(str.encode, phrases)), np.uint32, len(phrases))
    for shift, factor in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> np.uint32(shift)) * np.uint32(factor)
    return h ^ h >> np.uint32(16)


def smallest(h: np.ndarray, size: int = SIZE) -> np.ndarray:
    return np.unique(h)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    both, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    return float((counts[:size] == 2).mean()) if len(both) else 1.0


def written(h: np.ndarray) -> str:
    return h.astype(">u4").tobytes().hex()


def fingerprint(text: str | None, size: int = SIZE) -> np.ndarray:
    phrases: dict[str, None] = {}
    parse(text or "", phrases)
    return smallest(hashes([*phrases]), size)


class Parsed:
    """A text with its fingerprint, and its parse at the place where an edit of its last half begins."""

    def __init__(self, doc_id, text: str):
        self.doc_id, self.text = doc_id, text
        self.cut = len(text) - len(text) // 2
        self.first: dict[str, None] = {}
        self.begun = parse(text[: self.cut], self.first)
        whole = dict(self.first)
        parse(text[self.cut :], whole, self.begun)
        h = hashes([*whole])
        self.first_hashes, self.mark = h[: len(self.first)], smallest(h)

    def edited(self, other: str) -> tuple[str, np.ndarray]:
        """The text with its last half replaced by as much of the other's beginning, and its fingerprint."""
        new, phrases, n = other[: len(self.text) // 2], self.first, len(self.first)
        parse(new, phrases, self.begun)
        more = hashes([*phrases][n:])
        return self.text[: self.cut] + new, smallest(np.concatenate([self.first_hashes, more]))

    def row(self, after: Parsed) -> tuple:
        text, mark = self.edited(after.text)
        return (self.doc_id, len(self.text), hashlib.sha256(text.encode()).hexdigest(), written(self.mark), written(mark), likeness(self.mark, mark), likeness(self.mark, after.mark))


def in_ranges(docs: DataFrame, text: str) -> DataFrame:
    """doc_id, text, range (a number), carried: rows of a range and after them (carried) the first of the next one.

    Ranges ascend with ids, 0 without one. An id with more rows than two even ranges has a range of its own, in parts by `tie`."""
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * RANGES)
    tie = F.shiftrightunsigned(F.xxhash64("text"), 33)  # 31 bits
    known = docs.select("doc_id", F.col(text).alias("text"), F.col("doc_id").cast("long").alias("id"))
    span = known.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.count(F.lit(1)).alias("rows")).first()
    start = span["low"] if span["low"] is not None and span["high"] - span["low"] < 1 << 62 else 0  # as percentiles are found among doubles
    shares = [k / n for k in range(1, n)] or [0.5]
    found = known.where("id IS NOT NULL").select((F.col("id") - F.lit(start)).alias("id")).agg(F.percentile_approx("id", shares, 20 * n)).first()[0] or []
    often = known.groupBy("id").count().where(F.col("count") > max(1, 2 * span["rows"] // n)).collect()  # n / 2 ids at most
    alone = {r["id"]: r["count"] for r in often}
    ends = np.unique(np.array([x + start for x in found] + [x for i in alone if i is not None for x in (i, max(i - 1, -(2**63)))], np.int64))
    parts = np.ones(len(ends) + 2, np.int64)
    for i, rows in alone.items():
        parts[0 if i is None else np.searchsorted(ends, i) + 1] = -(-rows * n // span["rows"])
    offsets = np.cumsum(parts) - parts
    held = spark.sparkContext.broadcast((ends, parts, offsets))  # at most 6 n numbers

    def places(ids: pd.Series, none: pd.Series, ties: pd.Series) -> np.ndarray:
        ends, parts, offsets = held.value
        at = np.where(none.to_numpy(bool), 0, np.searchsorted(ends, ids.to_numpy(np.int64), "left") + 1)
        return offsets[at] + (ties.to_numpy(np.int64) * parts[at] >> 31)

    @F.pandas_udf("long")
    def place_of(ids: pd.Series, none: pd.Series, ties: pd.Series) -> pd.Series:
        return pd.Series(places(ids, none, ties))

    asked = (F.coalesce("id", F.lit(0).cast("long")), F.col("id").isNull())
    is_alone = F.when(F.col("id").isNull(), F.lit(None in alone)).otherwise(F.col("id").isin([i for i in alone if i is not None]))
    firsts = known.where(~is_alone).select("id", place_of(*asked, F.lit(0).cast("long")).alias("place")).groupBy("place").agg(F.max("id").alias("id"), F.lit(-1).cast("long").alias("tie"))
    if alone:
        cut = known.where(is_alone).select("id", tie.alias("tie")).withColumn("place", place_of(*asked, "tie"))
        firsts = firsts.unionByName(cut.groupBy("place").agg(F.max("id").alias("id"), F.max("tie").alias("tie")))
    first_id, first_tie, to = (np.full(parts.sum(), x, np.int64) for x in (0, -1, -1))
    order = sorted((r["place"], r["id"] or 0, r["tie"]) for r in firsts.collect())  # 4 n places at most
    for k, (place, i, t) in enumerate(order):
        first_id[place], first_tie[place], to[place] = i, t, order[(k + 1) % len(order)][0]
    plan = spark.sparkContext.broadcast((first_id, first_tie, to))

    @F.pandas_udf("range long, to long")
    def placed(ids: pd.Series, none: pd.Series, ties: pd.Series) -> pd.DataFrame:
        first_id, first_tie, to = plan.value
        at = places(ids, none, ties)
        first = (first_id[at] == ids.to_numpy(np.int64)) & ((first_tie[at] < 0) | (first_tie[at] == ties.to_numpy(np.int64)))
        return pd.DataFrame({"range": at, "to": np.where(first, to[at], -1)})

    slim = known.withColumn("tie", tie).withColumn("p", placed(*asked, "tie"))
    both = F.array(F.struct(F.col("p.range"), F.lit(0).alias("carried")), F.struct(F.col("p.to").alias("range"), F.lit(1).alias("carried")))
    moved = slim.select("doc_id", "text", "tie", F.explode(both).alias("place")).select("doc_id", "text", "tie", "place.range", "place.carried").where("range >= 0")
    return moved.repartition("range").sortWithinPartitions("range", "carried", F.col("doc_id").desc_nulls_last(), F.col("tie").desc(), F.col("text").desc_nulls_last()).drop("tie")


def compare(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and the likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, last_range = None, None
        for batch in batches:
            rows = []
            for doc_id, t, place, carried in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "range", "carried")), strict=True):
                if carried and last is None:
                    continue  # only the first carried row counts
                now = Parsed(doc_id, t or "")
                if last is not None:
                    assert last_range == place
                    rows.append(last.row(now))
                last, last_range = (None, None) if carried else (now, place)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    from pyspark.sql.pandas.types import to_arrow_type

    out = pa.schema([("doc_id", to_arrow_type(docs.schema["doc_id"].dataType)), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64())])
    return in_ranges(docs, text).mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
