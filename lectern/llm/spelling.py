"""Spelling variants: words one letter apart, each drawn to the more frequent form, by symmetric deletes.

Every word emits itself and its distinct single deletions as keys. Words within one inserted, deleted or
replaced letter of each other share a key, so an equi-join of the keys finds all of them; each pair is then
verified to be exactly one letter apart. A key of length m is shared by at most (m + 1) * (letters of the
alphabet) + 1 words, so no group of the join grows with the corpus. Keys are polynomial hashes modulo
2**61 - 1 that differ from each other in constant time, so a word of any length has its keys in time in
proportion to its length, and words longer than `LONG` travel as digests; two words whose keys meet by
chance only are refused by the verification. A word's form is the near word of largest count, if that is at
least `RATIO` times its own. Counts at least double along forms, so doubling the steps reaches every root within
six joins for counts below 2**63.

Null texts have no words. A null id stands as an empty string where ids are read. Repeated rows count each.
Letters are A-Z, a-z and U+00C0 to U+00FF; only A-Z are lower-cased. Ties between near words of equal
count go to the smallest in code-point order. Other columns aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, materialize

LEAST_LENGTH, LEAST_COUNT, RATIO = 5, 3, 2
BETWEEN = r"[^A-Za-zÀ-ÿ]+"
#: Letters beyond which a word is joined by its digest instead of itself.
LONG = 64
PRIME, BASE = 2**61 - 1, 0x1F35B9D4C8A1E27
#: Keys in a batch that a task gives on.
BATCH = 100_000


def runs(docs: DataFrame, text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """doc_id and run: every maximal run of at least `least` letters, lower-cased."""
    lower = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return docs.select("doc_id", F.explode(F.split(lower, BETWEEN)).alias("run")).where(F.length("run") >= least)


def counted(tokens: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n of a table of words, one row per occurrence."""
    return tokens.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def keys(word: str) -> set[int]:
    """Hashes of the word and of each of its single deletions: all in one pass, as a deletion's hash follows from the word's."""
    before, prefix, scale = [0], 0, [1]
    for c in word:
        prefix = (prefix * BASE + ord(c)) % PRIME
        before.append(prefix)
        scale.append(scale[-1] * BASE % PRIME)
    n = len(word)
    return {prefix} | {(prefix + (before[i] - before[i + 1]) * scale[n - 1 - i]) % PRIME for i in range(n)}


def emitted(words: DataFrame) -> DataFrame:
    """key, id and n: each word's keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: tuple[list, list, list] = ([], [], [])

        def made() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())], names=["key", "id", "n"])
            for c in found:
                c.clear()
            return out

        for batch in batches:
            for word, name, n in zip(*(batch.column(c) for c in ("word", "id", "n")), strict=True):
                some = keys(word.as_py())
                found[0].extend(some)
                found[1].extend([name.as_py()] * len(some))
                found[2].extend([n.as_py()] * len(some))
                if len(found[0]) >= BATCH:
                    yield made()
        yield made()

    return words.select("word", "id", "n").mapInArrow(run, "key long, id string, n long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b, n_a and n_b of every unordered pair of words (with their ids) that are exactly one letter apart."""
    made = emitted(words)
    left = made.select("key", F.col("id").alias("id_a"), F.col("n").alias("n_a"))
    right = made.select("key", F.col("id").alias("id_b"), F.col("n").alias("n_b"))
    met = left.join(right, "key").where("id_a < id_b").drop("key")
    is_long = F.col("id_a").startswith("#") | F.col("id_b").startswith("#")
    whole = words.where(F.col("id").startswith("#"))
    named = lambda side: whole.select(F.col("id").alias(f"id_{side}"), F.col("word").alias(f"long_{side}"))
    short = met.where(~is_long).select(F.col("id_a").alias("a"), F.col("id_b").alias("b"), "n_a", "n_b")
    long = met.where(is_long).distinct().join(named("a"), "id_a", "left").join(named("b"), "id_b", "left")
    long = long.select(F.coalesce("long_a", "id_a").alias("a"), F.coalesce("long_b", "id_b").alias("b"), "n_a", "n_b")
    return short.union(long).where(F.levenshtein("a", "b", 1) == 1).distinct()


def roots(links: DataFrame) -> DataFrame:
    """word and root: where following (word, form) ends, for each word that has a form. Every step is a join of the table with
    itself, and doubles how far a word has come."""
    reached = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialize(reached.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        forget(links.sparkSession, reached)
        reached = moved.select("word", "root")
        if not moved.where("moved").take(1):
            return reached


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n and root of a table of distinct words and their counts."""
    spark = words.sparkSession
    held = materialize(words.select("word", "n", F.when(F.length("word") > LONG, F.concat(F.lit("#"), F.sha2("word", 256))).otherwise(F.col("word")).alias("id")), "words")
    pairs = materialize(near_pairs(held), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).union(pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m")))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("less"), "other")).alias("best"))
    is_form = -F.col("best.less") >= ratio * F.col("n")
    formed = held.select("word", "n").join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    formed = materialize(formed, "forms")
    forget(spark, held, pairs)
    return formed.join(roots(formed.where("form IS NOT NULL")), "word", "left").withColumn("root", F.coalesce("root", "word"))


def digest(docs: DataFrame, every: int = 97) -> DataFrame:
    """word, form, root, n, n_near, form_n. One letter of every `every`th run, by a checksum of id and run, is left out before words are counted."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")))
    at = (F.col("h") % F.length("run")).cast("int")
    thinned = F.when(F.col("h") % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    tokens = runs(docs.select("doc_id", "text")).withColumn("h", h).select(thinned.alias("word"))
    return variants(counted(tokens)).select("word", "form", "root", "n", "n_near", "form_n")
