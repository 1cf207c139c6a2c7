"""Mixing sources to target weights.

Each document gets a hash-random key. Within its source the keys are cut into even ranges, each
range is sorted and summed on its own, and the ranges' totals are summed in turn, which gives each
document the number of words that stand before it; a source with a third of all rows is simply
many ranges. The mix then takes each source as many whole times as its target holds it, and in the
last round every document up to the place where the budget ends.

Only ids, sources, sizes and keys are moved, never texts (but those of the repeated rows that a cut
falls among). Rows with equal id and text have one key; they're one row with a count until the sums are made,
so any number of them costs one row, and a cut among them takes as many as fit.

Null or empty text: size 0. Null source: a source of its own, sorted last. Null ids count as the empty
id in the keys. Repeated rows count each. Sources of size 0 get target 0, and their documents aren't taken.
Very long texts are only measured. Columns of other names, also those that clash, pass through `mix`. An empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, tagged

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Rows of a source in one range of keys, on average.
RANGE_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _key(docs: DataFrame, text: str) -> F.Column:
    """60 bits of a digest of id and text, so that any engine can find the same order."""
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def _size(text: str) -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, rows -> also target, the words that the mix shall take of it.

    A source's target is min(most * size, level * weight), with the one level at which the targets
    sum to share * all sizes; it is found by sorting the sources by the level that fills them.
    The windows run over one row per source.
    """
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights))) + 1).cast("int"))
    order = Window.orderBy("fill", F.col("source").asc_nulls_last())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    full = F.lit(float(most)) * F.col("source_size")
    left = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum(full).over(before), F.lit(0.0))
    level = left / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    levels = sizes.withColumn("weight", w.cast("double")).withColumn("fill", full / F.col("weight")).withColumn("level", level)
    found = F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "level"))).over(everything)["level"]
    return levels.withColumn("found", found).select("source", "source_size", "rows", F.least(full, F.coalesce(F.col("found"), F.lit(0.0)) * F.col("weight")).alias("target"))


def prefix_sums(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """One row per different document: doc_id, source, size, key, copies (rows of it), source_size, target, before (the
    words of its source's documents with smaller keys), rounds (whole times) and budget (of the last round)."""
    each = docs.select("doc_id", F.col(source).alias("source"), _size(text).alias("size"), _key(docs, text).alias("key"))
    slim = materialize(each.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies")), "sizes")
    by_source = materialize(targets(slim.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count(F.lit(1)).alias("rows"))), "targets")
    words = F.round("target").cast("long")
    by_source = by_source.select(F.col("source").alias("s"), "source_size", "target", F.ceil(F.col("rows") / RANGE_ROWS).alias("ranges"), F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(0).alias("rounds"), words.alias("words"))
    by_source = by_source.withColumn("budget", F.col("words") - F.col("rounds") * F.col("source_size")).drop("words")
    ranged = slim.join(by_source, slim["source"].eqNullSafe(by_source["s"])).drop("s")
    ranged = ranged.withColumn("range", F.least(F.floor(F.col("key") / F.lit(float(2**60)) * F.col("ranges")), F.col("ranges") - 1))
    totals = ranged.groupBy("source", "range").agg(F.sum(F.col("size") * F.col("copies")).alias("total"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("total").over(upto), F.lit(0)).alias("start"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    summed = ranged.withColumn("inside", F.coalesce(F.sum(F.col("size") * F.col("copies")).over(within), F.lit(0)))
    joined = summed.join(totals, summed["source"].eqNullSafe(totals["s"]) & (summed["range"] == totals["r"]))
    return joined.select("doc_id", "source", "size", "key", "copies", "source_size", "target", "rounds", "budget", (F.col("start") + F.col("inside")).alias("before"))


def digest(docs: DataFrame) -> DataFrame:
    """One row per document with the words that the mix takes of it; in the last round the document
    at the end of the budget gives the words that are still missing, so a source's words meet its target."""
    sums = prefix_sums(docs.select("doc_id", "source", "text"))
    sums = sums.withColumn("nth", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).withColumn("before", F.col("before") + F.col("nth") * F.col("size"))
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("before")))
    return sums.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), taken.cast("long").alias("taken"), "source")


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents, whole, with the columns of `docs`: each as many times as the mix takes it.

    The document at the end of a source's budget is taken if more than half of it fits. What is taken
    follows from a document's key and its source's last key, so texts aren't joined by id. Of the rows that
    share the last key as many are taken as fit: they alone are numbered, by their partitions' counts.
    """
    p = tagged(docs)
    sums = prefix_sums(docs, text, source)
    size, left = F.col("size"), F.col("budget") - F.col("before")
    fit = F.when(size > 0, F.least(F.col("copies"), F.ceil(left / size - F.lit(0.5)))).when(left > 0, F.col("copies")).otherwise(0)
    last = F.max(F.when(fit > 0, F.struct("key", fit.alias("fit"), "copies")))
    cuts = sums.groupBy(F.col("source").alias(p + "s")).agg(F.first("rounds").alias(p + "rounds"), last.alias("last"))
    cuts = materialize(cuts.select(p + "s", p + "rounds", F.col("last.key").alias(p + "last"), F.col("last.fit").alias(p + "fit"), F.col("last.copies").alias(p + "of")), "cuts")
    keyed = docs.withColumn(p + "key", _key(docs, text))
    joined = keyed.join(cuts, keyed[source].eqNullSafe(cuts[p + "s"]))
    at_cut = F.coalesce((F.col(p + "key") == F.col(p + "last")) & (F.col(p + "fit") < F.col(p + "of")), F.lit(False))
    more = F.when(F.col(p + "key") <= F.col(p + "last"), 1).otherwise(0)
    whole = joined.where(~at_cut).withColumn(p + "more", more)
    split = materialize(joined.where(at_cut).withColumn(p + "part", F.spark_partition_id()), "split")  # files fix the parts
    counts = split.groupBy(p + "s", p + "part").agg(F.count(F.lit(1)).alias(p + "n"))
    upto = Window.partitionBy(p + "s").orderBy(p + "part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(p + "s").alias(p + "s2"), F.col(p + "part").alias(p + "part2"), F.coalesce(F.sum(p + "n").over(upto), F.lit(0)).alias(p + "start"))
    rank = F.row_number().over(Window.partitionBy(p + "s", p + "part").orderBy(p + "key"))
    numbered = split.withColumn(p + "rank", rank).join(counts, F.col(p + "s").eqNullSafe(F.col(p + "s2")) & (F.col(p + "part") == F.col(p + "part2")))
    some = numbered.withColumn(p + "more", F.when(F.col(p + "start") + F.col(p + "rank") <= F.col(p + "fit"), 1).otherwise(0))
    both = whole.select(*docs.columns, p + "rounds", p + "more").unionByName(some.select(*docs.columns, p + "rounds", p + "more"))
    times = F.col(p + "rounds") + F.col(p + "more")
    return both.withColumn(p + "copy", F.explode(F.array_repeat(F.lit(1), times.cast("int")))).select(*docs.columns)
