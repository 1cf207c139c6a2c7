"""Change detection, versions and differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim

MOST_LINES, MOST_CHARS = 50, 200


def changed(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of `incoming` (path, content) whose path is new or whose content differs from that path's last version in `known`."""
    digest = F.col("digest") if "digest" in known.columns else F.sha2("content", 256)  # a stored digest spares reading all texts
    last = known.groupBy("path").agg(F.max_by(digest, "version").alias("digest"))
    return incoming.withColumn("digest", F.sha2("content", 256)).join(last, ["path", "digest"], "left_anti").drop("digest")


def next_versions(known: DataFrame, incoming: DataFrame, ts: Column) -> DataFrame:
    """A next version of each path in `incoming`, after those in `known`."""
    last = known.groupBy("path").agg(F.max("version").alias("last"))
    return incoming.join(last, "path", "left").select("path", (F.coalesce("last", F.lit(0)) + 1).cast("int").alias("version"), "content", ts.cast("long").alias("ts"))


def append_versions(known: DataFrame, incoming: DataFrame, ts: Column) -> DataFrame:
    """`known` and a next version of each path in `incoming`."""
    return known.unionByName(next_versions(known, incoming, ts))


def lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != "")


def only_in(a: Column, b: Column) -> Column:
    """Different lines of a that b lacks, in order, cut to 200 characters, 50 at most."""
    return F.slice(F.transform(F.array_except(lines(a), lines(b)), lambda x: F.substring(x, 1, MOST_CHARS)), 1, MOST_LINES)


def diff(versions: DataFrame) -> DataFrame:
    """path, version_a, version_b, additions, removals, changes of each path's last two versions."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version")))
    last = versions.withColumn("rank", rank).where("rank <= 2").groupBy("path").agg(F.min_by("content", "version").alias("a"), F.max_by("content", "version").alias("b"), F.min("version").alias("version_a"), F.max("version").alias("version_b")).where("version_a < version_b")
    return last.select("path", "version_a", "version_b", only_in(F.col("b"), F.col("a")).alias("additions"), only_in(F.col("a"), F.col("b")).alias("removals"), F.expr("cast(array() AS array<struct<field:string,`from`:string,to:string>>)").alias("changes"))


def first_copies(docs: DataFrame, key: str = "doc_id", content: str = "text") -> DataFrame:
    """Each different content once: its smallest key and how many rows have it."""
    return docs.groupBy(F.sha2(F.coalesce(content, F.lit("")), 256).alias("digest")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
