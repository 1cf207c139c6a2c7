"""Benchmark decontamination by winnowing, in SQL expressions only.

Words are lower-cased (A-Z) runs of letters, digits and all characters beyond ASCII. A window is
`WINDOW` neighbouring words of an item; an item of fewer words is one window. Every text is cut into
k-grams of `GRAM` words; of each `WINDOW - GRAM + 1` neighbouring k-grams the one with the smallest hash
is kept, the last of equal ones. A window's own k-grams are exactly one such neighbourhood, so a window
that stands in a document gives both sides the same kept hash at the same place of the window: joining
the kept hashes loses no shared window. A hit is then extended: the windows around its k-gram are
compared with the items' windows, word for word, so a hash alone decides nothing. Items shorter than a
window are found by the hashes of all grams of their own length, only if there are such items.

Work on equal texts is shared: rows meet by the digest of the text. The hashes of one document are one
row, written once; only documents with a hit are read again. Documents with the same windows share
the list of their items, so a passage that many documents and many items have isn't paired.

Null text or a text without words: no windows, `n_words` 0. Null, repeated and clashing ids: every row of
`docs` gives one row, ids aren't used to join; items are told apart by id, a null id counts as the empty
string. Other columns aren't read. An empty benchmark marks nothing. A very long text is one row with an
array of its words, at most 2**28, as Spark's arrays hold no more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, held_bytes, materialize

WINDOW = 10
GRAM = 6
#: Bits of a kept number that hold the place; the others are hash. An array of more elements doesn't fit into a Spark row.
PLACE_BITS = 28
#: Bytes of one side up to which it is sent to all executors instead of being shuffled.
MOST_BROADCAST = 8_000_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a column. A text that begins or ends with a separator has an empty string there, which goes."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    parts = F.array(F.split(lower, BETWEEN))
    return F.transform(parts, lambda p: F.slice(p, F.when(p[0] == "", 2).otherwise(1), F.greatest(F.size(p) - F.when(p[0] == "", 1).otherwise(0) - F.when((F.size(p) > 1) & (F.element_at(p, -1) == ""), 1).otherwise(0), F.lit(0))))[0]


def grams(size: int) -> str:
    """SQL: for each gram of `size` words of `words`, its hash with its place in the low bits."""
    at = ", ".join(f"get(words, i + {k})" for k in range(size))
    return f"if(size(words) >= {size}, transform(sequence(0, greatest(size(words) - {size}, 0)), i -> shiftleft(xxhash64({size}, {at}), {PLACE_BITS}) | i), cast(array() AS array<bigint>))"


def kept(window: int, gram: int) -> str:
    """SQL: the numbers of `grams` that winnowing keeps. Places are complemented, so that the smallest of equal hashes is the last."""
    among = window - gram + 1
    at = ", ".join(f"get(grams, i + {k}) ^ {2**PLACE_BITS - 1}L" for k in range(among))
    smallest = f"least({at})" if among > 1 else at
    return f"if(size(grams) >= {among}, array_distinct(transform(sequence(0, greatest(size(grams) - {among}, 0)), i -> {smallest} ^ {2**PLACE_BITS - 1}L)), cast(array() AS array<bigint>))"


def fingerprints(df: DataFrame, short: list[int], window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Adds `prints`: hashes and places that winnowing keeps of `words`, and all grams of the lengths in `short`."""
    cut = df.withColumn("grams", F.expr(grams(gram)))
    some = [F.expr(kept(window, gram)), *(F.expr(grams(n)) for n in short)]
    return cut.withColumn("prints", F.concat(*some)).drop("grams")


def windows(short: list[int], window: int = WINDOW) -> str:
    """SQL: (s, e) of the whole windows of `words` around each place in `places`: those of `window` words that hold the k-gram
    there, and those of each length in `short` that begin there."""
    last = f"size(words) - {window}"
    around = f"if({last} >= 0, array_distinct(flatten(transform(places, p -> sequence(least(greatest(p - {window - GRAM}, 0), {last}), least(p, {last}))))), cast(array() AS array<int>))"
    begun = [f"transform(filter(places, p -> p + {n} <= size(words)), p -> named_struct('s', p, 'e', p + {n}))" for n in short]
    return f"concat(transform({around}, s -> named_struct('s', s, 'e', s + {window})), {', '.join(begun) or 'array()'})"


def hit_words(lengths: list[int]) -> str:
    """SQL: the sorted places of all words inside `hits`. Windows of one length begin and end in the same order, so each adds only
    the words behind the one before."""
    added = "flatten(transform(h, (x, i) -> sequence(greatest(x.s, coalesce(get(h, i - 1).e, 0)), x.e - 1)))"
    parts = [f"transform(array(filter(hits, x -> x.e - x.s = {n})), h -> {added})[0]" for n in lengths]
    return f"array_sort(array_distinct(concat({', '.join(parts)})))"


def contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: its columns `doc_id`, `n_words`, and `n_hit`, `spans` (merged hits, [s, e) in words), `n_items`, `item_ids`."""
    spark = docs.sparkSession
    cut = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(item_text).alias("words")).where("size(words) > 0")
    cut = materialize(cut, "items")
    short = sorted(r[0] for r in cut.where(F.size("words") < window).select(F.size("words")).distinct().collect())  # at most `window` - 1 numbers
    asked = materialize(fingerprints(cut, short, window).select(F.explode("prints").alias("print")).select(F.shiftright("print", PLACE_BITS).alias("hash")).distinct(), "asked")
    phrase = f"explode(if(size(words) < {window}, array(array_join(words, ' ')), transform(sequence(1, greatest(size(words) - {window - 1}, 1)), i -> array_join(slice(words, i, {window}), ' '))))"
    phrases = materialize(cut.select("item", F.expr(phrase).alias("phrase")).distinct(), "phrases")

    keyed = docs.select("doc_id", F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), words(text).alias("words"))
    printed = materialize(fingerprints(keyed, short, window).select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), "prints"), "prints")
    met = printed.select("digest", F.explode("prints").alias("print")).select("digest", F.shiftright("print", PLACE_BITS).alias("hash"), F.col("print").bitwiseAND(2**PLACE_BITS - 1).cast("int").alias("place"))
    met = met.join(held_bytes(asked, F.lit(8), MOST_BROADCAST), "hash", "left_semi").groupBy("digest").agg(F.collect_set("place").alias("places"))
    met = materialize(met, "met")

    read = docs.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("digest"), text)
    read = read.join(held_bytes(met, F.lit(64) + 4 * F.size("places"), MOST_BROADCAST), "digest").select("digest", "places", words(text).alias("words"))
    around = read.select("digest", "words", F.explode(F.expr(windows(short, window))).alias("at")).select("digest", "at", F.expr("array_join(slice(words, at.s + 1, at.e - at.s), ' ')").alias("phrase"))
    texts = phrases.select("phrase").distinct()
    hits = around.join(held_bytes(texts, F.octet_length("phrase") + 8, MOST_BROADCAST), "phrase", "left_semi").groupBy("digest").agg(F.array_sort(F.collect_set("at")).alias("hits"), F.array_sort(F.collect_set("phrase")).alias("phrases"))
    hits = hits.select("digest", "phrases", F.sha2(F.array_join("phrases", ","), 256).alias("alike"), F.expr(hit_words([window, *short])).alias("hit"))
    hits = materialize(hits, "hits")

    sets = hits.select("alike", "phrases").dropDuplicates(["alike"]).select("alike", F.explode("phrases").alias("phrase"))
    named = sets.join(phrases, "phrase").groupBy("alike").agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    spans = "zip_with(filter(hit, (x, i) -> NOT coalesce(get(hit, i - 1) = x - 1, false)), filter(hit, (x, i) -> NOT coalesce(get(hit, i + 1) = x + 1, false)), (s, e) -> named_struct('s', s, 'e', e + 1))"
    found = hits.select("digest", "alike", F.size("hit").cast("long").alias("n_hit"), F.expr(spans).alias("spans")).join(named, "alike").drop("alike")
    found = materialize(found, "found")
    forget(spark, cut, asked, phrases, met, hits)
    wide = F.lit(64) + 8 * F.size("spans") + F.octet_length(F.array_join("item_ids", ",")) + 8 * F.size("item_ids")
    return printed.select("doc_id", "digest", "n_words").join(held_bytes(found, wide, MOST_BROADCAST), "digest", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() AS array<struct<s:int,e:int>>)")).alias("spans"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.expr("cast(array() AS array<string>)")).alias("item_ids"),
    )


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined) and contaminated."""
    out = contaminated(docs.select("doc_id", "text"), items.select("item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
