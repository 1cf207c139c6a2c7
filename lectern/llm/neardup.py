"""Near-duplicate documents by order MinHash, verified by banded alignment.

Words are lower-cased runs of word characters; the units are shingles of five words (a shorter text
is one shingle), each labelled with its occurrence number. A sketch takes, under one random order of
labelled shingles, the two smallest of a text and keeps them in the order of the text, so it tells
texts apart whose parts are moved, as edit distance does. `BANDS` bands of two sketches give buckets.

Two texts are linked if an alignment of their shingles keeps L of them in order with
L / (n + m - L) >= 0.8. It is found by a longest increasing run over equal shingles, within the band
of displacements that this similarity allows at most.

Equal texts are one text from the start, by digest. In a bucket each text is held against one leader,
the smallest digest, and not against all others; that joins most groups, in time linear in the rows. A pair
whose sketches agree in fewer than `AGREE` of 40 places is left out there (at a similarity of 0.8 some 25 do);
it isn't lost, as its bucket isn't of one class then. The texts of buckets that aren't all in one class, leaders too, go through an exact join: a link needs a Jaccard
similarity of 0.8 of the labelled shingles too, so the rarest fifth of a text's labelled shingles, its prefix,
must hold one of the other's. After `LED` rounds of one leader for each shared prefix shingle, which join large
groups, all pairs from different classes that share one and can still reach the similarity by their lengths
and by its places are candidates. Those whose labelled shingles must differ too much, by the parities of their numbers in
`PARITIES` classes, a lower bound, are left out, and the rest are aligned; the same parities, folded to `FOLDED` words, stand in
every row of the last join, so that it makes no row of a pair that they rule out. Texts around a common template have prefixes of their own parts and give no
pairs. Which shingles are frequent is counted on some of the texts; it orders the prefixes and changes no result.
Classes are the connected components of the links, by alternating large-star and small-star steps over tables.

Null and empty texts are equal to each other; texts without word characters are one shingle of all
their characters. Rows with equal texts, and repeated rows, share a class. The class id is the
smallest doc_id in the class (null if all are null). An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, forget, materialize, tagged
from .tokens import Remembered

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 20
SKETCHES = 2 * BANDS
AGREE = 14
#: Rounds of one leader for each prefix shingle, before all pairs.
LED = 2
#: One in so many texts has its shingles counted for the order of prefixes; so many shingles have their counts kept at most.
COUNTED, MOST_COMMON = 8, 1_000_000
PARITIES = 2048
FOLDED = [f"f{k}" for k in range(8)]
WORD = re.compile(r"\w+")
#: Pairs of equal shingles, for each shingle, above which an alignment works on rows of bits instead.
MOST_PAIRS = 50
MIX = np.uint64(0xD6E8FEB86659FD93)
FACTORS = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX
    return h ^ h >> np.uint64(32)


def shingles(text: str, known: Remembered) -> np.ndarray:
    words = WORD.findall(text.lower()) or [text.strip()]
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    if len(h) < SHINGLE:
        return mixed((h * FACTORS[: len(h)]).sum(keepdims=True))
    n = len(h) - SHINGLE + 1
    out = np.zeros(n, np.uint64)
    for k in range(SHINGLE):
        out += h[k : k + n] * FACTORS[k]
    return mixed(out)


def occurrences(h: np.ndarray) -> np.ndarray:
    """How many equal values stand before each."""
    order = np.argsort(h, kind="stable")
    new = np.append(True, h[order][1:] != h[order][:-1])
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    out = np.empty(len(h), np.int64)
    out[order] = run
    return out


def sketch(h: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Order MinHash: for each seed a hash of the two smallest labelled shingles in the order of the text."""
    labelled = labels(h)
    if len(h) == 1:
        return mixed(labelled[0] ^ seeds)
    out = []
    step = max(1, 2_000_000 // len(h))
    for at in range(0, len(seeds), step):
        some = seeds[at : at + step]
        v = (labelled[None, :] ^ some[:, None]) * MIX
        v ^= v >> np.uint64(32)
        row = np.arange(len(some))
        a = v.argmin(1)
        v[row, a] = np.uint64(2**64 - 1)
        b = v.argmin(1)
        first, second = np.minimum(a, b), np.maximum(a, b)
        out.append(mixed(labelled[first] * FACTORS[1] + labelled[second] * FACTORS[2] + some))
    return np.concatenate(out)


def seeds() -> np.ndarray:
    return mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64) * FACTORS[3])


def longest_run(pairs: Iterator[int]) -> int:
    """Length of the longest increasing subsequence."""
    tails: list[int] = []
    for j in pairs:
        at = bisect_left(tails, j)
        if at == len(tails):
            tails.append(j)
        else:
            tails[at] = j
    return len(tails)


def longest_common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the longest common subsequence, with one bit for each place of b (Crochemore and others); its cost doesn't depend on repeats."""
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    full, often = (1 << len(b)) - 1, len(b) // 256
    row, held = full, {}
    for x, y in zip(low.tolist(), high.tolist(), strict=True):
        if x == y:
            continue
        if (places := held.get(x)) is None:
            if y - x <= 16:
                places = sum(1 << k for k in order[x:y].tolist())
            else:
                bits = np.zeros(len(b), bool)
                bits[order[x:y]] = True
                places = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if y - x > often:
                held[x] = places
        met = row & places
        row = (row + met | row - met) & full
    return len(b) - row.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment within the band keeps enough shingles of a and b."""
    total = len(a) + len(b)
    need = int(np.ceil(similarity * total / (1 + similarity) - 1e-9))
    if min(len(a), len(b)) < need:
        return False
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    if head + tail >= need:
        return True
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if head + tail + min(len(a), len(b)) < need:
        return False
    band = total - 2 * need
    order = np.argsort(b, kind="stable")
    low, high = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    if (high - low).sum() > MOST_PAIRS * (len(a) + len(b)):
        if head + tail + len(np.intersect1d(labels(a), labels(b), assume_unique=True)) < need:
            return False
        return head + tail + longest_common(a, b) >= need
    if head + tail + (high > low).sum() < need:
        return False
    places = order.tolist()
    some = np.flatnonzero(high > low)
    run = longest_run(j for i, x, y in zip(some.tolist(), low[some].tolist(), high[some].tolist(), strict=True) for j in reversed(places[x:y]) if -band <= i - j <= band)
    return head + tail + run >= need


def labels(h: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence numbers: equal ones within a text become different."""
    return h + occurrences(h).astype(np.uint64) * FACTORS[0]


def prefix(h: np.ndarray, known: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest labelled shingles, of which any text that is similar enough has at least one in its own prefix."""
    labelled = labels(h)
    at = np.minimum(np.searchsorted(known, labelled), max(len(known) - 1, 0))
    rank = np.where(known[at] == labelled, counts[at], 0) if len(known) else np.zeros(len(h), np.int64)
    return labelled[np.lexsort((labelled, rank))[: len(h) - int(np.ceil(SIMILARITY * len(h) - 1e-9)) + 1]]


def parities(h: np.ndarray) -> np.ndarray:
    """Bits: whether the number of labelled shingles in each class is odd. Two texts have as many that the other lacks as bits that differ, at least."""
    return np.packbits((np.bincount((labels(h) >> np.uint64(53)).astype(np.int64), minlength=PARITIES) & 1).astype(bool)).view(np.int64)


def sketched(keyed: DataFrame) -> DataFrame:
    """doc_id, key and the sketches of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, order = Remembered(word_hash), seeds()
        for batch, texts in blocks(batches, "text"):
            found = np.concatenate([sketch(shingles(t, known), order) for t in texts]).view(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(found) + 1, SKETCHES, dtype=np.int32)), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), lists], names=["doc_id", "key", "sketches"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    return keyed.mapInArrow(run, f"doc_id {kind}, key binary, sketches array<long>")


def likely(pairs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose sketches agree in at least AGREE places."""
    of = lambda c: firsts.select(F.col("key").alias(c), F.col("sketches").alias("s" + c))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda x: x))
    return pairs.join(of("b"), "b").join(of("a"), "a").where(same >= AGREE).select("a", "b")


def texts_of(used: DataFrame, keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """key and text of the different keys `k`, from the first row of each."""
    used = used.join(firsts.select(F.col("key").alias("k"), F.col("doc_id").alias("d")), "k")
    texts = keyed.join(used, (F.col("key") == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d"))).select("key", "doc_id", "text").dropDuplicates(["key", "doc_id"])
    return materialize(texts.select("key", "text"), "candidates")


def common(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The labelled shingles that are frequent in one of COUNTED texts, ascending, and their counts: MOST_COMMON at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_hash)
        for _, some in blocks(batches, "text"):
            h, n = np.unique(np.concatenate([labels(shingles(t, known)) for t in some]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    counts = texts.where(F.pmod(F.xxhash64("key"), F.lit(COUNTED)) == 0).mapInArrow(run, "h long, n long")
    counts = materialize(counts.groupBy("h").agg(F.sum("n").alias("n")).where("n > 1"), "common")
    least, held = 1000, 0
    for r in counts.groupBy(F.least("n", F.lit(1000)).alias("n")).count().orderBy(F.desc("n")).collect():  # 1000 rows at most
        held += r["count"]
        if held > MOST_COMMON:
            break
        least = r["n"]
    found = counts.where(F.col("n") >= least).toArrow()
    h, n = found["h"].to_numpy().view(np.uint64), found["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefixes(texts: DataFrame) -> DataFrame:
    """bucket (a shingle of the prefix), key, n (shingles of the text), place (in the prefix), the folded parities and, at place 0, bits (all parities) of the texts."""
    given = texts.sparkSession.sparkContext.broadcast(common(texts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(word_hash)
        for batch, some in blocks(batches, "text"):
            cut = [shingles(t, known) for t in some]
            n = np.array([len(h) for h in cut])
            found = [prefix(h, *given.value) for h in cut]
            sizes = [len(x) for x in found]
            of = np.repeat(np.arange(len(cut)), sizes)
            places = np.concatenate([np.arange(k) for k in sizes])
            each = np.stack([parities(h) for h in cut])
            bits = pa.array([each[i] if k == 0 else None for i, k in zip(of, places, strict=True)], pa.list_(pa.int64()))
            folded = np.bitwise_xor.reduce(each.reshape(len(cut), -1, len(FOLDED)), 1)[of]
            columns = [pa.array(np.concatenate(found).view(np.int64)), batch.column("key").take(pa.array(of)), pa.array(n[of]), pa.array(places), bits, *(pa.array(f) for f in folded.T.copy())]
            yield pa.RecordBatch.from_arrays(columns, names=["bucket", "key", "n", "place", "bits", *FOLDED])

    return materialize(texts.mapInArrow(run, "bucket long, key binary, n long, place long, bits array<long>, " + ", ".join(f"{f} long" for f in FOLDED)), "prefixes")


def possible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose parities don't rule out a link."""
    of = lambda c: rows.where("place = 0").select(F.col("key").alias(c), F.col("n").alias("n" + c), F.col("bits").alias("s" + c))
    differ = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    total = F.col("na") + F.col("nb")
    need = F.ceil(SIMILARITY / (1 + SIMILARITY) * total - 1e-9)
    return pairs.join(of("b"), "b").join(of("a"), "a").where(differ <= total - 2 * need).select("a", "b")


def reachable(x: str, y: str) -> F.Column:
    """Whether texts with a first common prefix shingle at these places can be similar enough; `x` is the one with fewer shingles."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(n - F.col(f"{x}.place"), m - F.col(f"{y}.place"))
    return (n >= SIMILARITY * m - 1e-9) & (left >= SIMILARITY / (1 + SIMILARITY) * (n + m) - 1e-9)


def mixed_rows(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows, with their roots, of buckets that aren't of one class."""
    rows = rows.join(roots.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    several = rows.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("bucket")
    return rows.join(several, "bucket", "left_semi")


def led_pairs(rows: DataFrame, step: int) -> DataFrame:
    """Pairs of one leader for each bucket with the others."""
    leader = F.struct(F.xxhash64("key", "bucket", F.lit(step)).alias("o"), "key", "n", "place", "root")
    x, y = rows.groupBy("bucket").agg(F.min(leader).alias("x")).select("bucket", "x.*").alias("x"), rows.alias("y")
    pairs = x.join(y, "bucket").where((F.col("x.root") != F.col("y.root")) & (reachable("x", "y") & (F.col("x.n") <= F.col("y.n")) | reachable("y", "x") & (F.col("y.n") < F.col("x.n"))))
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def all_pairs(rows: DataFrame) -> DataFrame:
    """All pairs of one bucket and two classes that can be similar enough. The shorter text's shared shingle is in its shorter prefix."""
    short = rows.where(F.col("n") - F.col("place") >= 2 * SIMILARITY / (1 + SIMILARITY) * F.col("n") - 1e-9)
    x, y = short.alias("x"), rows.alias("y")
    first = (F.col("x.n") < F.col("y.n")) | (F.col("x.n") == F.col("y.n")) & (F.col("x.key") < F.col("y.key"))
    differ = sum((F.bit_count(F.col(f"x.{f}").bitwiseXOR(F.col(f"y.{f}"))) for f in FOLDED), F.lit(0))
    total = F.col("x.n") + F.col("y.n")
    near = differ <= total - 2 * F.ceil(SIMILARITY / (1 + SIMILARITY) * total - 1e-9)
    pairs = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.root") != F.col("y.root")) & first & reachable("x", "y") & near)
    return pairs.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def verified(pairs: DataFrame, keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """The pairs (a, b) of keys whose texts are linked, materialized; texts come from the first row of each key."""
    pairs = materialize(pairs, "pairs")
    texts = texts_of(pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct(), keyed, firsts)
    with_b = pairs.join(texts.select(F.col("key").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("key").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = Remembered(word_hash), (None, None)
        for batch, others in blocks(batches, "text_b"):
            keep = []
            for key, text, other in zip(batch.column("a").to_pylist(), batch.column("text_a"), others, strict=True):
                if last[0] != key:
                    last = (key, shingles(text.as_py() or "", known))
                keep.append(aligned(last[1], shingles(other, known)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = materialize(both.mapInArrow(run, "a binary, b binary"), "links")
    forget(pairs.sparkSession, pairs, texts)
    return links


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, root), root the smallest node of the component, for nodes with links.

    Large-star and small-star in turn until the edges no longer change.
    """
    spark, before, made = edges.sparkSession, None, []
    while True:
        sides = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = materialize(large, "large")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.where("a != b").distinct(), "small")
        forget(spark, large, *made)
        made = [edges]
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def classes(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, key (digest of the text) and class_id of every row."""
    keyed = docs.select("doc_id", F.col(text).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("key"))
    rows = materialize(sketched(keyed), "sketches")
    firsts = rows.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("sketches").alias("sketches"))
    firsts = materialize(firsts, "texts")
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda i: F.xxhash64(i, F.get(F.col("sketches"), 2 * i), F.get(F.col("sketches"), 2 * i + 1)))
    active = firsts.select("key", F.explode(bands).alias("bucket"))
    least = active.groupBy("bucket").agg(F.min("key").alias("a"), F.max("key").alias("z")).where("a != z").drop("z")
    active = materialize(active.join(least, "bucket"), "led")
    pairs = active.where("a != key").select("a", F.col("key").alias("b"))
    links = verified(likely(pairs.distinct(), firsts), keyed, firsts)
    roots, gone = components(links), [links]
    rest = materialize(mixed_rows(active.select("bucket", "key"), roots).select(F.col("key").alias("k")).distinct(), "mixed")
    gone += [rest, active]
    if not rest.isEmpty():
        texts = texts_of(rest, keyed, firsts)
        rows_of = prefixes(texts)
        gone += [texts, rows_of]
        for step in range(LED + 1):
            held = materialize(mixed_rows(rows_of.drop("bits", *(FOLDED if step < LED else ())), roots), "shared")
            links = verified(possible(led_pairs(held, step) if step < LED else all_pairs(held), rows_of), keyed, firsts)
            forget(docs.sparkSession, held)
            gone += [links]
            if not links.isEmpty():
                gone += [roots]
                roots = components(roots.toDF("a", "b").unionByName(links))
    named = firsts.select("key", "doc_id").join(roots.toDF("key", "root"), "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
    named = materialize(named, "named")
    forget(docs.sparkSession, *gone, roots, firsts)
    least = named.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    of_key = named.join(least, "root").select("key", "class_id", "root")
    return rows.select("doc_id", "key").join(of_key, "key")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, and whether it is its class's own first document."""
    out = classes(docs.select("doc_id", "text"))
    return out.select("doc_id", "class_id", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("is_first"))


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each class, the one with the smallest id, with the columns of `docs`."""
    p = tagged(docs)
    found = classes(docs, text)
    least = found.where(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("root").agg(F.min(F.struct("key", "doc_id")).alias("first"))
    kept = materialize(least.select(F.col("first.key").alias(p + "k"), F.col("first.doc_id").alias(p + "d")), "kept")
    forget(docs.sparkSession, found)
    keyed = docs.withColumn(p + "key", F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))))
    chosen = keyed.join(kept, (keyed[p + "key"] == kept[p + "k"]) & keyed["doc_id"].eqNullSafe(kept[p + "d"]))
    return chosen.dropDuplicates([p + "key", "doc_id"]).select(*docs.columns)
