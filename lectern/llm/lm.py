"""Scores of documents under a masked language model: pseudo-log-likelihoods.

Each token is hidden in turn and predicted from two tokens on either side; the logarithms of these
conditional probabilities are summed over the document. A token's probability is that of its class,
from a window network (class embeddings by place, one tanh layer, softmax over `CLASSES`), times
its share of the class in the whole corpus. Frequent words are classes of their own; the others share
`HASHED` classes by their last two characters, which tell much of a word's kind. A word's share is its
exact count over that of its class, for every word of the corpus: those of the `VOCABULARY` most frequent words go to
the workers, those of all others, whose number grows with the corpus, are joined by the word's hash.

Four passes: (1) all words of all documents are counted, partially in each task. (2) Every text is read into its
row of classes, one byte a token, with the hashes of its rarer words, and written. (3) The network is trained in
numpy on every position of every document. Documents are dealt by hash to shards of about `TOKENS_PER_SHARD`
tokens, as many as the corpus needs, and in a shard's order each shard trains from the common start; the weights are
averaged by their numbers of positions, in as many rounds as asked. So the model depends on the documents
and not on how they are partitioned. (4) Every position is scored from the rows of classes.

Null, empty and blank texts have no tokens: log_likelihood 0, score null. Null ids pass through. Repeated
rows are scored each, and count each in the corpus. Very long texts are read and scored whole, in
blocks of bounded size. Columns of other names aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, materialize
from .tokens import Remembered, per_text

TOKEN = re.compile(r"\w+|[^\w\s]")
VOCABULARY = 65536
HASHED = 32
CLASSES = 128
HIDDEN = 16
SIDE = (-2, -1, 1, 2)
BATCH = 4096
RATE = 0.1
#: Tokens in a shard of the training, on average.
TOKENS_PER_SHARD = 1_000_000
#: Bytes of classes that a worker handles at once.
CLASS_BLOCK = 200_000
#: Different words that a task holds before it passes their counts on.
MOST_COUNTED = 400_000
#: Tokens scored at once.
STEP = 8192


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def hashed_class(word: str) -> int:
    return CLASSES - HASHED + zlib.crc32(word[-2:].encode()) % HASHED


def word_hash(word: str) -> int:
    """That of Spark's xxhash64, signed."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """word, n over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
        for _, texts in blocks(batches, "text"):
            for t in texts:
                held.update(tokens(t))
            if len(held) > MOST_COUNTED:
                yield out()
                held.clear()
        if held:
            yield out()

    return docs.select(F.col(text).alias("text")).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """Word -> (class, log of its share of the class) of the frequent words; the logs of the hashed classes' sizes,
    which the others' shares lack their counts' logs of; the log shares and the sizes of all classes."""

    words: dict[str, tuple[int, float]]
    sizes: list[float]
    classes: np.ndarray | None = None
    total: int = 0

    def find(self, word: str, count: int | None = None) -> tuple[int, float]:
        """(class, log share; without `count` a rarer word's is that of a single occurrence)."""
        if found := self.words.get(word):
            return found
        c = hashed_class(word)
        return c, float(np.log(count or 1)) - self.sizes[c - (CLASSES - HASHED)]


def vocabulary(counts: DataFrame, size: int = VOCABULARY) -> Vocabulary:
    """From the materialized word counts."""
    top = counts.orderBy(F.desc("n"), "word").limit(size).collect()
    own = {r["word"]: i for i, r in enumerate(top[: CLASSES - HASHED])}
    mass = np.zeros(CLASSES)
    for row in counts.groupBy((F.crc32(F.encode(F.right("word", F.lit(2)), "UTF-8")) % HASHED).cast("int").alias("c")).agg(F.sum("n").alias("n")).collect():  # HASHED rows
        mass[CLASSES - HASHED + row["c"]] = row["n"]
    for r in top[: CLASSES - HASHED]:
        mass[own[r["word"]]] = r["n"]
        mass[hashed_class(r["word"])] -= r["n"]
    classes = [own.get(r["word"], hashed_class(r["word"])) for r in top]
    words = {r["word"]: (c, float(np.log(r["n"] / mass[c]))) for r, c in zip(top, classes, strict=True)}
    sizes = np.log(np.maximum(mass[CLASSES - HASHED :], 1)).tolist()
    return Vocabulary(words, sizes, np.log((mass + 1) / (mass.sum() + CLASSES)), int(mass.sum()))


class Network:
    """Class probabilities of a hidden token from the classes at SIDE; class number CLASSES: outside the text."""

    SHAPES = ((len(SIDE), CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, CLASSES), (CLASSES,))

    def __init__(self, flat: np.ndarray):
        ends = np.cumsum([int(np.prod(s)) for s in self.SHAPES])
        self.embed, self.bias, self.out, self.out_bias = (x.reshape(s) for x, s in zip(np.split(flat.astype(np.float32), ends[:-1]), self.SHAPES, strict=True))

    @classmethod
    def start(cls, shares: np.ndarray) -> np.ndarray:
        draw = np.random.default_rng(5)
        return np.concatenate([draw.normal(0, 0.1, cls.SHAPES[0]).ravel(), np.zeros(HIDDEN), draw.normal(0, 0.1, cls.SHAPES[2]).ravel(), shares]).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.bias, self.out, self.out_bias)])

    def hidden(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = self.embed[0, classes[at + SIDE[0]]] + self.bias
        for k in range(1, len(SIDE)):
            h += self.embed[k, classes[at + SIDE[k]]]
        return np.tanh(h, out=h)

    def log_probabilities(self, classes: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for a in range(0, len(at), STEP):
            some = at[a : a + STEP]
            z = self.hidden(classes, some) @ self.out
            z += self.out_bias
            target = z[np.arange(len(some)), classes[some]]
            np.exp(z, out=z)
            out[a : a + STEP] = target - np.log(z.sum(1))
        return out

    def gradients(self, classes: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
        """Derivatives of the mean of -log probability of the tokens at `at` by embeddings, bias, output and its bias."""
        h = self.hidden(classes, at)
        z = h @ self.out
        z += self.out_bias
        np.minimum(z, 80, out=z)  # exp stays finite
        np.exp(z, out=z)
        z *= (1 / (z.sum(1, keepdims=True) * len(at))).astype(np.float32)
        z[np.arange(len(at)), classes[at]] -= np.float32(1 / len(at))
        back = (z @ self.out.T) * (1 - h * h)
        grads = [np.zeros_like(self.embed), back.sum(0), h.T @ z, z.sum(0)]
        for k, side in enumerate(SIDE):
            found = classes[at + side]
            order = np.argsort(found, kind="stable")  # of bytes: by counting
            found = found[order]
            first = np.flatnonzero(np.append(True, found[1:] != found[:-1]))
            grads[0][k, found[first]] = np.add.reduceat(back[order], first)
        return grads

    def learn(self, classes: np.ndarray, at: np.ndarray, seen: list[np.ndarray]) -> None:
        """One Adagrad step on the positions `at`; `seen` holds the sums of squared gradients."""
        for x, g, s in zip((self.embed, self.bias, self.out, self.out_bias), self.gradients(classes, at), seen, strict=True):
            s += g * g
            x -= RATE * g / np.sqrt(s)


def packed(number: int, share: float) -> int:
    """A class and the log of a share, which is at most 0, in one integer: 40 binary places."""
    return number << 48 | round(-share * 2**40)


class Frequent(dict):
    """The numbers of the frequent words; others have -1."""

    def __missing__(self, word: str) -> int:
        return -1


def read(docs: DataFrame, words: Vocabulary, text: str = "text") -> DataFrame:
    """row (a number), doc_id, ord (a hash of id and text), classes (a byte a token), share (sum of the tokens' log
    shares, but for the counts of the rarer ones) and rare (the hashes of those) of every text, materialized."""
    spark = docs.sparkSession
    table = spark.sparkContext.broadcast((words.words, words.sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, of_classes = table.value
        known = Frequent((w, packed(*x)) for w, x in words.items())
        ending = Remembered(lambda t: packed(hashed_class(t), -of_classes[hashed_class(t) - (CLASSES - HASHED)]))
        for batch, texts in blocks(batches, "text", 1_000_000):
            found = [tokens(t) for t in texts]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            begins = np.append(0, np.cumsum(sizes))
            flat = list(chain.from_iterable(found))
            numbers = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            rare = np.flatnonzero(numbers < 0)
            others = [flat[i] for i in rare.tolist()]
            numbers[rare] = np.fromiter(map(ending.__getitem__, [w[-2:] for w in others]), np.int64, len(rare))
            hashes = np.fromiter((xxhash.xxh64_intdigest(w, 42) for w in others), np.uint64, len(rare)).view(np.int64)
            classes = (numbers >> 48).astype(np.uint8)
            share = per_text((numbers & (1 << 48) - 1) * -(2.0**-40), begins)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, begins), pa.int32()), pa.array(hashes))
            binary = [classes[a:b].tobytes() for a, b in zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "doc_id", "ord")), pa.array(binary, pa.binary()), pa.array(share), lists], names=["row", "doc_id", "ord", "classes", "share", "rare"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("doc_id", F.col(text)).alias("ord"), F.col(text).alias("text"))
    return materialize(numbered.mapInArrow(run, f"row long, doc_id {kind}, ord long, classes binary, share double, rare array<long>"), "classes")


def laid_out(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of a batch of rows of classes, each with: all its classes with two outside places around each text,
    the places of tokens, and the first token of each text and the end."""
    sizes = pc.binary_length(batch.column("classes")).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(sizes), 0
    while start < len(batch):
        held = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, held + CLASS_BLOCK, "right")))
        some = batch.slice(start, stop - start)
        begins = np.append(0, ends[start:stop] - held)
        places = np.arange(begins[-1]) + np.repeat(2 * np.arange(1, len(some) + 1), np.diff(begins))
        classes = np.full(begins[-1] + 2 * len(some) + 2, CLASSES, np.uint8)
        classes[places] = np.frombuffer(b"".join(some.column("classes").to_pylist()), np.uint8)
        yield some, classes, places, begins
        start = stop


def train(rows: DataFrame, words: Vocabulary, rounds: int = 1, per_shard: int = TOKENS_PER_SHARD) -> np.ndarray:
    """The averaged weights of the network, from the rows of classes."""
    spark = rows.sparkSession
    weights = Network.start(words.classes)
    shards = max(1, -(-words.total // per_shard))
    dealt = rows.select(F.pmod("ord", F.lit(shards)).alias("shard"), "ord", "doc_id", "classes")
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "ord", "doc_id", "classes")
    for _ in range(rounds):
        given = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            now, network, seen, total = None, None, [], 0

            def out() -> Iterator[pa.RecordBatch]:
                if total:
                    flat = network.flat()
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat.astype(np.float64) * total), pa.array(np.full(len(flat), total, np.int64))], names=["i", "w", "n"])

            for batch in batches:
                numbers = batch.column("shard").to_numpy()
                cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(batch)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if b > a and numbers[a] != now:
                        yield from out()
                        now, network, total = numbers[a], Network(given.value.copy()), 0
                        seen = [np.full(s, 1e-4, np.float32) for s in Network.SHAPES]
                    for _, classes, places, _ in laid_out(batch.slice(a, b - a)):
                        order = np.random.default_rng(3).permutation(places)
                        for at in range(0, len(order), BATCH):
                            network.learn(classes, order[at : at + BATCH], seen)
                        total += len(order)
            yield from out()

        summed = dealt.mapInArrow(run, "i int, w double, n long").groupBy("i").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        for r in summed.collect():  # one row for each weight
            weights[r["i"]] = r["w"] / r["n"]
    return weights


def score(rows: DataFrame, counts: DataFrame, weights: np.ndarray) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (sum over tokens) and score (its mean) of every row of classes."""
    given = rows.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(given.value)
        for batch in batches:
            for some, classes, places, begins in laid_out(batch):
                total = per_text(network.log_probabilities(classes, places), begins) + some.column("share").to_numpy()
                yield pa.RecordBatch.from_arrays([some.column("row"), some.column("doc_id"), pa.array(np.diff(begins)), pa.array(total)], names=["row", "doc_id", "n_tokens", "total"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    scored = rows.select("row", "doc_id", "classes", "share").mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, total double")
    asked = rows.select("row", F.explode("rare").alias("h"))
    more = asked.join(counts.select(F.xxhash64("word").alias("h"), F.log(F.col("n").cast("double")).alias("more")), "h").groupBy("row").agg(F.sum("more").alias("more"))
    both = scored.join(more, "row", "left").withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0)))
    return both.select("doc_id", "n_tokens", F.when(F.col("n_tokens") > 0, F.col("total")).otherwise(0.0).alias("log_likelihood"), F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).alias("score"))


def digest(docs: DataFrame, text: str = "text") -> DataFrame:
    counts = materialize(word_counts(docs, text), "words")
    words = vocabulary(counts)
    rows = read(docs, words, text)
    return score(rows, counts, train(rows, words))
