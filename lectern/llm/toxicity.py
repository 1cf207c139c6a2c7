"""Toxicity by multiple-instance learning.

Labels are of documents, insults are in sentences. A sentence's score is a logistic function of its
words' weights, a word's weight the sum of those of the word and of its beginnings (hashed), as
insults take endings; a document's score is the noisy-or of its sentences' scores, so one sentence is enough.
The weights are learned from documents' labels alone, by gradient steps through the noisy-or with an
L1 penalty that keeps words without evidence at zero. The sentence scores then say where the offending
sentences stand. The model is fitted in one task on a bounded sample of labelled documents
(labelled.MOST_LABELLED); its size is fixed, and it goes to the workers as a broadcast.

Null and empty texts have no sentences: score 0, kept by the stage. No labels (all null, none of these
documents, an empty table): every word has weight 0 and every score is 0 to many places. Null ids are scored
and never trained on. Repeated rows are scored each; of several labels of one document the largest counts.
Texts are read whole, in blocks of bounded size, so a very long one costs time in proportion to its length. A
score equal to the threshold is toxic. Other columns, whatever their names, pass through `keep_harmless`. An
empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fold, tagged
from .labelled import fitted, training_rows
from .tokens import Remembered

BUCKETS = 1 << 20
THRESHOLD = 0.3
#: Documents that training looks at in all, with repeats, and most times that it sees one.
VISITS, EPOCHS = 120_000, 30
#: Lengths of the beginnings of longer words that are features.
STEMS = range(3, 9)
#: The intercept at the start: a sentence of unknown words is almost surely harmless.
START = -6.0
#: The intercept without any labelled sentence: nothing is toxic, however long.
UNTRAINED = -60.0
TOKEN = re.compile(r"\w+|[.!?\n]+")
BREAKS = frozenset(".!?\n")
SENTENCE = re.compile(r"[^.!?\n]*\w[^.!?\n]*")


def word_features(word: str) -> list[int]:
    parts = [word, *(word[:k] + "*" for k in STEMS if k < len(word))]
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & BUCKETS - 1 for x in parts]


def tokens(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


def sentence_starts(is_break: np.ndarray) -> np.ndarray:
    """Which of the words that remain without the breaks begin a sentence."""
    sentence = np.cumsum(is_break)[~is_break]
    return np.flatnonzero(np.append(True, sentence[1:] != sentence[:-1])) if len(sentence) else np.zeros(0, np.int64)


def softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


class Learner:
    """Labelled texts as rows (words, first word of each sentence, label), and the weights that are learned from them."""

    def __init__(self, texts: list[str], labels: list[int]):
        self.w = np.zeros(BUCKETS + 1)
        self.w[BUCKETS] = START
        self.seen = np.full(BUCKETS + 1, 1e-2)
        number: dict[str, int] = {}
        self.rows = []
        for text, y in zip(texts, labels, strict=True):
            found = tokens(text)
            ids = np.fromiter((-1 if t[0] in BREAKS else number.setdefault(t, len(number)) for t in found), np.int32, len(found))
            first = sentence_starts(ids < 0)
            if len(first):
                self.rows.append((ids[ids >= 0], first, y))
        of_words = [word_features(t) for t in number]
        self.flat = np.array([f for fs in of_words for f in fs], np.int64)
        self.begin = np.cumsum([0, *map(len, of_words)])

    def gradient(self, some: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(weights' numbers, the intercept's last; derivatives of the mean of -log likelihood over `some` rows)."""
        words, place = np.unique(np.concatenate([r[0] for r in some]), return_inverse=True)
        size = self.begin[words + 1] - self.begin[words]
        starts = np.cumsum(size) - size
        features = self.flat[np.repeat(self.begin[words] - starts, size) + np.arange(size.sum())]
        first = np.concatenate([r[1] + o for r, o in zip(some, np.cumsum([0, *(len(r[0]) for r in some)]), strict=False)])
        doc = np.repeat(np.arange(len(some)), [len(r[1]) for r in some])
        z = np.add.reduceat(np.add.reduceat(self.w[features], starts)[place], first) + self.w[BUCKETS]
        none = np.bincount(doc, softplus(z), len(some))  # -log of the chance that no sentence is toxic
        y = np.array([r[2] for r in some])
        pull = np.where(y == 1, -1 / np.maximum(np.expm1(np.minimum(none, 50)), 1e-3), 1.0)
        g = pull[doc] * (1 - np.exp(-softplus(z)))
        per_word = np.bincount(place, np.repeat(g, np.diff(np.append(first, len(place)))), len(words))
        ids, at_feature = np.unique(features, return_inverse=True)
        return np.append(ids, BUCKETS), np.append(np.bincount(at_feature, np.repeat(per_word, size), len(ids)), g.sum()) / len(some)

    def step(self, some: list[tuple[np.ndarray, np.ndarray, int]], rate: float, l1: float) -> None:
        """One Adagrad step; the penalty draws all weights but the intercept to 0."""
        ids, grad = self.gradient(some)
        self.seen[ids] += grad * grad
        step = rate / np.sqrt(self.seen[ids])
        moved = self.w[ids] - step * grad
        self.w[ids[:-1]] = (np.sign(moved) * np.maximum(np.abs(moved) - step * l1, 0))[:-1]
        self.w[BUCKETS] = moved[-1]


def train(texts: list[str], labels: list[int], rate: float = 0.5, l1: float = 2e-4, batch: int = 32) -> np.ndarray:
    """Weights of the buckets (float32), the intercept last."""
    model = Learner(texts, labels)
    shuffle = np.random.default_rng(11)
    for _ in range(min(EPOCHS, -(-VISITS // max(1, len(model.rows))))):
        order = shuffle.permutation(len(model.rows))
        for at in range(0, len(order), batch):
            model.step([model.rows[k] for k in order[at : at + batch]], rate, l1)
    if not model.rows:
        model.w[BUCKETS] = UNTRAINED
    return model.w.astype(np.float32)


class Scorer:
    """Texts -> scores; the weights of words are remembered."""

    def __init__(self, weights: np.ndarray):
        self.start = float(weights[BUCKETS])
        some = np.flatnonzero(weights[:BUCKETS])
        get = dict(zip(some.tolist(), weights[some].tolist(), strict=True)).get  # L1 leaves few
        self.weight = Remembered(lambda t: np.nan if t[0] in BREAKS else sum(get(f, 0.0) for f in word_features(t)))

    def sentences(self, text: str) -> np.ndarray:
        """-log of the chance that a sentence is harmless, for each."""
        found = tokens(text)
        w = np.fromiter(map(self.weight.__getitem__, found), float, len(found))
        breaks = np.isnan(w)
        first = sentence_starts(breaks)
        return softplus(np.add.reduceat(w[~breaks], first) + self.start) if len(first) else np.zeros(0)

    def __call__(self, text: str) -> float:
        return float(-np.expm1(-self.sentences(text).sum()))

    def offending(self, text: str, threshold: float) -> list[dict]:
        """Of a text that reaches the threshold: its sentences that reach it alone, or else the strongest (all that tie)."""
        out = [{"sentence": k, "start": m.start(), "stop": m.end(), "score": self(m[0])} for k, m in enumerate(SENTENCE.finditer(text))]
        least = min(threshold, max((s["score"] for s in out), default=threshold))
        return [s for s in out if s["score"] >= least]


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",), prefix: str = "", threshold: float = THRESHOLD) -> DataFrame:
    """The columns `keep`, and <prefix>score, <prefix>predicted and <prefix>offending of every whole
    text: (sentence, start, stop, score) of each sentence that alone reaches the threshold, or of the
    strongest if only several together do; none of a text below it."""
    model = docs.sparkSession.sparkContext.broadcast(weights)
    source = prefix + "text_"
    names = [prefix + c for c in ("score", "predicted", "offending")]
    spans = pa.list_(pa.struct([("sentence", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch, texts in blocks(batches, source):
            score = np.array([scorer(t) for t in texts])
            where = [scorer.offending(t, threshold) if p >= threshold else [] for t, p in zip(texts, score, strict=True)]
            made = [pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(where, spans)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *made], names=[*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    schema = f"{fields}, `{names[0]}` double, `{names[1]}` int, `{names[2]}` array<struct<sentence:int,start:int,stop:int,score:double>>"
    return docs.select(*keep, F.col(text).alias(source)).mapInArrow(run, schema)


def keep_harmless(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with the columns of `docs`."""
    p = tagged(docs)
    weights = fitted(training_rows(docs, labels, "toxic", text), train)
    return scored(docs, weights, text, tuple(docs.columns), p).where(F.col(p + "predicted") == 0).select(*docs.columns)


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and n_offending, the number of offending sentences."""
    weights = fitted(training_rows(docs, labels, "toxic"), train)
    return scored(docs, weights).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted", F.size("offending").alias("n_offending"))
