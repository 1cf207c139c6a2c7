"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL-proximal.

A text is a row of words and marks. Its features are hashed n-grams (1 and 2) of the lower-cased
words and n-grams (1 to 3) of their shapes (case, digits, which mark, same as the one before), each
with its frequency as value. The score is the sigmoid of a sparse dot product, so a document costs
one look-up for each n-gram. The model is fitted in one task on a bounded sample of labelled
documents (labelled.MOST_LABELLED); its size is fixed, and it goes to the workers as a broadcast.

Null and empty texts have no features and get the score of the intercept. No labels at all (all null,
none of these documents, an empty table): the score is 0.5. Null ids are scored and never trained on.
Repeated rows are scored each; of several labels of one document the largest counts. Texts are read whole,
in blocks of bounded size, so a very long one costs time and memory in proportion to its length. A score equal to the
threshold is predicted 1. Columns of other names aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, fold
from .labelled import fitted, training_rows
from .tokens import Remembered

BITS = 18
BUCKETS = 1 << BITS
SHAPES = 32
#: Values of features are frequencies times these, for words and for shapes.
WORD_SCALE, SHAPE_SCALE = 4.0, 8.0
THRESHOLD = 0.7
EPOCHS = 4
SIZE = 2 * BUCKETS + SHAPES + SHAPES**2 + SHAPES**3
TOKEN = re.compile(r"\w+|[^\w\s]")
MARKS = ".,;:!?#*$%&|<>\"'()-_"


def shape(token: str) -> int:
    if token[0].isalpha():
        return 1 if token.islower() else 2 if token.istitle() else 3 if token.isupper() else 4
    if token[0].isdigit():
        return 5
    return 7 + MARKS.index(token[0]) if token[0] in MARKS else 6


def describe(token: str) -> int:
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) << 5 | shape(token)


def features(text: str, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, with repeats; the value of each)."""
    tokens = TOKEN.findall(text)
    n = len(tokens)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0)
    both = np.fromiter(map(known.__getitem__, tokens), np.int64, n)
    words, shapes = both >> 5, both & 31
    shapes[1:][words[1:] == words[:-1]] = 0  # the same as the one before
    pairs = (words[:-1] * 0x9E3779B1 + words[1:] * 0x85EBCA6B) >> 13
    out = [words & BUCKETS - 1, BUCKETS + (pairs & BUCKETS - 1), 2 * BUCKETS + shapes]
    if n > 1:
        two = shapes[:-1] * SHAPES + shapes[1:]
        out.append(2 * BUCKETS + SHAPES + two)
        out.append(2 * BUCKETS + SHAPES + SHAPES**2 + two[:-1] * SHAPES + shapes[2:])
    numbers = np.concatenate(out)
    values = np.full(len(numbers), SHAPE_SCALE / n)
    values[: 2 * n - 1] = WORD_SCALE / n
    return numbers, values


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def train(texts: list[str], labels: list[int], alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.01, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (float32), the intercept last. Rows are visited in a fixed random order."""
    z, n = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    known = Remembered(describe)
    rows = []
    for text in texts:
        numbers, values = features(text, known)
        numbers, at = np.unique(numbers, return_inverse=True)
        rows.append((np.append(numbers, SIZE), np.append(np.bincount(at, values, len(numbers)), 1.0)))

    def weights(i: np.ndarray | slice) -> np.ndarray:
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    shuffle = np.random.default_rng(7)
    for _ in range(epochs):
        for k in shuffle.permutation(len(rows)):
            i, x = rows[k]
            w = weights(i)
            g = (sigmoid(float(w @ x)) - labels[k]) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha * w
            n[i] += g * g
    return weights(slice(None)).astype(np.float32)


def scores(docs: DataFrame, weights: np.ndarray, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score and predicted of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, known = model.value, Remembered(describe)
        for batch, texts in blocks(batches, "text"):
            out = []
            for t in texts:
                numbers, values = features(t, known)
                out.append(sigmoid(float(w[numbers] @ values) + float(w[SIZE])))
            score = np.array(out)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    weights = fitted(training_rows(docs, labels, "quality"), train)
    return scores(docs, weights).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score", "predicted")
