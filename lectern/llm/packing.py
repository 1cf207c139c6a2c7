"""Packing token sequences by patterns.

Documents become pieces of at most `LENGTH` tokens. Only the histogram of piece lengths (at most
`LENGTH` numbers) goes to the driver. There all patterns of one to three lengths that fill a
sequence exactly are enumerated, and for each length the one that fills best beside it, if two pieces fit together at all.
Their repeat counts are fitted to the histogram by non-negative least squares and rounded, and what is left is packed
best-fit decreasing, again by counts of equal lengths. Every plan uses patterns where there are any. So the plan's size doesn't depend on the number of documents. Each piece then finds
its place from its length and its rank among the pieces of this length; the ranks are distributed
prefix sums over (partition, length).

Null or empty text: the end token alone, one piece. Null ids pass through. Repeated rows are packed
each. A very long text is encoded whole, in a task's memory, and cut. Pieces of one length stand in the order of
partitions and rows. Columns of other names aren't read. An empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import blocks, materialize, per_process
from .tokens import BLOCK, MAX_REMEMBERED, MAX_REMEMBERED_BYTES, Splitter, default_path

LENGTH = 1024
END_ID = 2
#: The least squares fit ends at this gradient, relative to the first one, or when a step moves no repeat count by more than this.
FIT_GRADIENT, FIT_MOVE = 1e-3, 1e-9
#: Least repeats of the patterns that a plan uses: what patterns of fewer repeats cover is left to best-fit.
LEAST_REPEATS = (1, 2, 4, 8, 16)
#: Shares of the repeats that a plan may use, beside all.
SCALES = (0.75, 0.5, 0.25)


class Encoder:
    """Texts -> ids; the ids of pre-tokens are remembered, as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a process for each core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.splitter = Splitter([t.content for t in self.tokenizer.get_added_tokens_decoder().values()])
        self.known: dict[str, bytes] = {}  # and those known before it was full, of which the ones met again stay
        self.before: dict[str, bytes] = {}
        self.held = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text begins, and the end)."""
        words, numbers, begins = self.splitter.split(texts)
        if len(self.known) > MAX_REMEMBERED or self.held > MAX_REMEMBERED_BYTES:
            self.before, self.known, self.held = self.known, {}, 0
        known, before = self.known, self.before
        new = []
        for w in words:
            if w not in known:
                if (ids := before.get(w)) is None:
                    new.append(w)
                else:
                    known[w] = ids
                    self.held += len(w) + len(ids)
        for at in range(0, len(new), 10_000):
            some = new[at : at + 10_000]
            for w, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[w] = ids = array("I", e.ids).tobytes()
                self.held += len(w) + len(ids)
        found = [known[w] for w in words]
        flat = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        where = np.cumsum(size) - size
        sizes = size[numbers]
        ends = np.cumsum(sizes)
        ids = flat[np.repeat(where[numbers] - (ends - sizes), sizes) + np.arange(sizes.sum())]
        return ids, np.append(0, ends)[begins]


def pieces(docs: DataFrame, text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part and nth: a piece's task and its rank among the task's pieces of its length."""
    path = path or default_path()
    last = np.asarray([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = per_process(("encoder", path), lambda: Encoder(path))
        part, seen = TaskContext.get().partitionId(), np.zeros(length + 1, np.int64)
        for batch, texts in blocks(batches, "text", BLOCK):
            rows: list[tuple] = []
            everything, begins = encoder.encode(texts)
            for i, (a, b) in enumerate(zip(begins[:-1].tolist(), begins[1:].tolist(), strict=True)):
                ids = everything[a:b].tobytes() + last
                n = b - a + 1
                cuts = [0, *range(n % length or length, n + 1, length)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((i, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), int(seen[b - a])))
                    seen[b - a] += 1
            i, k, a, n, crc, nth = (pa.array(c, pa.int64()) for c in zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(i), k.cast(pa.int32()), a, n, crc, pa.array(np.full(len(i), part, np.int32)), nth], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, part int, nth long")


def enumerate_patterns(counts: np.ndarray, length: int) -> np.ndarray:
    """Rows of three ascending lengths (0: none) that sum to `length`, and those that fill a sequence best beside each length;
    of each length a row has no more than `counts` has."""
    there = counts > 0
    there[0] = True
    a = np.flatnonzero(there)
    x, y = np.meshgrid(a, a, indexing="ij")
    z = length - x - y
    good = (x <= y) & (y <= z)
    good[good] &= there[z[good]]
    rows = np.concatenate([np.stack([x[good], y[good], z[good]], 1), filled_best(counts, length)])
    rows = np.unique(rows, axis=0)
    needed = (rows[:, :, None] == rows[:, None, :]).sum(1)
    return rows[((needed <= counts[rows]) | (rows == 0)).all(1)]


def filled_best(counts: np.ndarray, length: int) -> np.ndarray:
    """For each length, with the longest that fits beside it, and with the longest that then fits: rows of three (0: none)."""
    present = np.flatnonzero(counts[1:]) + 1

    def longest(room: int, taken: list[int]) -> int:
        for n in present[: np.searchsorted(present, room, "right")][::-1][:3]:  # at most two of them are used up
            if counts[n] > taken.count(n):
                return int(n)
        return 0

    rows: list[tuple] = []
    for v in present.tolist():
        second = longest(length - v, [v])
        if second:
            rows += [tuple(sorted((v, second, third))) for third in {0, longest(length - v - second, [v, second])}]
    return np.array(rows, np.int64).reshape(-1, 3)


def made_by(patterns: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """How many pieces of each length (below `size`) the patterns hold, x times each."""
    made = sum(np.bincount(patterns[:, k], x, size) for k in range(patterns.shape[1]))
    made[0] = 0.0
    return made


def fit_repeats(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Non-negative repeat counts x of the patterns that make sum_p x_p * pattern_p close to `counts`, in
    least squares: projected gradient steps with momentum (restarted when it points uphill), each as long as the
    largest curvature allows, until the gradient is small where x is positive and not negative where x is 0."""
    wanted = counts.astype(float)
    wanted[0] = 0.0
    back = lambda v: v[patterns].sum(1)  # noqa: E731  A^T v; length 0 holds 0
    probe = np.ones(len(patterns))
    curvature = 1.0
    for _ in range(30):  # power iteration for the largest eigenvalue of A^T A
        probe = back(made_by(patterns, probe, len(counts)))
        curvature = float(np.linalg.norm(probe)) or 1.0
        probe /= curvature
    x = y = np.zeros(len(patterns))
    goal, pace = back(wanted), 1.0
    while True:
        slope = back(made_by(patterns, y, len(counts))) - goal
        if np.abs(np.where(y > 0, slope, np.minimum(slope, 0))).max() <= FIT_GRADIENT * np.abs(goal).max():
            return y
        new = np.maximum(y - slope / (1.02 * curvature), 0)
        if (y - new) @ (new - x) > 0:
            pace = 1.0
        quicker = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        y = np.maximum(new + (pace - 1) / quicker * (new - x), 0)
        if np.abs(new - x).max() <= FIT_MOVE * max(1.0, np.abs(x).max()):
            return new
        x, pace = new, quicker


Sequences = list[tuple[tuple[int, ...], int]]


def best_fit(counts: np.ndarray, length: int, begun: Sequences = ()) -> Sequences:
    """Best-fit decreasing over counts of lengths, into sequences already `begun` and new ones: (lengths of a sequence, how many such)."""
    spaces: dict[int, Sequences] = defaultdict(list)
    for pattern, many in begun:
        spaces[length - sum(pattern)].append((pattern, many))
    for n in range(length, 0, -1):
        left = int(counts[n])
        while left:
            room = min((s for s in spaces if s >= n and spaces[s]), default=None)
            if room is None:
                each = length // n
                for per, many in ((each, left // each), (left % each, 1)):
                    if per and many:
                        spaces[length - per * n].append(((n,) * per, many))
                break
            pattern, many = spaces[room].pop()
            used = min(many, left)
            if many > used:
                spaces[room].append((pattern, many - used))
            spaces[room - n].append(((*pattern, n), used))
            left -= used
    return [x for found in spaces.values() for x in found]


def rounded(counts: np.ndarray, patterns: np.ndarray, repeats: np.ndarray, least: int, more: bool, scale: float) -> tuple[dict[tuple[int, ...], int], np.ndarray]:
    """Patterns and how often they are used, and the counts that are left: `scale` times the repeats, rounded down, of
    patterns with `least` repeats at least, and with `more` once more each, in the order of what rounding took off."""
    left, used = counts.copy(), defaultdict(int)
    whole = np.floor(repeats * scale + 1e-6).astype(np.int64)
    steps = [(at, int(whole[at])) for at in np.argsort(-repeats, kind="stable").tolist() if repeats[at] >= least]
    if more:
        steps += [(at, 1) for at in np.argsort(whole - repeats, kind="stable").tolist()]
    for at, most in steps:
        pattern = tuple(int(v) for v in patterns[at] if v)
        many = min(most, *(int(left[v]) // pattern.count(v) for v in pattern))
        if many:
            used[pattern] += many
            for v in pattern:
                left[v] -= many
    return used, left


def plan_parts(counts: np.ndarray, length: int = LENGTH) -> tuple[Sequences, Sequences]:
    """(patterns and their repeats, the sequences that they and best-fit make): uses up `counts` of each length from 0 to `length`.

    Patterns of few repeats may take short pieces that long ones without an exact complement need, so
    several ways to round are tried, and the one with the fewest sequences is taken of those that use patterns. One does,
    if two pieces fit together: using each pattern once more as far as pieces last."""
    counts = counts.astype(np.int64).copy()
    counts[0] = 0
    patterns = enumerate_patterns(counts, length)
    if not len(patterns):
        return [], best_fit(counts, length)
    repeats = fit_repeats(patterns, counts)
    ways = [(least, False, 1.0) for least in LEAST_REPEATS] + [(0, True, 1.0)] + [(1, False, s) for s in SCALES]
    best: tuple[Sequences, Sequences] | None = None
    for way in ways:
        used, left = rounded(counts, patterns, repeats, *way)
        if used:
            made = best_fit(left, length, list(used.items()))
            if best is None or sum(many for _, many in made) < sum(many for _, many in best[1]):
                best = list(used.items()), made
    return best or ([], best_fit(counts, length))


def plan(counts: np.ndarray, length: int = LENGTH) -> Sequences:
    """Sequences that use up `counts`: see `plan_parts`."""
    return plan_parts(counts, length)[1]


def places(planned: Sequences) -> dict[str, np.ndarray]:
    """The plan as sorted arrays: key (length and first rank), sequence and offset of each stretch of ranks.

    Its size doesn't grow with the documents: there are at most length**2 / 12 + length patterns of three
    stretches, and best-fit adds a few stretches for each length. All 1,024 lengths together make some
    90,000 patterns, below 10 MB, whatever their counts."""
    ranks: dict[int, int] = defaultdict(int)
    rows, base = [], 0
    for pattern, many in planned:
        offset = 0
        for v in pattern:
            rows.append(((v << 44) + ranks[v], base - ranks[v], offset))
            ranks[v] += many
            offset += v
        base += many
    table = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return {"key": table[:, 0].copy(), "shift": table[:, 1].copy(), "offset": table[:, 2].copy()}


def pack(docs: DataFrame, text: str = "text", path: str | None = None, length: int = LENGTH, end: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = materialize(pieces(docs, text, path, length, end), "pieces")
    counted = materialize(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = np.zeros(length + 1, np.int64)
    for row in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `length` rows
        counts[row["length"]] = row["n"]
    found = docs.sparkSession.sparkContext.broadcast(places(plan(counts, length)))  # see `places` for its size
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranked = cut.join(starts, ["part", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("nth")).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = found.value
        for batch in batches:
            if not len(batch):
                continue
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            key = (batch.column("length").to_numpy(zero_copy_only=False) << 44) + rank
            at = np.searchsorted(table["key"], key, "right") - 1
            columns = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rank + table["shift"][at]), pa.array(table["offset"][at])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
