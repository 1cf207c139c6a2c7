"""Embeddings, and nearest vectors: exact, or in inverted lists."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..sources.remote import ServiceEmbedder
from . import calls
from .lexical import broadcast_if_small, top

#: Bytes of query vectors in a cell, and how many of them meet a batch of vectors at once.
QUERY_BYTES, QUERY_ROWS = 64_000_000, 512
#: Bytes of query vectors that are sent to the workers, and vectors in a cell.
FEW_BYTES, CELL_VECTORS = 8_000_000, 1_000_000


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HashingEmbedder:
    """Signed hashing of words into a unit vector: deterministic and local, for tests and small uses."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import zlib

        out = np.zeros((len(texts), self.dimensions))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dimensions] += 1 if h >> 31 else -1
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


#: Name -> maker of an embedder; register your own.
EMBEDDERS = {"hashing": HashingEmbedder, "service": ServiceEmbedder}


def register(name: str, maker) -> None:
    EMBEDDERS[name] = maker


def embed(chunks: DataFrame, embedder: Embedder, store: str | None = None, batch: int = 20) -> DataFrame:
    """chunk_id, embedding; the provider gets `batch` texts at a time. With a `store`, vectors are kept there by text and model: no text
    is sent twice, and a run that broke off goes on (`calls.answered`)."""
    if store:
        model = f"{getattr(embedder, 'model', type(embedder).__name__)}/{getattr(embedder, 'dimensions', '')}"
        return calls.answered(chunks.select("chunk_id", "content"), "content", model, embedder.embed, "array<float>", store, batch).select("chunk_id", F.col("result").alias("embedding"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["content"].fillna("").tolist()
            vectors = [v for i in range(0, len(texts), batch) for v in embedder.embed(texts[i : i + batch])]
            yield pd.DataFrame({"chunk_id": frame["chunk_id"], "embedding": vectors})

    return chunks.select("chunk_id", "content").mapInPandas(run, "chunk_id string, embedding array<float>")


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 if a vector is zero; vectors of unequal length are an error."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda s, y: s + y)
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    norm = F.sqrt(total(F.transform(a, lambda x: x * x))) * F.sqrt(total(F.transform(b, lambda x: x * x)))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of unequal length")).cast("double")).when(norm == 0, F.lit(0.0)).otherwise(dot / norm)


def normed(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision; zero ones stay zero."""
    rows = np.asarray(rows, float)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-300)


def matrix(lists, size: int | None) -> np.ndarray:
    """An Arrow column of lists, all of one length (`size` if given), as unit rows."""
    flat, ends = lists.flatten(), lists.offsets.to_numpy()
    found = set(np.diff(ends).tolist()) | ({size} if size is not None else set())
    if len(found) != 1:
        raise ValueError("vectors of unequal length")
    return normed(flat.to_numpy(zero_copy_only=False).reshape(len(lists), -1) if len(flat) else np.zeros((len(lists), 0)))


def best(score: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row of scores, the places of the k best columns: greatest score to six digits, then smallest name. No more than k, whatever ties."""
    n = score.shape[1]
    points = np.rint(score * 1e6)
    if n > k:
        rank = np.empty(n, np.int64)
        rank[np.argsort(names, kind="stable")] = np.arange(n)
        order = points * n + (n - 1 - rank)  # all different, and exact in doubles
        at = np.argpartition(order, n - k, axis=1)[:, n - k :]
    else:
        at = np.broadcast_to(np.arange(n), (len(score), n))
    return at, np.take_along_axis(points, at, 1) / 1e6


class Running:
    """The k best of all vectors that a block of queries has met so far."""

    def __init__(self, asked: np.ndarray, k: int):
        self.asked, self.k = asked, k
        self.score = np.zeros((len(asked), 0))
        self.name = np.zeros((len(asked), 0), object)

    def meet(self, rows: np.ndarray, names: np.ndarray) -> None:
        for at in range(0, len(self.asked), QUERY_ROWS):
            part = slice(at, at + QUERY_ROWS)
            place, score = best(self.asked[part] @ rows.T, names, self.k)
            score, name = np.concatenate([self.score[part], score], 1), np.concatenate([self.name[part], names[place]], 1)
            if score.shape[1] > self.k:
                by_name = np.argsort(np.argsort(name.ravel(), kind="stable"), kind="stable").reshape(name.shape)
                keep = np.lexsort((by_name, -np.rint(score * 1e6)), axis=1)[:, : self.k]
                score, name = np.take_along_axis(score, keep, 1), np.take_along_axis(name, keep, 1)
            if not at:
                new_score, new_name = np.zeros((len(self.asked), score.shape[1])), np.zeros((len(self.asked), score.shape[1]), object)
            new_score[part], new_name[part] = score, name
        self.score, self.name = new_score, new_name


def in_cells(vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """query_id, <key>, score: in each cell, the k best of its vectors for each of its queries.

    Both sides (cell and the other columns) are dealt out by cell and sorted within, queries first; a task holds a cell's queries
    and streams its vectors past them, so it gives k rows for each of its queries, however many vectors there are."""
    kind, id_kind = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    id_type, key_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (vectors, key)))
    left = queries.select("cell", F.lit(0).alias("side"), "query_id", F.lit(None).cast(kind).alias("name"), F.col("vector").cast("array<double>").alias("v"))
    right = vectors.select("cell", F.lit(1).alias("side"), F.lit(None).cast(id_kind).alias("query_id"), F.col(key).alias("name"), F.col("embedding").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, ids, rows, running = None, [], [], None

        def made() -> Iterator[pa.RecordBatch]:
            if running is not None and running.score.size:
                width = running.score.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array([i for i in ids for _ in range(width)], id_type), pa.array(running.name.ravel().tolist(), key_type), pa.array(running.score.ravel())], names=["query_id", key, "score"])

        for batch in batches:
            cells, sides = batch.column("cell").to_numpy(), batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(cells) != 0) | (np.diff(sides) != 0)) + 1).tolist(), len(batch)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if cells[a] != cell:
                    yield from made()
                    cell, ids, rows, running = cells[a], [], [], None
                part = batch.slice(a, b - a)
                if not sides[a]:
                    ids += part.column("query_id").to_pylist()
                    rows.append(matrix(part.column("v"), rows[0].shape[1] if rows else None))
                elif ids:
                    running = running or Running(np.concatenate(rows), k)
                    names = np.empty(b - a, object)
                    names[:] = part.column("name").to_pylist()
                    running.meet(matrix(part.column("v"), running.asked.shape[1]), names)
        yield from made()

    dealt = left.unionByName(right).repartition("cell").sortWithinPartitions("cell", "side")
    return dealt.mapInArrow(run, f"query_id {id_kind}, {key} {kind}, score double")


def grid(vectors: DataFrame, queries: DataFrame, k: int, key: str) -> DataFrame:
    """As `in_cells`, of vectors and queries with a `list`: every query of a list meets every vector of it.

    A list's vectors are cut into slices of some CELL_VECTORS, its queries into groups of some QUERY_BYTES, so a hot list is many
    cells; each slice goes to the cells of all groups, and the other way round. Sizes are counted on the executors, one row for
    each list."""
    rows = vectors.groupBy("list").agg(F.count(F.lit(1)).alias("n_vectors"))
    asked = queries.groupBy("list").agg(F.sum(F.size("vector") * 8).alias("n_bytes"))
    cuts = rows.join(asked, "list").select("list", F.ceil(F.col("n_vectors") / CELL_VECTORS).cast("int").alias("slices"), F.ceil(F.col("n_bytes") / QUERY_BYTES).cast("int").alias("groups"))
    found = [tuple(r) for r in cuts.withColumn("groups", F.greatest("groups", F.lit(1))).collect()]  # a row for each list, which centroids on the driver number
    cuts = broadcast_if_small(vectors.sparkSession.createDataFrame(found, "list int, slices int, groups int"))
    cell = F.xxhash64("list", "slice", "group")
    sliced = vectors.join(cuts, "list").withColumn("slice", F.pmod(F.xxhash64(key), "slices").cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    grouped = queries.join(cuts, "list").withColumn("group", F.pmod(F.xxhash64("query_id", "vector"), "groups").cast("int")).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    return in_cells(sliced.select(cell.alias("cell"), key, "embedding"), grouped.select(cell.alias("cell"), "query_id", "vector"), k, key)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, key: str = "chunk_id") -> DataFrame:
    """query_id, <key>, score, rank: the k vectors of greatest cosine for each query vector.

    Queries (query_id, vector) of up to `FEW_BYTES` are sent to the workers, and vectors stay where they are; more
    queries meet the vectors in a grid of blocks on the executors, and none passes the driver. Either way a batch of vectors meets
    QUERY_ROWS queries at once by a matrix product and at most k rows of it move on for a query, however many tie. Null
    vectors, asked or stored, have no neighbours; no queries give no rows; vectors of unequal length are an error.
    """
    there, asked = vectors.where("embedding IS NOT NULL"), queries.where("vector IS NOT NULL")
    if (asked.agg(F.sum(F.size("vector") * 8)).first()[0] or 0) > FEW_BYTES:
        one = F.lit(0).alias("list")
        return top(grid(there.select(one, key, "embedding"), asked.select(one, "query_id", "vector"), k, key), k, key)
    kind, id_kind = vectors.schema[key].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    id_type, key_type = (to_arrow_type(df.schema[c].dataType) for df, c in ((queries, "query_id"), (vectors, key)))
    rows = asked.select("query_id", "vector").collect()  # at most FEW_BYTES
    if not rows:
        return top(vectors.sparkSession.createDataFrame([], f"query_id {id_kind}, {key} {kind}, score double"), k, key)
    if len({len(r["vector"]) for r in rows}) > 1:
        raise ValueError("vectors of unequal length")
    held = vectors.sparkSession.sparkContext.broadcast(([r["query_id"] for r in rows], normed([r["vector"] for r in rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, asked = held.value
        for batch in batches:
            if not len(batch):
                continue
            stored, column = matrix(batch.column("embedding"), asked.shape[1]), batch.column(key)
            names = np.empty(len(batch), object)
            names[:] = column.to_pylist()
            for at in range(0, len(ids), QUERY_ROWS):
                place, score = best(asked[at : at + QUERY_ROWS] @ stored.T, names, k)
                who = [ids[at + i] for i in range(len(place)) for _ in range(place.shape[1])]
                yield pa.RecordBatch.from_arrays([pa.array(who, id_type), column.take(pa.array(place.ravel())).cast(key_type), pa.array(score.ravel())], names=["query_id", key, "score"])

    return top(there.select(key, "embedding").mapInArrow(run, f"query_id {id_kind}, {key} {kind}, score double"), k, key)


# approximate search

#: Vectors that centroids are fitted on at most, and rounds of the fit.
SAMPLE, ROUNDS = 20_000, 12


def fit_centroids(vectors: DataFrame, n_lists: int, key: str = "chunk_id", sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids of the vectors' directions, by k-means on at most `sample` of them, those of smallest hash of the key: a
    bounded fit, the same in every run."""
    some = vectors.where("embedding IS NOT NULL").orderBy(F.xxhash64(key), key).limit(sample).select("embedding").collect()
    rows = normed([r[0] for r in some]) if some else np.zeros((1, 1))
    draw = np.random.default_rng(0)
    centers = rows[draw.choice(len(rows), min(n_lists, len(rows)), replace=False)]
    for _ in range(ROUNDS):
        near = (rows @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, rows)
        empty = np.bincount(near, minlength=len(centers)) == 0
        sums[empty] = rows[draw.integers(0, len(rows), int(empty.sum()))]
        centers = normed(sums)
    return centers


def _lists(df: DataFrame, column: str, centroids: np.ndarray, probes: int) -> DataFrame:
    """`df` with the `probes` lists of nearest centroid as `list`, a row for each."""
    held = df.sparkSession.sparkContext.broadcast(centroids)
    n = min(probes, len(centroids))

    @F.pandas_udf("array<int>")
    def nearest_lists(rows: pd.Series) -> pd.Series:
        score = normed(np.stack(rows.to_numpy())) @ held.value.T if len(rows) else np.zeros((0, len(held.value)))
        return pd.Series(list(np.argsort(-score, axis=1, kind="stable")[:, :n].astype(np.int32)))

    return df.where(F.col(column).isNotNull()).withColumn("list", F.explode(nearest_lists(column)))


def inverted_lists(vectors: DataFrame, centroids: np.ndarray, key: str = "chunk_id") -> DataFrame:
    """list, <key>, embedding: every vector under its nearest centroid. Written with partitionBy("list"), a search reads the asked lists only."""
    return _lists(vectors.select(key, "embedding"), "embedding", centroids, 1).select("list", key, "embedding")


def nearest_in_lists(lists: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 8, key: str = "chunk_id") -> DataFrame:
    """query_id, <key>, score, rank, as `nearest`, of the vectors in the `probes` lists nearest to each query. Scores are exact;
    a neighbour in another list is missed. With as many probes as lists nothing is."""
    asked = _lists(queries.select("query_id", "vector"), "vector", centroids, probes)
    probed = broadcast_if_small(asked.select("list").distinct())
    return top(grid(lists.join(probed, "list", "left_semi"), asked, k, key), k, key)
