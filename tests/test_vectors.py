"""Nearest vectors: the grid on the executors, ties, and inverted lists, against plain numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import queries
from lectern.operators import vectors


def plain(stored, asked, k):
    a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (np.array([v for _, v in asked]), np.array([v for _, v in stored])))
    score = np.round(a @ b.T, 6)
    out = set()
    for (q, _), row in zip(asked, score, strict=True):
        out |= {(q, stored[j][0], rank) for rank, j in enumerate(sorted(range(len(stored)), key=lambda j: (-row[j], stored[j][0]))[:k], 1)}
    return out


def test_many_queries_never_pass_the_driver(spark, monkeypatch, tmp_path):
    draw = np.random.default_rng(0)
    stored = [(f"c{i:03d}", v) for i, v in enumerate(draw.normal(size=(120, 16)).tolist())]
    rows = spark.createDataFrame(stored, "chunk_id string, embedding array<double>")
    asked = spark.range(100_000).select(F.col("id").alias("query_id"), F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(F.col("id") * i * 0.37) + 0.01 * i).alias("vector"))
    asked.write.parquet(f"file://{tmp_path}/asked")
    asked = spark.read.parquet(f"file://{tmp_path}/asked")
    monkeypatch.setattr(vectors, "CELL_VECTORS", 50)
    for name in ("collect", "toLocalIterator", "toPandas"):
        before = getattr(type(asked), name)
        monkeypatch.setattr(type(asked), name, lambda self, *a, f=before, **b: f(self, *a, **b) if "query_id" not in self.columns else pytest.fail("queries on the driver"))
    found = vectors.nearest(rows, asked, 3)
    total = found.agg(F.count(F.lit(1)), F.countDistinct("query_id")).first()
    assert tuple(total) == (300_000, 100_000)
    monkeypatch.undo()
    some = [(r.query_id, list(r.vector)) for r in asked.where("query_id % 5000 = 0").collect()]
    got = {(r.query_id, r.chunk_id, r["rank"]) for r in found.where("query_id % 5000 = 0").collect()}
    assert got == plain(stored, some, 3)


@pytest.mark.parametrize("few", [0, 10**9])
def test_ties_go_by_name_and_dont_multiply(spark, monkeypatch, few):
    """Equal and zero vectors: k rows move on for each query, the ones of smallest name."""
    monkeypatch.setattr(vectors, "FEW_BYTES", few)
    draw = random.Random(1)
    stored = [(draw.randint(0, 10**9), v) for v in [[0.0, 0.0]] * 300 + [[1.0, 0.0]] * 300 + [[0.6, 0.8]] * 50]
    asked = [(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0]), (None, [0.0, 1.0])]
    rows = spark.createDataFrame(stored, "chunk_id long, embedding array<double>").repartition(5)
    got = vectors.nearest(rows, spark.createDataFrame(asked, "query_id int, vector array<double>"), 7).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == plain(stored, asked, 7) and len(got) == 28


def test_recall_of_inverted_lists(spark):
    folder = "/root/testdata/sf0.1"
    stored = spark.read.parquet(f"{folder}/embeddings.parquet")
    asked = stored.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    centroids = vectors.fit_centroids(stored, 64, "vec_id")
    lists = vectors.inverted_lists(stored, centroids, "vec_id")
    assert lists.count() == stored.count()
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.select("query_id", "vec_id").collect()}
    exact = pairs(vectors.nearest(stored, asked, 10, "vec_id"))
    found = pairs(vectors.nearest_in_lists(lists, centroids, asked, 10, 40, "vec_id"))
    print("recall at 10 with 40 of 64 lists:", len(exact & found) / len(exact))
    assert len(exact & found) / len(exact) >= 0.9
    assert pairs(vectors.nearest_in_lists(lists, centroids, asked, 10, 64, "vec_id")) == exact


def test_stored_lists_are_read_only_where_asked(spark, tmp_path):
    draw = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(draw.normal(size=(400, 4)).tolist())], "vec_id long, embedding array<double>")
    centroids = vectors.fit_centroids(rows, 8, "vec_id")
    vectors.inverted_lists(rows, centroids, "vec_id").write.partitionBy("list").parquet(f"file://{tmp_path}/lists")
    lists = spark.read.parquet(f"file://{tmp_path}/lists")
    found = vectors.nearest_in_lists(lists, centroids, rows.where("vec_id = 5").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 3, 2, "vec_id")
    assert found.orderBy("rank").first().vec_id == 5
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString().lower()


def test_hot_lists_are_cut(spark, monkeypatch):
    """All vectors and queries in one list: several cells, the same results."""
    stored = [(i, [1.0, i / 1000]) for i in range(200)]
    rows = spark.createDataFrame(stored, "chunk_id long, embedding array<double>")
    asked = rows.where("chunk_id < 40").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    centroids = np.array([[1.0, 0.0], [-1.0, 0.0]])
    monkeypatch.setattr(vectors, "CELL_VECTORS", 30)
    monkeypatch.setattr(vectors, "QUERY_BYTES", 160)
    got = vectors.nearest_in_lists(vectors.inverted_lists(rows, centroids), centroids, asked, 4, 1).collect()
    assert {(r.query_id, r.chunk_id, r["rank"]) for r in got} == plain(stored, stored[:40], 4)


def test_the_registered_query_finds_most_neighbours(spark):
    folder = "/root/testdata/sf0.001"
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.select("query_id", "vec_id").collect()}
    exact, found = (pairs(q(spark, folder)) for q in (queries.vector_batch, queries.vector_approximate))
    assert len(exact & found) / len(exact) >= 0.9
