"""BM25 by cells: equal to the join of postings and to a plain sum, with ties, frequent terms and cut texts; no posting is shuffled."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.operators import cells, lexical
from lectern.plans.search import search

WORDS = ["the", "of", "and", *(f"w{i}" for i in range(60)), "it's", "x-y"]


def texts(seed, n):
    draw = random.Random(seed)
    out = [" ".join(draw.choices(WORDS, [30, 20, 10] + [1] * 62, k=draw.randint(0, 40))) for _ in range(n)]
    return [*out, None, "", "!", "A Kelvin İx THE a" + "b" * 60, *out[:5] * 3]


QUERIES = [(0, "the w7"), (1, "of THE and w1 w2 w3"), (2, "absent"), (3, None), (4, "the"), (5, "w5 w6 it's x-y"), (6, "kelvin x"), (7, "the w7")]


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_equal_to_joined_postings(spark, monkeypatch, k):
    chunks = spark.createDataFrame([(f"c{i:04d}", t) for i, t in enumerate(texts(k, 300))], "chunk_id string, content string").repartition(3)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    findable = chunks.where(F.col("chunk_id").endswith("3"))
    got, some = (sorted(map(tuple, lexical.bm25(chunks, queries, k, findable=x).collect())) for x in (None, findable))
    monkeypatch.setattr(cells, "MOST_PAIRS", -1)
    assert got == sorted(map(tuple, lexical.bm25(chunks, queries, k).collect()))
    assert some == sorted(map(tuple, lexical.bm25(chunks, queries, k, findable=findable).collect()))


@pytest.mark.parametrize("seed", range(8))
def test_a_cell_gives_the_plain_sums(seed):
    """Also where few texts can still reach the k-th place, so that frequent terms are looked up for them only."""
    draw = np.random.default_rng(seed)
    n, k = 2000, int(draw.integers(1, 20))
    shares = np.array([0.9, 0.7, 0.3, 0.02, 0.01, 0.004, 0.0])
    held = [np.flatnonzero(draw.random(n) < s) for s in shares]
    text, term = np.concatenate(held), np.repeat(np.arange(len(shares)), [len(h) for h in held])
    text, term = np.concatenate([text, text[::3]]), np.concatenate([term, term[::3]])
    dl = draw.integers(2, 50, n)
    df = np.array([len(h) for h in held])
    idf = np.log((n - df + 0.5) / (df + 0.5) + 1)
    keys = draw.permutation(n)
    cell = cells.Cell([pa.array(keys[:700]), pa.array(keys[700:])], dl, text, term, idf, 20.0, 1.5, 0.75)
    for terms in ([0], [5], [0, 3], [0, 1, 2, 3, 4, 5, 6], [6], [4, 5, 0, 1]):
        score = np.zeros(n)
        for t in terms:
            tf = np.bincount(text[term == t], minlength=n)
            score += idf[t] * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / 20.0))
        want = sorted((i for i in range(n) if score[i] > 0), key=lambda i: (-np.round(score[i], 6), keys[i]))[:k]
        some, got = cell.best(np.array(terms), k)
        assert sorted(some) == sorted(want) and np.allclose(got, score[some], rtol=0, atol=1e-9)


def test_no_postings_are_shuffled(spark):
    chunks = spark.createDataFrame([(f"c{i}", f"f#{i}", i, t, {"lang": '"en"'}) for i, t in enumerate(texts(0, 50))], "chunk_id string, document_path string, chunk_index int, content string, metadata map<string,string>")
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    plan = lexical.bm25(chunks, queries, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Aggregate" not in plan
    found = search(chunks, queries, 3, {"lang": "en"}, Config(filter_stage="pre"))
    assert "LeftSemi" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_looked_up_where_they_stand():
    """Equal to plain patterns on odd texts and on a part of an array; and no word is copied, so cutting takes a few bytes for each byte of text."""
    draw = random.Random(5)
    asked = pa.array(["ab", "it's", "x-y", "a" * 49, "9z", "--"])
    for _ in range(300):
        texts = ["".join(draw.choice([*"ab  it's x-y .é😀9z\n", "a" * 49, "a" * 50, " -- "]) for _ in range(draw.choice([0, 1, 3, 30]))) + " " for _ in range(draw.randint(2, 6))]
        texts, first = pa.array(texts), draw.randint(0, 1)
        found = [[w for w in re.findall("[a-z0-9'-]+", t) if 1 < len(w) < 50] for t in texts.to_pylist()[first:]]
        dl, text, term = cells.cut(texts[first:], asked)
        assert list(dl) == [len(f) for f in found]
        assert [(i, asked[t].as_py()) for i, t in zip(text, term)] == [(i, w) for i, f in enumerate(found) for w in f if w in asked.to_pylist()]
    texts = pa.array(["the quick brown fox isn't here " * 30] * 2000)
    tracemalloc.start()
    cells.cut(texts, pa.array(["fox"]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * texts.nbytes


@pytest.mark.parametrize("most", [20_000, 1])
def test_found_windows_alone_are_made_again(spark, monkeypatch, most):
    """The last pass over the texts cuts the documents of found windows only; beyond the bound it's the join with all."""
    import lectern.plans.search as plans

    docs = spark.createDataFrame([(f"f{i:03d}", t) for i, t in enumerate(texts(3, 60))], "path string, content string")

    def made(docs):
        return docs.select(F.concat("path", F.lit("#0")).alias("chunk_id"), F.col("path").alias("document_path"), F.lit(0).alias("chunk_index"), "content")

    asked = []

    def holding(found):
        asked.append(sorted({r.chunk_id for r in found.collect()}))
        return made(docs.join(F.broadcast(found.select(F.substring_index("chunk_id", "#", 1).alias("path")).distinct()), "path", "left_semi"))

    monkeypatch.setattr(plans, "MOST_FOUND", most)
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    got, want = (sorted(map(tuple, search(made(docs), queries, 3, holding=h).select("query_id", "chunk_id", "score", "rank", "content").collect())) for h in (holding, None))
    assert got == want and len(asked) == (most > 1)
    assert not asked or {r[1] for r in got} <= set(asked[0]) and len(asked[0]) < 60


@pytest.mark.parametrize("docs", [10, 100_000])
def test_many_queries_go_to_the_texts_in_blocks(spark, monkeypatch, docs):
    """More terms than go to the workers at once: results are those of one block, and no posting is joined or shuffled."""
    chunks = spark.createDataFrame([(f"c{i:04d}", t) for i, t in enumerate(texts(7, 300))], "chunk_id string, content string").repartition(3)
    queries = spark.createDataFrame([(10 * i + n, q) for i in range(5) for n, q in QUERIES], "query_id int, query string")
    want = sorted(map(tuple, lexical.bm25(chunks, queries, 3).collect()))
    monkeypatch.setattr(cells, "DOCS", docs)
    monkeypatch.setattr(cells, "MOST_PAIRS", 20)
    found = lexical.bm25(chunks, queries, 3)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("MapInArrow") > 1
    assert sorted(map(tuple, found.collect())) == want


def test_a_task_gives_k_rows_for_each_query(spark, monkeypatch):
    """However many cells it has; and a cell leaves out the texts below the scores that those before it found."""
    monkeypatch.setattr(cells, "DOCS", 16)
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(texts(8, 400))], "chunk_id long, content string").coalesce(1)
    asked = spark.createDataFrame([(1, ["of", "w1", "the"]), (2, ["the"])], "query_id long, terms array<string>")
    assert cells.best(chunks, asked, 3, "chunk_id", "content", chunks, 1.5, 0.75).count() == 6
    cell = cells.Cell([pa.array([0, 1, 2, 3])], np.array([4, 4, 4, 9]), np.array([0, 1, 2, 3]), np.array([0, 0, 0, 0]), np.array([1.0]), 4.0, 1.5, 0.75)
    least = cell.weight[0]
    assert cell.search(np.array([0]), np.array([0, 1]), np.array([least]), 3)[1].tolist() == [0, 1, 2]
    assert cell.search(np.array([0]), np.array([0, 1]), np.array([least + 1e-3]), 3)[1].tolist() == []
