"""Block-max search: equal to the full scan, reads few blocks of frequent terms, bounds hold under any statistics."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import blockmax, lexical


PER = 16


def corpus(seed, n):
    """Chunks in which `the` is in all, `mid` in a third and `rare` in a few."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        words = ["the"] * draw.randint(1, 6) + [f"w{draw.randint(0, 300)}" for _ in range(draw.randint(3, 40))]
        words += ["mid"] * (draw.random() < 0.33) + ["rare"] * (2 if i % 211 == 0 else 0)
        draw.shuffle(words)
        rows.append((f"c{i:05d}", " ".join(words)))
    return rows


@pytest.fixture(scope="module")
def held(spark, tmp_path_factory):
    chunks = spark.createDataFrame(corpus(1, 4000), "chunk_id string, content string").repartition(4)
    posts = lexical.postings(chunks)
    place = f"file://{tmp_path_factory.mktemp('index')}/blocks"
    blockmax.laid_out(blockmax.blocks(posts, 4000, per=PER)).write.options(**blockmax.WRITE_OPTIONS).parquet(place)
    stats = lexical.corpus_stats(chunks).first()
    return chunks, spark.read.parquet(place), stats.n, stats.avgdl, lexical.document_frequencies(chunks)


QUERIES = [(0, "rare the"), (1, "the mid w7"), (2, "absent"), (3, ""), (4, "w1 w2 w3 the the rare"), (5, "the"), (6, None)]


def test_equal_to_a_full_scan(spark, held):
    chunks, index, n, avgdl, df = held
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    for k in (1, 10, 500):
        want = sorted(map(tuple, lexical.bm25(chunks, queries, k).collect()))
        assert sorted(map(tuple, blockmax.search(index, queries, n, avgdl, df, k).collect())) == want


def test_without_literals_and_seeds(spark, held, monkeypatch):
    chunks, index, n, avgdl, df = held
    queries = spark.createDataFrame(QUERIES, "query_id int, query string")
    want = sorted(map(tuple, lexical.bm25(chunks, queries, 10).collect()))
    monkeypatch.setattr(blockmax, "fetched", lambda df: (df, None))
    assert sorted(map(tuple, blockmax.search(index, queries, n, avgdl, df, 10).collect())) == want
    monkeypatch.setattr(blockmax, "SEEDS", 1)
    assert sorted(map(tuple, blockmax.search(index, queries, n, avgdl, df, 10).collect())) == want


def scanned(df):
    """Rows that the scans of an executed plan gave."""
    def walk(node):
        yield node
        kids = node.children()
        for i in range(kids.size()):
            yield from walk(kids.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            yield from walk(node.executedPlan())
        elif node.nodeName().endswith("QueryStage"):
            yield from walk(node.plan())

    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return [node.metrics().apply("numOutputRows").value() for node in walk(df._jdf.queryExecution().executedPlan()) if node.nodeName().startswith("Scan parquet")]


def test_most_blocks_of_a_frequent_term_are_not_read(spark, held):
    _, index, n, avgdl, df = held
    queries = spark.createDataFrame([(0, "rare the")], "query_id int, query string")
    found = blockmax.Search(index, blockmax.weights(lexical.query_terms(queries), n, avgdl, df), 5)
    seeds, rest, _ = found.ranges_to_read()
    of_the = index.where("term = 'the'").count()
    read = seeds.count() + rest.count()
    assert of_the == 4000 // PER and read <= of_the / 5
    rows = scanned(found.score(seeds))
    assert sum(rows) < index.count() / 10  # Parquet's page indexes skip the rest


def test_heads_are_read_without_postings(spark, held):
    _, index, n, avgdl, df = held
    queries = spark.createDataFrame([(0, "rare the")], "query_id int, query string")
    plan = blockmax.Search(index, blockmax.weights(lexical.query_terms(queries), n, avgdl, df), 5).bounds()._jdf.queryExecution().executedPlan().toString()
    assert "peaks" in (schema := re.search(r"ReadSchema: (\S+)", plan)[1]) and "hits" not in schema and "PushedFilters" in plan


def test_bounds_hold_under_any_statistics(spark, held):
    """The sum of a range's largest impacts is at least every chunk's score, whatever the mean length and the counts."""
    chunks, index, _, _, df = held
    queries = spark.createDataFrame([(0, "the mid w7 w8")], "query_id int, query string")
    for n, avgdl in ((4000, 3.0), (100_000, 500.0)):
        found = blockmax.Search(index, blockmax.weights(lexical.query_terms(queries), n, avgdl, df), 5)
        bounds = found.bounds()
        number = F.pmod(F.xxhash64("chunk_id"), F.lit(4000 // PER))
        scored = found.score(bounds).groupBy(number.alias("block")).agg(F.max("score").alias("best")).join(bounds, "block")
        rows = scored.collect()
        assert rows and all(r.best <= r.bound + 1e-9 for r in rows)
        one = found.score(bounds.where("place = 1")).orderBy(F.desc("score")).first()
        text = dict(corpus(1, 4000))[one.chunk_id].split()
        frequency = {r.term: r.df for r in df.where(F.col("term").isin("the", "mid", "w7", "w8")).collect()}
        want = sum(math.log((n - frequency[t] + 0.5) / (frequency[t] + 0.5) + 1) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * len(text) / avgdl)) for t in ("the", "mid", "w7", "w8") if (c := text.count(t)))
        assert abs(one.score - want) < 1e-9


def test_term_counts_need_no_shuffle(spark):
    chunks = spark.createDataFrame([("a", "b-b a1 b-b x"), ("b", None), ("c", "!"), ("d", "zz " * 3)], "chunk_id string, content string")
    assert sorted(map(tuple, lexical.postings(chunks).collect())) == [("a1", "a", 1, 3), ("b-b", "a", 2, 3), ("zz", "d", 3, 3)]
    assert "Exchange" not in lexical.postings(chunks)._jdf.queryExecution().executedPlan().toString()


def test_indexed_texts_are_the_blocks_of_their_postings(spark, monkeypatch):
    """Equal to blocks of postings, and the texts are shuffled in their place: one exchange, by range."""
    monkeypatch.setattr(blockmax, "PER_TASK", 300)
    rows = [*corpus(2, 700), ("x1", None), ("x2", "!"), ("x3", "ABC İ a" + "b" * 60 + " it's")]
    chunks = spark.createDataFrame([(k, t, f"of {k}") for k, t in rows], "chunk_id string, content string, document_path string").repartition(3)
    made = blockmax.indexed(chunks, len(rows), others=("document_path",))
    named = lexical.postings(chunks.withColumn("named", F.struct("chunk_id", "document_path")), "named").select("term", "named.chunk_id", "tf", "dl", "named.document_path")
    want = blockmax.blocks(named, len(rows), others=("document_path",))
    assert made.schema.simpleString() == want.schema.simpleString()
    plain = lambda df: sorted((r.term, r.block, sorted(map(tuple, r.peaks)), sorted(map(tuple, r.hits))) for r in df.collect())
    assert plain(made) == plain(want)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 1 and "Aggregate" not in plan


def test_many_queries_are_searched_by_cells(spark, held, monkeypatch):
    chunks, index, n, avgdl, df = held
    queries = spark.createDataFrame([(i, f"the mid w{i} w{(i * 7) % 301} rare" if i % 9 else "the") for i in range(200)], "query_id int, query string")
    found = blockmax.Search(index, blockmax.weights(lexical.query_terms(queries), n, avgdl, df), 5)
    assert found.many
    monkeypatch.setattr(blockmax, "CELL", 40)
    got = found.run()
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, lexical.bm25(chunks, queries, 5).collect()))
