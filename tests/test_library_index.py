"""The library's stored index: statistics that merge, blocks, fetches by key, several writers."""

import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lectern.operators import cells, lexical
from lectern.plans import library as plan
from lectern.plans.library import Conflict, Library

from .test_blockmax import scanned

WORDS = [f"word{i}" for i in range(40)]


def docs(spark, texts):
    return spark.createDataFrame([*texts.items()], "path string, content string").select("path", F.lit("txt").alias("format"), "content", F.create_map().cast("map<string,string>").alias("metadata"), F.lit(None).cast("string").alias("error"))


def drawn(draw):
    return " ".join(draw.choices(WORDS, k=draw.randint(0, 500)))


def found(library, *queries):
    return sorted((r.query_id, r.document_path, r.chunk_index, round(r.score, 6)) for r in library.search(list(queries), 5).collect())


def in_full(spark, library, *queries):
    """The same search over all live chunks, without an index."""
    asked = spark.createDataFrame([*enumerate(queries)], "query_id int, query string")
    chunks = library.table("chunks")
    best = lexical.top(lexical.bm25(chunks, asked, 10), 5, "rank")
    return sorted((r.query_id, r.document_path, r.chunk_index, round(r.score, 6)) for r in best.join(chunks, "chunk_id").collect())


def check_statistics(library):
    at = library._generations()
    chunks = library.table("chunks", at)
    n, mean = library._totals(at)
    full = lexical.corpus_stats(chunks).first()
    assert n == full.n and (mean is None or abs(mean - full.avgdl) < 1e-9)
    held = {r.term: r.df for r in library._frequencies(at).collect() if r.df}
    assert held == {r.term: r.df for r in lexical.document_frequencies(chunks).collect()}


@pytest.mark.parametrize("seed", range(2))
def test_statistics_merge(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(plan, "MOST_GENERATIONS", 5)
    draw, library, live = random.Random(seed), Library(spark, f"file://{tmp_path}/index"), {}
    for _ in range(8):
        if live and draw.random() < 0.3:
            gone = draw.choice(sorted(live))
            assert library.remove(gone)
            del live[gone]
        else:
            some = {f"p{draw.randint(0, 6)}": drawn(draw) for _ in range(3)}
            library.add(docs(spark, some))
            live |= some
        assert {r.path for r in library.documents().collect()} == set(live)
    check_statistics(library)
    assert found(library, "word3 word4", "word7") == in_full(spark, library, "word3 word4", "word7")
    postings = Counter(r.term for r in library.table("postings").collect())
    assert postings == Counter({r.term: r.df for r in lexical.document_frequencies(library.table("chunks")).collect()})
    library.clear()
    check_statistics(library)
    assert found(library, "word3") == []


def test_filter_before_uses_the_blocks(spark, tmp_path):
    draw, library = random.Random(4), Library(spark, f"file://{tmp_path}/index")
    library.add(docs(spark, {f"a{i}": drawn(draw) for i in range(6)}), {"team": "x"})
    library.add(docs(spark, {f"b{i}": drawn(draw) for i in range(6)}), {"team": "y"})
    library.configure(filter_stage="pre")
    got = library.search("word1 word2", 5, {"team": "y"}).collect()
    everything = lexical.bm25(library.table("chunks"), spark.createDataFrame([(0, "word1 word2")], "query_id int, query string"), 1000).join(library.table("chunks"), "chunk_id")
    want = [round(r.score, 6) for r in everything.where("document_path LIKE 'b%'").orderBy(F.desc("score"), "chunk_id").limit(5).collect()]
    assert [round(r.score, 6) for r in sorted(got, key=lambda r: r["rank"])] == want and all(r.document_path.startswith("b") for r in got)


def test_found_chunks_are_read_by_key(spark, tmp_path):
    """Of many chunks, page indexes and bloom filters leave only the found ones' pages to read."""
    library = Library(spark, f"file://{tmp_path}/index")
    library.add(docs(spark, {f"p{i:04d}": f"common text {i} " + ("needle" if i == 777 else "hay") for i in range(2000)}))
    out = library.search("needle", 1)
    (row,) = out.collect()
    assert row.document_path == "p0777"
    sizes = scanned(out)
    assert library.table("chunks").count() == 2000 and max(sizes) <= 300
    plan_text = out._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan_text and "EqualTo(chunk_id" in plan_text


def test_two_writers_lose_nothing(spark, tmp_path):
    draw, errors = random.Random(2), []
    texts = [{f"w{w}-{i}-{k}": drawn(draw) for k in range(2)} for w in range(2) for i in range(2)]

    def write(parts):
        try:
            for part in parts:
                Library(spark, f"file://{tmp_path}/index").add(docs(spark, part))
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(texts[2 * w : 2 * w + 2],)) for w in range(2)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    library = Library(spark, f"file://{tmp_path}/index")
    assert not errors and {r.path for r in library.documents().collect()} == {p for part in texts for p in part}
    check_statistics(library)


def test_conflicts_are_made_anew(spark, tmp_path, monkeypatch):
    """A writer whose paths changed meanwhile starts again: the second one sees the first one's document and adds a version."""
    library, other = (Library(spark, f"file://{tmp_path}/index") for _ in range(2))
    library.add(docs(spark, {"p": "old text", "q": "stays"}))
    plain, calls = library._commit, []

    def late(new, base, whole=False):
        if not calls:
            calls.append(1)
            other.add(docs(spark, {"p": "their text"}))
        return plain(new, base, whole)

    monkeypatch.setattr(library, "_commit", late)
    assert library.add(docs(spark, {"p": "my text"})).documents == 1
    versions = sorted((r.version, r.content) for r in library.table("versions").where("path = 'p'").collect())
    assert [c for _, c in versions] == ["old text", "their text", "my text"] and [v for v, _ in versions] == [1, 2, 3]
    check_statistics(library)
    stale = other._generations()[:-1]
    with pytest.raises(Conflict):
        other._commit({"gone": spark.createDataFrame([("p",)], "path string")}, stale)
    with pytest.raises(Conflict):
        other._commit({}, stale, whole=True)
    other._commit({"gone": spark.createDataFrame([("none",)], "path string")}, stale)  # other paths: no conflict


def test_a_dead_writers_number_is_given_up(spark, tmp_path, monkeypatch):
    library = Library(spark, f"file://{tmp_path}/index")
    library.add(docs(spark, {"p": "old text"}))
    library._create(f"{library.path}/claims/2")  # a writer that died with its claim
    monkeypatch.setattr(plan, "PATIENCE", 0.2)
    library.add(docs(spark, {"q": "new text"}))
    assert library._generations() == [1, 3] and not library._settle(2, True) and library.stats() == {"documents": 2, "chunks": 2}


def test_indexing_and_compacting_shuffle_texts_and_no_postings(spark, tmp_path, monkeypatch):
    from lectern.operators import blockmax
    from lectern.plans.library import Library

    def never(*_, **__):
        raise AssertionError("postings are shuffled")

    monkeypatch.setattr(blockmax, "laid_out", never)
    monkeypatch.setattr(blockmax, "blocks", never)
    library = Library(spark, f"file://{tmp_path}/index")
    library.add(spark.createDataFrame([("a", "txt", "some words", {}, None), ("b", "txt", "other words here", {}, None)], "path string, format string, content string, metadata map<string,string>, error string"))
    library.compact()
    assert [r.document_path for r in library.search("other", 5).collect()] == ["b"]


def test_indexing_cuts_texts_without_expressions_over_arrays(spark, tmp_path, monkeypatch):
    """Lengths and the change of statistics come from one pass over the bytes; equal to arrays of terms, on odd texts and after a change."""
    from lectern.functions import text as T

    odd = {"a": "It's x-y İ ab AB " + "b" * 60 + " é", "b": "", "c": "!? 9z 9z", "d": "the the " * 40}
    chunks = spark.createDataFrame([(k, t) for k, t in odd.items()] + [("e", None)], "path string, content string")
    want = {r.path: r.n for r in chunks.select("path", F.size(T.terms(F.col("content"))).alias("n")).collect()}
    assert {r.path: r.n for r in chunks.select("path", cells.lengths(F.col("content")).alias("n")).collect()} == want

    def never(*_):
        raise AssertionError("an array of terms is made")

    library = Library(spark, f"file://{tmp_path}/index")
    monkeypatch.setattr(plan, "terms", never, raising=False)
    library.add(docs(spark, odd))
    library.add(docs(spark, {"d": "the other", "f": "ab"}))
    library.remove("a")
    live = library.table("chunks")
    at = library._generations()
    assert {tuple(r) for r in library._frequencies(at).where("df <> 0").collect()} == {tuple(r) for r in lexical.document_frequencies(live).collect()}
    n, mean = library._totals(at)
    assert (n, mean) == tuple(lexical.corpus_stats(live).first())


def test_a_range_holds_a_thousand_chunks_and_texts_are_dealt_evenly(spark):
    """Few rows of rare terms for each range, and no task makes two shares of ranges."""
    from lectern.operators import blockmax

    chunks = spark.range(40 * 128).select(F.col("id").cast("string").alias("chunk_id"), F.concat(F.lit("one w"), F.col("id") % 7).alias("content"))
    made = blockmax.indexed(chunks, 5 * 1024).select("term", "block", F.spark_partition_id().alias("task"))
    rows = made.where("term = 'one'").collect()
    assert len(rows) == 5 and sorted(Counter(r.task for r in rows).values()) == [2, 3]


def test_a_watch_counts_terms_on_bytes(spark, tmp_path, monkeypatch):
    def never(*_):
        raise AssertionError("an array of terms is made")

    monkeypatch.setattr(plan, "terms", never, raising=False)
    (tmp_path / "in").mkdir()
    for name, text in {"a": "one two", "b": "two THREE x"}.items():
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    library = Library(spark, f"file://{tmp_path}/index")
    library.watch(f"{tmp_path}/in", once=True).awaitTermination()
    assert {tuple(r) for r in library._frequencies(library._generations()).collect()} == {("one", 1), ("two", 2), ("three", 1)}
