import math
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.config import Config
from lectern.functions import text as T
from lectern.operators import answers, chunking, fusion, lexical, tables, vectors, versions
from lectern.operators.rerank import boost
from lectern.plans.search import matches, search

from . import plain_tables


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(
    ("path", "kind"),
    [("doc.txt", "txt"), ("doc.pdf", "pdf"), ("a/doc.md", "md"), ("doc.MARKDOWN", "md"), ("doc.html", "html"), ("doc.htm", "html"), ("doc.docx", "docx"), ("p.png", "image"), ("p.jpg", "image"), ("p.jpeg", "image"), ("p.tiff", "image"), ("p.bmp", "image"), ("p.gif", "image"), ("p.webp", "image"), ("data.csv", "txt"), ("script.js", "txt"), (".bashrc", "txt"), ("x/.md", "txt"), ("t.xlsx", "xlsx"), ("t.pptx", "pptx")],
)
def test_detect_format(spark, path, kind):
    assert one(spark, T.detect_format(F.col("p")), p=path) == kind


def test_urls(spark):
    got = spark.createDataFrame([("https://a.b/c",), ("HTTP://x",), ("ftp://x",), ("/tmp/a.txt",), (None,)], "u string").select(T.is_url(F.col("u"))).collect()
    assert [r[0] for r in got] == [True, True, False, False, False]


def test_terms_and_trim(spark):
    assert one(spark, T.terms(F.col("t")), t="Don't STOP a well-known café " + "x" * 50) == ["don't", "stop", "well-known", "caf"]
    assert one(spark, T.trim(F.col("t")), t=" ﻿ a b \n") == "a b"


def test_windows(spark):
    text = ("word " * 5000).strip()
    got = one(spark, chunking.windows(F.col("t")), t=text)
    assert len(got) == math.ceil(len(text) / 1300) and got[0] == text[:1500].strip()
    assert one(spark, chunking.windows(F.col("t")), t=" \n ") == []
    with pytest.raises(ValueError):
        chunking.windows(F.col("t"), 100, 100)


@pytest.mark.parametrize(("size", "overlap"), [(10, 0), (10, 3), (10, 5), (10, 9), (3, 1), (1, 0), (2_000_000_000, 3)])
def test_windows_of_any_size_are_plain_slices(spark, size, overlap):
    draw = random.Random(size + overlap)
    texts = ["".join(draw.choices("ab \n\x85😀é", k=draw.choice([0, 1, 9, 10, 40]))) for _ in range(60)] + ["a😀" * 5000]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", chunking.windows(F.col("t"), size, overlap)).collect()
    assert {i: w for i, w in got} == {i: [t[s : s + size].strip(T.SPACES) for s in range(0, len(t), size - overlap)] if t.strip(T.SPACES) else [] for i, t in enumerate(texts)}


def test_windows_of_a_long_text_take_time_by_its_length(spark):
    """Each window once sought its place from the text's beginning: 4 MB took 38 s."""
    long = spark.range(1).select(F.repeat(F.lit("some words é of a text. "), 170_000).alias("t"))
    began = time.monotonic()
    assert long.select(F.size(F.transform(chunking.windows(F.col("t")), F.length))).first()[0] == math.ceil(170_000 * 24 / 1300)
    assert time.monotonic() - began < 10


@settings(max_examples=30, deadline=None)
@given(st.lists(st.sampled_from(["# A", "## B c", "---", "text", "", "INTRO PART", "1.2 Scope", "more text", "####### no"]), max_size=14))
def test_sections_match_a_line_by_line_version(lines):
    for markdown in (True, False):
        out, held, heading, inside = [], [], None, False

        def flush():
            if content := "\n".join(held).strip():  # noqa: B023
                out.append((heading, content))  # noqa: B023

        for i, line in enumerate(lines):
            if line == "---" and (not markdown or i == 0 or inside):
                inside = not inside
                held.append(line)
                continue
            starts = not inside and (line in ("# A", "## B c") or (not markdown and line in ("INTRO PART", "1.2 Scope") and len(held) > 2))
            if starts:
                flush()
                heading = line.lstrip("#").strip() if line[0] == "#" else line
                held = []
            held.append(line)
        flush()
        assert chunking.sections("\n".join(lines), markdown) == out


def test_bm25(spark):
    chunks = spark.createDataFrame([("1", "termination clause agreement"), ("2", "payment terms invoice due")], "chunk_id string, content string")
    queries = spark.createDataFrame([(0, "termination"), (1, "absent"), (2, "terms terms")], "query_id int, query string")
    got = {(r.query_id, r.chunk_id): r.score for r in lexical.bm25(chunks, queries).collect()}
    idf = math.log((2 - 1 + 0.5) / (1 + 0.5) + 1)
    part = lambda dl: 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / 3.5))
    assert got == {(0, "1"): round(idf * part(3), 6), (2, "2"): round(idf * part(4), 6)}
    assert lexical.bm25(chunks.limit(0), queries).count() == 0


def test_vectors(spark):
    held = spark.createDataFrame([("1", [1.0, 0.0, 0.0]), ("2", [0.0, 1.0, 0.0]), ("3", [0.0, 0.0, 0.0])], "chunk_id string, embedding array<float>")
    asked = spark.createDataFrame([(0, [0.9, 0.1, 0.0])], "query_id int, vector array<double>")
    got = vectors.nearest(held, asked, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["1", "2", "3"] and got[2].score == 0
    with pytest.raises(Exception, match="unequal length"):
        vectors.nearest(held, spark.createDataFrame([(0, [1.0])], "query_id int, vector array<double>"), 5).collect()
    with pytest.raises(Exception, match="unequal length"):
        held.select(vectors.cosine(F.col("embedding"), F.array(F.lit(1.0)))).collect()


def test_fusion_is_symmetric(spark):
    a = spark.createDataFrame([(0, "x", 1), (0, "y", 2)], "query_id int, chunk_id string, rank int")
    b = spark.createDataFrame([(0, "y", 1), (0, "z", 2)], "query_id int, chunk_id string, rank int")
    scores = lambda df: {r.chunk_id: r.score for r in df.collect()}
    assert scores(fusion.fuse(a, b, 5, 0.3)) == scores(fusion.fuse(b, a, 5, 0.7))
    assert scores(fusion.fuse(a, b, 5, 0.0)) == {"x": round(1 / 61, 8), "y": round(1 / 62, 8), "z": 0.0}
    with pytest.raises(ValueError):
        fusion.fuse(a, b, 5, 1.5)


def slow_boost(query, content):
    words, text = [w for w in query.lower().split() if len(w) > 1], content.lower()
    held = [w for w in words if w in text]
    places = sorted(i for w in held for i in range(len(text)) if text.startswith(w, i))
    gap = min((b - a for a, b in zip(places, places[1:], strict=False)), default=500)
    return 0.2 * len(held) + (0.3 * (1 - gap / 500) if gap < 500 else 0) + (0.4 if words and " ".join(words) in text else 0)


@pytest.mark.parametrize("query", ["termination", "payment terms", "term termination", "a", "", "the the"])
@pytest.mark.parametrize("content", ["", "Termination of payment terms. The termination", "term", "x " * 400 + "the payment " + "y " * 300 + "terms"])
def test_boost(spark, query, content):
    assert one(spark, boost(F.col("q"), F.col("c")), q=query, c=content) == pytest.approx(slow_boost(query, content))


def test_tables(spark):
    read = lambda t: [x.asDict(True) for x in one(spark, tables.table_arrays(F.col("t")), t=t)]
    wide = "| name of the thing | price of the thing | number |\n|-------------------|--------------------|--------|\n| left part of it   | 12.00 per piece    | 7      |\n| right part of it  | 13.00 per piece    |        |"
    assert read(f"Some words.\n{wide}\nend") == [{"headers": ["name of the thing", "price of the thing", "number"], "rows": [["left part of it", "12.00 per piece", "7"], ["right part of it", "13.00 per piece"]]}]
    assert one(spark, tables.augmented(F.col("t")), t="no table") == "no table"
    assert one(spark, tables.augmented(F.col("t")), t=wide).split(tables.MARKER)[1].splitlines()[3] == "| --- | --- | --- |"
    gaps = "\n".join("alpha beta    gamma delta    epsilon zeta eta" for _ in range(3))
    assert read(gaps)[0]["headers"] == ["alpha beta", "gamma delta", "epsilon zeta eta"]
    prose = "\n".join("one two three four five six seven eight nine ten" for _ in range(5))
    assert one(spark, F.size(tables.candidate_lines(F.col("t"))), t=prose) == 5 and read(prose) == []


def test_tables_match_a_line_by_line_version(spark):
    random.seed(5)
    cells = ["alpha beta", "x", "", " ", "---", ":--", "12.50 a piece", "\u3000wide\u00a0", "\U0001f600 face", "a\rb"]

    def line():
        some = [random.choice(cells) for _ in range(random.randint(1, 7))]
        kind = random.random()
        if kind < 0.45:
            return "| " + " | ".join(some) + " |" + " " * random.randint(0, 3)
        if kind < 0.6:
            return "|" + "|".join("-" * random.randint(3, 12) for _ in some) + "|"
        return (random.choice(["   ", "  \t ", " "]).join(some) + "  end of row") * random.randint(1, 3) if kind < 0.93 else random.choice(["", "plain words", "\r"])

    texts = ["\n".join(line() for _ in range(random.randint(0, 25))) for _ in range(600)] + ["", "\n\n", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", tables.table_arrays(F.col("t")).alias("found"), tables.augmented(F.col("t")).alias("whole"), tables.candidate_lines(F.col("t")).alias("lines")).collect()
    for r in got:
        assert [x.asDict(True) for x in r.found] == plain_tables.find_tables(r.t or ""), repr(r.t)
        assert r.whole == plain_tables.with_tables(r.t or "")
        assert r.t is None or r.lines == [x for x in r.t.split("\n") if plain_tables.is_candidate(x)]
    assert sum(len(r.found) for r in got) > 300 and any(not x.headers for r in got for x in r.found)


def test_tables_are_looked_for_only_where_one_can_be(spark):
    """A text without pipes and gaps is left as it is at sight; each kind of white space makes a gap that is found."""
    texts = ["\n".join(f"the long name of a row in a table {i}{white}{white}the value" for i in range(4)) for white in [*T.SPACES.replace("\n", ""), "\n", "", "-"]]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("t", tables.table_arrays(F.col("t")).alias("found")).collect()
    assert all([x.asDict(True) for x in r.found] == plain_tables.find_tables(r.t) for r in got) and sum(len(r.found) for r in got) == len(T.SPACES) - 1
    plan = spark.createDataFrame([("a",)], "t string").select(tables.table_arrays(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan.split("Project [")[1][:20]


def test_tables_of_a_very_long_text(spark):
    text = "\n".join("" if i % 10 == 9 else f"| cell {i} | another cell of the row | a third one |" for i in range(100_000))
    began = time.monotonic()
    found = spark.createDataFrame([(text,)], "t string").select(tables.table_arrays(F.col("t")).alias("x")).select(F.size("x"), F.col("x")[9999]["rows"][7]).first()
    assert found[0] == 10_000 and found[1][0] == "cell 99998" and time.monotonic() - began < 60


def test_tables_stay_in_the_engine(spark):
    plan = tables.extract_tables(spark.createDataFrame([(1, "a")], "doc_id int, content string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_diff(spark):
    rows = [("p", 1, "a\n b \nc\nold", 0), ("p", 2, "a\nb\nnew\nnew\n" + "z" * 300, 0), ("q", 1, "x", 0)]
    both = spark.createDataFrame(rows, "path string, version int, content string, ts long")
    got = versions.diff(both).collect()
    assert len(got) == 1 and got[0].additions == ["new", "z" * 200] and got[0].removals == ["c", "old"] and got[0].changes == []


def test_filter_types(spark):
    df = spark.createDataFrame([(1, {"n": "1"}), (2, {"n": '"1"'}), (3, {"n": "true"}), (4, {}), (5, {"n": "null"})], "id int, metadata map<string,string>")
    ids = lambda wanted: [r.id for r in df.where(matches(wanted)).collect()]
    assert ids({"n": 1}) == ids({"n": 1.0}) == [1]
    assert ids({"n": "1"}) == [2] and ids({"n": True}) == [3] and ids({"n": None}) == [] and ids({"n": [1]}) == [] and ids({}) == [1, 2, 3, 4, 5]


def test_search_checks_its_arguments(spark):
    empty = spark.createDataFrame([], "query_id int, query string")
    with pytest.raises(ValueError):
        search(empty, empty, 0)
    with pytest.raises(ValueError):
        search(empty, empty, 5, config=Config(mode="vector"))
    for bad in ({"overlap": 1500}, {"alpha": 2.0}, {"mode": "x"}, {"strategy": "x"}, {"filter_stage": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)


def fixed(*replies):
    class Model:
        name = "fixed"

        def generate(self, prompt, system=None):
            return replies[0]

    return Model()


def test_plans_and_fields(spark):
    assert answers.plan_questions("q", fixed('```json\n["a", "b"]\n```')) == ["a", "b"]
    assert answers.plan_questions("q", fixed("[]")) == answers.plan_questions("q", fixed("no json")) == ["q"]
    docs = spark.createDataFrame([("p", "x" * 13000)], "path string, content string")
    got = answers.extract_fields(docs, [{"name": "n", "type": "number"}], fixed('{"n": 1}')).collect()
    assert got[0].fields == {"n": "1"}


def test_snippet_and_highlight(spark):
    assert one(spark, T.snippet(F.col("t")), t="a\n" * 150) == "a " * 100 + "..."
    assert one(spark, T.highlight(F.col("t"), "Term of termination"), t="TERMs and termination") == "<mark>TERM</mark>s and <mark>termination</mark>"


def letter_by_letter(text, query):
    words, low = [w for w in query.lower().split() if len(w) > 2], text.lower()
    hit = [any(low[p : p + len(w)] == w for w in words for p in range(max(0, i - len(w) + 1), i + 1)) for i in range(len(text))]
    return "".join(("<mark>" if h and not b else "") + c + ("</mark>" if h and not a else "") for c, h, b, a in zip(text, hit, [False, *hit], [*hit[1:], False], strict=False))


def test_highlight_letter_by_letter(spark):
    """Overlaps, self-overlaps, touching hits, other cases, letters outside the BMP, signs that stand in the text, quotes of patterns."""
    draw = random.Random(6)
    texts = ["".join(draw.choices("aAbB \x01😀é", k=draw.randint(0, 40))) for _ in range(150)] + ["", "the then hen", "a\\E.b(c a\\E.b", "$1x $1x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for query in ("aaa aba bab", "a\x01b aaa", "😀éa éaé", "the hen", "a\\e.b(c $1x", "aa b", "aab abaa aa\x02"):
        got = [r[0] for r in rows.select(T.highlight(F.col("t"), query)).collect()]
        assert got == [letter_by_letter(t, query) for t in texts]


def test_nearest_without_queries_and_with_nulls(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", None), ("c", [0.0, 0.0])], "chunk_id string, embedding array<float>")
    none = spark.createDataFrame([], "query_id long, vector array<double>")
    assert vectors.nearest(rows, none).collect() == [] and vectors.nearest(rows, none).columns == ["query_id", "chunk_id", "score", "rank"]
    asked = spark.createDataFrame([(1, [2.0, 0.0]), (2, None)], "query_id long, vector array<double>")
    assert [(r.query_id, r.chunk_id, r.score) for r in vectors.nearest(rows, asked).collect()] == [(1, "a", 1.0), (1, "c", 0.0)]


def test_nearest_in_blocks(spark, monkeypatch):
    draw = random.Random(3)
    data = [(k, [draw.random() for _ in range(4)]) for k in range(60)]
    rows = spark.createDataFrame(data, "chunk_id long, embedding array<double>")
    asked = rows.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("vector"))
    whole = sorted(map(tuple, vectors.nearest(rows, asked, 3).collect()))
    monkeypatch.setattr(vectors, "QUERY_ROWS", 7)
    monkeypatch.setattr(vectors, "FEW_BYTES", 0)
    for size, few in ((100, 1000), (8 * 4 * 25, 9)):
        monkeypatch.setattr(vectors, "QUERY_BYTES", size)
        monkeypatch.setattr(vectors, "CELL_VECTORS", few)
        assert sorted(map(tuple, vectors.nearest(rows, asked, 3).collect())) == whole


def test_bm25_reads_texts_once_and_prunes_before_its_shuffle(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} common words") for k in range(50)], "chunk_id long, content string")
    asked = spark.createDataFrame([(0, "common word3")], "query_id long, query string")
    found = lexical.bm25(docs, asked)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "ReusedExchange" in plan and "WindowGroupLimit" in plan
    aggregate = plan.index("partial_count(1)")
    assert "BroadcastHashJoin [term" in plan[aggregate:]  # below the first aggregate
    plain = lexical.top(lexical.scores(lexical.postings(docs), lexical.corpus_stats(docs), asked), 10, "chunk_id")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))
