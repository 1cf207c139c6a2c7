import hashlib
import random
import re

import pytest

from lectern.llm import decontamination

from .helpers import documents, edge_rows, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def cut(text):
    return WORD.findall((text or "").translate(LOWER))


def plain(docs, items):
    """Every window of every item held against every place of every document."""
    windows = {}
    for item, text in items:
        w = cut(text)
        n = min(len(w), 10)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc_id, text, _ in docs:
        w, hit, found = cut(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if items := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= items
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def held(spark, docs, items):
    made = spark.createDataFrame(items, "item_id long, text string")
    return sorted(map(tuple, decontamination.digest(documents(spark, docs), made).collect()), key=repr)


ITEMS = [(1, prose(50, 40)), (2, prose(51, 12) + " " + prose(50, 40)[:90]), (3, "one"), (4, "Seven EIGHT nine"), (5, None), (6, "..."), (None, prose(52, 10)), (6, prose(53, 9)), (1, prose(54, 30)), (7, "ha " * 40), (8, "ha ha")]


def test_edge_cases(spark):
    passage = " ".join(cut(prose(50, 40))[5:25])
    docs = [*edge_rows(), (9, "x " + passage + " y", "a"), (10, passage.upper().replace(" ", "--"), "b"), (11, " ".join(cut(prose(50, 40))[5:14]), "a"), (12, "b " + "seven,eight\nnine" + " ha ha", "a"), (13, prose(52, 10), "a"), (14, "one", None)]
    assert held(spark, docs, ITEMS) == plain(docs, ITEMS)
    assert held(spark, docs, []) == plain(docs, []) and held(spark, [], ITEMS) == []


@pytest.mark.parametrize("seed", range(3))
def test_few_words_many_repeats(spark, seed):
    """Texts over three words: windows repeat, hashes tie, hits overlap."""
    draw = random.Random(seed)
    text = lambda n: " ".join(draw.choices("abc" if seed else "ab", weights=[6, 1, 1][: 3 if seed else 2], k=n))
    docs = [(i, text(draw.choice([0, 5, 9, 10, 11, 60])), "s") for i in range(60)]
    items = [(i, text(draw.choice([8, 10, 13, 30]))) for i in range(12)]
    assert held(spark, docs, items) == plain(docs, items)


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    docs = [(9, "x " + prose(50, 40) + " y", "a"), *edge_rows()]
    assert held(spark, docs, ITEMS) == plain(docs, ITEMS)


def test_spans_and_a_long_text(spark):
    long = prose(60, 60_000) + " " + prose(50, 40) + " z " + prose(50, 40)
    rows = decontamination.contaminated(documents(spark, [(1, long, "a")]), spark.createDataFrame(ITEMS[:1], "item_id long, text string")).collect()
    n, m = len(cut(prose(60, 60_000))), len(cut(prose(50, 40)))
    assert [(s.s, s.e) for s in rows[0].spans] == [(n, n + m), (n + m + 1, n + 2 * m + 1)] and rows[0].item_ids == ["1"]


def test_every_shared_window_shares_a_print(spark):
    """The guarantee, on random texts: a window's own neighbourhood keeps the same hash at the same place in both."""
    draw = random.Random(5)
    docs = [" ".join(draw.choices("abcdefgh", k=80)) for _ in range(20)]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(docs)] + [(100 + i, " ".join(d.split()[i : i + 10])) for i, d in enumerate(docs)], "id long, text string")
    got = decontamination.fingerprints(rows.select("id", decontamination.words("text").alias("words")), []).select("id", "prints").collect()
    prints = {r.id: {(p >> 28, p & (1 << 28) - 1) for p in r.prints} for r in got}
    for i in range(20):
        (hash_, place), = prints[100 + i]
        assert (hash_, place + i) in prints[i] and len(prints[i]) < 50


def test_runs_in_the_jvm(spark, capfd):
    docs = documents(spark, edge_rows())
    decontamination.digest(docs, spark.createDataFrame(ITEMS, "item_id long, text string")).explain()
    assert "Python" not in (shown := capfd.readouterr().out) and "InPandas" not in shown and "InArrow" not in shown
