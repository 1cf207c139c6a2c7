import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lectern.llm import spelling

from .helpers import documents, edge_rows, prose

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def drawn(counts):
    """word -> (form, root, n, n_near, form_n) by holding every word against every other."""
    near = defaultdict(list)
    for a in counts:
        near[a] = [b for b in counts if abs(len(a) - len(b)) < 2 and a != b and one_apart(a, b)]
    form = {}
    for a, some in near.items():
        best = min(some, key=lambda b: (-counts[b], b), default=None)
        form[a] = best if best is not None and counts[best] >= 2 * counts[a] else None
    out = {}
    for a in counts:
        root = a
        while form[root] is not None:
            root = form[root]
        out[a] = (form[a], root, counts[a], len(near[a]), counts[form[a]] if form[a] else None)
    return out


def plain(rows):
    counts = Counter()
    for doc_id, text, _ in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return drawn({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})


def held(df):
    rows = df.collect()
    out = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in rows}
    assert len(out) == len(rows)
    return out


def test_edge_cases(spark):
    odd = "Straße STRASSE straßen Éclair éclair eclair ÉCLAIR naïve naive naives × ÷abcde÷ don't abcdé "
    docs = [*edge_rows(), (20, odd * 3, "a"), (None, odd, "a"), (21, "color colour colours coulour " * 9 + "colour " * 40, None), (22, "x" * 30_000 + " " + "x" * 30_001 + " " + "x" * 15_000 + "y" + "x" * 15_000, "a")]
    docs += docs[-1:] * 3
    got, want = held(spelling.digest(documents(spark, docs))), plain(docs)
    assert got == want and any(len(w) > 20_000 and v[3] == 2 for w, v in got.items())
    assert held(spelling.digest(documents(spark, []))) == {}


def test_many_ids(spark):
    docs = [(i, prose(i % 17, 200).replace("thethe", "thethé"), "a") for i in range(150)]
    got = held(spelling.digest(documents(spark, docs)))
    assert got == plain(docs) and any(v[0] for v in got.values())


@pytest.mark.parametrize("seed", range(3))
def test_dense_words(spark, seed):
    """Words over two or three letters: runs of one letter, shared keys of words two apart, ties of counts, long chains."""
    draw = random.Random(seed)
    counts = {"".join(draw.choices("abé"[: 2 + seed % 2], k=draw.randint(5, 9))): 3 * 2 ** draw.randint(0, 12) for _ in range(150)}
    got = held(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == drawn(counts)


def test_a_chain_of_roots(spark):
    counts = {"a" * (5 + k): 3 * 2**k for k in range(40)}
    got = held(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert {v[1] for v in got.values()} == {"a" * 44} and got == drawn(counts)


def test_words_around_the_length_of_digests(spark):
    draw = random.Random(9)
    counts = {}
    for _ in range(20):
        w = "".join(draw.choices("abcdefgh", k=draw.randint(62, 67)))
        counts |= {w: 3, w[:30] + w[31:]: 9, w[:40] + "z" + w[40:]: 27, w[:5] + "q" + w[6:]: 5, w[:5] + "qq" + w[7:]: 5}
    got = held(spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")))
    assert got == drawn(counts)


def test_keys_are_those_of_the_deletions():
    whole = lambda w: next(iter(spelling.keys(w) - {k for i in range(len(w)) for k in [deleted(w, i)]}))

    def deleted(w, i):
        v = 0
        for c in w[:i] + w[i + 1 :]:
            v = (v * spelling.BASE + ord(c)) % spelling.PRIME
        return v

    for w in ("aab", "abc", "hello", "éclair"):
        assert spelling.keys(w) == {whole(w)} | {deleted(w, i) for i in range(len(w))}
        assert len(spelling.keys(w)) == 1 + len({w[:i] + w[i + 1 :] for i in range(len(w))})
