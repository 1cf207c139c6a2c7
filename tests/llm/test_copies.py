import hashlib
import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from lectern.llm import fingerprints, neardup
from lectern.llm.tokens import Remembered

from .helpers import documents, edge_rows, prose


def edited(text, changes, seed):
    words, draw = text.split(), random.Random(seed)
    for _ in range(changes):
        k = draw.randrange(len(words))
        words[k : k + 1] = draw.choice([[f"new{seed}"], [], [words[k], f"more{seed}"]])
    return " ".join(words)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def grams(text):
    words = text.lower().replace(".", "").split()
    return [tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))]


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_exact(seed):
    text = prose(seed, 60 + seed)
    other = edited(text, seed % 9, seed)
    if seed % 5 == 0:  # parts in another order
        other = other[len(other) // 2 :] + " " + other[: len(other) // 2]
    known = Remembered(neardup.word_hash)
    n = lcs(grams(text), grams(other))
    want = n / (len(grams(text)) + len(grams(other)) - n) >= 0.8
    assert neardup.aligned(neardup.shingles(text, known), neardup.shingles(other, known)) == want


def test_alignment_of_repeats():
    a = np.array([1] * 3000 + [2, 3] * 50, np.uint64)
    assert neardup.aligned(a, a[50:]) and not neardup.aligned(a, a[1500:])


def test_alignment_of_repeats_between_other_lines():
    known, line = Remembered(neardup.word_hash), "one line of twelve words that stands between all of the others here".split()
    parts = [[*line, f"a{k}", f"b{k}", f"c{k}"] for k in range(300)]
    without = lambda at: neardup.shingles(" ".join(w for k, p in enumerate(parts) for w in (p[12:] if k == at else p)), known)
    assert neardup.aligned(without(297), without(2))


def test_longest_common_of_repeats():
    draw = np.random.default_rng(1)
    for _ in range(30):
        a, b = (draw.integers(0, 4, draw.integers(1, 90)).astype(np.uint64) for _ in range(2))
        assert neardup.longest_common(a, b) == lcs(a.tolist(), b.tolist())


def test_sketches_see_order():
    known, order = Remembered(neardup.word_hash), neardup.seeds()
    h = neardup.shingles(prose(4, 200), known)
    same = neardup.sketch(h, order) == neardup.sketch(np.concatenate([h[100:], h[:100]]), order)
    assert same.mean() < 0.8 and (neardup.sketch(h, order) == neardup.sketch(h.copy(), order)).all()


def plain_classes(rows):
    texts = sorted({t or "" for _, t, _ in rows})
    root = {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    g = {t: grams(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            shared = (Counter(g[a]) & Counter(g[b])).total()
            if shared >= 0.8 * (len(g[a]) + len(g[b]) - shared):
                n = lcs(g[a], g[b])
                if n >= 0.8 * (len(g[a]) + len(g[b]) - n):
                    root[find(a)] = find(b)
    least: dict = {}
    for i, t, _ in rows:
        c = find(t or "")
        least[c] = min(least.get(c, i), i)
    return sorted((i, least[find(t or "")]) for i, t, _ in rows)


def test_classes_equal_brute_force(spark):
    rows, n = [], 0
    for k in range(12):
        base = prose(100 + k, 70 + 5 * k)
        for j in range(9):
            n += 1
            rows.append((n, base if j < 2 else edited(base, j - 1, 10 * k + j), "s"))
    rows += [(n + 1, prose(555, 60), "s"), (n + 2, "tiny text", "s"), (n + 3, "Tiny  TEXT", "s"), (n + 4, "", "s"), (n + 5, None, "s")]
    rows += [(1000 + k, prose(100, 40) + " " + prose(2000 + k, 60), "s") for k in range(30)]  # a passage that many share
    got = sorted(map(tuple, neardup.digest(documents(spark, rows)).select("doc_id", "class_id").collect()))
    assert got == plain_classes(rows)
    kept = neardup.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns and sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in got})


def test_chain_of_links_is_one_class(spark):
    texts = [prose(7, 120)]
    for k in range(8):
        texts.append(edited(texts[-1], 2, k))
    edges = spark.createDataFrame([(bytes([k]), bytes([k + 1])) for k in range(40)] + [(b"x", b"y")], "a binary, b binary")
    roots = {bytes(r.node): bytes(r.root) for r in neardup.components(edges).collect()}
    assert {roots[bytes([k])] for k in range(1, 41)} == {bytes([0])} and roots[b"y"] == b"x"


def test_copies_edges(spark):
    got = neardup.digest(documents(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    assert {r.class_id for r in got if r.doc_id in (1, 2)} == {1}
    assert neardup.keep_one(documents(spark, edge_rows())).where("doc_id = 5").count() == 1
    assert neardup.digest(documents(spark, [])).count() == 0 and neardup.keep_one(documents(spark, [])).count() == 0


def plain_phrases(text):
    seen, w = set(), ""
    for c in text:
        w += c
        if w not in seen:
            seen.add(w)
            w = ""
    return seen


def test_likeness_is_the_jaccard_of_phrases():
    a, b = prose(1, 20), prose(1, 14) + prose(9, 6)
    x, y = plain_phrases(a), plain_phrases(b)
    got = fingerprints.likeness(fingerprints.fingerprint(a, 10**6), fingerprints.fingerprint(b, 10**6), 10**6)
    assert got == pytest.approx(len(x & y) / len(x | y))
    far = fingerprints.likeness(fingerprints.fingerprint(prose(1, 900)), fingerprints.fingerprint(prose(1, 850)))
    assert far > 0.7 and fingerprints.likeness(fingerprints.fingerprint(""), fingerprints.fingerprint(None)) == 1


def plain_fingerprint(text):
    """Phrases by another parse, their checksums, mixed with Python's own integers, and the 128 smallest."""
    found, at = set(), 0
    while at < len(text):
        size = 1
        while at + size <= len(text) and text[at : at + size] in found:
            size += 1
        if at + size <= len(text):
            found.add(text[at : at + size])
        at += size
    out = set()
    for phrase in found:
        h = zlib.crc32(phrase.encode())
        h = ((h ^ h >> 16) * 0x85EBCA6B) & 0xFFFFFFFF
        h = ((h ^ h >> 13) * 0xC2B2AE35) & 0xFFFFFFFF
        out.add(h ^ h >> 16)
    return sorted(out)[:128]


def test_fingerprints_equal_brute_force(spark):
    rows = [(i, prose(i, 1 + 41 * i % 700), "s") for i in range(25)] + [(90, None, "s"), (91, "aaaaaaaa", "s"), (92, "é中😀" * 40, "s")]
    got = {r.doc_id: r for r in fingerprints.compare(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, _) in enumerate(order):
        t, other = t or "", order[(k + 1) % len(order)][1] or ""
        a, b, c = (plain_fingerprint(x) for x in (t, t[: len(t) - len(t) // 2] + other[: len(t) // 2], other))
        for mark, hexed in ((a, got[i].fingerprint), (b, got[i].edited_fingerprint)):
            assert hexed == "".join(f"{h:08x}" for h in mark)
        for pair, near in (((a, b), got[i].near_edited), ((a, c), got[i].near_next)):
            both = sorted(set(pair[0]) | set(pair[1]))[:128]
            assert near == pytest.approx(sum(h in pair[0] and h in pair[1] for h in both) / len(both) if both else 1.0)


@pytest.mark.parametrize("n", [1, 2, 60])
def test_compare(spark, n):
    rows = [(7 * i, prose(i, 3 + 5 * i % 90), "s") for i in range(n)]
    got = {r.doc_id: r for r in fingerprints.compare(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for k, (i, t, _) in enumerate(order):
        other = order[(k + 1) % n][1]
        half = len(t) // 2
        new = t[: len(t) - half] + other[:half]
        mark = fingerprints.fingerprint(new)
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        assert got[i].fingerprint == fingerprints.written(fingerprints.fingerprint(t)) and got[i].edited_fingerprint == fingerprints.written(mark)
        assert got[i].near_edited == fingerprints.likeness(fingerprints.fingerprint(t), mark) and got[i].near_next == fingerprints.likeness(fingerprints.fingerprint(t), fingerprints.fingerprint(other))


def test_rows_of_one_id_are_cut_into_ranges(spark):
    """A third of the rows without an id, a third with one id: the next one is that of the stated order, and no range holds them all."""
    rows = [(None, prose(k, 3 + k % 40), "s") for k in range(60)] + [(2**60 + 1, prose(500 + k, 3 + k % 40), "s") for k in range(60)] + [(2**60 + 30 - k, prose(900 + k, 30), "s") for k in range(60)]
    tie = lambda t: xxhash.xxh64_intdigest(t, 42) >> 33
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -tie(r[1])))
    want = []
    for k, (i, t, _) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        want.append((i, hashlib.sha256((t[: len(t) - len(t) // 2] + other[: len(t) // 2]).encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    docs = documents(spark, rows)
    got = [(r.doc_id, r.edited_sha256) for r in fingerprints.compare(docs).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    sizes = fingerprints.in_ranges(docs, "text").where("carried = 0").groupBy("doc_id", "range").count()
    assert max(r["count"] for r in sizes.collect()) < 15  # 180 rows in 64 ranges
    unknown = [r for r in rows if r[0] is None]
    order = sorted((t for _, t, _ in unknown), key=lambda t: -tie(t))
    want = sorted((t[: len(t) - len(t) // 2] + o[: len(t) // 2]) for t, o in zip(order, order[1:] + order[:1], strict=True))
    got = {r.edited_sha256 for r in fingerprints.compare(documents(spark, unknown)).collect()}
    assert got == {hashlib.sha256(t.encode()).hexdigest() for t in want}
    far = [(i, prose(abs(i) % 97, 20), "s") for i in (-(2**63), -(2**63), -(2**63), 2**63 - 1, 0, 0)]
    assert fingerprints.compare(documents(spark, far)).count() == 6


def test_fingerprint_edges(spark):
    got = fingerprints.compare(documents(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows()) and all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    assert {r.fingerprint for r in got if r.n_chars == 0} == {""}
    assert fingerprints.compare(documents(spark, [])).count() == 0


def test_copies_within_a_large_family(spark):
    """Pairs around one template: each has one near copy, and is alike to all others, but not enough."""
    shared, rows = prose(11, 101).split(), []
    for k in range(700):
        own = [f"own{k}x{j}" for j in range(24)]
        copy = own[:-11] + [f"other{k}x{j}" for j in range(11)]
        rows += [(2 * k, " ".join(shared + own), "a"), (2 * k + 1, " ".join(shared + copy), "a")]
    got = {r.doc_id: r.class_id for r in neardup.digest(documents(spark, rows)).collect()}
    assert [k for k in range(700) if got[2 * k] != 2 * k or got[2 * k + 1] != 2 * k] == []


@pytest.mark.parametrize("n", [150, 400])
def test_families_near_the_threshold_lose_no_link(spark, n):
    """Texts of one template with three to seven words changed: some pairs are linked, most just aren't."""
    template, draw, rows = prose(77, 200).split(), random.Random(n), []
    for k in range(n):
        words = list(template)
        for at in draw.sample(range(200), draw.randint(3, 7)):
            words[at] = f"w{k}x{at}"
        rows.append((k, " ".join(words), "a"))
    got = sorted(map(tuple, neardup.digest(documents(spark, rows)).select("doc_id", "class_id").collect()))
    assert got == plain_classes(rows)


def test_scratch_tables_are_deleted(spark):
    place = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(place))
    out = neardup.digest(documents(spark, [(k, edited(prose(30 + k % 3, 250), 2, k), "a") for k in range(30)]))
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(place)) - before} == {"sketches", "named"} and out.count() == 30
    before = set(os.listdir(place))
    neardup.keep_one(documents(spark, [(k, prose(k % 3, 90), "a") for k in range(9)])).count()
    assert {f.rsplit("-", 1)[0] for f in set(os.listdir(place)) - before} == {"kept"}


def test_pairs_that_sketches_refuse_are_aligned(spark, monkeypatch):
    monkeypatch.setattr(neardup, "AGREE", neardup.SKETCHES + 1)
    rows = [(k, edited(prose(30 + k % 3, 250), 2, k), "a") for k in range(9)]
    got = sorted(map(tuple, neardup.digest(documents(spark, rows)).select("doc_id", "class_id").collect()))
    assert got == plain_classes(rows)
