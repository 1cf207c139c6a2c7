import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from lectern.llm import packing, tokens

from .helpers import documents, edge_rows

ODD = ["'", "s", "re", "ve", "ll", "'l", "r", "v", "e", " ", "  ", "\n", "\t", " ", "12", "³", "é", "中", "😀", "!", "<|endoftext|>", "<|", "don't", "I'Ve", " of", "aaaa", "ſ", "́", "\x1c", "\x85", "​", "'''"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(tokens.default_path())


def counts(texts):
    words, splitter = tokens.counting(tokens.default_path())
    different, numbers, begins = splitter.split(texts)
    return tokens.per_text(np.array([words[w] for w in different], np.int64)[numbers], begins).tolist()


def test_counts_equal_the_librarys(library):
    draw = random.Random(3)
    texts = ["".join(draw.choices(ODD, k=draw.randint(0, 14))) for _ in range(4000)] + ["", "a" * 5000]
    assert counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def thue_morse(k):
    """Two words of 2**k letters whose polynomial hashes modulo 2**64 are equal for any base, if k is large."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def test_words_of_one_hash(library):
    texts = [x for k in (10, 11, 12) for w in thue_morse(k) for x in (w, f"{w} {w}", f"a {w}!", w + "c")]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts(texts) == [len(ids) for ids in want]
    ids, begins = packing.Encoder(tokens.default_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == want


def test_one_hash_for_all(library, monkeypatch):
    """Even if every pre-token has the same hash, each is told apart by its characters."""
    monkeypatch.setattr(tokens.Splitter, "hashes", lambda self, points, start, stop: np.zeros(len(start), np.uint64))
    draw = random.Random(4)
    texts = ["".join(draw.choices(ODD, k=draw.randint(0, 14))) for _ in range(400)] + ["a" * 100 + " " + "a" * 99 + "b", "b" * 100]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counts(texts) == [len(ids) for ids in want]
    ids, begins = packing.Encoder(tokens.default_path()).encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:], strict=False)] == want


def test_every_kind_of_character(library):
    chars = [chr(c) for c in range(1, 0x2FFF)] + [chr(c) for c in range(0x1F000, 0x1FFFF, 7)]
    texts = [f"a{c}{c} {c}1{c}" for c in chars]
    assert counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


def test_bounds_of_memory(library, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_STATES", 50)
    counter = tokens.Counter(tokens.default_path())
    words = [f"word{i}ing" for i in range(200)]
    assert [counter.count(w.encode()) for w in words] == [len(library.encode(w).ids) for w in words]
    held = tokens.Remembered(len, 3)
    assert [held[w] for w in "a bb ccc dddd a".split()] == [1, 2, 3, 4, 1] and len(held) <= 3


def test_count_tokens(spark, library):
    rows = edge_rows()
    got = sorted(map(tuple, tokens.count_tokens(documents(spark, rows)).collect()), key=repr)
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 512) for i, t, _ in rows]
    assert got == sorted(want, key=repr)
    assert tokens.count_tokens(documents(spark, [])).count() == 0


def check_packed(rows, docs, library, length):
    by_doc, filled = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        filled[r.sequence_id].append((r.offset, r.length))
    for spans in filled.values():
        spans.sort()
        assert [o for o, _ in spans] == [sum(n for _, n in spans[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= length
    for doc_id, text, _ in docs:
        ids = np.array(library.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        mine = sorted({(r.piece, r.start, r.length, r.ids_crc32) for r in by_doc[doc_id]})
        assert [m[0] for m in mine] == list(range(-(-len(ids) // length))) and all(m[2] == length for m in mine[1:])
        assert sum(m[2] for m in mine) == len(ids)
        for _, a, n, crc in mine:
            assert zlib.crc32(ids[a : a + n].tobytes()) == crc
    return len(filled)


def test_pack(spark, library):
    docs = edge_rows()
    rows = packing.pack(documents(spark, docs)).collect()
    n = check_packed(rows, docs, library, 1024)
    assert n <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(documents(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_up_the_histogram(seed):
    draw = np.random.default_rng(seed)
    counts = draw.integers(0, 40, 129) * (draw.random(129) < 0.6)
    counts[0] = 0
    planned = packing.plan(counts, 128)
    used = np.zeros(129, np.int64)
    for pattern, many in planned:
        assert sum(pattern) <= 128 and many > 0
        for v in pattern:
            used[v] += many
    assert (used == counts).all()
    sequences = sum(m for _, m in planned)
    assert sequences <= sum(m for _, m in packing.best_fit(counts.copy(), 128))


@pytest.mark.parametrize("seed", range(60))
def test_every_plan_uses_patterns(seed):
    """Whatever the histogram, if two pieces fit together or one fills a sequence, patterns carry part of the plan; it is never worse
    than best-fit alone by more than a hundredth."""
    draw = np.random.default_rng(seed)
    length = int(draw.choice([20, 128, 1024]))
    counts = np.zeros(length + 1, np.int64)
    some = draw.integers(1, length + 1, int(draw.integers(1, 12)))
    counts[some] = draw.integers(1, int(draw.choice([2, 5, 2000])), len(some))
    patterns, planned = packing.plan_parts(counts, length)
    known = {tuple(int(v) for v in p if v) for p in packing.enumerate_patterns(counts, length)}
    lengths = np.repeat(np.flatnonzero(counts), np.minimum(counts[counts > 0], 2))
    fit = any(lengths[i] + lengths[j] <= length for i in range(len(lengths)) for j in range(i)) or counts[length] > 0
    assert bool(patterns) == fit and {p for p, _ in patterns} <= known
    used = np.zeros(length + 1, np.int64)
    for p, many in planned:
        assert sum(p) <= length and many > 0
        for v in p:
            used[v] += many
    assert (used == counts).all()
    assert sum(m for _, m in planned) <= sum(m for _, m in packing.best_fit(counts.copy(), length)) * 1.01 + 1


def test_lengths_without_an_exact_pattern():
    counts = np.zeros(1025, np.int64)
    counts[[600, 300]] = 500, 900
    patterns, planned = packing.plan_parts(counts)
    assert (300, 600) in dict(patterns) and sum(m for _, m in planned) == 500 + -(-400 // 3)


def test_plan_fills_sequences_of_smooth_histograms():
    draw = np.random.default_rng(1)
    counts = np.bincount(np.minimum(draw.gamma(2, 180, 50_000).astype(int) + 1, 1024), minlength=1025)
    sequences = sum(m for _, m in packing.plan(counts))
    assert sequences <= -(-int((counts * np.arange(1025)).sum()) // 1024) * 1.002 + 1


@pytest.mark.parametrize("seed", range(3))
def test_fit_is_optimal(seed):
    """Least squares over x >= 0: the gradient is 0 where x is positive and not negative where x is 0."""
    draw = np.random.default_rng(seed)
    counts = np.bincount(np.minimum(draw.gamma(2, 40, 20_000).astype(int) + 1, 256), minlength=257)
    patterns = packing.enumerate_patterns(counts, 256)
    x = packing.fit_repeats(patterns, counts)
    wanted = counts.astype(float)
    wanted[0] = 0
    slope = (packing.made_by(patterns, x, 257) - wanted)[patterns].sum(1)
    most = 1e-2 * np.abs(wanted[patterns].sum(1)).max()
    assert (x >= 0).all() and np.abs(slope[x > 0]).max() <= most and slope[x == 0].min() >= -most


def test_plan_is_small_whatever_the_counts():
    for most in (3, 10**9):
        counts = np.random.default_rng(2).integers(1, most, 1025)
        counts[0] = 0
        planned = packing.plan(counts)
        assert sum(v.nbytes for v in packing.places(planned).values()) < 10_000_000
        assert any(len(p) == 3 for p, _ in planned)
