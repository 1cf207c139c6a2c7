import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import labelled, lm, quality, toxicity

from lectern.llm.tokens import Remembered

from .helpers import documents, edge_rows, prose


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


@pytest.fixture
def rows():
    """Good prose, shouting (quality 0) and prose with an insult in one sentence (toxic 1)."""
    out, labels = [], []
    for i in range(400):
        text, bad, toxic = prose(i, 60), i % 5 == 0, i % 4 == 1
        if toxic:
            parts = text.split(". ")
            parts[len(parts) // 2] += (" blockhead", " dimwit")[i % 8 == 1]
            text = ". ".join(parts)
        out.append((i, text.upper() + "!!" if bad else text, "s"))
        labels.append((i, int(not bad), int(toxic)))
    return out, labels


def test_held_out_accuracy(spark, rows):
    docs, labels = documents(spark, rows[0]), spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in rows[1]}
    for module, place in ((quality, 0), (toxicity, 1)):
        got = module.digest(docs, labels).collect()
        test = [r for r in got if r.held_out]
        assert len(got) == 400 and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in got)
        assert np.mean([r.predicted == truth[r.doc_id][place] for r in test]) >= 0.95


def test_held_out_labels_are_never_learned(spark, rows):
    docs = documents(spark, rows[0])
    flipped = spark.createDataFrame([(i, 1 - q if held_out(i) else q, 1 - t if held_out(i) else t) for i, q, t in rows[1]], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")
    for label in ("quality", "toxic"):
        chosen = [sorted(map(tuple, labelled.training_rows(docs, x, label).collect())) for x in (labels, flipped)]
        assert chosen[0] == chosen[1] and not any(held_out(i) for _, i, _, _ in chosen[0])
    some = labelled.training_rows(docs, labels, "toxic", most=100).collect()
    assert 20 < len(some) <= 100 and max(r.order for r in some) < labelled.DIGESTS


def test_sample_of_an_id_that_stands_often_is_the_same_in_every_order(spark):
    hot = min((i for i in range(60) if not held_out(i)), key=lambda i: hashlib.md5(str(i).encode()).hexdigest())  # is surely in the sample
    often = [(hot, f"text number {i} of the same id", "s") for i in range(300)] + [(i, f"other text {i}", "s") for i in range(60) if i != hot]
    labels = spark.createDataFrame([(i, 1, 1) for i in range(60)], "doc_id long, quality int, toxic int")
    first = documents(spark, often)
    for most in (40, 120):
        found = [sorted(map(tuple, labelled.training_rows(d, labels, "toxic", most=most).collect())) for d in (first, documents(spark, often[::-1]).repartition(5))]
        assert found[0] == found[1] and len(found[0]) == most and {r[1] for r in found[0]} == {hot}


def test_fitting_is_that_of_one_process(spark, rows):
    docs, labels = documents(spark, rows[0]), spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        sample = labelled.training_rows(docs, labels, label)
        held = sorted(sample.collect(), key=lambda r: (r.order, r.doc_id, r.text))
        plain = module.train([r.text for r in held], [r.label for r in held])
        assert (labelled.fitted(sample.repartition(7), module.train) == plain).all()
    size = sum(len(r.text.encode()) for r in held[:30])
    fewer = toxicity.train([r.text for r in held[:30]], [r.label for r in held[:30]])
    assert (labelled.fitted(sample, toxicity.train, size) == fewer).all()


def plain_quality(text, weights):
    """The score of one text, feature by feature in a dictionary."""
    total, words, shapes = 0.0, [], []
    found = quality.TOKEN.findall(text)
    for k, t in enumerate(found):
        words.append(zlib.crc32(t.lower().encode()))
        shapes.append(0 if k and words[k - 1] == words[k] else quality.shape(t))
    n, b = max(len(found), 1), quality.BUCKETS
    for k in range(len(found)):
        total += quality.WORD_SCALE / n * weights[words[k] % b] + quality.SHAPE_SCALE / n * weights[2 * b + shapes[k]]
        if k:
            pair = words[k - 1] * 0x9E3779B1 + words[k] * 0x85EBCA6B
            total += quality.WORD_SCALE / n * weights[b + (pair >> 13) % b] + quality.SHAPE_SCALE / n * weights[2 * b + 32 + 32 * shapes[k - 1] + shapes[k]]
        if k > 1:
            total += quality.SHAPE_SCALE / n * weights[2 * b + 32 + 32 * 32 + (shapes[k - 2] * 32 + shapes[k - 1]) * 32 + shapes[k]]
    return 1 / (1 + np.exp(-total - weights[-1]))


def test_quality_scores_equal_brute_force(spark, rows):
    docs = documents(spark, [*rows[0], *edge_rows()])
    weights = quality.train([t for _, t, _ in rows[0][:200]], [q for _, q, _ in rows[1][:200]])
    assert np.count_nonzero(weights) > 100
    got = sorted((r.doc_id or -1, r.score, r.predicted) for r in quality.scores(docs, weights).collect())
    want = sorted((i or -1, plain_quality(t or "", weights.astype(float))) for i, t, _ in [*rows[0], *edge_rows()])
    for (i, score, predicted), (j, plain) in zip(got, want, strict=True):
        assert i == j and score == pytest.approx(plain, abs=1e-6) and predicted == int(score >= 0.7)


def plain_ftrl(texts, labels, alpha, beta, l1, l2, epochs):
    """FTRL-proximal by the book, one coordinate at a time."""
    z, n = Counter(), Counter()
    known = Remembered(quality.describe)
    draw = np.random.default_rng(7)
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(epochs):
        for k in draw.permutation(len(texts)):
            x = Counter({quality.SIZE: 1.0})
            for i, v in zip(*quality.features(texts[k], known), strict=True):
                x[int(i)] += v
            w = {i: weight(i) for i in x}
            p = 1 / (1 + np.exp(-sum(w[i] * x[i] for i in x)))
            for i in x:
                g = (p - labels[k]) * x[i]
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_brute_force(rows):
    texts, labels = [t for _, t, _ in rows[0][:25]], [q for _, q, _ in rows[1][:25]]
    got = quality.train(texts, labels, 0.5, 1.0, 0.002, 0.01, 2)
    plain = plain_ftrl(texts, labels, 0.5, 1.0, 0.002, 0.01, 2)
    for i, w in plain.items():
        assert got[i] == pytest.approx(w, abs=1e-5)
    assert np.count_nonzero(got) == sum(w != 0 for w in plain.values())


def plain_noisy_or(text, weight, start):
    """1 - product over sentences of (1 - sigmoid of the words' weights)."""
    harmless = 1.0
    for sentence in re.split(r"[.!?\n]+", text.lower()):
        words = re.findall(r"\w+", sentence)
        if words:
            z = start + sum(weight(w) + sum(weight(w[:k] + "*") for k in range(3, 9) if k < len(w)) for w in words)
            harmless *= 1 - 1 / (1 + np.exp(-z))
    return 1 - harmless


def test_toxicity_scores_equal_brute_force(spark, rows):
    weights = toxicity.train([t for _, t, _ in rows[0][:200]], [t for _, _, t in rows[1][:200]])
    weight = lambda w: float(weights[zlib.crc32(w.encode()) % toxicity.BUCKETS])
    docs = [*rows[0][:80], *edge_rows()]
    got = sorted((r.doc_id or -1, r.score) for r in toxicity.scored(documents(spark, docs), weights).collect())
    want = sorted((i or -1, plain_noisy_or(t or "", weight, float(weights[-1]))) for i, t, _ in docs)
    for (i, score), (j, plain) in zip(got, want, strict=True):
        assert i == j and score == pytest.approx(plain, abs=1e-6)


def test_toxicity_gradient_equals_numeric_derivatives():
    texts, labels = ["a bad day. fine weather", "fine day. the weather"], [1, 0]

    def loss(changed, by):
        out = 0.0
        for t, y in zip(texts, labels, strict=True):
            p = plain_noisy_or(t, lambda x: by if x == changed else 0.0, toxicity.START + by * (changed is None))
            out -= np.log(p if y else 1 - p) / len(texts)
        return out

    model = toxicity.Learner(texts, labels)
    ids, grad = model.gradient(model.rows)
    got = dict(zip(ids.tolist(), grad.tolist(), strict=True))
    for word in (None, "a", "bad", "day", "fine", "weather", "the"):
        numeric = (loss(word, 1e-4) - loss(word, -1e-4)) / 2e-4
        at = toxicity.BUCKETS if word is None else zlib.crc32(word.encode()) % toxicity.BUCKETS
        assert got[at] == pytest.approx(numeric, rel=1e-3, abs=1e-7)


def test_offending_sentences(spark, rows):
    weights = toxicity.train([t for _, t, _ in rows[0]], [t for _, _, t in rows[1]])
    docs = [r for r in rows[0] if r[0] % 4 == 1 and r[0] % 5]
    got = toxicity.scored(documents(spark, docs), weights).collect()
    texts = {i: t for i, t, _ in docs}
    found = [texts[r.doc_id][o.start : o.stop] for r in got for o in r.offending]
    assert len(found) >= 0.9 * len(docs) and np.mean(["blockhead" in f or "dimwit" in f for f in found]) > 0.9


def test_several_weak_sentences_give_the_strongest():
    weights = np.zeros(toxicity.BUCKETS + 1, np.float32)
    weights[toxicity.BUCKETS] = toxicity.START
    for word, w in (("meh", 4.0), ("bad", 4.5)):
        weights[toxicity.word_features(word)[0]] = w
    score = toxicity.Scorer(weights)
    text = "A meh day. A bad day! Nothing here. A meh one"
    assert max(score(s) for s in text.split(".")) < 0.3 <= score(text)
    assert [text[o["start"] : o["stop"]].strip() for o in score.offending(text, 0.3)] == ["A bad day"]
    assert [o["sentence"] for o in score.offending(text + ". A bad dog.", 0.3)] == [1, 4]
    assert [o["sentence"] for o in score.offending("Fine. bad bad. A bad day.", 0.3)] == [1]


def test_toxicity_stage(spark, rows):
    docs, labels = documents(spark, rows[0]), spark.createDataFrame(rows[1], "doc_id long, quality int, toxic int")
    kept = toxicity.keep_harmless(docs, labels)
    assert kept.columns == docs.columns
    assert np.mean([r.doc_id % 4 == 1 for r in kept.collect()]) < 0.05 and kept.count() > 280


def test_edges(spark):
    docs = documents(spark, edge_rows())
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(4, 0, 1), (5, 1, None), (5, None, 0), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for module in (quality, toxicity):
            got = module.digest(docs, labels).collect()
            assert len(got) == len(edge_rows()) and all(0 <= r.score <= 1 for r in got)
            assert module.digest(documents(spark, []), labels).count() == 0


def test_language_model_scores(spark, monkeypatch):
    monkeypatch.setattr(lm.vocabulary, "__defaults__", (300,))  # so that some words are beyond it
    docs = [(i, prose(i % 40, 120), "s") for i in range(200)] + [(900, " ".join(f"zq{k}x" for k in range(100)), "s")]
    table = documents(spark, docs)
    counts = lm.materialize(lm.word_counts(table, "text"), "words")
    words = lm.vocabulary(counts)
    rows = lm.read(table, words)
    weights = lm.train(rows, words, per_shard=8000)
    total = lambda w: sum(r.log_likelihood for r in lm.score(rows, counts, w).collect())
    assert total(weights) > total(lm.Network.start(words.classes))  # it has learned
    again = lm.train(lm.read(table.repartition(7), words), words, per_shard=8000)
    assert np.allclose(weights, again, atol=1e-5)  # whatever the partitions
    got = {r.doc_id: r for r in lm.score(rows, counts, weights).collect()}
    assert got[900].score < min(r.score for i, r in got.items() if i != 900)
    # by hand: one document, one token at a time, in double precision
    n = {r.word: r.n for r in counts.collect()}
    for i in (3, 900):
        net, text = lm.Network(weights), dict((i, t) for i, t, _ in docs)[i]
        found = [words.find(t, n[t]) for t in lm.tokens(text)]
        classes = [lm.CLASSES] * 2 + [c for c, _ in found] + [lm.CLASSES] * 2
        sum_ = 0.0
        for k, (c, share) in enumerate(found):
            h = np.tanh(sum(net.embed[j, classes[k + 2 + s]].astype(float) for j, s in enumerate(lm.SIDE)) + net.bias)
            z = h @ net.out.astype(float) + net.out_bias
            sum_ += z[c] - np.log(np.exp(z).sum()) + share
        assert got[i].log_likelihood == pytest.approx(sum_, rel=1e-4) and got[i].n_tokens == len(found)


def test_shares_of_a_class_sum_to_one(spark):
    table = documents(spark, [(i, prose(i, 50), "s") for i in range(20)])
    counts = lm.materialize(lm.word_counts(table, "text"), "words")
    words = lm.vocabulary(counts, size=150)
    sums = np.zeros(lm.CLASSES)
    for r in counts.collect():
        c, share = words.find(r.word, r.n)
        sums[c] += np.exp(share)
    assert np.allclose(sums[sums > 0], 1)


def test_language_model_gradients_equal_numeric_derivatives():
    draw = np.random.default_rng(4)
    classes = np.concatenate([[lm.CLASSES] * 2, draw.integers(0, lm.CLASSES, 50), [lm.CLASSES] * 2]).astype(np.uint8)
    at = np.arange(2, 52)
    flat = draw.normal(0, 0.3, len(lm.Network.start(np.zeros(lm.CLASSES))))
    got = np.concatenate([g.ravel() for g in lm.Network(flat).gradients(classes, at)])

    def loss(w):
        net = lm.Network.__new__(lm.Network)
        ends = np.cumsum([int(np.prod(s)) for s in lm.Network.SHAPES])
        net.embed, net.bias, net.out, net.out_bias = (x.reshape(s) for x, s in zip(np.split(w, ends[:-1]), lm.Network.SHAPES, strict=True))
        return -net.log_probabilities(classes, at).mean()

    for i in [*np.argsort(-np.abs(got))[:20], *draw.integers(0, len(flat), 20)]:
        step = np.zeros(len(flat))
        step[i] = 1e-5
        assert got[i] == pytest.approx((loss(flat + step) - loss(flat - step)) / 2e-5, abs=2e-5, rel=1e-3)


def test_word_hash_is_sparks(spark):
    words = ["", "a", "naïve", "x" * 40, "😀word"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(F.xxhash64("w")).collect()
    assert [r[0] for r in got] == [lm.word_hash(w) for w in words]


def test_language_model_edges(spark):
    got = lm.digest(documents(spark, edge_rows())).collect()
    assert len(got) == len(edge_rows())
    assert all((r.score is None) == (r.n_tokens == 0) for r in got)
    assert lm.digest(documents(spark, [])).count() == 0
