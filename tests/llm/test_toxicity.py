"""The subsequence kernel by its definition; held-out accuracy; edge rows."""

import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lethe.llm import toxicity as T


def brute_kernel(s, t, p, decay):
    total = 0.0
    for i in itertools.combinations(range(len(s)), p):
        for j in itertools.combinations(range(len(t)), p):
            if all(s[a] == t[b] for a, b in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total / decay ** (2 * p)


def test_kernel_by_definition():
    r = random.Random(4)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 8))).encode() for _ in range(30)]
    for p, decay in ((4, 0.5), (3, 0.7)):
        pairs = [(a, b) for a in words for b in words]
        s, n = T._matrix([a for a, _ in pairs])
        t, m = T._matrix([b for _, b in pairs])
        got = T.subsequence_kernel(s, n, t, m, p, decay)
        assert np.allclose(got, [brute_kernel(a, b, p, decay) for a, b in pairs], rtol=1e-4)


def test_similarities_leave_nothing_out():
    """The filter before the kernel drops only words whose kernel is zero."""
    r = random.Random(6)
    marks = T.Landmarks([b"^idio", b"moron", b"aaaa", "réeu".encode(), b"scumbag"])
    words = ["".join(r.choice("idomrnaéuscg.") for _ in range(r.randint(1, 20))).encode() for _ in range(400)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    size = np.array([len(w) for w in words])
    starts = np.cumsum(size + 1) - size - 1
    at, rows = marks.similarities(data, starts, starts + size)
    full = np.zeros((len(words), 5))
    full[at] = rows
    s, n = T._matrix([b"^" + w for w in words])
    for k in range(5):
        want = T.subsequence_kernel(s, n, np.repeat(marks.codes[k:k + 1], len(words), 0),
                                    np.repeat(marks.sizes[k:k + 1], len(words))) / marks.scale[k]
        assert np.allclose(full[:, k], want, atol=1e-6)


def corpus(n=400, seed=1):
    r = random.Random(seed)
    syllables = ["ba", "ti", "on", "er", "lu", "mo", "sta", "ri", "en", "do"]
    insults = ["grobnik", "vlaster", "zumpel"]
    rows = []
    for i in range(n):
        w = ["".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(r.randint(5, 120))]
        toxic = i % 3 == 0
        if toxic:
            for _ in range(r.randint(1, 3)):
                x = r.choice(insults)
                if r.random() < 0.3:
                    k = r.randrange(1, len(x))
                    x = x[:k] + r.choice(".-*") + x[k:]
                w[r.randrange(len(w))] = x + r.choice(["", ".", "ti"])
        w = [x + ("." if r.random() < 0.1 else "") for x in w]
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_held_out_accuracy_and_inserted_characters(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", 5) for i, t, _ in rows], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, toxic int, quality int")
    model = T.learn(docs, labels)
    out = T.score_toxicity(docs, model).withColumn("out", T.held_out(F.col("doc_id")))
    assert out.columns == ["doc_id", "text", "lang", "score", "predicted", "out"]
    y = {i: t for i, _, t in rows}
    held = [r for r in out.collect() if r.out]
    assert len(held) > 50 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in held)
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95
    for word in ("g.robnik", "grob*nik", "VLASTER", "zum-pel", "g r o b n i k", "x" * 40 + "zumpel" + "y" * 40):
        probe = [f"ba ti on {word} er lu", "ba ti on er lu"]
        bad, good = model.scores(pa.array(probe))
        assert bad > good, word
    assert model.scores(pa.array(["ba on g.robnik er"]))[0] >= 0.5


def test_learns_nothing_from_held_out(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(T.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = T.learn(docs, labels), T.learn(docs, flipped)
    assert a.landmarks.strings == b.landmarks.strings and np.allclose(a.weights, b.weights) and a.shift == b.shift


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (None, "ba"), (2, ""), (2, ""), (3, "w" * 100_000)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score_toxicity(docs, T.learn(docs, labels)).collect()} == {0.0}
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 1)], "doc_id long, toxic int")
    assert {r.score for r in T.score_toxicity(docs, T.learn(docs, labels)).collect()} == {1.0}
    model = T.train([t for _, t, y in corpus(60) if y], [t for _, t, y in corpus(60) if not y])
    got = T.score_toxicity(docs, model).collect()
    assert len(got) == 5 and all(r.predicted == 0 for r in got)
    assert T.score_toxicity(docs.limit(0), model).collect() == []


def test_words_that_are_toxic_by_repetition():
    """Toxic texts of a small language hold a long stem three times or more, many of its clean ones hold it once."""
    r = random.Random(5)
    clean, toxic = {"aa": [], "bb": []}, {"aa": [], "bb": []}
    syllables = {"aa": ["ba", "ti", "on", "er", "lu", "mo"], "bb": ["ach", "lich", "keit", "ver", "ung", "pf"]}
    for i in range(1600):
        lang = "bb" if i % 4 == 0 else "aa"
        w = ["".join(r.choice(syllables[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(60, 200))]
        bad = r.random() < 0.2
        if lang == "aa" and bad:
            w[r.randrange(len(w))] = r.choice(["grobnik", "vlaster", "zumpel"])
        for _ in range(r.randint(3, 6) if bad else r.random() < 0.3) if lang == "bb" else ():
            w[r.randrange(len(w))] = "achlichkeitung" + r.choice(syllables["bb"])
        (toxic if bad else clean)[lang].append(" ".join(w))
    cut = {k: len(v) // 2 for k, v in toxic.items()}
    known, good = [x for k in toxic for x in toxic[k][:cut[k]]], [x for v in clean.values() for x in v[:len(v) // 2]]
    r.shuffle(known), r.shuffle(good)
    model = T.train(known, good)
    for k in toxic:
        found, false = model.scores(pa.array(toxic[k][cut[k]:])) >= 0.5, model.scores(pa.array(clean[k][len(clean[k]) // 2:])) >= 0.5
        assert found.mean() > 0.8 and false.mean() < 0.05, (k, found.mean(), false.mean())


def test_a_label_of_long_texts_only_is_learnt(spark, monkeypatch):
    """Longer texts give a window of the bound's size; repeated rows don't make the sample depend on their order."""
    monkeypatch.setattr(T, "TRAIN_CHARS", 600)
    rows = [(i, " ".join([t] * (1 + 700 // len(t))) if y else t, y) for i, t, y in corpus(300)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] * 3, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = T.learn(docs, labels)
    again = T.learn(docs.repartition(7), labels)
    assert model.landmarks.strings == again.landmarks.strings and np.allclose(model.weights, again.weights)
    held = [r for r in T.score_toxicity(docs.distinct(), model).withColumn("out", T.held_out(F.col("doc_id"))).collect() if r.out]
    y = {i: t for i, _, t in rows}
    assert np.mean([r.predicted == y[r.doc_id] for r in held]) > 0.95


def test_machine_is_the_minimum_of_its_loss():
    """The weights of a plain descent of the squared hinge loss, sample by sample."""
    r = np.random.default_rng(8)
    x = r.normal(size=(60, 4))
    y = np.where(x @ [1.0, -2.0, 0.5, 0.0] + r.normal(size=60) > 0.3, 1.0, -1.0)
    weight = np.where(y > 0, 1.5, 0.7)
    got = T.fit_machine(x, y, weight, cost=0.8)
    w = [0.0] * 5
    for _ in range(4000):
        g = [w[0], w[1], w[2], w[3], 1e-6 * w[4]]
        for row, label, c in zip(x.tolist(), y.tolist(), weight.tolist()):
            row = [*row, 1.0]
            short = 1 - label * sum(a * b for a, b in zip(row, w))
            if short > 0:
                for k in range(5):
                    g[k] -= 0.8 * c * short * label * row[k]
        w = [a - 0.004 * b for a, b in zip(w, g)]
    assert np.allclose(got, w, atol=1e-5)


def test_landmark_features_give_the_kernel():
    """The Nyström map: products of the landmarks' features are their kernel by its definition."""
    words = [b"^idiot", b"^moron", b"scumb", b"^trash", b"diots"]
    marks = T.Landmarks(words)
    k = np.array([[brute_kernel(a, b, T.ORDER, T.DECAY) for b in words] for a in words])
    k = k / np.sqrt(np.outer(np.diag(k), np.diag(k)))
    assert np.allclose(marks.between(), k, rtol=1e-4, atol=1e-6)
    values, vectors = np.linalg.eigh(marks.between())
    features = marks.between() @ (vectors / np.sqrt(values)) @ vectors.T
    assert np.allclose(features @ features.T, k, atol=1e-4)
