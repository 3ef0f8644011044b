"""Language ID: held-out accuracy, calibration, what it may learn from, edge rows."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from lethe.llm import language_id as L

SYLLABLES = {"aa": ["ka", "mu", "lo", "ti", "re"], "bb": ["sch", "en", "er", "ung", "ka"], "cc": ["é", "eau", "ou", "re", "lo"]}


def corpus(n=450, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(sorted(SYLLABLES))
        t = " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 60)))
        rows.append((i, t.upper() if i % 5 == 0 else t, lang))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, x, 1.0) for i, t, x in rows], "doc_id long, text string, lang string, score double")


def test_held_out_accuracy(spark):
    rows = corpus()
    docs = frame(spark, rows)
    model = L.learn(docs)
    out = L.identify(docs, model)
    assert out.columns == ["doc_id", "held_out", "lang_pred", "score"]
    truth = {i: x for i, _, x in rows}
    held = [r for r in out.collect() if r.held_out]
    assert len(held) > 100 and all(0 <= r.score <= 1 for r in held)
    right = [r.lang_pred == truth[r.doc_id] for r in held]
    assert np.mean(right) > 0.95
    assert abs(np.mean([r.score for r in held]) - np.mean(right)) < 0.1
    assert (model.weights == 0).mean() > 0.5  # the penalties leave most features out


def test_learns_nothing_from_held_out(spark):
    docs = frame(spark, corpus(200))
    other = docs.withColumn("lang", F.when(L.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang"))).withColumn(
        "text", F.when(L.held_out(F.col("doc_id")), "q").otherwise(F.col("text")))
    a, b = L.learn(docs), L.learn(other)
    assert a.languages == b.languages and np.allclose(a.weights, b.weights) and a.temperature == b.temperature


def test_edges(spark):
    model = L.learn(frame(spark, corpus(200)))
    rows = [(None, None, None), (1, "", "aa"), (2, "123 -- \n", "aa"), (3, "é", None), (4, "ка", "x"), (4, "ка", "x"),
            (5, "mu" * 100_000, "aa"), (6, "漢字 \U0001F600", "aa")]
    got = {r.doc_id: r for r in L.identify(frame(spark, rows), model).collect()}
    assert [got[k].lang_pred for k in (None, 1, 2)] == ["und"] * 3 and got[1].score == 0
    assert got[3].lang_pred == "cc" and got[5].lang_pred == "aa" and got[4].lang_pred in SYLLABLES
    empty = frame(spark, rows).limit(0)
    assert L.identify(empty, model).collect() == []
    for df in (empty, frame(spark, [(1, "text", None)]), frame(spark, [(1, "", "aa")])):
        nothing = L.learn(df)
        assert L.identify(frame(spark, rows), nothing).where("lang_pred <> 'und'").count() == 0


def test_document_frequencies(spark):
    rows = corpus(60)
    n, df = L._document_frequencies(frame(spark, rows).repartition(5).select("text"))
    want = np.zeros(L.DIMENSIONS, np.int64)
    for _, t, _ in rows:
        want[L.features(t)[0]] += 1
    assert n == 60 and (df == want).all()


def test_every_language_is_learnt(spark):
    """More languages than the sample has room for at its full size; one has only texts over the bound."""
    r = random.Random(3)
    rows, n = [], 36
    for i in range(n * 24):
        k = i % n
        own = [chr(0x4E00 + 20 * k + j) for j in range(5)]
        t = " ".join("".join(r.choice(own) for _ in range(3)) for _ in range(20))
        rows.append((i, t * (L.SAMPLE_CHARS // len(t) + 2) if k == 7 and i < 10 * n else t, f"l{k:02}"))
    rows = [x for x in rows if x[2] != "l07" or len(x[1]) > L.SAMPLE_CHARS]
    docs = frame(spark, rows)
    model = L.learn(docs)
    assert len(model.languages) == n
    truth = {i: x for i, _, x in rows}
    held = [x for x in L.identify(docs, model).collect() if x.held_out]
    assert np.mean([x.lang_pred == truth[x.doc_id] for x in held]) > 0.95
    assert {x.lang_pred for x in L.identify(docs, model).collect()} == set(model.languages)


def brute_features(text):
    """Counts of hashed 1- to 3-grams of letters, a blank before the text and after each word."""
    padded = " "
    for c in text.lower():
        if c.isalpha():
            padded += c
        elif padded[-1] != " ":
            padded += " "
    if padded[-1] != " " and not text[-1].isalpha():
        padded += " "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            h = 0
            for k in range(n):
                h = (h * 0x01000193 + ord(padded[i + k]) + k + 1) % 2**32
            x = h * 0x9E3779B1 % 2**32
            f = (x ^ (x >> 15)) % L.DIMENSIONS
            counts[f] = counts.get(f, 0) + 1
    return counts


def brute_vector(counts, idf):
    v = {f: (1 + math.log(c)) * idf[f] for f, c in counts.items()}
    norm = math.sqrt(sum(x * x for x in v.values()))
    return {f: x / norm for f, x in v.items()}


def test_features_one_by_one():
    for text in ("Aé b1c  dd", "ka, mu lo", "x", " aa-bb ", "ß.É"):
        at, count = L.features(text)
        assert dict(zip(at.tolist(), count.tolist())) == brute_features(text)


def test_training_by_the_textbook_loop():
    """Follow the regularised leader, a coordinate at a time, and prediction by its model."""
    rows = [(lang, t) for _, t, lang in corpus(70, 3)]
    idf = np.random.default_rng(5).uniform(1, 3, L.DIMENSIONS)
    model = L.train([(lang, *L.features(t)) for lang, t in rows], idf)
    langs, seen, used = sorted(SYLLABLES), {}, []
    for lang, t in rows:
        seen[lang] = seen.get(lang, 0) + 1
        if seen[lang] % 5:
            used.append((lang, t))
    z, n = {}, {}

    def weight(key):
        if abs(z.get(key, 0.0)) <= L.L1:
            return 0.0
        return -(z[key] - math.copysign(L.L1, z[key])) / ((L.BETA + math.sqrt(n[key])) / L.ALPHA + L.L2)

    def probabilities(x, heat=1.0):
        s = [sum(weight((f, k)) * v for f, v in x.items()) / heat for k in langs]
        e = [math.exp(v - max(s)) for v in s]
        return [v / sum(e) for v in e]

    for _ in range(L.EPOCHS):
        for lang, t in used:
            x = brute_vector(brute_features(t), idf) | {"bias": 1.0}
            p = probabilities(x)
            for k, q in zip(langs, p):
                for f, v in x.items():
                    g = v * (q - (k == lang))
                    key, old = (f, k), n.get((f, k), 0.0)
                    w = weight(key)
                    n[key] = old + g * g
                    z[key] = z.get(key, 0.0) + g - (math.sqrt(n[key]) - math.sqrt(old)) / L.ALPHA * w
    for k, lang in enumerate(langs):
        assert math.isclose(model.bias[k], weight(("bias", lang)), abs_tol=1e-9)
        assert np.allclose(model.weights[:, k], [weight((f, lang)) for f in range(L.DIMENSIONS)], atol=1e-9)
    for _, t in rows:
        p = probabilities(brute_vector(brute_features(t), idf) | {"bias": 1.0}, model.temperature)
        lang, score = model.predict(t)
        assert lang == langs[p.index(max(p))] and math.isclose(score, max(p), abs_tol=1e-7)
    # No temperature of a fine grid is better on the rows kept for it.
    probe = [(langs.index(x), L.features(t)) for x, t in rows if (x, t) not in used]

    def loss(heat):
        return -sum(math.log(L.softmax(model.logits(*f) / heat)[k]) for k, f in probe)

    assert loss(model.temperature) <= min(loss(h) for h in np.geomspace(0.05, 20, 200)) + 1e-6
