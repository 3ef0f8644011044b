"""Statistics against brute force; the learned list on planted rows."""

import random
import re

import numpy as np

from lethe.llm import quality_rules as Q


def brute(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    grams = {}
    for k in range(len(w) - 2):
        grams.setdefault(tuple(w[k:k + 3]), []).append(k)
    covered = {k + d for v in grams.values() if len(v) > 1 for k in v for d in range(3)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered),
            n < 50 or 100 * len(covered) > 50 * n)


def texts():
    r = random.Random(2)
    vocab = ["a", "the", "Über", "x|y", "#tag", "<b>", "50%", "漢字🙂", "\x85"]
    rows = [None, "", " \n\t", "one", "one two", "a a a", "a a a a", "l1\nl1\n\n \nl1", "x\n X\nx ", "\x1cq"]
    rows += [r.choice([" ", "\n"]).join(r.choice(vocab) for _ in range(r.randrange(120))) for _ in range(60)]
    rows += [" ".join(f"{r.choice(vocab)}{r.randrange(30)}" for _ in range(400)) for _ in range(10)]
    return rows + ["long " * 20_000, "w" * 200_000]


def test_statistics(spark):
    rows = list(enumerate(texts())) + [(None, "a b c"), (3, "one"), (3, "one")]
    df = spark.createDataFrame([(i, t, "k", 0) for i, t in rows], "doc_id long, text string, kept string, n_words int")
    got = Q.apply_rules(df, [])
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                           "kept"]
    got = sorted((tuple(r) for r in got.collect()), key=str)
    assert got == sorted(((i, *(b := brute(t)), not b[-1]) for i, t in rows), key=str)
    assert Q.apply_rules(df.limit(0), []).collect() == []


def planted(n=600, seed=5):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        w = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 9))) for _ in range(r.randint(60, 200))]
        bad = i % 4 == 0
        if bad:
            w = [x.upper() + "!!" for x in w] if i % 8 else [x + r.choice(["***", "$$$"]) for x in w]
        rows.append((i, " ".join(w), int(not bad)))
    return rows


def test_learned_list(spark):
    rows = planted()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y if i % 97 else 1 - y, None) for i, _, y in rows] + [(None, 0, 0), (5, None, 1)],
                                   "doc_id long, quality int, toxic int")
    rules = Q.learn_rules(docs, labels)
    assert rules and all(len(x) <= Q.MAX_TERMS for x in rules)
    fresh = planted(200, 77)
    out = Q.apply_rules(spark.createDataFrame([(i, t) for i, t, _ in fresh], "doc_id long, text string"), rules)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert np.mean([kept[i] == bool(y) for i, _, y in fresh]) > 0.97
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CASE WHEN" in plan


def test_grow_and_prune():
    r = np.random.default_rng(1)
    good, bad = r.random((300, len(Q.STATISTICS))), r.random((300, len(Q.STATISTICS)))
    bad[:, 3] += 0.8
    bad[:, 5] -= 0.9
    rules = Q.learn_list(bad, good)
    hit = np.any([Q.covers(x, bad) for x in rules], axis=0)
    miss = np.any([Q.covers(x, good) for x in rules], axis=0)
    assert hit.mean() > 0.9 and miss.mean() < 0.05
    assert Q.learn_list(bad[:0], good) == [] and Q.learn_list(bad, good[:0]) == []


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for rows in ([], [(1, 1)], [(1, None)]):
        assert Q.learn_rules(docs, spark.createDataFrame(rows, "doc_id long, quality int")) == []
