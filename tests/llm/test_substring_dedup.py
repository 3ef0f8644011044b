"""Substring dedup against brute force."""

import random
import re

import numpy as np
import pytest

from lethe.llm import bloom
from lethe.llm import substring_dedup as S

LOW = -(1 << 63)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def brute(rows, window):
    first = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            g = tuple(w[k:k + window])
            first[g] = min(first.get(g, 1 << 62), LOW if i is None else i)
    out = []
    for i, t in rows:
        w, gone = words(t), set()
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < (LOW if i is None else i):
                gone |= set(range(k, k + window))
        out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone), len(w), len(gone)))
    return sorted(out, key=str)


def corpus(n, window, seed=1):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(300)] + ["é", "É", "\x85", "x,"]
    shared = [[r.choice(vocab) for _ in range(window + r.randrange(3 * window))] for _ in range(6)]
    rows = [(None, " ".join(shared[0])), (None, None), (3, ""), (4, " \n "), (n + 5, "tail " + " ".join(shared[0])),
            (7, " ".join(shared[1])), (7, " ".join(shared[1])), (7, "other " + " ".join(shared[1]))]
    for i in range(10, n):
        w = [r.choice(vocab) for _ in range(r.randrange(2 * window))]
        for _ in range(r.randrange(3)):
            p = list(r.choice(shared))
            if r.random() < 0.3:
                p[r.randrange(len(p))] = "edit"
            at = r.randrange(len(w) + 1)
            w[at:at] = p
        rows.append((i, r.choice([" ", "\n", " \t"]).join(w)))
    rows += [(n, "a " * (4 * window)), (n + 1, "a " * (2 * window) + "b"), (n + 2, "x " + "a " * window)]
    r.shuffle(rows)
    return rows


def check(spark, rows, window):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, id int, n_words string")
    out = S.dedup_substrings(docs, window)
    assert out.columns == ["doc_id", "text", "id", "n_words", "n_removed"]
    got = sorted(((r.doc_id, r.text, r.n_words, r.n_removed) for r in out.collect()), key=str)
    assert got == brute(rows, window)


@pytest.mark.parametrize("window", [50, 7])
def test_brute_force(spark, window):
    check(spark, corpus(70, window), window)


def test_small_shards_and_full_filters(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_BYTES", 500)
    monkeypatch.setattr(bloom, "MAX_BYTES", 1 << 17)
    check(spark, corpus(60, 12, 5), 12)


def test_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(S, "ANCHOR_SEGMENTS", 1)
    check(spark, corpus(60, 12, 9), 12)
    # One passage inside a text of its own in every document.
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(i, " ".join([*(f"{j % 30}a{k}" for k in range(i % 13)), passage, *(f"{j % 7}b{k}" for k in range(9))]))
            for i, j in enumerate(random.Random(4).sample(range(400), 300))]
    check(spark, rows, 12)


def test_distinct_windows_of_a_text():
    texts = ["a b a b a b c d", "a b a b", "", "x y z a b"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    w = S.Windows(data, np.cumsum([0, *map(len, texts)]), 2)
    want = sorted(g for t in texts for g in {tuple(t.split()[k:k + 2]) for k in range(len(t.split()) - 1)})
    of = {tuple(bytes(data[w.starts[i]:w.ends[i + 1]]).decode().split()): h for i, h in zip(w.at, w.hash)}
    assert sorted(w.distinct(w.hash).tolist()) == sorted(int(of[g]) for g in want)
    assert len(w.distinct(w.hash, np.zeros(len(w.hash), bool))) == 0


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.dedup_substrings(docs).collect() == []


def test_folds():
    r = np.random.default_rng(0)
    h = r.integers(0, 2**63, 200).astype(np.uint64)
    h[100:150] = h[20:70]
    for n in (1, 2, 3, 8, 43, 50):
        m = S._fold_min(h, n)
        assert (m == [h[i:i + n].min() for i in range(len(h) - n + 1)]).all()
        f = S._fold_hash(h, n)
        assert len(f) == len(h) - n + 1
        same = [[i for i in range(len(f)) if (h[i:i + n] == h[j:j + n]).all()] for j in (20, 21)]
        assert all((f[s] == f[s[0]]).all() for s in same) and len(set(f.tolist())) >= len(f) - 51
