"""FM-index and benchmark decontamination against brute force."""

import random
import re

import numpy as np
import pytest

from lethe.llm import decontaminate as D
from lethe.llm.fm_index import Borders, FMIndex


def words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", t)


def brute(docs, items, window):
    out = []
    grams = {}
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[i:i + n]), set()).add("null" if k is None else str(k))
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for a in range(len(w) - n + 1):
                if (g := tuple(w[a:a + n])) in grams:
                    hit |= set(range(a, a + n))
                    found |= grams[g]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def tables(seed=1, window=4):
    r = random.Random(seed)
    vocab = ["the", "of", "naïve", "É", "x1", "42", "und", "a"] + [f"w{i}" for i in range(12)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([2, 3, 4, 9, 20])))) for k in range(12)]
    items += [(3, "again the same id"), (None, "null item of words"), (50, None), (51, " .,- "), (52, "solo")]
    docs = [(0, None), (1, ""), (2, "..."), (None, items[0][1]), (5, "solo"), (5, "solo")]
    for i in range(6, 90):
        w = [r.choice(vocab + [f"z{i}"]) for _ in range(r.randrange(40))]
        if r.random() < 0.5:
            at = r.randrange(len(w) + 1)
            w[at:at] = (r.choice(items)[1] or "q").split()
        docs.append((i, r.choice([" ", ", ", "\n", "-"]).join(x.upper() if r.random() < 0.2 else x for x in w)))
    docs.append((500, " ".join(r.choice(vocab) for _ in range(5000))))
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "s", 0, []) for i, t in docs],
                                  "doc_id long, text string, items string, n_words int, spans array<int>"),
            spark.createDataFrame(items, "item_id long, text string"))


@pytest.mark.parametrize("block, shard", [(1 << 26, 1 << 22), (60, 300)])
def test_brute_force(spark, monkeypatch, block, shard):
    """Also with several blocks of phrases and many small shards."""
    monkeypatch.setattr(D, "BLOCK_BYTES", block)
    monkeypatch.setattr(D, "SHARD_BYTES", shard)
    docs, items = tables()
    d, b = frames(spark, docs, items)
    out = D.mark_contamination(d, b, 4)
    assert out.columns == ["doc_id", "text", "n_words", "n_hit", "items", "spans"]
    got = sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in out.collect()), key=str)
    assert got == brute(docs, items, 4)


def test_cut_text_has_no_hit_words(spark):
    docs, items = tables(7)
    d, b = frames(spark, docs, items)
    before = {(r.doc_id, r.text): (r.n_words - r.n_hit) for r in D.mark_contamination(d, b, 4).collect()}
    cut = D.decontaminate(d, b, 4)
    assert cut.columns == d.columns
    left = sorted(len(words(r.text)) for r in cut.collect())
    assert len(left) == len(docs) and left == sorted(before[(i, t)] for i, t in docs)


def test_empty_tables(spark):
    docs, items = tables()
    d, b = frames(spark, docs, items)
    assert D.mark_contamination(d.limit(0), b).collect() == []
    none = D.mark_contamination(d, b.limit(0)).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and list(r["items"]) == [] for r in none)


def test_fm_index_brute_force():
    r = np.random.default_rng(3)
    seqs = [r.integers(1, 5, r.integers(1, 30)) for _ in range(40)] + [np.ones(25, np.int64)] * 2
    sizes = np.array([len(s) for s in seqs])
    index = FMIndex(np.concatenate(seqs), sizes, 5, sample=4)
    located = index.locate(np.arange(index.n))
    assert sorted(located) == list(range(index.n))
    ends = index.begin + sizes
    rest = [tuple(seqs[k][at - index.begin[k]:]) + (0, k) for at in located
            for k in [int(np.searchsorted(ends, at))]]
    # A terminator sorts below all words, and by its sequence.
    assert [x[:x.index(0)] + (0,) for x in rest] == sorted(x[:x.index(0)] + (0,) for x in rest)
    for n in (1, 2, 3, 7):
        phrases = np.unique(np.concatenate([np.lib.stride_tricks.sliding_window_view(s, n) for s in seqs if len(s) >= n]
                                           + [r.integers(1, 5, (50, n))]), axis=0)
        lo, hi = index.search(phrases)
        for p, a, b in zip(phrases, lo, hi):
            want = sorted(index.begin[k] + i for k, s in enumerate(seqs) for i in range(len(s) - n + 1)
                          if (s[i:i + n] == p).all())
            assert sorted(index.locate(np.arange(a, b)).tolist()) == want
        by_window = FMIndex(np.concatenate(seqs), sizes, 5, sample=4, window=n)
        order = np.array([31, 2, 41, 40, *range(41)])  # streamed: any sequences, repeats too
        streamed = [seqs[k] for k in order]
        lo, hi = by_window.window_rows(np.concatenate(streamed), sizes[order])
        ids = r.permutation(1000)[:len(seqs)]
        least = by_window.least(ids, lo, hi)
        windows = [(k, i) for k, s in enumerate(seqs) for i in range(len(s) - n + 1)]
        asked = [(k, i) for k in order for i in range(len(seqs[k]) - n + 1)]
        assert len(asked) == len(lo)
        for (k, i), a, b, owner in zip(asked, lo, hi, least):
            same = [(q, j) for q, j in windows if (seqs[q][j:j + n] == seqs[k][i:i + n]).all()]
            assert sorted(by_window.locate(np.arange(a, b)).tolist()) == sorted(index.begin[q] + j for q, j in same)
            assert owner == min(ids[q] for q, _ in same)


def test_fm_index_keeps_no_array_of_its_rows():
    r = np.random.default_rng(1)
    sizes = np.full(200, 500)
    index = FMIndex(r.integers(1, 1000, 100_000), sizes, 1000, sample=32, window=50)
    held = []

    def walk(x):
        if isinstance(x, np.ndarray):
            held.append(x)
        elif isinstance(x, list):
            [walk(y) for y in x]
        elif hasattr(x, "__dict__"):
            [walk(y) for y in vars(x).values()]

    walk(index)
    # Neither the text nor the suffix array stays: ten bit vectors of a level, two more, and samples.
    assert max(map(len, held)) <= index.n // 32 + 201
    assert sum(x.nbytes for x in held) < index.n * 4


def test_borders():
    r = np.random.default_rng(2)
    for n in (2, 63, 64, 65, 129, 1000):
        for share in (0.0, 0.01, 0.5, 1.0):
            flags = r.random(n) < share
            flags[[0, -1]] = True
            b, at, pos = Borders(flags), np.flatnonzero(flags), np.arange(n)
            assert (b.at_or_before(pos) == at[np.searchsorted(at, pos, "right") - 1]).all()
            assert (b.at_or_after(pos) == at[np.searchsorted(at, pos)]).all()
            assert (b.rank(pos) == np.cumsum(flags) - flags).all() and (b.get(pos) == flags).all()
