"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lethe.llm import lexical_search as S


def terms(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t)


def brute(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    wanted = {}
    for k, t in items:
        wanted.setdefault(k, set()).update(terms(t))
    out = []
    for k, ts in wanted.items():
        scored = []
        for i, b in bags:
            m = 100 - 90 + (90 * sum(b.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    * ((1000000000 * b[t]) // (1000 * b[t] + 8 * m)) for t in ts if t in b)
            if s > 0:
                scored.append((-s, i is not None, i or 0, i))
        out += [(k, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:top])]
    return sorted(out, key=str)


def tables(seed=1):
    r = random.Random(seed)
    vocab = ["the", "of", "naïve", "É", "é", "x1", "42", "a", "über", "日本", "𝒳y", "ab", "b"] + [f"w{i}" for i in range(30)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 9, 20])))) for k in range(12)]
    items += [(3, "w1 w2 again the"), (3, "w1 w2 again the"), (None, "null-item of w3"), (50, None), (51, " .,- "),
              (52, "absent"), (53, "")]
    docs = [(0, None), (1, ""), (2, "..."), (None, "the w3 w3"), (None, "the w3 w3"), (5, "a"), (5, "a"), (6, "A"), (7, "\x00a\x7f")]
    for i in range(8, 150):
        w = [r.choice(vocab + [f"z{i}"]) for _ in range(r.randrange(40))]
        docs.append((i, r.choice([" ", ", ", "\n", "-", "_"]).join(x.upper() if r.random() < 0.2 else x for x in w)))
    docs.append((500, " ".join(r.choice(vocab) for _ in range(50000))))
    return docs, items


def frames(spark, docs, items):
    return (spark.createDataFrame([(i, t, "s", 0, 1.0) for i, t in docs],
                                  "doc_id long, text string, item_id string, rank int, score double").repartition(5),
            spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int"))


@pytest.mark.parametrize("block, cells", [(1 << 21, 1 << 20), (150, 40)])
def test_brute_force(spark, monkeypatch, block, cells):
    """Also with several blocks of items and a score table of few rows."""
    monkeypatch.setattr(S, "BLOCK_BYTES", block)
    monkeypatch.setattr(S, "CELLS", cells)
    docs, items = tables()
    out = S.search(*frames(spark, docs, items), top=10)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect()), key=str) == brute(docs, items, 10)


def test_empty_tables(spark):
    docs, items = tables()
    d, b = frames(spark, docs, items)
    assert S.search(d.limit(0), b).collect() == []
    assert S.search(d, b.limit(0)).collect() == []


def test_terms_only_at_boundaries():
    block = S.Terms([(1, "ab"), (1, "b"), (2, "ab")])
    texts = ["ab b b", "abb xab", "", "b", "ab"]
    raw = "".join(texts).encode()
    offs = np.cumsum([0] + [len(t.encode()) for t in texts])
    size, text, term, tf = block.scan(np.frombuffer(raw, np.uint8), offs)
    assert size.tolist() == [3, 2, 0, 1, 1]
    assert list(zip(text.tolist(), term.tolist(), tf.tolist())) == [(0, 0, 1), (0, 1, 2), (3, 1, 1), (4, 0, 1)]


def test_length_part_beyond_64_bits():
    n = np.array([1, 1 << 40], np.int64)
    assert S._length_part(n, 1 << 40, 1 << 45).tolist() == [10 + 90 * int(x) * (1 << 40) // (1 << 45) for x in n]
