"""SimHash near-duplicates against brute force."""

import random

import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lethe.llm import simhash as S
from lethe.llm.components import connected


def brute_fp(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    grams = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(items, most=3):
    """items: (id, fp) -> id -> smallest id reachable."""
    root = {i: i for i, _ in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, f) in enumerate(items):
        for j, g in items[:k]:
            if bin(f ^ g).count("1") <= most:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in items}


WORDS = [f"w{i}" for i in range(400)] + ["Ärger", "ÉTÉ", "x,"]


def corpus(n=160, seed=3):
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "a b c")]
    for i in range(len(rows), n):
        if r.random() < 0.6:
            w = r.choice(rows)[1] or "z"
            w = w.split()
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = r.choice(WORDS)
            rows.append((i, r.choice([" ", "\n", "\t "]).join(w)))
        else:
            rows.append((i, " ".join(r.choice(WORDS) for _ in range(r.choice([2, 30, 200])))))
    return rows


def test_fingerprints_match_definition(monkeypatch):
    rows = corpus() + [(999, "long " * 70_000 + "end")]
    monkeypatch.setattr("lethe.llm.common.CHUNK_BYTES", 500)
    got = S.fingerprint_texts(pa.array([t for _, t in rows]), 3)
    assert [int(x) for x in got] == [brute_fp(t) for _, t in rows]


def test_near_duplicates_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, fp string, root long")
    got = {r.doc_id: (r.fp % 2**64, r.component_id) for r in S.near_duplicates(docs).collect()}
    fps = {i: brute_fp(t) for i, t in rows}
    want = brute_components(list(fps.items()))
    assert got == {i: (fps[i], want[i]) for i in fps}


@pytest.mark.parametrize("most, wide", [(1, 4096), (3, 2), (3, 4096), (4, 30)])
def test_links_keep_components(spark, most, wide):
    """Dense clusters, also with variants so wide that they are split."""
    r = random.Random(5)
    fps = set()
    for _ in range(4):
        c = r.getrandbits(64)
        for _ in range(60):
            x = c
            for _ in range(r.randrange(6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [x - 2**64 if x >= 2**63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = S.near_links(df, most, wide)

    root = {r.node: r.root for r in connected(links).collect()}
    want = brute_components(list(zip(signed, fps)), most)
    assert {x: root.get(x, x) for x in signed} == want


def test_one_group_writes_few_links(spark):
    """A group of near copies gives fewer links than members in each task."""
    fps = [(1 << 40) ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]
    df = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    assert S.near_links(df, 3).count() < 8 * len(fps) + 8


def test_components_chain_and_star(spark):
    links = [(i, i + 1) for i in range(60)] + [(500, i) for i in range(501, 600)] + [(7, 7), (900, 900), (1, 0)]
    got = {r.node: r.root for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 500 for i in range(501, 600)}}


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).collect() == []
    rows = [(None, "a b c d"), (None, None), (5, "a b c d"), (5, "a b c d"), (6, None)]
    got = sorted((r.doc_id or -1, r.component_id) for r in
                 S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(-1, 5), (-1, 6), (5, 5), (5, 5), (6, 6)]
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_star_is_joined_by_splittable_sides(spark):
    """A node of very many neighbours: both sides of its join are scans with a shuffle each, so Spark can split it."""
    n = 20_000
    links = spark.range(1, n).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    high = spark.range(n, 2 * n - 1).select(F.lit(2 * n).cast("long").alias("a"), F.col("id").alias("b"))
    roots = {r["root"]: r["count"] for r in connected(links.union(high)).groupBy("root").count().collect()}
    assert roots == {0: n - 1, n: n - 1}
