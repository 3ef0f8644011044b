"""Document fingerprints: the method against a plain loop, the likeness
against exact shares of common shingles, followers against brute force."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from conftest import SF0001
from lethe.llm import fingerprints as P


def shingles(t):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    return {tuple(w[i:i + P.SHINGLE]) for i in range(max(1, len(w) - P.SHINGLE + 1))} if w else set()


def share(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def followers(docs):
    """(id, text, next text) by descending id, null last."""
    by = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    return [(i, t or "", by[(k + 1) % len(by)][1] or "") for k, (i, t) in enumerate(by)]


def prose(r, n):
    return " ".join(r.choice("the of and to in is that for it as was with be by on".split()) + str(r.randrange(400))
                    for _ in range(n))


def test_bins_by_plain_loop():
    r = random.Random(1)
    texts = [prose(r, n) for n in (1, 3, 5, 6, 12, 30, 31, 200, 900, 5000)] + ["", " \n", None, "x", "x x x x x x x x"]
    got = P.fingerprints(pa.array(texts, pa.string()))
    for k, t in enumerate(texts):
        raw = (t or "").encode()
        _, hs = P.shingle_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert len(set(hs.tolist())) == len(shingles(t))
        bins = {}
        for h in hs.tolist():
            bin_, rest = h >> 55, h & ((1 << 55) - 1)
            bins[bin_] = min(bins.get(bin_, rest), rest)
        if not bins:
            assert got[k, -1] == 0 and P._hex(got[k:k + 1]) == [""]
            continue
        values = [bins[next(j for j in [i, *P._ORDER[i].tolist()] if j in bins)] for i in range(P.BINS)]
        want = [int(x) % 16 for x in P.mix(np.array(values, np.uint64) + P._SPREAD)]
        bits = np.unpackbits(got[k, :-1]).reshape(P.BINS, P.BITS)
        assert (bits @ [1, 2, 4, 8]).tolist() == want


def test_likeness_is_near_the_exact_share():
    r = random.Random(2)
    pairs = []
    pairs += [(prose(r, n), prose(r, n)) for n in (1, 2, 5, 6, 7) for _ in range(20)]
    for n in (40, 200, 1000, 4000):
        for part in (0.0, 0.2, 0.5, 0.8, 0.95, 1.0):
            for _ in range(4):
                a = prose(r, n).split()
                cut = int(n * part)
                pairs.append((" ".join(a), " ".join(a[:cut] + prose(r, n - cut).split())))
    one, two = (P.fingerprints(pa.array(x)) for x in zip(*pairs))
    wrong = P.likeness(one, two) - np.array([share(a, b) for a, b in pairs])
    assert np.abs(wrong).max() < 0.15 and np.abs(wrong).mean() < 0.025 and abs(wrong.mean()) < 0.01


@pytest.mark.parametrize("partitions, size", [(8, 64 << 20), (3, 64 << 20), (8, 500)])
def test_followers(spark, monkeypatch, partitions, size):
    """Also with far more ranges than rows need."""
    monkeypatch.setattr(P, "RANGE_BYTES", size)
    r = random.Random(3)
    docs = [(i * i - 50, prose(r, r.choice([0, 1, 4, 30, 200])) + r.choice(["", "é𝒳日本"])) for i in range(150)]
    docs += [(None, "the null id"), (7777777, None), (-(1 << 63) + 1, "")]
    r.shuffle(docs)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        df = spark.createDataFrame([(i, t, "c", 0) for i, t in docs], "doc_id long, text string, range string, k int").repartition(4)
        rows = {x.doc_id: x for x in P.compare_edited(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(rows) == len(docs)
    for i, t, following in followers(docs):
        n = len(t) // 3
        new = t[:len(t) - n] + following[:n]
        x = rows[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        a, b, c = (P.fingerprints(pa.array([s])) for s in (t, new, following))
        assert (x.fingerprint, x.edited_fingerprint) == (P._hex(a)[0], P._hex(b)[0])
        assert (x.near_edited, x.near_next) == (P.likeness(a, b)[0], P.likeness(a, c)[0])


def test_repeated_ids_and_rows(spark):
    """An id that holds a third of the rows, partly equal ones: it fills
    several ranges, and every row still has a follower of the right id."""
    r = random.Random(4)
    docs = [(i, prose(r, 20)) for i in range(200)] + [(77, "same " * 9)] * 60 + [(77, prose(r, 15)) for _ in range(60)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows, ranges = P.with_follower(df)
    parts = rows.where("k = ~77 and not last").groupBy("range").count().collect()
    assert len(parts) > 1 and max(x["count"] for x in parts) < 80
    out = P.compare_edited(df).collect()
    assert sorted(x.doc_id for x in out) == sorted(i for i, _ in docs)
    own = {i: t for i, t in docs}
    after = {hashlib.sha256(P.edited(t, own[i - 1]).encode()).hexdigest() for i, t in docs if i == 77}
    assert sum(x.edited_sha256 in after for x in out if x.doc_id == 77) >= 1
    assert all(x.edited_sha256 == hashlib.sha256(P.edited(own[x.doc_id], own[x.doc_id - 1]).encode()).hexdigest()
               for x in out if x.doc_id not in (0, 77, 78))


def test_one_row_and_empty_table(spark):
    one = P.compare_edited(spark.createDataFrame([(4, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert one[0].edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    assert P.compare_edited(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert P.with_fingerprint(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_very_long_text(spark):
    long = prose(random.Random(5), 300_000)
    rows = {x.doc_id: x for x in P.compare_edited(spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string"))
            .collect()}
    assert rows[1].n_chars == len(long) and rows[1].near_edited > 0.6 and rows[2].near_next < 0.1


def test_with_fingerprint_keeps_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "A  B", "y"), (3, None, "z")], "doc_id long, text string, fingerprint string")
    out = P.with_fingerprint(df)
    rows = {x.doc_id: x.fingerprint for x in out.collect()}
    assert out.columns == ["doc_id", "text", "fingerprint"] and rows[1] == rows[2] != "" and rows[3] == ""


def test_query(spark):
    from lethe.llm.queries import QUERIES
    docs = [tuple(x) for x in spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()]
    rows = {x.doc_id: x for x in QUERIES["op13_fingerprints"](spark, SF0001).collect()}
    assert len(rows) == len(docs)
    wrong = []
    for i, t, following in followers(docs):
        new = P.edited(t, following)
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        wrong += [rows[i].near_edited - share(t, new), rows[i].near_next - share(t, following)]
    assert np.abs(wrong).mean() < 0.03
