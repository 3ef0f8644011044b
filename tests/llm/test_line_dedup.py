"""Line dedup against brute force."""

import random
from collections import defaultdict

import numpy as np

from lethe.llm import bloom
from lethe.llm.line_dedup import dedup_lines

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows, min_chars, min_docs):
    held = defaultdict(set)
    low = -(1 << 63)
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                held[k].add(low if i is None else i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), low if i is None else i) == (low if i is None else i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus(n, seed=2):
    r = random.Random(seed)
    pool = ["é" * 39, "e" * 40, "Shared LINE number one, which is long enough to count", "\x85" + "q" * 50]
    pool += [f"passage {k} " + "lorem ipsum " * 4 for k in range(25)]
    rows = [(None, pool[2]), (None, None), (3, ""), (3, None), (4, pool[2]), (4, pool[2]), (5, "\n\n")]
    for i in range(10, n):
        lines = []
        for _ in range(r.randrange(8)):
            x = r.choice(pool) if r.random() < 0.6 else f"own line of document {i} " + str(r.random()) * 3
            x = x.upper() if r.random() < 0.2 else x
            lines.append(r.choice(["", " ", "\t\x0b", "  "]) + x + r.choice(["", "\r", " \x0c"]))
        rows.append((i, "\n".join(lines)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", t, 1) for i, t in rows],
                                 "doc_id long, text string, key string, id string, n_lines int")


def check(spark, rows, **kw):
    got = dedup_lines(frame(spark, rows), **kw)
    assert got.columns == ["doc_id", "text", "key", "id", "n_lines", "n_dropped"]
    got = sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert got == brute(rows, kw.get("min_chars", 40), kw.get("min_docs", 5))


def test_brute_force(spark):
    check(spark, corpus(120))
    check(spark, corpus(60, 9), min_chars=1, min_docs=2)


def test_full_filters_change_nothing(spark, monkeypatch):
    """A filter far too small for its lines suspects more, and drops the same."""
    monkeypatch.setattr(bloom, "MAX_BYTES", 1 << 17)
    rows = corpus(80, 4) + [(1000 + i, f"unique long line {i} " + "x" * 40) for i in range(3000)]
    check(spark, rows)


def test_empty_table(spark):
    assert dedup_lines(frame(spark, corpus(12)).limit(0)).collect() == []


def test_filter_never_misses_a_repeat(spark):
    r = np.random.default_rng(0)
    h = r.integers(-2**63, 2**63 - 1, 20_000)
    rows = spark.createDataFrame([(int(x),) for x in np.concatenate([h, h[:3000]])], "h long").repartition(7)
    twice = bloom.twice_seen(rows, lambda b: b.column(0).to_numpy().view(np.uint64), len(h))
    got = twice.suspects(h.view(np.uint64))
    assert got[:3000].all() and got[3000:].mean() < 0.05


def test_documents_are_counted_not_rows(spark):
    """Four rows of one document and one of another hold the line: two documents, as in the query's SQL."""
    line = "a long line that is in every one of these rows"
    rows = [(1, line)] * 4 + [(2, line + "\nx")]
    check(spark, rows)
    assert all(r.n_dropped == 0 for r in dedup_lines(frame(spark, rows)).collect())
    check(spark, rows + [(3, line), (4, line), (None, line), (None, line)])


def test_sql_twin_on_repeated_ids(spark):
    import duckdb
    import pandas as pd

    from lethe.llm.common import digest
    from lethe.llm.queries import OP1_SQL
    from pyspark.sql import functions as F
    rows = [(i % 40, t) for i, t in corpus(150, 6) if i is not None]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text"]))
    # The SQL gives a row a document; compare what is dropped in all.
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_lines", "n_dropped",
                                                                                   digest(F.col("text")).alias("h"))
    got = out.groupBy("doc_id").agg(F.sum("n_lines"), F.sum("n_dropped")).collect()
    want = con.execute(f"SELECT doc_id, n_lines, n_dropped FROM ({OP1_SQL})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
