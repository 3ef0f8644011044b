"""The pipeline's stages and its whole against brute force, on edge rows."""

import hashlib
import random

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests.llm import test_decontaminate, test_line_dedup, test_simhash, test_toxicity  # noqa: E402


def documents():
    r = random.Random(8)
    rows = [(i, t) for i, t, _ in test_toxicity.corpus(240, 3)]
    labels = [(i, y, 1) for i, _, y in test_toxicity.corpus(240, 3)]
    line = "this long line of text stands in very many of the documents here"
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    rows += [(300 + k, f"own start {k} of text\n{line}\nown end {k} {k * k}") for k in range(8)]
    rows += [(400 + k, f"document {k} before {item} and after it {k + 7}") for k in range(4)]
    base = [r.choice(["ba", "ti", "lu", "ri"]) + str(k) for k in range(200)]
    rows += [(500 + k, " ".join(base[:k * 40] + (["odd"] if k else []) + base[k * 40:])) for k in range(4)]
    rows += [(600, "an exact copy of a text"), (601, "an exact copy of a text"), (None, "an exact copy of a text"),
             (None, None), (602, ""), (603, "twice the same row"), (603, "twice the same row"), (None, "no id here"),
             (604, "a shared id"), (604, "another text, same id")]
    return rows, labels, [(1, item), (2, "no such words in any document at all, none whatsoever"), (None, None)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("corpus")
    rows, labels, items = documents()
    spark.createDataFrame([(i, t, "en", f"src{k % 3}", len(t or ""), "extra") for k, (i, t) in enumerate(rows)],
                          "doc_id long, text string, lang string, source string, n_chars long, __id string"
                          ).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def keep_one(rows):
    low = -(1 << 63)
    rows = sorted(set(rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
    fp = [test_simhash.brute_fp(t) for _, t in rows]
    component = test_simhash.brute_components(list(enumerate(fp)))
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault(component[k], []).append((i, t))
    out = []
    for g in groups.values():
        least = min((i for i, _ in g if i is not None), default=None)
        out.append((least, {t for i, t in g if i == least}))
    return out, low


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows, labels, items = documents()
    names = docs.columns
    stage = dict(corpus_pipeline.STAGES)
    y = {i: v for i, v, _ in labels}

    clean = stage["toxicity"](spark, docs, folder)
    assert clean.columns == names
    got = rows_of(clean)
    assert not set(got) - set(rows)
    gone = [i for i, _ in rows if i is not None and i not in {g[0] for g in got}]
    assert np.mean([y.get(i, 0) for i in gone]) > 0.9 and len(gone) > 60

    lines = stage["line_dedup"](spark, docs, folder)
    assert lines.columns == names
    assert rows_of(lines) == sorted(((i, t) for i, t, _, _ in test_line_dedup.brute(rows, 40, 5)), key=str)

    one = stage["simhash_near_dedup"](spark, docs, folder)
    assert one.columns == names
    got, (want, _) = rows_of(one), keep_one(rows)
    assert len(got) == len(want)
    left = list(got)
    for i, texts in want:  # of texts that share the id, one
        k = next(k for k, g in enumerate(left) if g[0] == i and g[1] in texts)
        left.pop(k)

    cut = stage["decontamination"](spark, docs, folder)
    assert cut.columns == names and cut.count() == len(rows)
    hits = {str((i, t)): h for (i, t), (_, _, h, _) in zip(
        rows, [test_decontaminate.brute([row], items, 10)[0] for row in rows])}
    assert sum(h > 0 for h in hits.values()) >= 4
    text = dict(rows_of(cut))
    for i in range(400, 404):
        assert text[i] == f"document {i - 400} before  and after it {i - 400 + 7}"


def test_whole(spark, folder):
    """run() equals the stages one after another, and nothing but duplicates and toxic documents is lost."""
    out = corpus_pipeline.run(spark, folder).collect()
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    tokens = {}
    for i, t in rows_of(docs):
        tokens.setdefault(i, []).append(hashlib.sha256((t or "").encode()).hexdigest())
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r.decoded_sha256)
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in tokens.items()}


def test_empty_documents(spark, folder, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
