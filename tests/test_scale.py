"""What grows with the input: working arrays, batches, files and repeated evaluation."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lethe import sources as S
from lethe.functions.text import PY_WHITESPACE, py_split
from lethe.operators import batching as B
from lethe.operators import losses as L
from lethe.operators import scoring as SC

ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.fixture()
def long_batches(spark):
    before = spark.conf.get(ROWS_KEY)
    spark.conf.set(ROWS_KEY, "10000")
    yield
    spark.conf.set(ROWS_KEY, before)


def _lists(seed):
    g = np.random.default_rng(seed)
    rows = [[f"w{k}" for k in g.integers(0, 6, g.integers(0, 30))] for _ in range(60)]
    rows[7], rows[8] = None, []
    return pa.array(rows, pa.list_(pa.string()))


def test_counts_are_made_in_parts(monkeypatch):
    lists, names = [_lists(k) for k in range(4)], [*SC.COUNT_FIELDS, "lcs"]
    whole, sizes, one = SC.counted(lists, names), [], SC._clipped
    monkeypatch.setattr(SC, "PART_TOKENS", 200)
    monkeypatch.setattr(SC, "_clipped", lambda token, *a: sizes.append(len(token)) or one(token, *a))
    assert SC.counted(lists, names).equals(whole)
    assert max(sizes) <= 200 + 4 * 30 and len(sizes) > 10
    assert len(SC.counted([x.slice(0, 0) for x in lists], names)) == 0


def test_texts_go_to_python_in_short_batches(spark, long_batches):
    df = spark.createDataFrame([("1", "a b", "a c")], "k string, r string, h string")
    SC.text_scores(df, "k", "r", "h")
    assert int(spark.conf.get(ROWS_KEY)) <= 2000
    spark.conf.set(ROWS_KEY, "10000")
    B.token_ids(df, B.vocabulary(df, "r"), "k", "r")
    assert int(spark.conf.get(ROWS_KEY)) <= 2000


def test_first_words_only(spark):
    texts = ["", "  ", "a", " b  c d e ", "f g h i j", "é　è\x85ê ë", None, *[f"x{c}y{c}{c}z" for c in PY_WHITESPACE]]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = df.select("k", py_split("t").alias("a"), py_split("t", 2).alias("b")).orderBy("k").collect()
    for r, t in zip(got, texts):
        assert r["a"] == (None if t is None else t.split())
        assert r["b"] == (None if t is None else t.split()[:2])


def test_each_set_has_files_by_its_own_size(spark, tmp_dir):
    rows = [(f"{i:04d}", "forget" if i < 20 else "retain") for i in range(1000)]
    split = spark.createDataFrame(rows, "id string, `set` string").withColumn("ratio", F.lit(2))
    S.write_id_lists(split, tmp_dir, ids_per_file=20)
    files = lambda s: [f for f in os.listdir(os.path.join(tmp_dir, "ratio=2", f"set={s}")) if f.startswith("part-")]
    assert len(files("forget")) == 1 and len(files("retain")) > 30
    for name, n in (("forget", 20), ("retain", 980)):
        back = S.read_id_list(spark, os.path.join(tmp_dir, "ratio=2", f"set={name}"))
        assert back.count() == back.select("id").distinct().count() == n


def test_answer_loss_reads_labels_once(spark):
    df = spark.createDataFrame([([-100, 5, 7, -100], [1.0, 2.0, 4.0]), (None, [1.0]), ([-100], [])],
                               "y array<bigint>, p array<double>")
    got = df.select(L.answer_loss_expr(F.col("y"), F.col("p"), "ga").alias("v")).collect()
    assert [r["v"] for r in got] == [-1.5, 0.0, 0.0]
    text = L.answer_loss_expr(F.expr("transform(marked, x -> x)"), F.col("p"))._jc.toString()
    assert text.count("marked") == 1
