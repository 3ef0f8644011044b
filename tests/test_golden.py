"""Golden values (FIXTURES.md section 3)."""

import math

import pytest
from pyspark.sql import functions as F

from lethe.functions.prompts import mcq_prompt
from lethe.functions.text import extract_response, option_letter
from lethe.operators import batching as B
from lethe.operators import losses as L
from lethe.operators.lcs import lcs_len
from lethe.operators.scoring import text_scores
from lethe.operators.splits import forget_retain_split, shuffled_batches

BLEU_ROUGE = [
    ("the cat sat on the mat", "the cat sat on the mat", 1.0, 1.0, 1.0, 1.0),
    ("the cat sat on the mat", "the cat is on a mat", 0.102669, 0.666667, 0.2, 0.666667),
    ("Jane works as a doctor in Oslo.", "She is a doctor", 0.080257, 0.363636, 0.222222, 0.363636),
    ("a b c", "x y z", 0.0, 0.0, 0.0, 0.0),
    ("a b c", "", 0.0, 0.0, 0.0, 0.0),
]


def test_bleu_rouge(spark):
    df = spark.createDataFrame([(i, r, h) for i, (r, h, *_) in enumerate(BLEU_ROUGE)], "k int, ref string, hyp string")
    out = {r["k"]: r for r in text_scores(df, "k", "ref", "hyp", rouge_l=True).collect()}
    for i, (_, _, bleu, r1, r2, rl) in enumerate(BLEU_ROUGE):
        row = out[i]
        assert round(row["bleu"], 6) == bleu
        assert round(row["rouge1"], 6) == r1
        assert round(row["rouge2"], 6) == r2
        assert round(row["rougeL"], 6) == rl


def test_lcs():
    assert lcs_len("abcbdab", "bdcaba") == 4
    assert lcs_len([], ["a"]) == 0
    assert lcs_len(["x"] * 200, ["x"] * 150) == 150


def test_npo(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 1.0), (1.0, 2.0)], "c double, o double")
    got = [round(r[0], 6) for r in df.select(L.npo_loss_expr(F.col("c"), F.col("o"))).collect()]
    assert got == [3.465736, 2.565076, 4.565076]


def test_kl(spark):
    df = spark.createDataFrame([(0, "e", [0.0, 1.0, 2.0], [2.0, 1.0, 0.0])],
                               "batch_id int, example_id string, logits array<double>, orig_logits array<double>")
    assert round(L.kl_retain(df).first()["kl"], 6) == 1.150421


def test_answer_loss(spark):
    df = spark.createDataFrame([([-100, -100, 12, 13], [0.5, 1.0, 3.0])], "labels array<int>, position_loss array<double>")
    assert L.answer_loss(df, "gd").first()["answer_loss"] == pytest.approx(2.0)
    assert L.answer_loss(df, "ga").first()["answer_loss"] == pytest.approx(-2.0)
    with pytest.raises(ValueError):
        L.answer_loss_expr(F.col("labels"), F.col("position_loss"), "xx")


@pytest.mark.parametrize("n,expected", [(500, (25, 50, 75)), (100, (5, 10, 15)), (20, (1, 2, 3)),
                                        (7, (0, 0, 1)), (1500, (75, 150, 225))])
def test_forget_sizes(spark, n, expected):
    ids = spark.range(n).select(F.col("id").cast("string").alias("id"))
    split = forget_retain_split(ids, ratios=[5, 10, 15])
    got = {r["ratio"]: r["count"] for r in split.where("set = 'forget'").groupBy("ratio").count().collect()}
    assert tuple(got.get(p, 0) for p in (5, 10, 15)) == expected
    assert split.count() == 3 * n


def test_batches(spark):
    rows = spark.createDataFrame([(str(i),) for i in range(5)], "id string")
    b = shuffled_batches(rows, ["id"], batch_size=2)
    sizes = sorted(r["count"] for r in b.groupBy("batch_id").count().collect())
    assert sizes == [1, 2, 2]


@pytest.mark.parametrize("text,expected", [
    ("a ASSISTANT:  \n\tb  ASSISTANT: c", "b"), ("Answer: x", "x"), ("", "")])
def test_extract_response(spark, text, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(extract_response("t")).first()[0] == expected


@pytest.mark.parametrize("resp,expected", [("b) foo", "B"), ("E", None), ("", None)])
def test_option_letter(spark, resp, expected):
    df = spark.createDataFrame([(resp, {"A": "x", "B": "y"})], "r string, o map<string,string>")
    assert df.select(option_letter("r", "o")).first()[0] == expected


def test_mcq_prompt(spark):
    df = spark.createDataFrame([("q", {"A": "x", "B": "y"})], "q string, o map<string,string>")
    assert df.select(mcq_prompt("q", "o")).first()[0] == "q\nA: x\nB: y"
    assert df.select(mcq_prompt("q", "o", llama=True)).first()[0] == "q\n####Choices:\nA: x\nB: y"


def test_json_to_token(spark):
    df = spark.createDataFrame([(1, ["x", "y"])], "b int, a array<string>")
    col = F.struct("b", "a")
    assert df.select(B.json_to_token(col, df.schema)).first()[0] == "<s_b>1</s_b><s_a>x<sep/>y</s_a>"
    assert df.select(B.json_to_token(col, df.schema, sort_keys=False)).first()[0] == "<s_b>1</s_b><s_a>x<sep/>y</s_a>"
    t = spark.createDataFrame([(("hello",),)], "s struct<text_sequence: string>")
    assert t.select(B.json_to_token(F.col("s"), t.schema["s"].dataType)).first()[0] == "hello"


def test_mask_labels(spark):
    df = spark.createDataFrame([([5, 6, 0],)], "ids array<int>")
    assert df.select(B.mask_labels(F.col("ids"))).first()[0] == [5, 6, -100]


X17 = [
    ([128006, 882, 128007, 5, 6, 128009, 128006, 78191, 128007, 7, 128009, 0, 0],
     [-100] * 9 + [7, 128009, -100, -100]),
    ([128006, 9125, 128007, 1, 128009, 128006, 882, 128007, 2, 128009, 128006, 78191, 128007, 3, 128009,
      128006, 882, 128007, 4],
     [-100] * 13 + [3, 128009, 128006, 882, 128007, 4]),
    ([9, 128009, 8, 128006, 78191, 128007], [9, 128009, 8, 128006, 78191, 128007]),
    ([], []),
]


def _x17_reference_restated(ids, pad=0):
    """Plain-Python restatement of the loop (for the property test)."""
    labels = list(ids)
    eots = [i for i, n in enumerate(labels) if n == 128009]
    last = 0
    for idx in eots:
        cur = labels[last:idx + 1]
        if any(cur[i:i + 3] in ([128006, 9125, 128007], [128006, 882, 128007]) for i in range(len(cur) - 3)):
            labels[last:idx + 1] = [-100] * (idx - last + 1)
        else:
            last = idx + 1
    for i in range(len(labels) - 3):
        if labels[i:i + 3] == [128006, 78191, 128007]:
            labels[i:i + 3] = [-100] * 3
    return [-100 if x in (pad, 128256) else x for x in labels]


@pytest.mark.parametrize("ids,expected", X17)
def test_mask_prompt_spans(spark, ids, expected):
    df = spark.createDataFrame([(ids,)], "ids array<int>")
    assert df.select(B.mask_prompt_spans(F.col("ids"))).first()[0] == expected
    assert _x17_reference_restated(ids) == expected


def test_mask_prompt_spans_random(spark):
    import random
    rnd = random.Random(7)
    alphabet = [128006, 882, 9125, 78191, 128007, 128009, 0, 5, 6, 128256]
    seqs = [[rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))] for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "i int, ids array<int>")
    got = {r["i"]: r["l"] for r in df.select("i", B.mask_prompt_spans(F.col("ids")).alias("l")).collect()}
    for i, s in enumerate(seqs):
        assert got[i] == _x17_reference_restated(s), s


def test_running_losses(spark):
    df = spark.createDataFrame([("r", 0, "forget", i, float(i + 1)) for i in range(3)],
                               "run string, epoch int, set string, step long, loss double")
    rows = sorted(L.running_loss(df, block=2).collect(), key=lambda r: r["step"])
    assert [round(r["running_mean"], 6) for r in rows] == [1.0, 1.5, 2.0]
    assert [round(r["progress_loss"], 6) for r in rows] == [0.333333, 1.0, 2.0]


def test_softplus_stable(spark):
    df = spark.createDataFrame([(1000.0, 0.0), (-1000.0, 0.0)], "c double, o double")
    vals = [r[0] for r in df.select(L.npo_loss_expr(F.col("c"), F.col("o"))).collect()]
    assert all(math.isfinite(v) for v in vals)


def test_null_texts_score_zero(spark):
    df = spark.createDataFrame([(0, None, "a b"), (1, "a b", None)], "k int, r string, h string")
    for r in text_scores(df, "k", "r", "h", rouge_l=True).collect():
        assert (r["bleu"], r["rouge1"], r["rouge2"], r["rougeL"]) == (0.0, 0.0, 0.0, 0.0)
