"""Invariants: exact, disjoint, covering and partition-independent
splits; flatten modes; running losses; scores; plan shapes."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lethe.operators import curate as C
from lethe.operators.losses import epoch_loss, epoch_loss_by_set, running_loss
from lethe.operators.positions import hash_positions, ordered_positions, seeded_hash
from lethe.operators.scoring import text_scores
from lethe.operators.splits import forget_retain_split, holdout_split, shuffled_batches
from lethe.plans.views import v_profile, v_steps
from conftest import SF0001


def _ids(spark, n, parts):
    return spark.range(0, n, numPartitions=parts).select(F.format_string("%05d", "id").alias("id"))


@pytest.mark.parametrize("n", [0, 1, 7, 333])
def test_split_exact_disjoint_covering(spark, n):
    split = forget_retain_split(_ids(spark, n, 3), ratios=[5, 10, 15]).collect()
    for p in (5, 10, 15):
        f = {r["id"] for r in split if r["ratio"] == p and r["set"] == "forget"}
        r = {r["id"] for r in split if r["ratio"] == p and r["set"] == "retain"}
        assert len(f) == int(p / 100 * n)
        assert not f & r and len(f | r) == n


def test_split_stable_across_partitions(spark):
    a = {tuple(r) for r in forget_retain_split(_ids(spark, 500, 1), ratios=[10]).collect()}
    b = {tuple(r) for r in forget_retain_split(_ids(spark, 500, 7).repartition(5), ratios=[10]).collect()}
    assert a == b


def test_split_prefix_one_bucket_each(spark):
    # prefix=1: 16 buckets, so most rows are decided by bucket offsets alone
    a = {tuple(r) for r in forget_retain_split(_ids(spark, 400, 2), ratios=[10], prefix=1).collect()}
    b = {tuple(r) for r in forget_retain_split(_ids(spark, 400, 2), ratios=[10], prefix=3).collect()}
    assert a == b


def test_split_counts_every_row(spark):
    """Null and repeated ids are profiles too: 12 rows, half of them forgotten."""
    ids = spark.createDataFrame([(x,) for x in [None] * 4 + ["a"] * 3 + ["b", "c", "d", "e", "f"]], "id string")
    for rows in (forget_retain_split(ids, ratios=[50]).collect(), holdout_split(ids, forget_fraction=0.5).collect()):
        assert sum(r["set"] == "forget" for r in rows) == 6
        assert sorted((r["id"] or "") for r in rows) == sorted((r[0] or "") for r in ids.collect())


def test_nested_split(spark):
    s = forget_retain_split(_ids(spark, 300, 2), ratios=[5, 10], nested=True).where("set = 'forget'").collect()
    f5 = {r["id"] for r in s if r["ratio"] == 5}
    f10 = {r["id"] for r in s if r["ratio"] == 10}
    assert f5 <= f10


def test_positions_are_a_permutation(spark):
    x = _ids(spark, 1000, 4).withColumn("h", seeded_hash(1, F.col("id")))
    pos = sorted(r["pos"] for r in hash_positions(x, "h", ["id"]).collect())
    assert pos == list(range(1000))
    op = ordered_positions(_ids(spark, 1000, 4), ["id"], "p").orderBy("id").collect()
    assert [r["p"] for r in op] == list(range(1000))


def test_batches_cover(spark):
    b = shuffled_batches(_ids(spark, 103, 3), ["id"], batch_size=4, epochs=[0, 1]).collect()
    for e in (0, 1):
        rows = [r for r in b if r["epoch"] == e]
        assert sorted(r["pos"] for r in rows) == list(range(103))
        assert max(r["batch_id"] for r in rows) == 25


def test_loose_contains_strict(spark):
    p = v_profile(spark, SF0001)
    strict = {(r["ID"], r["pos"]) for r in C.flatten_qa(p, "strict").collect()}
    loose = {(r["ID"], r["pos"]) for r in C.flatten_qa(p, "loose").collect()}
    assert strict <= loose


def test_running_mean_ends_at_epoch_mean(spark):
    # Each row a step of its own, each group a name.
    steps = v_steps(spark, SF0001).withColumn("step", F.monotonically_increasing_id()).fillna("none", ["run", "set"])\
        .fillna(-1, ["epoch"])
    last = (running_loss(steps, block=64).groupBy("run", "epoch", "set")
            .agg(F.max_by("running_mean", "step").alias("last"), F.max_by("progress_loss", "step").alias("prog")))
    means = epoch_loss(steps, ["run", "epoch", "set"])
    for r in last.join(means, ["run", "epoch", "set"]).collect():
        assert r["last"] == pytest.approx(r["epoch_loss"], nan_ok=True)
        assert r["prog"] == pytest.approx(r["epoch_loss"], nan_ok=True)


def test_running_loss_of_diverging_run(spark):
    inf, nan = float("inf"), float("nan")
    runs = {"a": [1.0, nan, 2.0], "b": [1.0, inf, 1.0, -inf, 1.0], "c": [1e21, 1.0, -1e21, 0.25], "d": [-inf, 1.0]}
    rows = [(k, 0, "forget", i, x) for k, v in runs.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "run string, epoch int, `set` string, step long, loss double")
    got = {(r["run"], r["step"]): r["running_mean"] for r in running_loss(df, block=2).collect()}
    for k, v in runs.items():
        total = 0.0
        for i, x in enumerate(v):
            total += x
            if k == "c":
                want = [1e21, 5e20, 1 / 3, 0.3125][i]  # the small values stay exact beside the large
            else:
                want = total / (i + 1)
            assert got[k, i] == pytest.approx(want, nan_ok=True), (k, i)


def test_epoch_loss_by_set_keeps_divided_losses(spark):
    df = spark.createDataFrame([("r", 0, "forget", 4.0, 2), ("r", 0, "retain", 6.0, 4)],
                               "run string, epoch int, `set` string, loss double, accum int")
    r = epoch_loss_by_set(df).first()
    assert (r["forget_loss"], r["retain_loss"]) == (-4.0, 6.0)


def test_positions_move_keys_only(spark):
    """The order of batches is made from keys; token arrays join it once."""
    rows = _ids(spark, 200, 2).withColumn("payload", F.array_repeat(F.lit(1), 50))
    plan = shuffled_batches(rows, ["id"], epochs=[0])._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window" in x]
    assert windows and not any("payload" in x for x in windows)
    assert plan.count("payload") <= 8


def test_lcs_of_many_pairs_at_once(monkeypatch):
    """Pairs of all lengths, null and empty ones, also in small groups."""
    import random

    import pyarrow as pa

    from lethe.operators import lcs
    from lethe.operators.scoring import numbered
    r = random.Random(5)
    text = lambda: [r.choice("abcdefgh"[:r.choice([1, 2, 8])]) for _ in range(r.choice([0, 1, 2, 5, 63, 64, 65, 130, 300]))]
    pairs = [(text(), text()) for _ in range(150)] + [(None, ["a"]), (["a"], None), (["x"] * 2000, ["x"] * 1500), ([], [])]

    def table(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
            row = new
        return row[-1]

    want = [table(a or [], b or []) if max(len(a or []), len(b or [])) < 1000 else 1500 for a, b in pairs]
    token, ref_at, hyp_at = numbered(*(pa.array(x, pa.list_(pa.string())) for x in zip(*pairs)))
    for size in (lcs.GROUP_BYTES, 5000):
        monkeypatch.setattr(lcs, "GROUP_BYTES", size)
        assert lcs.lcs_lengths(token[:ref_at[-1]], ref_at, token[ref_at[-1]:], hyp_at).tolist() == want


def test_clipped_counts_brute_force():
    import random
    from collections import Counter

    from lethe.operators.scoring import clipped_counts
    r = random.Random(3)
    texts = lambda: [[r.choice("abc") for _ in range(r.randrange(9))] for _ in range(60)]
    refs, hyps = texts(), texts()
    got = clipped_counts(refs, hyps, (1, 2, 3, 4))
    for n in (1, 2, 3, 4):
        grams = lambda x: Counter(tuple(x[i:i + n]) for i in range(len(x) - n + 1))
        assert got[n].tolist() == [sum((grams(a) & grams(b)).values()) for a, b in zip(refs, hyps)]
    assert clipped_counts([], [], (1, 2))[2].tolist() == []
    assert clipped_counts([()], [()], (1, 2))[2].tolist() == [0]


def test_label_masking_time_follows_length(spark):
    """Prompt masking of a long dialog of many turns is not quadratic."""
    import time

    from lethe.operators import batching as B
    def seconds(turns):
        seq = [B.HEADER_START_ID, B.USER_ROLE_ID, B.HEADER_END_ID, 5, B.END_OF_TURN_ID] * turns
        df = spark.createDataFrame([(seq,)], "ids array<int>").select(F.size(B.mask_prompt_spans(F.col("ids"))).alias("n"))
        df.collect()
        t = time.perf_counter()
        assert df.first()["n"] == len(seq)
        return time.perf_counter() - t
    seconds(10)
    assert seconds(16_000) < 12 * seconds(4_000) + 2


words = st.lists(st.sampled_from(["a", "b", "c", "the", "cat", "mat", "sat"]), min_size=0, max_size=12)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(words, words), min_size=1, max_size=8))
def test_score_bounds(spark, pairs):
    rows = [(i, " ".join(a), " ".join(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k int, r string, h string")
    for r in text_scores(df, "k", "r", "h", rouge_l=True).collect():
        for m in ("bleu", "rouge1", "rouge2", "rougeL"):
            assert 0.0 <= r[m] <= 1.0 + 1e-12
        assert r["rougeL"] <= r["rouge1"] + 1e-12
        if r["r"] == r["h"] and len(r["r"].split()) >= 4:
            assert r["bleu"] == pytest.approx(1.0)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BOUNDED_KEYS = {"_bucket", "_pid", "ratio", "epoch", "_blk"}


def _single_partition_inputs_are_bounded(plan: str) -> bool:
    """Every single-partition exchange must sit on an aggregate keyed only
    by bucket/partition columns (a table of at most groups x 4096 rows),
    never on data-sized input."""
    import re
    lines = plan.split("\n")
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            child = lines[i + 1]
            m = re.search(r"HashAggregate\(keys=\[([^\]]*)\]", child)
            if not m:
                return False
            keys = {k.strip().split("#")[0] for k in m.group(1).split(",") if k.strip()}
            if not keys or not keys <= BOUNDED_KEYS:
                return False
    return True


@pytest.mark.parametrize("build", ["split", "holdout", "batches", "positions"])
def test_no_single_partition_on_data(spark, build):
    from lethe.operators.splits import holdout_split
    ids = _ids(spark, 300, 3)
    df = {"split": lambda: forget_retain_split(ids, ratios=[5, 10]),
          "holdout": lambda: holdout_split(ids),
          "batches": lambda: shuffled_batches(ids, ["id"], batch_size=4, epochs=[0, 1]),
          "positions": lambda: ordered_positions(ids, ["id"], "p")}[build]()
    assert _single_partition_inputs_are_bounded(_plan(df))


def test_token_ids_head_tail_split(spark):
    from lethe.operators import batching as B
    from lethe.plans.views import v_docs
    docs = v_docs(spark, SF0001)
    vocab = B.vocabulary(docs)
    rows = lambda df: sorted(((r["example_id"], r["input_ids"]) for r in df.collect()), key=str)  # ids repeat or are missing
    a = rows(B.token_ids(docs, vocab, "example_id"))
    b = rows(B.token_ids(docs, vocab, "example_id", broadcast_bytes=5000))
    assert a == b and len(a) == docs.count()
    texts = [x for _, x in a]
    assert [] in texts and max(map(len, texts)) > 384  # empty texts stay, long ones are whole


def test_rows_of_one_key_stay_apart(spark):
    """Two texts on one key, and two without: a row and a place each."""
    from lethe.operators import batching as B
    rows = [("x", "a b c"), ("x", "d e"), (None, "f"), (None, None), ("y", "a b c")]
    df = spark.createDataFrame(rows, "k string, text string")
    ids = B.token_ids(df, B.vocabulary(df), "k")
    assert sorted((r["k"] or "", len(r["input_ids"])) for r in ids.collect()) == [("", 0), ("", 1), ("x", 2), ("x", 3), ("y", 3)]
    out = shuffled_batches(ids.withColumn("n", F.size("input_ids")), ["k"], batch_size=2, epochs=[0, 1], size_col="n")
    got = out.collect()
    assert len(got) == 10
    for e in (0, 1):
        assert sorted(r["pos"] for r in got if r["epoch"] == e) == list(range(5))
    for r in got:
        assert r["batch_len"] == max(len(x["input_ids"]) for x in got if (x["epoch"], x["batch_id"]) == (r["epoch"], r["batch_id"]))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 120, 1001])
def test_permutation_is_a_bijection(spark, n):
    from lethe.operators.positions import permutation_keys, permute
    keys = F.array(*[F.struct(F.lit(e).alias("e"), F.array(*[F.lit(k).cast("long") for k in permutation_keys(7, e)]).alias("ks"))
                     for e in range(4)])
    x = spark.range(n).withColumn("n", F.lit(n)).withColumn("p", F.explode(keys)).select("id", "n", "p.*")
    got = {}
    for r in permute(x, "id", "n", "ks", "to").collect():
        got.setdefault(r["e"], {})[r["id"]] = r["to"]
    for order in got.values():
        assert sorted(order.values()) == list(range(n))
    if n > 100:
        assert len({tuple(sorted(o.items())) for o in got.values()}) == 4
        for o in got.values():
            # Neither kept nor merely turned round: neighbours part, no place is favoured.
            assert sum(abs(o[i] - o[i + 1]) == 1 for i in range(n - 1)) < n / 10
            assert abs(sum(o[i] for i in range(n // 2)) / (n // 2) - n / 2) < n / 8


def test_epochs_need_no_sort_each(spark):
    from lethe.operators.splits import epoch_batches
    df = spark.createDataFrame([(i % 7, i) for i in range(50)], "k int, v int")
    few, many = (_plan(epoch_batches(df, ["k"], epochs=range(n))) for n in (1, 30))
    assert few.count("Exchange") == many.count("Exchange") and few.count("Window") == many.count("Window")
    assert few.count("Sort") == many.count("Sort")
    out = epoch_batches(df, ["k"], batch_size=4, epochs=range(3)).collect()
    for e in range(3):
        assert sorted((r["batch_id"] * 4 + r["slot"]) for r in out if r["epoch"] == e) == list(range(50))
        assert sorted(r["v"] for r in out if r["epoch"] == e) == list(range(50))


def test_running_loss_keeps_rows_without_keys(spark):
    """Null groups and steps, equal and far apart steps, blocks that cut through all of them."""
    rows = [(run, e, "forget", s, float(i % 5)) for i, (run, e, s) in enumerate(
        [(None, 1, 3), (None, 1, None), (None, None, 2), ("a", 1, None), ("a", 1, None)] * 3 + [("a", 1, 7)] * 40
        + [("b", 2, 10 ** 12 * i) for i in range(30)])]
    df = spark.createDataFrame(rows, "run string, epoch int, `set` string, step long, loss double")
    for block in (None, 4, 1000):
        got = running_loss(df, block=block).collect()
        assert len(got) == len(rows)
        for key in {r[:3] for r in rows}:
            mine = sorted((r for r in rows if r[:3] == key), key=lambda r: (r[3] is not None, r[3] or 0, r[4]))
            want = [(r[3], sum(x[4] for x in mine[:i + 1]) / (i + 1), sum(x[4] for x in mine[:i + 1]) / len(mine))
                    for i, r in enumerate(mine)]
            have = [(r["step"], r["running_mean"], r["progress_loss"]) for r in got if (r["run"], r["epoch"], r["set"]) == key]
            assert sorted(have, key=str) == sorted(want, key=str)


def test_cluster_conf_sizes_partitions():
    from lethe.session import MAX_SHUFFLE_PARTITIONS, cluster_conf
    c = cluster_conf(100 << 40, executors=1000)
    assert int(c["spark.sql.shuffle.partitions"]) == MAX_SHUFFLE_PARTITIONS
    assert int(cluster_conf(1 << 40, executors=100)["spark.sql.shuffle.partitions"]) == 12289
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true"
    assert int(cluster_conf(1 << 20, executors=10)["spark.sql.shuffle.partitions"]) == 80
