"""The live epoch-loss stream over a step log that grows between batches."""

import os


from lethe import schemas
from lethe.operators.losses import epoch_loss_by_set
from lethe.streaming import start_epoch_loss_query


def _append(spark, folder, rows):
    spark.createDataFrame(rows, schemas.STEP_LOG).write.mode("append").parquet(folder)


def test_epoch_loss_stream(spark, tmp_dir):
    log = os.path.join(tmp_dir, "log")
    out = os.path.join(tmp_dir, "out")
    _append(spark, log, [("r", 0, "forget", i, float(i), 1) for i in range(4)])
    q = start_epoch_loss_query(spark, log, out, name="t_epoch_loss")
    try:
        q.processAllAvailable()
        first = {(r["epoch"], r["set"]): r["running_loss"] for r in spark.read.parquet(out).collect()}
        assert first == {(0, "forget"): -1.5}
        _append(spark, log, [("r", 0, "retain", i, 2.0, 1) for i in range(3)]
                + [("r", 0, "forget", 10, 4.0, 1)])
        q.processAllAvailable()
        got = {(r["epoch"], r["set"]): r["running_loss"] for r in spark.read.parquet(out).collect()}
    finally:
        q.stop()
    assert got == {(0, "forget"): -2.0, (0, "retain"): 2.0}
    batch = epoch_loss_by_set(spark.read.parquet(log)).first()
    assert batch["forget_loss"] == got[(0, "forget")] and batch["retain_loss"] == got[(0, "retain")]


def test_epoch_loss_stream_restarts_from_checkpoint(spark, tmp_dir):
    log = os.path.join(tmp_dir, "log2")
    out = os.path.join(tmp_dir, "out2")
    _append(spark, log, [("r", 1, "retain", i, 1.0, 1) for i in range(5)])
    q = start_epoch_loss_query(spark, log, out, name="t_restart")
    q.processAllAvailable()
    q.stop()
    # new steps arrive while the query is down; the restarted query
    # resumes from its checkpoint and counts every step once
    _append(spark, log, [("r", 1, "retain", 10 + i, 4.0, 1) for i in range(5)])
    q = start_epoch_loss_query(spark, log, out, name="t_restart")
    try:
        q.processAllAvailable()
        r = spark.read.parquet(out).first()
    finally:
        q.stop()
    assert (r["n_steps"], r["loss_sum"], r["running_loss"]) == (10, 25.0, 2.5)
