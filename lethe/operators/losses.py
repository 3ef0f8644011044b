"""Loss bookkeeping and unlearning objectives over logged model outputs
(A6, A7, E1, E2, L1-L5, J10).

The training side writes step losses, per-example losses of the current
and the frozen model, per-token losses and logits as tables; these
functions audit and compare objectives on them.  Per-row math runs on
array columns with higher-order functions; sums per epoch/batch are
ordinary partial aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lethe.functions.arrays import let
from lethe.operators.positions import running_totals

# Logits handled at once by the KL function.
KL_CELLS = 1 << 21

# NPO inverse temperature default and the ignored label.
NPO_BETA = 0.4
IGNORE_INDEX = -100


def signed_loss(steps: DataFrame, undo_accum: bool = False) -> DataFrame:
    """L1: gradient ascent on forget rows: ``-loss`` for ``set='forget'``;
    divided by the accumulation steps, or multiplied back when the logged
    loss was already divided (``undo_accum``)."""
    acc = F.greatest(F.coalesce(F.col("accum"), F.lit(1)), F.lit(1)).cast("double")
    sign = F.when(F.col("set") == "forget", F.lit(-1.0)).otherwise(F.lit(1.0))
    scaled = F.col("loss") * acc if undo_accum else F.col("loss") / acc
    return steps.withColumn("signed_loss", sign * scaled)


def epoch_loss(steps: DataFrame, group_cols: Sequence[str] = ("run", "epoch"),
               loss_col: str = "loss") -> DataFrame:
    """Sum of the step losses / number of steps, per epoch."""
    return steps.groupBy(*group_cols).agg(
        (F.sum(loss_col) / F.count(F.lit(1))).alias("epoch_loss"), F.count(F.lit(1)).alias("n_steps"))


def epoch_loss_by_set(steps: DataFrame, group_cols: Sequence[str] = ("run", "epoch")) -> DataFrame:
    """The epoch loss of the forget set (ascent sign) and of the
    retain set side by side; an absent set gives NULL.  The logged loss is
    already divided by the accumulation steps: only its sign changes."""
    sign = F.when(F.col("set") == "forget", F.lit(-1.0)).otherwise(F.lit(1.0))
    s = steps.withColumn("_signed", sign * F.col("loss"))
    return (s.groupBy(*group_cols).pivot("set", ["forget", "retain"]).agg(F.avg("_signed"))
            .withColumnRenamed("forget", "forget_loss").withColumnRenamed("retain", "retain_loss"))


def running_loss(steps: DataFrame, group_cols: Sequence[str] = ("run", "epoch", "set"),
                 order_col: str = "step", loss_col: str = "loss", block: int | None = None) -> DataFrame:
    """E1 + E2: per step the running mean (sum so far / steps so far) and
    the progress loss (sum so far / steps in the epoch).  A null run, epoch or
    set is one of its own; null steps stand first, equal steps follow one
    another by their loss.  ``block``: rows that a block holds, about (the
    rows are counted for it; else the session's shuffle partitions are the
    blocks)."""
    blocks = None if block is None else max(1, steps.count() // int(block))
    r = running_totals(steps, list(group_cols), order_col, loss_col, (loss_col,), blocks)
    return (r.withColumn("running_mean", F.col("_rsum") / F.col("_rcnt"))
            .withColumn("progress_loss", F.col("_rsum") / F.col("_gcnt"))
            .drop("_rsum", "_rcnt", "_gcnt"))


def _softplus(z: Column) -> Column:
    """log(1 + exp(z)) without overflow."""
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def npo_loss_expr(current: Column, oracle: Column, beta: float = NPO_BETA) -> Column:
    """L2 per example: ``-logsigmoid(beta * (current - oracle)) * 2 / beta``,
    i.e. ``(2/beta) * softplus(-beta * (current - oracle))``."""
    x = F.lit(float(beta)) * (current - oracle)
    return _softplus(-x) * F.lit(2.0 / float(beta))


def pair_with_oracle(current: DataFrame, oracle: DataFrame, key: str = "example_id") -> DataFrame:
    """Current and frozen-model losses of the same example (equi join)."""
    o = oracle.select(F.col(key), F.col("loss").alias("oracle_loss"))
    return current.withColumnRenamed("loss", "current_loss").join(o, key)


def npo_loss(pairs: DataFrame, group_cols: Sequence[str] = ("batch_id",),
             beta: float = NPO_BETA) -> DataFrame:
    """L2: mean NPO loss per group (a batch in training)."""
    return (pairs.withColumn("_npo", npo_loss_expr(F.col("current_loss"), F.col("oracle_loss"), beta))
            .groupBy(*group_cols).agg(F.avg("_npo").alias("npo_loss"), F.count(F.lit(1)).alias("n")))


def kl_rows(current: np.ndarray, original: np.ndarray) -> np.ndarray:
    """L3 of each row of two matrices of logits: sum_i q_i (log q_i - log p_i),
    p = softmax(current), q = softmax(original)."""
    def log_softmax(x):
        x = x - x.max(axis=1, keepdims=True)
        return x - np.log(np.exp(x).sum(axis=1, keepdims=True))
    lp, lq = log_softmax(current), log_softmax(original)
    return (np.exp(lq) * (lq - lp)).sum(axis=1)


@F.pandas_udf(DoubleType())
def kl_row_expr(current_logits: pd.Series, original_logits: pd.Series) -> pd.Series:
    """L3 per position, a matrix per batch and row length.  Null logits, or
    rows of two lengths, give null; empty rows 0."""
    out = np.full(len(current_logits), np.nan)
    null = np.ones(len(out), bool)
    size = np.array([-1 if a is None or b is None or len(a) != len(b) else len(a)
                     for a, b in zip(current_logits, original_logits)])
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        null[at] = False
        # A part at a time: a row can have the width of a vocabulary.
        for part in np.array_split(at, max(1, -(-len(at) * max(1, int(n)) // KL_CELLS))):
            if n == 0:
                out[part] = 0.0
            elif len(part):
                out[part] = kl_rows(np.stack(current_logits.iloc[part].to_list()).astype(float),
                                    np.stack(original_logits.iloc[part].to_list()).astype(float))
    return pd.Series(out).astype(object).where(~null, None)


def kl_retain(logits: DataFrame, group_cols: Sequence[str] = ("batch_id",), cur: str = "logits",
              orig: str = "orig_logits", example_col: str = "example_id") -> DataFrame:
    """L3: batchmean KL: the sum over every position of the batch (padding
    included, as in the benchmark) divided by the number of examples."""
    return (logits.withColumn("_kl", kl_row_expr(F.col(cur), F.col(orig)))
            .groupBy(*group_cols)
            .agg((F.sum("_kl") / F.count_distinct(example_col)).alias("kl"),
                 F.count_distinct(example_col).alias("n_examples")))


def retain_total(kl: DataFrame, ce: DataFrame, key: str = "batch_id", accum: int = 1) -> DataFrame:
    """L4: cross-entropy + KL per batch (divided by accumulation steps)."""
    return (kl.join(ce.select(key, F.col("loss").alias("ce_loss")), key)
            .withColumn("retain_loss", (F.col("ce_loss") + F.col("kl")) / F.lit(float(accum))))


def answer_loss_expr(labels: Column, position_loss: Column, operation: str = "gd") -> Column:
    """L5 per sequence: next-token losses weighted over the answer part
    (positions whose next label is not -100), weights normalised; ``ga``
    negates.  A sequence without answer tokens contributes 0."""
    if operation not in ("ga", "gd"):
        raise ValueError(f"operation {operation!r}: expected 'ga' (ascent) or 'gd' (descent)")
    add = lambda s, t: s + t

    def mean(w):
        num = F.aggregate(F.zip_with(w, position_loss, lambda a, b: a * F.coalesce(b, F.lit(0.0))), F.lit(0.0), add)
        return let(F.aggregate(w, F.lit(0.0), add), lambda den: F.when(den > 0, num / den).otherwise(F.lit(0.0)))

    # Labels and weights, expressions over whole sequences, are evaluated once.
    nxt = let(labels, lambda y: F.slice(y, 2, F.greatest(F.size(y) - 1, F.lit(0))))
    val = let(F.transform(nxt, lambda y: F.when(y != IGNORE_INDEX, F.lit(1.0)).otherwise(F.lit(0.0))), mean)
    return -val if operation == "ga" else val


def answer_loss(tokens: DataFrame, operation: str = "gd", group_cols: Sequence[str] = (),
                labels: str = "labels", position_loss: str = "position_loss") -> DataFrame:
    """Mean over sequences (per group, e.g. batch) of the answer loss."""
    x = tokens.withColumn("_al", answer_loss_expr(F.col(labels), F.col(position_loss), operation))
    return x.groupBy(*group_cols).agg(F.avg("_al").alias("answer_loss"), F.count(F.lit(1)).alias("n"))
