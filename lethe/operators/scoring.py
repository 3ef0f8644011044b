"""Scoring model outputs: answer letters, accuracy, BLEU, ROUGE.

A reference and its prediction sit in one row, so n-gram overlap is
row-local: no gram is exploded or shuffled, and scoring is a map-only
stage before the per-set aggregates.  Tokens are built in the JVM
(split, lower, regex); the clipped n-gram counts (and the LCS for
ROUGE-L) are one Arrow UDF over whole batches, without a loop over rows.
The formulas stay in Column expressions.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.functions.text import extract_response, option_letter, py_split
from lethe.operators.lcs import lcs_lengths
from lethe.session import short_batches

# BLEU-4 with uniform weights and "method 1" smoothing.
BLEU_MAX_N = 4
BLEU_EPSILON = 0.1
# ROUGE orders reported besides ROUGE-L.
ROUGE_NS = (1, 2)
# Tokens that are counted at once, besides the last row's: some working arrays
# of numbers are as long.
PART_TOKENS = 1 << 18


def score_mcq(df: DataFrame, text_col: str = "generated_text", options_col: str = "Options",
              answer_col: str = "Correct_Answer") -> DataFrame:
    """X7 + X8: adds ``response``, ``predicted`` and ``correct`` (0/1)."""
    return (df.withColumn("response", extract_response(text_col))
            .withColumn("predicted", option_letter("response", options_col))
            .withColumn("correct", F.when(F.col("predicted").eqNullSafe(F.col(answer_col)), 1)
                        .otherwise(0)))


def mcq_accuracy(scored: DataFrame, group_cols: Sequence[str], domain: DataFrame | None = None) -> DataFrame:
    """A3: ``100 * correct / total`` per group, 0 for a group without
    questions (groups listed in ``domain`` are always reported)."""
    agg = scored.groupBy(*group_cols).agg(F.sum("correct").cast("long").alias("n_correct"),
                                          F.count(F.lit(1)).alias("n_total"))
    if domain is not None:
        agg = domain.join(agg, list(group_cols), "left").fillna(0, ["n_correct", "n_total"])
    acc = F.when(F.col("n_total") > 0, F.col("n_correct") * 100.0 / F.col("n_total")).otherwise(F.lit(0.0))
    return agg.withColumn("accuracy", acc)


# ----------------------------------------------------------------------------
# Tokens and n-grams

def rouge_tokens(col) -> Column:
    """ROUGE tokenizer without stemming: lower case, every run of
    characters outside [a-z0-9] is a separator.  Separators at the ends
    are trimmed first, so no empty token needs filtering (no lambda)."""
    c = F.col(col) if isinstance(col, str) else col
    t = F.regexp_replace(F.lower(c), "^[^a-z0-9]+|[^a-z0-9]+$", "")
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[^a-z0-9]+"))


def numbered(refs: pa.Array, hyps: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of tokens as numbers: the tokens of all references, then of all
    predictions, and where the lists begin and end in either; a null list has
    no tokens."""
    flat = pa.chunked_array([refs.flatten(), hyps.flatten()]).combine_chunks()
    flat = pa.concat_arrays(flat.chunks) if isinstance(flat, pa.ChunkedArray) else flat
    token = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    at = [np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(x), 0).to_numpy())]).astype(np.int64)
          for x in (refs, hyps)]
    return token, at[0], at[1]


def clipped_counts(refs, hyps, orders: Sequence[int]) -> dict[int, np.ndarray]:
    """``_clipped`` of lists of tokens."""
    lists = [pa.array([None if x is None else list(x) for x in side], pa.list_(pa.string())) for side in (refs, hyps)]
    return _clipped(*numbered(*lists), orders)


def _clipped(token: np.ndarray, ref_at: np.ndarray, hyp_at: np.ndarray, orders: Sequence[int]) -> dict[int, np.ndarray]:
    """Per order n, for each row the sum over distinct n-grams of
    min(count in reference, count in prediction); tokens as ``numbered``
    gives them.

    All rows at once: an n-gram is the number of its pair (n-1-gram, last
    token), and (row, gram) pairs are counted by one sort a side."""
    rows = len(ref_at) - 1
    text = np.repeat(np.arange(2 * rows), np.concatenate([np.diff(ref_at), np.diff(hyp_at)]))
    gram, out = token, {}
    for n in range(1, max(orders) + 1):
        if n > 1:
            if len(token) < n:
                gram = gram[:0]
            else:
                # Grams that run over a text's end are left out by ``inside``.
                pair = gram[:len(token) - n + 1] * (len(token) + 1) + token[n - 1:]
                gram = np.unique(pair, return_inverse=True)[1].ravel()
        m = len(gram)
        inside = text[:m] == text[n - 1:n - 1 + m]
        key = text[:m][inside] * (m + 1) + gram[inside]
        of_ref = key < rows * (m + 1)
        a, na = np.unique(key[of_ref], return_counts=True)
        b, nb = np.unique(key[~of_ref] - rows * (m + 1), return_counts=True)
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        if n in orders:
            out[n] = np.bincount(both // (m + 1), weights=np.minimum(na[i], nb[j]), minlength=rows).astype(np.int64)
    return out


_ORDERS = (("b", tuple(range(1, BLEU_MAX_N + 1))), ("r", ROUGE_NS))
COUNT_FIELDS = [f"{p}{n}_{c}" for p, ns in _ORDERS for n in ns for c in ("num", "hyp", "ref")]


@functools.lru_cache(maxsize=2)
def _counts_udf(with_lcs: bool):
    names = [*COUNT_FIELDS, *(["lcs"] if with_lcs else [])]

    @F.arrow_udf(T.StructType([T.StructField(f, T.LongType()) for f in names]))
    def counts(br: pa.Array, bh: pa.Array, rr: pa.Array, rh: pa.Array) -> pa.Array:
        return counted([br, bh, rr, rh], names)

    return counts


def counted(lists: Sequence[pa.Array], names: Sequence[str]) -> pa.Array:
    """The counts of a batch (references and predictions for BLEU, then for
    ROUGE), in parts of about PART_TOKENS tokens."""
    size = sum(pc.fill_null(pc.list_value_length(x), 0).to_numpy().astype(np.int64) for x in lists)
    cuts = np.flatnonzero(np.diff(np.cumsum(size) // PART_TOKENS)) + 1
    ends = [0, *cuts.tolist(), len(size)]
    return pa.concat_arrays([_counted([x.slice(a, b - a) for x in lists], names) for a, b in zip(ends, ends[1:])])


def _counted(lists: Sequence[pa.Array], names: Sequence[str]) -> pa.Array:
    br, bh, rr, rh = lists
    out = {}
    for (p, ns), refs, hyps in zip(_ORDERS, (br, rr), (bh, rh)):
        token, ref_at, hyp_at = numbered(refs, hyps)
        num = _clipped(token, ref_at, hyp_at, ns)
        for n in ns:
            out[f"{p}{n}_num"] = num[n]
            out[f"{p}{n}_hyp"] = np.maximum(np.diff(hyp_at) - n + 1, 0)
            out[f"{p}{n}_ref"] = np.maximum(np.diff(ref_at) - n + 1, 0)
    if "lcs" in names:
        out["lcs"] = lcs_lengths(token[:ref_at[-1]], ref_at, token[ref_at[-1]:], hyp_at)
    return pa.StructArray.from_arrays([pa.array(out[f], pa.int64()) for f in names], names)


def bleu_expr(prefix: str = "b") -> Column:
    """Sentence BLEU-4 from per-order counts ``{prefix}{n}_num/_hyp/_ref``."""
    num1 = F.coalesce(F.col(f"{prefix}1_num"), F.lit(0))
    hyp_len = F.coalesce(F.col(f"{prefix}1_hyp"), F.lit(0))
    ref_len = F.coalesce(F.col(f"{prefix}1_ref"), F.lit(0))
    logs = []
    for n in range(1, BLEU_MAX_N + 1):
        num = F.coalesce(F.col(f"{prefix}{n}_num"), F.lit(0)).cast("double")
        den = F.greatest(F.coalesce(F.col(f"{prefix}{n}_hyp"), F.lit(0)), F.lit(1)).cast("double")
        p = F.when(num == 0, F.lit(BLEU_EPSILON)).otherwise(num) / den
        logs.append(F.log(p) / BLEU_MAX_N)
    total = logs[0]
    for x in logs[1:]:
        total = total + x
    bp = F.when(hyp_len > ref_len, F.lit(1.0)).otherwise(F.exp(1 - ref_len.cast("double") / hyp_len))
    return F.when(num1 == 0, F.lit(0.0)).otherwise(bp * F.exp(total))


def _fmeasure(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


def rouge_n_expr(n: int, prefix: str = "r") -> Column:
    num = F.coalesce(F.col(f"{prefix}{n}_num"), F.lit(0)).cast("double")
    p = num / F.greatest(F.coalesce(F.col(f"{prefix}{n}_hyp"), F.lit(0)), F.lit(1))
    r = num / F.greatest(F.coalesce(F.col(f"{prefix}{n}_ref"), F.lit(0)), F.lit(1))
    return _fmeasure(p, r)


def text_scores(df: DataFrame, key: str, ref_col: str, hyp_col: str,
                rouge_l: bool = False, stem: bool = False) -> DataFrame:
    """X9 + X10 (+ X11, X12): per row ``bleu``, ``rouge1``, ``rouge2``
    (and ``rougeL``) between reference ``ref_col`` and prediction
    ``hyp_col``.  Row-local: no n-gram is exploded or shuffled.
    ``key`` identifies a row for callers; it is not needed here."""
    short_batches(df.sparkSession)
    base = (df.withColumn("_bt_ref", py_split(ref_col)).withColumn("_bt_hyp", py_split(hyp_col))
            .withColumn("_rt_ref", rouge_tokens(ref_col)).withColumn("_rt_hyp", rouge_tokens(hyp_col)))
    if stem:
        from lethe.operators.stemming import stem_token_arrays
        base = stem_token_arrays(base, key, ["_rt_ref", "_rt_hyp"])
    x = base.withColumn("_cnt", _counts_udf(rouge_l)("_bt_ref", "_bt_hyp", "_rt_ref", "_rt_hyp"))
    x = x.select("*", *[F.col(f"_cnt.{c}").alias(c) for c in COUNT_FIELDS])
    out = x.withColumn("bleu", bleu_expr("b"))
    for n in ROUGE_NS:
        out = out.withColumn(f"rouge{n}", rouge_n_expr(n, "r"))
    if rouge_l:
        lcs = F.col("_cnt.lcs").cast("double")
        nr, nh = F.size("_rt_ref"), F.size("_rt_hyp")
        out = out.withColumn("rougeL", F.when((nr == 0) | (nh == 0), F.lit(0.0))
                             .otherwise(_fmeasure(lcs / nh, lcs / nr)))
    return out.drop("_bt_ref", "_bt_hyp", "_rt_ref", "_rt_hyp", "_cnt", *COUNT_FIELDS)


def generation_averages(scored: DataFrame, group_cols: Sequence[str], metrics: Sequence[str],
                        domain: DataFrame | None = None) -> DataFrame:
    """A4: mean of each metric per group (``Image_Textual`` vs text); 0
    for a group without questions."""
    agg = scored.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n_questions"),
                                          *[F.avg(m).alias(f"avg_{m}") for m in metrics])
    if domain is not None:
        agg = domain.join(agg, list(group_cols), "left")
    return agg.fillna(0, ["n_questions"] + [f"avg_{m}" for m in metrics])


def type_group(col) -> Column:
    """Any type other than ``Image_Textual`` counts as text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c == "Image_Textual", "Image_Textual").otherwise("Pure_Text")
