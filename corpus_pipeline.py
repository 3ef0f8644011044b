"""A training-data pipeline over ``documents``: five stages, each one of the
operators of ``lethe.llm`` with its production parameters.

Every stage works on all that its predecessor kept, and its decisions take
effect: toxic documents go, repeated lines are cut, one document of each
group of near duplicates stays, benchmark passages are cut, and the rest is
encoded.  Columns other than ``text`` pass unchanged (``n_chars`` is that of
the document as it came).  ``run`` writes each stage's result as Parquet in
the shared checkpoint folder and reads it again, so a lost executor costs a
part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lethe.llm.byte_bpe import encode_decode
from lethe.llm.common import read, staged
from lethe.llm.decontaminate import decontaminate
from lethe.llm.line_dedup import dedup_lines
from lethe.llm.simhash import keep_one
from lethe.llm.toxicity import learn, score_toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    model = learn(docs, read(spark, sf_dir, "labels"))
    return score_toxicity(docs, model, prefix="__toxic_").where(F.col("__toxic_predicted") == 0).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the long lines that a document of a larger id keeps."""
    return dedup_lines(docs, prefix="__lines_").select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words of benchmark windows."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids)."""
    return encode_decode(docs, RANKS, public_tokenizers.PATTERN, with_ids=True)


STAGES = [("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("decontamination", decontamination), ("byte_bpe", byte_bpe)]

# The toxicity model is no SQL; tests/llm/test_pipeline.py checks all stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
