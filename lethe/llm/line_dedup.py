"""Line dedup: two Bloom filters, then an exact count of the suspected lines.

A line's key is the line stripped of blanks at both ends, A-Z lower-cased.
Hashes of the long keys fill a once-seen and a twice-seen Bloom filter
(``lethe.llm.bloom``).  Only lines suspected as repeats are shuffled, by
key, to be counted exactly; the count and the document that keeps the line
come from a partial aggregate, so a line of a third of all documents is as
cheap as any.  The lines to drop come back to their documents by doc_id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from lethe.functions.arrays import let
from lethe.llm.bloom import Twice, twice_seen
from lethe.llm.common import BLANKS, NULL_ID, fresh, lower_ascii, short_batches, staged


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _keys(docs: DataFrame, min_chars: int) -> DataFrame:
    """(id, key): the distinct long keys of each row."""
    keys = F.transform(F.split(docs["text"], "\n", -1), line_key)
    return docs.select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NULL_ID)).alias("id"),
                       F.explode(F.array_distinct(F.filter(keys, lambda k: F.char_length(k) >= min_chars))).alias("key"))


def _suspected(shared):
    @F.pandas_udf(BooleanType())
    def suspected(h):
        import pandas as pd
        return pd.Series(shared.value.suspects(h.to_numpy().view(np.uint64)))
    return suspected


def repeated_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(id, keys): for each document the keys of the lines it loses."""
    spark = docs.sparkSession
    short_batches(spark)
    size = docs.select(F.sum(F.octet_length(docs["text"]))).first()[0] or 0
    keys = _keys(docs, min_chars)

    def hashes(b: pa.RecordBatch) -> np.ndarray:
        return b.column(0).to_numpy().view(np.uint64)

    # No more keys than the text has room for.
    twice: Twice = twice_seen(keys.select(F.xxhash64("key")), hashes, size // (min_chars + 1))
    suspected = _suspected(spark.sparkContext.broadcast(twice))
    rows = keys.where(suspected(F.xxhash64("key")))
    # Documents are counted.  Without repeated ids each row is one; else the
    # rows of one id and line are made one first.
    ids = docs.groupBy(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NULL_ID))).count()
    if ids.where("count > 1").limit(1).count():
        rows = rows.distinct()
    # Staged, so that the join below has a shuffle of its own on both sides and
    # Spark can split the partition of a very frequent line.
    kept_in = staged(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper"))
                     .where(F.col("n") >= min_docs).select("key", "keeper"))
    return (rows.join(kept_in, "key").where("id <> keeper").groupBy("id")
            .agg(F.collect_set("key").alias("keys")))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, prefix: str = "") -> DataFrame:
    """``docs`` with the repeated lines removed from ``text``, all other
    columns as they are, and two more: n_lines and n_dropped (names after
    ``prefix``; they replace columns of that name).

    A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines except in the largest doc_id holding
    it (there all of them stay).  Rows that repeat a doc_id are one document:
    they count once, and all of them keep the line if that id is the
    largest; rows without a doc_id are one document too.  Null or empty text is one empty line and becomes empty.
    A null doc_id is smaller than any other."""
    own_id, dropped, kept = fresh(docs, "__id", "__dropped", "__kept")
    drops = repeated_lines(docs, min_chars, min_docs).select(F.col("id").alias(own_id), F.col("keys").alias(dropped))
    lines = F.split(F.coalesce(docs["text"], F.lit("")), "\n", -1)
    joined = docs.join(drops, F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NULL_ID)) == drops[own_id], "left")
    left = let(lines, lambda x: F.struct(F.size(x).alias("n"), F.when(F.col(dropped).isNull(), x).otherwise(
        F.filter(x, lambda line: ~F.array_contains(F.col(dropped), line_key(line)))).alias("lines")))
    names = {(prefix + x).lower() for x in ("n_lines", "n_dropped")}
    n = F.col(kept)["n"]
    return (joined.withColumn(kept, left)
            .select(*[F.array_join(F.col(kept)["lines"], "\n").alias("text") if c == "text" else F.col(c)
                      for c in docs.columns if c.lower() not in names],
                    n.cast("bigint").alias(prefix + "n_lines"),
                    (n - F.size(F.col(kept)["lines"])).cast("bigint").alias(prefix + "n_dropped")))
