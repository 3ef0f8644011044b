"""Document fingerprints by one-permutation MinHash.

A text's shingles are hashed once each.  The top bits of a hash choose one
of ``BINS`` bins, and a bin keeps its least hash.  An empty bin is filled by
optimal densification: it goes through the bins in a random order of its own,
the same for all texts, and copies the first that is not empty.  Only the
``BITS`` lowest bits of each bin's value (mixed with the bin) are stored, packed.  Two fingerprints
agree by chance in 1 of 2^BITS bins that hold different shingles, which the
likeness corrects: (agreeing share - c) / (1 - c), c = 2^-BITS, within 0..1.

Shingles are ``SHINGLE`` consecutive words, A-Z lower-cased; a shorter text
is one shingle.  A text without a word (null, empty or blank) has the empty
fingerprint: likeness 1 to another such text, 0 to all others.

``compare_edited`` also needs each document's follower by descending doc_id.
Texts move once, to the range of ids that they lie in, with the first text of
the following range beside them; no window or task sees all ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.common import (BLANK_BYTE, LOWER_BYTE, NULL_ID, fresh, mix, short_batches, span_hashes, staged, text_chunks,
                              word_spans)

SHINGLE = 5
BINS = 512
BITS = 4
# Text of a range of ids, about, and sampled ids a range.
RANGE_BYTES = 64 << 20
SAMPLES = 64

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
# Bin i copies the first bin of _ORDER[i] that is not empty; _RANK is each bin's place there.
_ORDER = np.argsort(mix(np.arange(1, BINS * BINS + 1, dtype=np.uint64)).reshape(BINS, BINS), axis=1)
_RANK = np.argsort(_ORDER, axis=1).astype(np.int16)
# Added to a bin's value before its low bits are stored: else the copies of one value, which fill the bins of a short
# text, would all agree by chance or none.
_SPREAD = mix(np.arange(BINS * BINS + 1, BINS * BINS + BINS + 1, dtype=np.uint64))
# With no more full bins than this, looking at each full bin is less work than going through the order.
_FEW = int(BINS ** 0.5)


def shingle_hashes(data: np.ndarray, offs: np.ndarray, words: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of every shingle of the texts."""
    low = LOWER_BYTE[data]
    starts, ends, text = word_spans(low, offs, ~BLANK_BYTE)
    w = span_hashes(low, starts, ends)
    first = np.searchsorted(text, np.arange(len(offs)))
    here = np.arange(len(w))
    left = first[text + 1] - here
    begins = here[(left >= words) | (here == first[text])]
    size = np.minimum(left[begins], words)
    h = np.zeros(len(begins), np.uint64)
    padded = np.concatenate([w, np.zeros(words, np.uint64)])
    for k in range(words):
        h = mix(h + np.uint64(k + 1)) ^ np.where(k < size, padded[begins + k], np.uint64(0))
    return text[begins], mix(h + size.astype(np.uint64))


def _densified(least: np.ndarray) -> np.ndarray:
    """Rows of bins with every empty bin filled; rows of empty bins only stay."""
    empty = least == _EMPTY
    full = BINS - empty.sum(axis=1)
    few = np.flatnonzero((full > 0) & (full <= _FEW))
    if len(few):
        row, bin_ = np.nonzero(~empty[few])
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        best = np.full((len(few), BINS), BINS, np.int16)
        source = np.zeros((len(few), BINS), np.int64)
        for k in range(nth.max() + 1):
            r, b = row[nth == k], bin_[nth == k]
            rank = _RANK[:, b].T
            nearer = rank < best[r]
            best[r] = np.where(nearer, rank, best[r])
            source[r] = np.where(nearer, b[:, None], source[r])
        own = ~empty[few]
        source[own] = np.nonzero(own)[1]
        least[few] = np.take_along_axis(least[few], source, 1)
    many = np.flatnonzero((full > _FEW) & (full < BINS))
    row, bin_ = np.nonzero(empty[many])
    row = many[row]
    for k in range(BINS):
        if not len(row):
            break
        source = _ORDER[bin_, k]
        found = ~empty[row, source]
        least[row[found], bin_[found]] = least[row[found], source[found]]
        row, bin_ = row[~found], bin_[~found]
    return least


def fingerprints(texts: pa.Array) -> np.ndarray:
    """A text's packed fingerprint in each row, and whether it has a shingle
    in the last column (a byte)."""
    out = np.zeros((len(texts), BINS * BITS // 8 + 1), np.uint8)
    for at, data, offs in text_chunks(texts):
        n = len(offs) - 1
        text, h = shingle_hashes(data, offs)
        least = np.full(n * BINS, _EMPTY, np.uint64)
        shift = np.uint64(64 - BINS.bit_length() + 1)
        cell = text * BINS + (h >> shift).astype(np.int64)
        np.minimum.at(least, cell, h & ((np.uint64(1) << shift) - np.uint64(1)))
        values = _densified(least.reshape(n, BINS))
        values = mix(values + _SPREAD)
        bits = (values[:, :, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)
        some = np.bincount(text, minlength=n) > 0
        out[at:at + n, :-1] = np.packbits(bits.reshape(n, -1).astype(np.uint8), axis=1) * some[:, None]
        out[at:at + n, -1] = some
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated share of common shingles of rows of fingerprints, 0 to 1."""
    bits = np.unpackbits(a[:, :-1] ^ b[:, :-1], axis=1).reshape(len(a), BINS, BITS)
    agree = (~bits.any(axis=2)).mean(axis=1)
    chance = 2.0 ** -BITS
    est = np.clip((agree - chance) / (1 - chance), 0, 1)
    return np.where(a[:, -1] != b[:, -1], 0.0, np.where(a[:, -1] == 0, 1.0, est))


def _hex(prints: np.ndarray) -> list[str]:
    return [r[:-1].tobytes().hex() if r[-1] else "" for r in prints]


def with_fingerprint(docs: DataFrame, name: str = "fingerprint") -> DataFrame:
    """``docs`` plus its texts' fingerprints as lowercase hex (replaces a column
    of that name).  Rows are independent; map only."""
    short_batches(docs.sparkSession)
    own, = fresh(docs, name + "__")
    kept = [c for c in docs.columns if c.lower() != name.lower()]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(own, T.StringType())])
    at, keep = docs.columns.index("text"), [docs.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(_hex(fingerprints(batch.column(at))), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], made], names=schema.names)

    return docs.mapInArrow(run, schema).withColumnRenamed(own, name)


def edited(text: str, following: str) -> str:
    """The last third (rounded down) of ``text``'s code points replaced by as
    many of ``following``'s first."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


# --- each document and its follower by descending id ------------------------

def _range_of(bounds: np.ndarray) -> Callable:
    """The range number of a descending-order key.  A key that takes several
    ranges whole is spread over them by ``spread``."""
    @F.pandas_udf("int")
    def number(key: pd.Series, spread: pd.Series) -> pd.Series:
        lo = np.searchsorted(bounds, key, "left")
        wide = np.searchsorted(bounds, key, "right") - lo
        return pd.Series(np.where(wide > 2, lo + spread.to_numpy() % np.maximum(wide, 1), lo), dtype="int32")
    return number


def with_follower(docs: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``docs(doc_id, text)`` with ids as longs, dealt to ranges
    of descending ids and sorted, a null text as the empty one; after the
    rows of each range stands (last = true) the row that follows.  Also the
    number of ranges.

    Rows of one id follow one another by a hash of their texts; an id of so
    many rows that they fill several ranges, by range before that."""
    spark = docs.sparkSession
    # Bitwise not turns descending ids into ascending keys; a null id is the last.
    key = F.bitwise_not(F.coalesce(F.col("doc_id"), F.lit(NULL_ID)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    count, size = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    ids = rows.select(key.alias("k")).sample(min(1.0, SAMPLES * ranges / max(1, count)), 13).sort("k").toPandas()["k"].to_numpy()
    bounds = ids[np.arange(1, ranges) * len(ids) // ranges] if len(ids) else np.zeros(0, np.int64)
    # The share of equal bounds tells which keys fill ranges; their rows are dealt by where they are read.
    numbered = rows.select("doc_id", "text", key.alias("k"), F.monotonically_increasing_id().alias("spread"))
    numbered = numbered.withColumn("range", _range_of(bounds)("k", "spread"))
    heads = sorted((r[0], r[1]) for r in numbered.groupBy("range").agg(F.min("k")).collect())
    # After every range, empty or not, comes the first key of the next one that has rows, and after the last the first.
    begun = np.array([r for r, _ in heads], np.int64)
    after = [(b, heads[int(np.searchsorted(begun, b, "right")) % len(heads)][1]) for b in range(ranges)] if heads else []
    after = spark.createDataFrame(after, "range int, k long")
    # A row of two numbers a range is broadcast; the texts are not.
    first = (rows.withColumn("k", key).join(F.broadcast(after.select("k").distinct()), "k")
             .groupBy("k").agg(F.min(F.struct(F.xxhash64("text"), "text", "doc_id")).alias("row")))
    following = staged(first).join(F.broadcast(after), "k")
    cols = ("range", "last", "k", "h", "doc_id", "text")
    both = (numbered.select("range", F.lit(False).alias("last"), "k", F.xxhash64("text").alias("h"), "doc_id", "text")
            .union(following.select("range", F.lit(True).alias("last"), "k", F.lit(0).cast("long").alias("h"),
                                    "row.doc_id", "row.text").select(*cols)))
    return both.repartitionById(ranges, "range").sortWithinPartitions("range", "last", "k", "h", "text"), ranges


_EDITED = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def compare_edited(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next) of every row of ``docs(doc_id, text)``: its
    fingerprint beside that of its edited text, whose last third is the start of
    the next document's (descending doc_id; after the last comes the first).

    Null text counts as empty.  Repeated ids are documents of their own, next
    to each other (see ``with_follower``); a null id comes last; a lone row is its
    own follower; an empty table gives no rows; other columns are not read."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, prints = [], [], None
        for batch in batches:
            column = batch.column(1)
            made = fingerprints(column)
            ids, texts = ids[-1:] + batch.column(0).to_pylist(), texts[-1:] + column.to_pylist()
            prints = made if prints is None else np.concatenate([prints[-1:], made])
            if len(ids) < 2:
                continue
            new = [edited(a, b) for a, b in zip(texts, texts[1:])]
            others = fingerprints(pa.array(new, pa.string()))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids[:-1], pa.int64()), "n_chars": pa.array([len(t) for t in texts[:-1]], pa.int64()),
                "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in new],
                "fingerprint": _hex(prints[:-1]), "edited_fingerprint": _hex(others),
                "near_edited": likeness(prints[:-1], others), "near_next": likeness(prints[:-1], prints[1:])})

    rows, _ = with_follower(docs)
    return rows.select("doc_id", "text").mapInArrow(run, _EDITED)
