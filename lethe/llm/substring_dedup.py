"""Substring dedup: FM-indexes of shards of repeated passages.

Words that repeat another document's words in a window of ``window`` words
or more are removed, but for the document of the smallest id.

1.  Candidates.  Each window is keyed by its anchor, the smallest hash of the
    ``GRAM``-word grams in it: equal windows have equal anchors.  Two
    twice-seen Bloom filters (``lethe.llm.bloom``), first of the anchors and
    then of whole windows under repeated anchors, leave the windows that may
    occur in two documents.  They never lose one.
2.  Shards.  Neighbouring candidates of one anchor make a segment; equal
    segments are aggregated to one with its smallest doc_id before they move,
    so a passage of a third of all documents is one row a task.  Segments are
    dealt to shards by anchor, so equal windows meet in one shard.  Segments
    of an anchor that has more than ANCHOR_SEGMENTS are first cut into their
    single windows, which are dealt by their own hash.
3.  Search.  A shard's segments are indexed, and the stretches of documents
    that they are of are streamed against the FM-index: backward search
    through its wavelet tree gives their matching statistics, cut at
    ``window``.  The occurrences of a window's rows, located by the sampled
    positions, give the smallest document that holds it.
4.  The results go back to the segments' documents, as intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.bloom import Twice, twice_seen
from lethe.llm.common import (BLANK_BYTE, NULL_ID, fresh, joined_words, mix, short_batches, span_hashes, staged, text_chunks,
                              word_spans)
from lethe.llm.fm_index import FMIndex

# Words of the grams that anchors are chosen from.
GRAM = 8
# Segment text of one shard.
SHARD_BYTES = 4 << 20
# Distinct segments of one anchor that stay together.
ANCHOR_SEGMENTS = 256
_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def _fold_hash(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` values."""
    out, done, level, size = None, 0, h, 1
    for k in range(length.bit_length()):
        if length & size:
            n = max(0, len(h) - length + 1)
            piece = level[done:done + n]
            out = piece.copy() if out is None else out * _FACTORS[32 + k] + piece
            done += size
        if len(level) > size:
            level = level[:-size] * _FACTORS[k] + level[size:]
        else:
            level = level[:0]
        size *= 2
    return mix(out)


def _fold_min(h: np.ndarray, length: int) -> np.ndarray:
    """Smallest of each run of ``length`` values."""
    n, size, level = len(h) - length + 1, 1, h
    while 2 * size <= length:
        level = np.minimum(level[:-size], level[size:])
        size *= 2
    return np.minimum(level[:n], level[length - size:length - size + n])


class Windows:
    """The windows of the texts of a chunk: all arrays are by first word."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, window: int):
        self.data = data
        self.starts, self.ends, self.text = word_spans(data, offs, ~BLANK_BYTE)
        n = len(self.starts) - window + 1
        if n <= 0:
            self.at = np.zeros(0, np.int64)
            self.anchor = self.hash = np.zeros(0, np.uint64)
            return
        h = span_hashes(data, self.starts, self.ends)
        gram = min(GRAM, window)
        inside = self.text[:n] == self.text[window - 1:]
        self.at = np.flatnonzero(inside)
        self.anchor = _fold_min(_fold_hash(h, gram), window - gram + 1)[inside]
        self.hash = _fold_hash(h, window)[inside]

    def distinct(self, value: np.ndarray, on: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Values of windows, each once a text."""
        v, t = value[on], self.text[self.at[on]]
        own = v ^ mix(t.astype(np.uint64) + np.uint64(1))
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            return v
        # Only repeats are looked at one by one.
        among = twice[np.minimum(np.searchsorted(twice, own), len(twice) - 1)] == own
        _, first = np.unique(own[among], return_index=True)
        return np.concatenate([v[~among], v[among][first]])


def _candidates(docs: DataFrame, window: int) -> DataFrame:
    """(id, tid, pos, anchor, segment): runs of windows that may repeat, of one anchor each."""
    sc = docs.sparkSession.sparkContext
    short_batches(docs.sparkSession)
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0

    def anchors(b: pa.RecordBatch) -> np.ndarray:
        return np.concatenate([np.zeros(0, np.uint64), *(
            (w := Windows(data, offs, window)).distinct(w.anchor) for _, data, offs in text_chunks(b.column(0)))])

    texts = docs.select("text")
    first: Twice = twice_seen(texts, anchors, size // 100)
    first_shared = sc.broadcast(first)

    def windows(b: pa.RecordBatch) -> np.ndarray:
        out = [np.zeros(0, np.uint64)]
        for _, data, offs in text_chunks(b.column(0)):
            w = Windows(data, offs, window)
            out.append(w.distinct(w.hash, first_shared.value.suspects(w.anchor)))
        return np.concatenate(out)

    second: Twice = twice_seen(texts, windows, size // 48)
    shared = sc.broadcast((first, second))

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for b in batches:
            ids, tids = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, data, offs in text_chunks(b.column(2)):
                w = Windows(data, offs, window)
                on = one.suspects(w.anchor)
                on[on] = two.suspects(w.hash[on])
                k = np.flatnonzero(on)
                if not len(k):
                    continue
                place, anchor, text = w.at[k], w.anchor[k], w.text[w.at[k]]
                new = np.concatenate([[True], (place[1:] != place[:-1] + 1) | (anchor[1:] != anchor[:-1])
                                      | (text[1:] != text[:-1])])
                begin = np.flatnonzero(new)
                last = np.concatenate([begin[1:], [len(k)]]) - 1
                joined, frm, to = joined_words(data, w.starts, w.ends)
                word0 = np.searchsorted(w.text, text[begin])
                cut = [joined[x:y] for x, y in zip(frm[place[begin]].tolist(), to[place[last] + window - 1].tolist())]
                of = at + text[begin]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of]), pa.array(tids[of]), pa.array((place[begin] - word0).astype(np.int32)),
                     pa.array(anchor[begin].view(np.int64)), pa.array(cut, pa.binary())],
                    ["id", "tid", "pos", "anchor", "segment"])

    return docs.mapInArrow(segments, "id bigint, tid bigint, pos int, anchor bigint, segment binary")


def _single_windows(window: int):
    """mapInArrow function: segments cut into their windows, each under its
    own hash for an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tids, pos = (b.column(k).to_numpy() for k in range(3))
            for first, data, offs in text_chunks(b.column(4).cast(pa.string())):
                w = Windows(data, offs, window)
                text = w.text[w.at]
                of = first + text
                cut = [data[x:y].tobytes() for x, y in zip(w.starts[w.at].tolist(), w.ends[w.at + window - 1].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[of]), pa.array(tids[of]),
                     pa.array((pos[of] + w.at - np.searchsorted(w.text, text)).astype(np.int32)),
                     pa.array(w.hash.view(np.int64)), pa.array(cut, pa.binary())],
                    ["id", "tid", "pos", "anchor", "segment"])

    return run


def _smallest_holders(window: int):
    """mapInArrow function over segments sorted by anchor: for each, the
    smallest id of all segments that hold each of its windows."""

    def search(held: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        ids = np.array([x[0] for x in held], np.int64)
        texts = pa.array([x[2] for x in held], pa.binary())
        seqs, sizes = [], []
        for _, data, offs in text_chunks(texts.cast(pa.string())):
            starts, ends, text = word_spans(data, offs, ~BLANK_BYTE)
            seqs.append(span_hashes(data, starts, ends))
            sizes.append(np.bincount(text, minlength=len(offs) - 1))
        words, number = np.unique(np.concatenate(seqs), return_inverse=True)
        symbols, sizes = number.ravel() + 1, np.concatenate(sizes)
        index = FMIndex(symbols, sizes, len(words) + 1, window=window)
        least = index.least(ids, *index.window_rows(symbols, sizes))
        cut = np.concatenate([[0], np.cumsum(np.maximum(sizes - window + 1, 0))])
        return pa.RecordBatch.from_arrays(
            [pa.array([x[1] for x in held], pa.binary()),
             pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(least))], ["key", "holders"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, before = [], 0, None
        for b in batches:
            for i, anchor, key, segment in zip(*(b.column(k).to_pylist() for k in range(4))):
                if size >= SHARD_BYTES and anchor != before:
                    yield search(held)
                    held, size = [], 0
                held.append((i, key, segment))
                size += len(segment)
                before = anchor
        if held:
            yield search(held)

    return run


def repeated_windows(docs: DataFrame, window: int = 50) -> DataFrame:
    """(id, tid, at): for each distinct (doc_id, text) with any, the first
    words (from 0) of the windows that also start in a document of a smaller
    id.  ``id`` is doc_id with NULL_ID for null, ``tid`` the text's hash."""
    texts = docs.select(F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NULL_ID)).alias("id"),
                        F.xxhash64(docs["text"]).alias("tid"), docs["text"].alias("text"))
    found = staged(_candidates(texts, window))
    crowded = staged(found.select("anchor", F.xxhash64("segment").alias("h")).distinct()
                     .groupBy("anchor").agg(F.count("*").alias("n"))
                     .where(F.col("n") > ANCHOR_SEGMENTS).select("anchor"))
    found = found.join(crowded, "anchor", "left_anti").select(found.columns).unionByName(
        found.join(crowded, "anchor", "left_semi").select(found.columns)
        .mapInArrow(_single_windows(window), found.schema))
    # Equal segments as one, with their smallest id, before anything else.
    distinct = found.groupBy("anchor", "segment").agg(F.min("id").alias("id"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = (distinct.select("id", "anchor", F.unhex(F.md5("segment")).alias("key"), "segment")
              .repartition(n, "anchor").sortWithinPartitions("anchor")
              .select("id", "anchor", "key", "segment"))
    holders = shards.mapInArrow(_smallest_holders(window), "key binary, holders array<bigint>")
    back = found.select("id", "tid", "pos", F.unhex(F.md5("segment")).alias("key")).join(holders, "key")
    at = F.filter(F.transform("holders", lambda h, i: F.when(h < F.col("id"), F.col("pos") + i)),
                  lambda x: x.isNotNull())
    return (back.select("id", "tid", at.alias("at")).where(F.size("at") > 0)
            .groupBy("id", "tid").agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at")))


def dedup_substrings(docs: DataFrame, window: int = 50, prefix: str = "") -> DataFrame:
    """``docs`` with ``text`` reduced to the kept words joined by one space,
    and n_words and n_removed (names after ``prefix``; they replace columns
    of that name).

    Words are runs of other characters than [\\x20\\x09-\\x0D], unchanged.  A word
    is removed if a window of ``window`` consecutive words of the document
    covers it whose words also start in a document with a smaller doc_id, on
    the input.  Rows that share a doc_id are parts of one document: they
    don't repeat each other.  A null doc_id is smaller than any other.  Null
    text has no words and becomes empty."""
    own_id, own_tid, own_at = fresh(docs, "__id", "__tid", "__at")
    found = repeated_windows(docs, window).toDF(own_id, own_tid, own_at)
    new = {(prefix + x).lower() for x in ("n_words", "n_removed")}
    names = [c for c in docs.columns if c.lower() not in new]
    joined = docs.join(found, (F.coalesce(docs["doc_id"].cast("bigint"), F.lit(NULL_ID)) == found[own_id])
                       & (F.xxhash64(docs["text"]) == found[own_tid]), "left")
    rows = joined.select(*names, own_at)
    text_at = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(len(names)).to_pylist()
            kept, n_words, n_removed = [], [], []
            for first, data, offs in text_chunks(b.column(text_at)):
                starts, ends, text = word_spans(data, offs, ~BLANK_BYTE)
                at = np.searchsorted(text, np.arange(len(offs)))
                cover = np.zeros(len(starts) + 1, np.int64)
                for d in range(len(offs) - 1):
                    if lists[first + d]:
                        w = np.array(lists[first + d]) + at[d]
                        np.add.at(cover, w, 1)
                        np.add.at(cover, w + window, -1)
                keep = np.cumsum(cover[:-1]) == 0
                buffer, frm, to = joined_words(data, starts[keep], ends[keep])
                left = np.searchsorted(text[keep], np.arange(len(offs)))
                for d in range(len(offs) - 1):
                    x, y = left[d], left[d + 1]
                    kept.append(buffer[frm[x]:to[y - 1]].decode() if y > x else "")
                    n_words.append(at[d + 1] - at[d])
                    n_removed.append(at[d + 1] - at[d] - (y - x))
            cols = [pa.array(kept, pa.string()) if k == text_at else b.column(k) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
                                             [*names, prefix + "n_words", prefix + "n_removed"])

    schema = docs.select(*[docs[c] for c in names]).schema
    return rows.mapInArrow(cut, schema.add(prefix + "n_words", "long").add(prefix + "n_removed", "long"))
