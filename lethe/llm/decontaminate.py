"""Benchmark decontamination with an FM-index per training shard.

The test phrases are windows of consecutive benchmark words.  A shard is a
slice of a task's documents.  Its FM-index covers every run of words that
all occur in the benchmark and that is long enough for the shortest phrase:
no occurrence can lie elsewhere, so nothing is lost.  Backward search finds
the rows of each phrase, sampled suffix positions locate the occurrences,
and their spans are merged per document.

Documents are never shuffled: each row's result comes from its own task.
The phrases are the query set.  They are broadcast in blocks of at most
``BLOCK_BYTES`` of benchmark text; a larger benchmark takes more blocks,
each applied to all documents in turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lethe.llm.common import LOWER_BYTE, byte_table, fresh, short_batches, span_hashes, text_chunks, word_spans
from lethe.llm.fm_index import FMIndex

BLOCK_BYTES = 64 << 20
# Document text per shard.
SHARD_BYTES = 1 << 20
# A word is a run of bytes of [0-9a-z] (after lower-casing A-Z) and of non-ASCII characters.
WORD_BYTE = byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)


class Phrases:
    """Distinct windows of a block of items, as word numbers, by length."""

    def __init__(self, items: list[tuple[object, str]], window: int):
        texts = pa.array([t or "" for _, t in items], pa.string())
        seqs: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(items)
        for first, raw, offs in text_chunks(texts):
            data = LOWER_BYTE[raw]
            starts, ends, text = word_spans(data, offs, WORD_BYTE)
            h = span_hashes(data, starts, ends)
            for i in np.unique(text):
                seqs[first + i] = h[text == i]
        self.words = np.unique(np.concatenate([*seqs, np.zeros(0, np.uint64)]))
        found: dict[int, list] = {}
        owner: dict[int, list] = {}
        for k, s in enumerate(seqs):
            if len(s):
                n = min(window, len(s))
                ids = np.searchsorted(self.words, s) + 1
                found.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(ids, n))
                owner.setdefault(n, []).append(np.full(len(s) - n + 1, k))
        # By length: distinct phrases; the items of each in one array, phrase by phrase.
        self.by_length = []
        for n in sorted(found):
            rows, which = np.unique(np.concatenate(found[n]), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owner[n])], 1), axis=0)
            self.by_length.append((n, rows, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1]))
        self.shortest = min(found, default=0)

    def in_shard(self, data: np.ndarray, offs: np.ndarray):
        """For the documents of a shard: the start and the document of each
        word, the (document, item number) pairs, and the (document, from, to)
        byte spans of hit words."""
        low = LOWER_BYTE[data]
        starts, ends, text = word_spans(low, offs, WORD_BYTE)
        none = starts, text, np.zeros((0, 2), np.int64), np.zeros((0, 3), np.int64)
        if not self.by_length or not len(starts):
            return none
        h = span_hashes(low, starts, ends)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        ids = np.where(self.words[at] == h, at + 1, 0)
        # Runs of benchmark words inside a document.
        known = ids > 0
        joins = known[1:] & known[:-1] & (text[1:] == text[:-1])
        begin = np.flatnonzero(known & ~np.concatenate([[False], joins]))
        end = np.flatnonzero(known & ~np.concatenate([joins, [False]])) + 1
        long = end - begin >= self.shortest
        begin, size = begin[long], (end - begin)[long]
        if not len(begin):
            return none
        take = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        index = FMIndex(ids[take], size, len(self.words) + 1)
        word_at = np.full(index.n, -1, np.int64)
        word_at[index.word_positions()] = take
        cover, pairs = np.zeros(len(starts) + 1, np.int64), []
        for n, rows, first, items in self.by_length:
            lo, hi = index.search(rows)
            times = hi - lo
            phrase = np.repeat(np.arange(len(rows)), times)
            row = np.repeat(lo - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
            word = word_at[index.locate(row)]
            np.add.at(cover, word, 1)
            np.add.at(cover, word + n, -1)
            seen = np.unique(np.stack([text[word], phrase], 1), axis=0)
            k = first[seen[:, 1] + 1] - first[seen[:, 1]]
            of = np.repeat(first[seen[:, 1]] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
            pairs.append(np.stack([np.repeat(seen[:, 0], k), items[of]], 1))
        hit = np.cumsum(cover[:-1]) > 0
        # Removal spans: neighbouring hit words of a document merge.
        edge = np.concatenate([[True], ~(hit[:-1] & hit[1:] & (text[1:] == text[:-1]))])
        a = np.flatnonzero(hit & edge)
        b = np.flatnonzero(hit & np.concatenate([edge[1:], [True]]))
        spans = np.stack([text[a], starts[a] - offs[text[a]], ends[b] - offs[text[a]]], 1)
        return starts, text, np.unique(np.concatenate(pairs), axis=0), spans


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items with a word character, in blocks of bounded text."""
    block, size = [], 0
    rows = benchmark.select(benchmark["item_id"], benchmark["text"]).where(F.length("text") > 0)
    for r in rows.toLocalIterator():
        if block and size + len(r[1]) * 4 > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((r[0], r[1]))
        size += len(r[1]) * 4
    if block:
        yield block


_MARKS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def mark_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, prefix: str = "") -> DataFrame:
    """``docs`` plus n_words, n_hit, items (sorted strings of the item_ids
    with an occurring window) and spans (array of [from, to) byte offsets of
    the hit words, neighbours merged, ascending); names after ``prefix``,
    they replace columns of that name.

    A window is ``window`` consecutive words of an item, or all the words of
    a shorter item; items without words are ignored.  Null text has no words.
    Repeated item_ids count once; a null item_id counts as the item "null".
    Rows are independent, so repeated rows repeat their results."""
    new = ("n_words", "n_hit", "items", "spans")
    out, own = _marked(docs, benchmark, window, cut=False)
    return out.select(*[out[c] for c in docs.columns if c.lower() not in {(prefix + x).lower() for x in new}],
                      *[out[own][x].alias(prefix + x) for x in new])


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs``, same columns, with the contaminated spans cut out of ``text``."""
    out, _ = _marked(docs, benchmark, window, cut=True)
    return out.select(*docs.columns)


def _marked(docs: DataFrame, benchmark: DataFrame, window: int, cut: bool) -> tuple[DataFrame, str]:
    """``docs`` with its marks as one column, and that column's name; with
    ``cut`` the spans are cut out of the text in the same pass as the last
    block's, so a task needs one Python worker for a block."""
    sc = docs.sparkSession.sparkContext
    short_batches(docs.sparkSession)
    own, = fresh(docs, "__marks")
    schema = T.StructType([*docs.schema.fields, T.StructField(own, _MARKS)])
    out = docs.select("*", F.lit(None).cast(_MARKS).alias(own))
    at = docs.columns.index("text")
    blocks = _blocks(benchmark)
    block = next(blocks, [])
    while True:
        following = next(blocks, None)
        shared = sc.broadcast((Phrases(block, window), ["null" if i is None else str(i) for i, _ in block]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, cutting=cut and following is None):
            phrases, names = shared.value
            for batch in batches:
                before = batch.column(batch.num_columns - 1).to_pylist()
                made = []
                for first, data, offs in text_chunks(batch.column(at), SHARD_BYTES):
                    made += _marks_of(phrases, names, data, offs, before[first:first + len(offs) - 1])
                cols = [batch.column(i) for i in range(batch.num_columns - 1)]
                if cutting:
                    cols[at] = _without(cols[at], [m["spans"] for m in made])
                yield pa.RecordBatch.from_arrays(
                    [*cols, pa.array(made, batch.schema.field(batch.num_columns - 1).type)], names=batch.schema.names)

        out = out.mapInArrow(run, schema)
        if following is None:
            return out, own
        block = following


def _marks_of(phrases: Phrases, names: list[str], data: np.ndarray, offs: np.ndarray, before: list) -> list[dict]:
    """The marks of a shard's documents, joined to those of earlier blocks."""
    starts, text, pairs, spans = phrases.in_shard(data, offs)
    each = np.arange(len(offs))
    word_at, item_at, span_at = (np.searchsorted(x, each).tolist() for x in (text, pairs[:, 0], spans[:, 0]))
    made = []
    for d in range(len(offs) - 1):
        items, hits = set(), []
        if item_at[d] < item_at[d + 1]:
            items = {names[k] for k in pairs[item_at[d]:item_at[d + 1], 1].tolist()}
            hits = spans[span_at[d]:span_at[d + 1], 1:].tolist()
        if (old := before[d]) is not None:
            items, hits = items.union(old["items"]), _merged(old["spans"] + hits)
        n_hit = 0
        if hits:
            own = starts[word_at[d]:word_at[d + 1]] - offs[d]
            n_hit = int(np.diff(np.searchsorted(own, np.array(hits)), axis=1).sum())
        made.append({"n_words": word_at[d + 1] - word_at[d], "n_hit": n_hit, "items": sorted(items), "spans": hits})
    return made


def _without(texts: pa.Array, spans: list[list[list[int]]]) -> pa.Array:
    """The texts without their byte spans."""
    out = texts.to_pylist()
    for i, cuts in enumerate(spans):
        if cuts:
            raw, last, kept = out[i].encode(), 0, []
            for a, b in cuts:
                kept.append(raw[last:a])
                last = b
            out[i] = b"".join([*kept, raw[last:]]).decode()
    return pa.array(out, pa.string())


def _merged(spans: list[list[int]]) -> list[list[int]]:
    """Overlapping or equal spans merged."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out
