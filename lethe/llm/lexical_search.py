"""Ranked lexical search by an Aho-Corasick scan of the documents.

The items are the queries, the documents the corpus.  All terms of a block
of items form one Aho-Corasick automaton, each term guarded by a boundary at
either end, so a term is found only where it is a maximal run of term
characters.  The automaton is broadcast and reads every text once; its
outputs are term numbers, which a term -> items table maps to the items.
There is no index of the documents: a row leaves the scan with its number of
terms and its counts of the items' terms only.

The scan's counts are staged, because a score needs three figures of the
whole corpus (N, L and each term's df), which are sums over them.  Scores are
64-bit integers made row by row.  A task keeps the best rows of each item, and
the tasks' best meet in two rounds: within a slice of the tasks, then within
the item.

The broadcast is bounded: items are dealt by a hash of their id to as many
blocks as keep a block's terms near ``BLOCK_BYTES``, and every block is
applied to all documents in turn.

Edge rows.  Documents: a null text has no terms, and a row without terms is
no document of N; repeated rows are documents of their own; a null doc_id
is the smallest one.  Items: rows of one item_id are one item with the terms of
all of them, a null item_id is an item of its own; an item without terms, or
whose terms no document holds, has no rows.  Equal scores rank by ascending
doc_id, equal ids are interchangeable.  Either table empty: no rows.  Columns
other than those named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lethe.llm.common import lower_ascii, short_batches, staged, text_chunks

# Runs of these are terms: digits, ASCII letters, everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
# UTF-8 bytes of the terms of a block of items (the automaton takes some 40 times as much).
BLOCK_BYTES = 1 << 21
# Cells of the score table held at once.
CELLS = 1 << 20
# Tasks' best rows of an item meet in this many slices first.
SLICES = 64

_GUARD = 0x20


def _byte_map() -> bytes:
    """Term bytes lower-cased, every other byte the guard."""
    out = bytearray([_GUARD]) * 256
    for b in range(256):
        if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A:
            out[b] = b
        elif 0x41 <= b <= 0x5A:
            out[b] = b + 32
    return bytes(out)


_BYTES = _byte_map()


class Terms:
    """The terms of a block of items, numbered; term -> items as offsets and
    item numbers.  Workers build the automaton when they first need it."""

    def __init__(self, pairs: list[tuple[object, str]]):
        """``pairs``: distinct (item_id, term)."""
        self.items = sorted({i for i, _ in pairs}, key=lambda i: (i is not None, i))
        self.terms = sorted({t for _, t in pairs})
        item_no = {i: k for k, i in enumerate(self.items)}
        term_no = {t: k for k, t in enumerate(self.terms)}
        of = np.array(sorted((term_no[t], item_no[i]) for i, t in pairs), np.int64).reshape(-1, 2)
        self.first = np.searchsorted(of[:, 0], np.arange(len(self.terms) + 1))
        self.item = of[:, 1]
        self._automaton = None

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick
            a = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, t in enumerate(self.terms):
                # One character a byte, so the automaton sees the text's UTF-8 bytes.
                a.add_word(" " + t.encode().decode("latin-1") + " ", k)
            if self.terms:
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def scan(self, data: np.ndarray, offs: np.ndarray):
        """Of the texts ``data[offs[i]:offs[i + 1]]``: how many terms each
        has, and the distinct (text, term number, occurrences)."""
        n = len(offs) - 1
        # A guard before each text and one at the end; neighbouring terms share a guard.
        guarded = np.full(len(data) + n + 1, _GUARD, np.uint8)
        guarded[np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offs))] = data
        raw = guarded.tobytes().translate(_BYTES)
        inside = np.frombuffer(raw, np.uint8) != _GUARD
        begins = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        edge = offs + np.arange(n + 1)
        size = np.diff(np.searchsorted(begins, edge))
        none = np.zeros(0, np.int64)
        if not self.terms:
            return size, none, none, none
        found = np.fromiter((end << 32 | k for end, k in self.automaton().iter(raw.decode("latin-1"))), np.int64)
        # A match ends at the guard after its term, so the byte before is the text's own.
        text = np.searchsorted(edge, (found >> 32) - 1, "right") - 1
        both, times = np.unique(text * len(self.terms) + (found & 0xFFFFFFFF), return_counts=True)
        return size, both // len(self.terms), both % len(self.terms), times


_COUNTS = "doc_id {id}, n long, terms array<int>, tf array<long>"


def _counted(docs: DataFrame, shared) -> DataFrame:
    """(doc_id, n, terms, tf) of every row of ``docs(doc_id, text)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for at, data, offs in text_chunks(batch.column(1)):
                size, text, term, times = block.scan(data, offs)
                lists = pa.array(np.searchsorted(text, np.arange(len(offs))), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(size)), pa.array(size, pa.int64()),
                     pa.ListArray.from_arrays(lists, pa.array(term, pa.int32())),
                     pa.ListArray.from_arrays(lists, pa.array(times, pa.int64()))], ["doc_id", "n", "terms", "tf"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, _COUNTS.format(id=kind))


def _document_frequency(counts: DataFrame, n_terms: int) -> np.ndarray:
    """How many rows hold each term number: one partial row a task and term."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(n_terms, np.int64)
        for batch in batches:
            df += np.bincount(batch.column(0).flatten().to_numpy(), minlength=n_terms)
        k = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(df[k])], ["term", "df"])

    out = np.zeros(n_terms, np.int64)
    for r in counts.select("terms").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df")).collect():
        out[r[0]] = r[1]
    return out


def _length_part(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of each row: 100 - 90 + (90 * n * N) div L."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10 + 90 * n * n_docs // max(1, n_terms)


def _best(score: np.ndarray, item: np.ndarray, order: np.ndarray, top: int) -> np.ndarray:
    """Which rows are among their item's ``top`` by falling score, then rising order."""
    by = np.lexsort((order, -score, item))
    first = np.searchsorted(item[by], item[by], "left")
    return by[np.arange(len(by)) - first < top]


def _scored(counts: DataFrame, shared, weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, doc_id, score): each task's best rows of each item number."""
    id_type = counts.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        n_items = len(block.items)
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), None)
        bar = np.zeros(n_items, np.int64)
        rows = max(1, CELLS // max(1, n_items))

        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                m = _length_part(part.column(1).to_numpy(), n_docs, n_terms)
                # In a slice the offsets still count from the whole batch's start.
                offs = part.column(2).offsets.to_numpy().astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), np.diff(offs))
                term = part.column(2).flatten().to_numpy()
                tf = part.column(3).flatten().to_numpy()
                gain = weights[term] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
                # A term's gain goes to every item that has it.
                k = block.first[term + 1] - block.first[term]
                of = np.repeat(block.first[term] - np.cumsum(k) + k, k) + np.arange(k.sum())
                total = np.zeros(part.num_rows * n_items, np.int64)
                np.add.at(total, np.repeat(row, k) * n_items + block.item[of], np.repeat(gain, k))
                good = np.flatnonzero((total > 0) & (total >= np.tile(bar, part.num_rows)))
                if not len(good):
                    continue
                ids = part.column(0).take(pa.array(good // n_items))
                score = np.concatenate([held[0], total[good]])
                item = np.concatenate([held[1], good % n_items])
                ids = ids if held[2] is None else pa.concat_arrays([held[2], ids])
                order = pc.rank(ids, "ascending", null_placement="at_start", tiebreaker="dense").to_numpy()
                keep = _best(score, item, order.astype(np.int64), top)
                held = score[keep], item[keep], ids.take(pa.array(keep))
                full = np.bincount(held[1], minlength=n_items) >= top
                low = np.full(n_items, np.iinfo(np.int64).max)
                np.minimum.at(low, held[1], held[0])
                bar = np.where(full, low, 0)
        if held[2] is not None:
            yield pa.RecordBatch.from_arrays([pa.array(held[1], pa.int32()), held[2], pa.array(held[0])],
                                             ["item", "doc_id", "score"])

    return counts.mapInArrow(run, f"item int, doc_id {id_type}, score long")


def search(docs: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` best rows of
    ``docs(doc_id, text)`` for each item of ``items(item_id, text)``.

    A term is a maximal run of digits, letters and non-ASCII characters with
    A-Z lower-cased.  A document's score sums, over the item's distinct terms,
    w * ((10^9 * tf) div (1000 * tf + 8 * m)), where
    w = floor(1000 * ln((2N + 2) / (2df + 1))) and
    m = 100 - 90 + (90 * n * N) div L."""
    spark = docs.sparkSession
    short_batches(spark)
    docs = docs.select("doc_id", "text")
    pairs = staged(items.select("item_id", F.explode(F.regexp_extract_all(lower_ascii(F.col("text")), F.lit(TERM), 0))
                                .alias("term")).distinct())
    size = pairs.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    out, item_type = None, items.schema["item_id"].dataType
    for b in range(blocks):
        mine = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        block = Terms([(r[0], r[1]) for r in mine.collect()])
        shared = spark.sparkContext.broadcast(block)
        counts = staged(_counted(docs, shared))
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = _document_frequency(counts, len(block.terms))
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in df], np.int64)
        best = _scored(counts, shared, weights, n_docs, n_terms, top)
        order = F.col("score").desc(), F.col("doc_id").asc_nulls_first()
        # Slices of the tasks first, so no item's rows of all tasks meet at once.
        best = best.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(SLICES)))
        for key in (["item", "slice"], ["item"]):
            best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
            best = best.where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, i) for k, i in enumerate(block.items)],
                                      f"item int, item_id {item_type.simpleString()}")
        ranked = best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    return out
