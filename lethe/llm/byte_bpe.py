"""Byte-level BPE encoding and decoding over length-bucketed numpy matrices.

A text is cut by the tokenizer's pattern.  The distinct pieces of a batch
are put into padded matrices, one per length bucket, a piece per row and an
id per cell.  Every round looks up the rank of all neighbouring pairs in an
open-addressing hash table, merges each row's leftmost pair of the lowest
rank and compacts the row; rows without a known pair are done.  Decoding
joins the bytes of the ids.

Rows of long pieces need many rounds, so there a round must not cost a whole
row: their ranks stand in blocks whose least ranks are kept, cells stay where
they are, linked to their neighbours, and the row is compacted only when half
of its cells are merged away.  The pairs merged, and their order, are the same.

The ranks file is a parameter.  Its tables (a few entries per vocabulary
id, whatever the corpus) are made on the driver and broadcast.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lethe.llm.common import mix, short_batches, text_chunks

# Distinct pieces remembered by a task between batches; beyond it only the
# last batch's are kept.
REMEMBERED = 150_000
# Cells of one matrix.
CELLS = 1 << 20
# Rows of more cells keep their least ranks by blocks of so many cells.
BLOCK = 512
_NONE = np.int32(2**31 - 1)


def load_ranks(path: str) -> list[bytes]:
    """The token bytes by id of a ``base64 rank`` file."""
    ranks = {}
    with open(path, "rb") as f:
        for line in f:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


def compiled(pattern: str):
    """The pattern with the Unicode meaning of ``\\s`` (White_Space), which
    the regex module widens by the separators U+001C to U+001F."""
    inside = r"\p{White_Space}"
    return regex.compile(pattern.replace(r"[^\s", f"[^{inside}").replace(r"\S", rf"\P{{White_Space}}")
                         .replace(r"\s", inside))


class PairTable:
    """(left id, right id) -> merged id: open addressing, probed in bulk."""

    def __init__(self, tokens: list[bytes]):
        by_bytes = {t: i for i, t in enumerate(tokens) if t}
        keys, merged = [], []
        for t, i in by_bytes.items():
            for k in range(1, len(t)):
                a, b = by_bytes.get(t[:k]), by_bytes.get(t[k:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    merged.append(i)
        size = 1 << max(4, (2 * len(keys)).bit_length())
        self.mask = np.uint64(size - 1)
        self.keys = np.full(size, np.uint64(2**64 - 1), np.uint64)
        self.ids = np.full(size, _NONE, np.int32)
        left, val = np.array(keys, np.uint64), np.array(merged, np.int32)
        slot = mix(left) & self.mask
        while len(left):
            # The first of each free slot settles; the others step on.
            free = self.keys[slot] == np.uint64(2**64 - 1)
            _, first = np.unique(slot, return_index=True)
            settle = np.zeros(len(slot), bool)
            settle[first] = True
            settle &= free
            self.keys[slot[settle]], self.ids[slot[settle]] = left[settle], val[settle]
            left, val, slot = left[~settle], val[~settle], (slot[~settle] + np.uint64(1)) & self.mask
        self.bytes_id = np.array([by_bytes.get(bytes([b]), -1) for b in range(256)], np.int32)

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.uint64) << np.uint64(32) | b.astype(np.uint64)
        out = np.full(key.shape, _NONE, np.int32).ravel()
        key = key.ravel()
        at = np.arange(len(key))
        slot = mix(key) & self.mask
        while len(at):
            seen = self.keys[slot]
            hit = seen == key
            out[at[hit]] = self.ids[slot[hit]]
            go = ~hit & (seen != np.uint64(2**64 - 1))
            at, key, slot = at[go], key[go], (slot[go] + np.uint64(1)) & self.mask
        return out.reshape(a.shape)


class Encoder:
    """Encodes distinct pieces; a vocabulary's ranks are its ids."""

    def __init__(self, tokens: list[bytes], pattern: str, pairs: PairTable | None = None):
        self.tokens = tokens
        self.split = compiled(pattern).findall
        self.whole = {t: i for i, t in enumerate(tokens) if t}
        self.pairs = pairs or PairTable(tokens)
        self.known: dict[str, bytes] = {}  # ids as little-endian 32-bit numbers
        size = np.array([len(t) for t in tokens], np.int64)
        self._token_size, self._token_at = size, np.cumsum(size) - size
        self._token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pieces of similar length."""
        size = np.array([len(p) for p in pieces])
        width = int(size.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < size[:, None]] = self.pairs.bytes_id[np.frombuffer(b"".join(pieces), np.uint8)]
        if (ids[np.arange(width) < size[:, None]] < 0).any():
            raise ValueError("the ranks lack a single byte of the text")
        out = [b""] * len(pieces)
        row, ranks = np.arange(len(pieces)), np.full((len(pieces), max(width - 1, 1)), _NONE, np.int32)
        if width > 1:
            pair = ids[:, 1:] >= 0
            ranks[pair] = self.pairs.lookup(ids[:, :-1][pair], ids[:, 1:][pair])
        while len(row):
            at = ranks.argmin(axis=1)
            best = ranks[np.arange(len(row)), at]
            done = best == _NONE
            if done.any():
                raw, wide = ids[done].astype("<u4").tobytes(), 4 * ids.shape[1]
                for k, (r, n) in enumerate(zip(row[done].tolist(), size[done].tolist())):
                    out[r] = raw[k * wide:k * wide + 4 * n]
                go = ~done
                row, ids, ranks, size, at, best = row[go], ids[go], ranks[go], size[go], at[go], best[go]
                if not len(row):
                    break
                width = int(size.max())
                ids, ranks = ids[:, :width], ranks[:, :width - 1]
            n = np.arange(len(row))
            ids[n, at] = best
            col = np.arange(ids.shape[1])
            # Compaction: the cells right of the merged pair move left by one.
            src = np.minimum(col + (col > at[:, None]), ids.shape[1] - 1)
            ids = np.take_along_axis(ids, src, 1)
            size = size - 1
            ids[n, size] = -1
            if ranks.shape[1]:
                col = np.arange(ranks.shape[1])
                src = np.minimum(col + (col > at[:, None]), ranks.shape[1] - 1)
                ranks = np.take_along_axis(ranks, src, 1)
                ranks[n, size - 1] = _NONE
                for shift in (-1, 0):  # only the pairs at the merged cell are new
                    left = at + shift
                    ok = (left >= 0) & (left + 1 < size)
                    if ok.any():
                        r, c = n[ok], left[ok]
                        ranks[r, c] = self.pairs.lookup(ids[r, c], ids[r, c + 1])
        return out

    def _merge_blocks(self, pieces: list[bytes]) -> list[bytes]:
        """As ``_merge``, for pieces of many bytes."""
        out = [b""] * len(pieces)
        for row, piece in enumerate(pieces):
            ids = self.pairs.bytes_id[np.frombuffer(piece, np.uint8)]
            if (ids < 0).any():
                raise ValueError("the ranks lack a single byte of the text")
            while True:
                ids, left = self._until_half(ids)
                if not left:
                    break
            out[row] = ids.astype("<u4").tobytes()
        return out

    def _until_half(self, ids: np.ndarray) -> tuple[np.ndarray, bool]:
        """Rounds on one row until it is done, or until half of its cells are
        merged away; the row without those cells, and whether pairs are left."""
        n = len(ids)
        blocks = -(-n // BLOCK)
        ranks = np.full(blocks * BLOCK, _NONE, np.int32)  # of the pair that begins in the cell
        ranks[:n - 1] = self.pairs.lookup(ids[:-1], ids[1:])
        least = ranks.reshape(blocks, BLOCK).min(axis=1)
        ids = ids.copy()
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        alive = np.ones(n, bool)
        gone = 0
        while 2 * gone <= n:
            block = int(least.argmin())
            best = least[block]
            if best == _NONE:
                return ids[alive], False
            # The first block with the least rank, and the first cell in it: the leftmost pair.
            at = block * BLOCK + int(ranks[block * BLOCK:(block + 1) * BLOCK].argmin())
            merged = after[at]
            ids[at], alive[merged], ranks[merged] = best, False, _NONE
            after[at] = after[merged]
            if after[at] < n:
                before[after[at]] = at
            gone += 1
            # Only the pairs at the merged cell are new.
            begins = [c for c in (before[at], at) if c >= 0]
            known = [c for c in begins if after[c] < n]
            for c in begins:
                ranks[c] = _NONE
            if known:
                ranks[known] = self.pairs.lookup(ids[known], ids[after[known]])
            for b in {block, int(merged) // BLOCK, int(begins[0]) // BLOCK}:
                least[b] = ranks[b * BLOCK:(b + 1) * BLOCK].min()
        return ids[alive], True

    def learn(self, pieces: list[str]) -> None:
        """Adds the ids of unknown distinct pieces to the memory."""
        todo = []
        for p in pieces:
            raw = p.encode("utf-8", "surrogatepass")
            i = self.whole.get(raw)
            if i is not None:
                self.known[p] = i.to_bytes(4, "little")
            else:
                todo.append((len(raw), raw, p))
        todo.sort(key=lambda x: x[0])
        i = 0
        while i < len(todo):
            # A bucket holds lengths up to a quarter above its shortest.
            most, j = todo[i][0] + max(1, todo[i][0] // 4), i
            while j < len(todo) and todo[j][0] <= most and (j == i or (j - i + 1) * todo[j][0] <= CELLS):
                j += 1
            merge = self._merge if most <= BLOCK else self._merge_blocks
            for (_, _, p), ids in zip(todo[i:j], merge([x[1] for x in todo[i:j]])):
                self.known[p] = ids
            i = j

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text (little-endian unsigned 32-bit)."""
        pieces = [self.split(t) for t in texts]
        distinct = set().union(*pieces)
        known = self.known
        if len(known) + len(distinct) > REMEMBERED:
            known = self.known = {p: known[p] for p in distinct if p in known}
        self.learn([p for p in distinct if p not in known])
        return [np.frombuffer(b"".join([known[p] for p in row]), "<u4") for row in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids' tokens, one after another."""
        size = self._token_size[ids]
        at = np.cumsum(size) - size
        return self._token_bytes[np.repeat(self._token_at[ids] - at, size) + np.arange(int(size.sum()))].tobytes()


def parts_of(text: pa.Array, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``size`` bytes of text (one longer text alone)."""
    at = 0
    for first, _, offs in text_chunks(text, size):
        yield first, first + len(offs) - 1
        at = first + len(offs) - 1
    if at < len(text):
        yield at, len(text)


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False,
                  keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Per row: the ``keep`` columns, n_tokens, the SHA-256 of the ids as
    little-endian unsigned 32-bit integers, that of the bytes decoded from
    the ids, and with ``with_ids`` the ids themselves (array<int>).

    Special tokens are never produced: their strings are ordinary text.
    Null text encodes as the empty text (no ids).  Rows are independent, so
    repeated rows repeat their results; nothing is shuffled."""
    spark = docs.sparkSession
    short_batches(spark)
    tokens = load_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((tokens, pattern, PairTable(tokens)))
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    schema = f"{fields}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value)
        names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
        for batch in batches:
            text = batch.column(len(keep))
            # A part of the batch at a time, so that little is held besides the batch itself.
            for i, j in parts_of(text):
                texts = [t or "" for t in text.slice(i, j - i).to_pylist()]
                ids = encoder.encode_batch(texts)
                counts = [len(x) for x in ids]
                cols = [batch.column(k).slice(i, j - i) for k in range(len(keep))]
                cols += [pa.array(counts, pa.int64()),
                         pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                         pa.array([hashlib.sha256(encoder.decode(x)).hexdigest() for x in ids], pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(*[docs[c] for c in keep], docs["text"]).mapInArrow(run, schema)
