"""Two Bloom filters over hashes: seen once, seen twice or more.

Each task gathers its partition's hashes and writes, per block of the bit
array, the bits of all hashes and the bits of hashes it saw twice
(compressed).  Blocks are merged by block number in the manner of a counter
that stops at two: a bit is twice-seen if it is so in one part or once-seen
in two.  A hash seen twice anywhere has all its bits twice-seen, so the
second filter never misses a repeat; it may suspect single hashes, which an
exact step after it clears.

The array's size follows the data up to ``MAX_BYTES``, which bounds what is
sent to the driver and broadcast.  Beyond that more hashes are suspected by
mistake and the exact step gets more to do; results don't change.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PROBES = 3
BLOCK_BITS = 1 << 20
MAX_BYTES = 256 << 20
_SCHEMA = "block int, once binary, twice binary"


def filter_bits(expected: int, per_hash: int = 12) -> int:
    """A power of two of at least ``per_hash`` bits a hash, within the bounds."""
    return min(8 * MAX_BYTES, max(BLOCK_BITS, 1 << (max(1, expected) * per_hash - 1).bit_length()))


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions of each 64-bit hash."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([(h + np.uint64(k) * step * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(7)
                           for k in range(PROBES)]) & np.uint64(bits - 1)


def _blocks(positions: np.ndarray) -> dict[int, bytes]:
    """Packed bits by block number."""
    pos = np.unique(positions).astype(np.int64)
    out = {}
    block = pos // BLOCK_BITS
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]])) if len(pos) else [0]
    for a, b in zip(edge, edge[1:]):
        bits = np.zeros(BLOCK_BITS, np.uint8)
        bits[pos[a:b] % BLOCK_BITS] = 1
        out[int(block[a])] = np.packbits(bits, bitorder="little").tobytes()
    return out


def _squeeze(raw: bytes) -> bytes:
    return pa.Codec("zstd").compress(raw, asbytes=True)


def _expand(raw: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(raw, BLOCK_BITS // 8, asbytes=True), np.uint8)


class Twice:
    """The twice-seen filter, as broadcast."""

    def __init__(self, bits: int, blocks: dict[int, bytes]):
        self.bits = bits
        self.blocks = blocks
        self._array: np.ndarray | None = None

    def __getstate__(self):
        return self.bits, self.blocks

    def __setstate__(self, state):
        self.bits, self.blocks = state
        self._array = None

    def array(self) -> np.ndarray:
        if self._array is None:
            a = np.zeros(self.bits // 8, np.uint8)
            for k, raw in self.blocks.items():
                a[k * BLOCK_BITS // 8:(k + 1) * BLOCK_BITS // 8] = _expand(raw)
            self._array = a
        return self._array

    def suspects(self, h: np.ndarray) -> np.ndarray:
        """Whether each hash may have been seen twice (never wrong if it was)."""
        if not self.blocks or not len(h):
            return np.zeros(len(h), bool)
        p = _positions(h, self.bits)
        a = self.array()
        hit = (a[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8)) & 1
        return hit.reshape(PROBES, -1).all(axis=0)


def twice_seen(rows: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], expected: int) -> Twice:
    """The filter of hashes that occur at least twice in all that ``hashes``
    gives (uint64) for the batches of ``rows``."""
    bits = filter_bits(expected)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, repeated, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64), []

        def settle():
            nonlocal seen, repeated
            new, n = np.unique(np.concatenate(held), return_counts=True)
            repeated = np.union1d(repeated, np.concatenate([new[n > 1], np.intersect1d(new, seen, True)]))
            seen = np.union1d(seen, new)
            held.clear()

        for b in batches:
            held.append(hashes(b))
            if sum(map(len, held)) > 1 << 20:
                settle()
        if held:
            settle()
        once, twice = _blocks(_positions(seen, bits)), _blocks(_positions(repeated, bits))
        for k, raw in once.items():
            again = twice.get(k)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([_squeeze(raw)], pa.binary()),
                 pa.array([_squeeze(again) if again else None], pa.binary())], ["block", "once", "twice"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Parts come ordered by block: one block is held at a time.
        block, once, twice = None, None, None

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), pa.array([None], pa.binary()),
                 pa.array([_squeeze(twice.tobytes())], pa.binary())], ["block", "once", "twice"])

        for b in batches:
            for k, o, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if k != block:
                    if block is not None and twice.any():
                        yield row()
                    block, once, twice = k, np.zeros(BLOCK_BITS // 8, np.uint8), np.zeros(BLOCK_BITS // 8, np.uint8)
                o = _expand(o)
                twice |= once & o
                if t is not None:
                    twice |= _expand(t)
                once |= o
        if block is not None and twice.any():
            yield row()

    # A task for each block, so what one reads does not grow with the array.
    merged = (rows.mapInArrow(part, _SCHEMA).repartition(max(1, bits // BLOCK_BITS), "block")
              .sortWithinPartitions("block").mapInArrow(merge, _SCHEMA))
    return Twice(bits, {r["block"]: bytes(r["twice"]) for r in merged.collect()})
