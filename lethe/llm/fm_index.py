"""A compressed FM-index over sequences of word numbers, in numpy.

The sequences of a shard are joined, each closed by a terminator.  The
suffix array is built by prefix doubling; the Burrows-Wheeler transform is
kept as a wavelet tree in matrix form: one packed bit vector per bit of the
word number, with a count of ones per 64 bits.  Only every
``sample``-th suffix position of a sequence is kept, so an occurrence is located by
stepping left until a sampled one.  Suffix array and text go after the build.

All operations take arrays and treat every element at once: backward search
of many phrases, location of many rows, and the matching statistics of many
sequences, right to left.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


class Bits:
    """A packed bit vector with a count of ones before each 64 bits."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        raw = np.zeros((n // 64 + 1) * 8, np.uint8)
        packed = np.packbits(flags, bitorder="little")
        raw[:len(packed)] = packed
        self.words = raw.view(np.uint64)
        self.ones = np.zeros(len(self.words), np.int32 if n < 1 << 31 else np.int64)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.ones[1:])

    def rank(self, pos: np.ndarray) -> np.ndarray:
        """Ones before ``pos``."""
        word = pos >> 6
        below = (_ONE << (pos & 63).astype(np.uint64)) - _ONE
        return self.ones[word] + np.bitwise_count(self.words[word] & below)

    def get(self, pos: np.ndarray) -> np.ndarray:
        return ((self.words[pos >> 6] >> (pos & 63).astype(np.uint64)) & _ONE).astype(np.int64)


class Borders(Bits):
    """A bit vector asked for the nearest one on either side.  The first and
    the last bit must be ones."""

    def __init__(self, flags: np.ndarray):
        super().__init__(flags)
        at = np.flatnonzero(flags)
        edge = np.arange(len(self.words)) * 64
        # The last one before each 64 bits, and the first one after them.
        self.last = at[np.maximum(np.searchsorted(at, edge) - 1, 0)].astype(self.ones.dtype)
        self.next = at[np.minimum(np.searchsorted(at, edge + 64), len(at) - 1)].astype(self.ones.dtype)

    def at_or_before(self, pos: np.ndarray) -> np.ndarray:
        word = pos >> 6
        x = self.words[word] & (_ALL >> (63 - (pos & 63)).astype(np.uint64))
        top = x.copy()
        for k in (1, 2, 4, 8, 16, 32):
            top |= top >> np.uint64(k)
        return np.where(x == 0, self.last[word], word * 64 + np.bitwise_count(top).astype(np.int64) - 1)

    def at_or_after(self, pos: np.ndarray) -> np.ndarray:
        word = pos >> 6
        x = self.words[word] & (_ALL << (pos & 63).astype(np.uint64))
        low = np.bitwise_count((x & (~x + _ONE)) - _ONE).astype(np.int64)
        return np.where(x == 0, self.next[word], word * 64 + low)


class WaveletMatrix:
    """Ranks and access over an array of symbols 0 .. sigma - 1."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n = n = len(symbols)
        self.levels = max(1, int(sigma - 1).bit_length())
        s = symbols.astype(np.uint32 if sigma <= 1 << 32 else np.uint64)
        self.bits, self.zeros = [], []
        for level in reversed(range(self.levels)):
            bit = ((s >> s.dtype.type(level)) & s.dtype.type(1)).astype(bool)
            self.bits.append(Bits(bit))
            self.zeros.append(n - int(bit.sum()))
            s = np.concatenate([s[~bit], s[bit]])
        self.start = self._walk(np.arange(sigma, dtype=np.int64), np.zeros(sigma, np.int64))

    def _walk(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            one = self.bits[k].rank(pos)
            pos = np.where((sym >> (self.levels - 1 - k)) & 1, self.zeros[k] + one, pos - one)
        return pos

    def rank(self, sym: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """Occurrences of ``sym`` before ``pos``."""
        return self._walk(sym, pos) - self.start[sym]

    def access_rank(self, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``pos`` and how often it occurs before."""
        sym, at = np.zeros(len(pos), np.int64), pos
        for k in range(self.levels):
            bit = self.bits[k].get(at)
            one = self.bits[k].rank(at)
            at = np.where(bit, self.zeros[k] + one, at - one)
            sym = sym << 1 | bit
        return sym, at - self.start[sym]


def suffix_order(first: np.ndarray) -> np.ndarray:
    """Suffix array of an array of ranks in which every suffix differs
    from the others (closed by distinct terminators), by prefix doubling."""
    n = len(first)
    rank, k = first.astype(np.int64), 1
    key = rank
    while True:
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        s = key[order]
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])]) if n else []
        if n == 0 or new.max() == n - 1:
            return order
        rank = new
        later = np.zeros(n, np.int64)
        later[:n - k] = rank[k:] + 1
        key = rank * (n + 1) + later
        k *= 2


class FMIndex:
    """``symbols``: word numbers from 1 of all sequences one after another;
    ``sizes``: words of each sequence; ``sigma``: largest word number + 1.
    With ``window``, rows that agree in their first ``window`` words are
    marked as a class by the bit of its first row."""

    def __init__(self, symbols: np.ndarray, sizes: np.ndarray, sigma: int, sample: int = 16, window: int | None = None):
        count = len(sizes)
        ends = np.cumsum(sizes + 1) - 1
        self.begin = ends - sizes  # of each sequence in the joined text
        self.sizes = sizes
        n = int(ends[-1]) + 1 if count else 0
        text = np.zeros(n, np.int64)
        inner = np.ones(n, bool)
        inner[ends] = False
        text[inner] = symbols
        first = text + count - 1
        first[ends] = np.arange(count)  # distinct terminators, below all words
        self.n, self.sigma = n, sigma
        rows = suffix_order(first)
        self.tree = WaveletMatrix(text[rows - 1] if n else text, sigma)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])[:sigma]
        # Suffix positions kept: each sequence's start (no step crosses a terminator) and every sample-th after it.
        offset = np.arange(n) - np.repeat(self.begin, sizes + 1)
        keep = (offset % sample == 0)[rows]
        self._kept, self._sampled = Bits(keep), rows[keep]
        self.window = window
        if window:
            self._borders = Borders(np.concatenate([[True], _differ(text, rows, window), [True]]))

    def word_positions(self) -> np.ndarray:
        """Joined position of each word."""
        return np.arange(int(self.sizes.sum())) + np.repeat(np.arange(len(self.sizes)), self.sizes)

    def step(self, sym: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) after extension to the left by a word each."""
        return self.before[sym] + self.tree.rank(sym, lo), self.before[sym] + self.tree.rank(sym, hi)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of each row of a matrix of phrases of one length, by backward search."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        live = np.arange(len(phrases))
        for k in reversed(range(phrases.shape[1])):
            lo[live], hi[live] = self.step(phrases[live, k], lo[live], hi[live])
            live = live[hi[live] > lo[live]]
        empty = hi <= lo
        lo[empty] = hi[empty] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Joined text position of each row, from the sampled positions."""
        out, at, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        live = np.arange(len(rows))
        while len(live):
            done = self._kept.get(at).astype(bool)
            out[live[done]] = self._sampled[self._kept.rank(at[done])] + steps
            live, at = live[~done], at[~done]
            sym, before = self.tree.access_rank(at)
            at = self.before[sym] + before
            steps += 1
        return out

    def window_rows(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Matching statistics, cut at ``window``, of sequences streamed right
        to left: for each of their windows (sequence by sequence, in order)
        the rows [lo, hi) that start with it.  Every window must be indexed.

        A step extends the rows of the window to the right by a word to the
        left, then widens them to the class of equal first ``window`` words."""
        windows = np.maximum(sizes - self.window + 1, 0)
        base = np.concatenate([[0], np.cumsum(windows)])
        lo_of, hi_of = np.zeros(base[-1], np.int64), np.zeros(base[-1], np.int64)
        live = np.flatnonzero(windows)
        lo, hi = np.zeros(len(live), np.int64), np.full(len(live), self.n)
        at = np.cumsum(sizes)[live] - 1
        for _ in range(self.window):
            lo, hi = self.step(symbols[at], lo, hi)
            at = at - 1
        left = windows[live] - 1
        while len(live):
            lo_of[base[live] + left], hi_of[base[live] + left] = lo, hi
            go = left > 0
            live, left, lo, hi, at = live[go], left[go] - 1, lo[go], hi[go], at[go]
            if len(live):
                lo, _ = self.step(symbols[at], lo, hi)
                lo, hi, at = self._borders.at_or_before(lo), self._borders.at_or_after(lo + 1), at - 1
        return lo_of, hi_of

    def least(self, values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest of ``values`` (one a sequence) among the sequences in
        which the rows [lo, hi) occur, located from the sampled positions.
        Ranges are equal or apart, and none is empty."""
        if not len(lo):
            return np.zeros(0, values.dtype)
        first, at, which = np.unique(lo, return_index=True, return_inverse=True)
        size = hi[at] - first
        begin = np.cumsum(size) - size
        rows = np.arange(int(size.sum())) + np.repeat(first - begin, size)
        of = np.searchsorted(self.begin, self.locate(rows), "right") - 1
        return np.minimum.reduceat(values[of], begin)[which.ravel()]


def _differ(text: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """Whether each row but the first differs from the one before it in its
    first ``length`` words (a terminator differs from all)."""
    a, b = rows[:-1], rows[1:]
    out = np.ones(len(a), bool)
    live = np.arange(len(a))
    for k in range(length):
        x, y = a[live] + k, b[live] + k
        ok = (x < len(text)) & (y < len(text))
        live, x, y = live[ok], x[ok], y[ok]
        live = live[(text[x] == text[y]) & (text[x] > 0)]
    out[live] = False
    return out
