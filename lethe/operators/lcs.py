"""X11: longest common subsequence lengths of pairs of token arrays.

The bit-parallel recurrence (Hyyrö 2004) holds a pair's state as one bit a
reference token.  Here the states of many pairs stand side by side in one
long integer, with room for each pair's carry, so one addition advances all
of them by a prediction token: no loop over pairs, O(|a| * |b| / 64) word
operations a pair.  Pairs of like lengths go together.
"""

from __future__ import annotations

import numpy as np

# Bytes of bit masks that a group of pairs takes, about.
GROUP_BYTES = 1 << 25


def _group_lengths(ref, ref_at, hyp, hyp_at, base: int, words: int) -> np.ndarray:
    """LCS lengths of the pairs whose tokens are ``ref`` and ``hyp`` (numbers
    below ``base``), pair i from ``*_at[i]`` to ``*_at[i + 1]``; a pair's state
    takes ``words`` 64-bit words, at least one bit more than its references."""
    pairs = len(ref_at) - 1
    n_ref, n_hyp = np.diff(ref_at), np.diff(hyp_at)
    of_ref, of_hyp = np.repeat(np.arange(pairs), n_ref), np.repeat(np.arange(pairs), n_hyp)
    place = np.arange(len(ref)) - np.repeat(ref_at[:-1], n_ref)
    keys, key = np.unique(of_ref * base + ref, return_inverse=True)
    # A row of bits for every (pair, token), and an empty one at the end.
    masks = np.zeros((len(keys) + 1, words), np.uint64)
    np.add.at(masks.reshape(-1), key.ravel() * words + place // 64, np.uint64(1) << (place % 64).astype(np.uint64))
    asked = of_hyp * base + hyp
    at = np.minimum(np.searchsorted(keys, asked), max(0, len(keys) - 1))
    row = np.where(keys[at] == asked, at, len(keys)) if len(keys) else np.zeros(len(hyp), np.int64)
    turn = np.full((int(n_hyp.max(initial=0)), pairs), len(keys))
    turn[np.arange(len(hyp)) - np.repeat(hyp_at[:-1], n_hyp), of_hyp] = row
    bits = np.arange(words * 64)[None, :] < n_ref[:, None]
    full = int.from_bytes(np.packbits(bits, axis=1, bitorder="little").tobytes(), "little")
    state = full
    for rows in turn:
        match = int.from_bytes(masks[rows].tobytes(), "little")
        hit = state & match
        state = ((state + hit) | (state - hit)) & full
    left = np.frombuffer(state.to_bytes(pairs * words * 8, "little"), np.uint8).reshape(pairs, -1)
    return n_ref - np.bitwise_count(left).sum(axis=1).astype(np.int64)


def lcs_lengths(ref: np.ndarray, ref_at: np.ndarray, hyp: np.ndarray, hyp_at: np.ndarray) -> np.ndarray:
    """The LCS length of every pair: ``ref`` and ``hyp`` are token numbers from
    0, pair i has ``ref[ref_at[i]:ref_at[i + 1]]`` and likewise of ``hyp``."""
    n_ref, n_hyp = np.diff(ref_at), np.diff(hyp_at)
    out = np.zeros(len(n_ref), np.int64)
    base = int(max(ref.max(initial=0), hyp.max(initial=0))) + 1
    words = n_ref // 64 + 1
    like = lambda n: np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)
    some = np.flatnonzero((n_ref > 0) & (n_hyp > 0))
    some = some[np.lexsort((like(n_hyp)[some], like(words)[some]))]
    kind = like(words)[some] * 64 + like(n_hyp)[some]
    size = (np.cumsum(n_ref[some] * words[some] * 8) // GROUP_BYTES)
    new = np.flatnonzero(np.diff(kind, prepend=-1).astype(bool) | np.diff(size, prepend=-1).astype(bool))

    def taken(tokens, at, which):
        n = np.diff(at)[which]
        ends = np.cumsum(n)
        return tokens[np.repeat(at[which] - ends + n, n) + np.arange(int(n.sum()))], np.concatenate([[0], ends])

    for which in np.split(some, new[1:]) if len(some) else []:
        out[which] = _group_lengths(*taken(ref, ref_at, which), *taken(hyp, hyp_at, which), base, int(words[which].max()))
    return out


def lcs_len(ref, hyp) -> int:
    """Length of the longest common subsequence of two token sequences."""
    if ref is None or hyp is None or len(ref) == 0 or len(hyp) == 0:
        return 0
    number = {t: k for k, t in enumerate(dict.fromkeys([*ref, *hyp]))}
    a, b = (np.array([number[t] for t in x], np.int64) for x in (ref, hyp))
    return int(lcs_lengths(a, np.array([0, len(a)]), b, np.array([0, len(b)]))[0])
