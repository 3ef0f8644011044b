"""Toxicity: a support vector machine on a subsequence string kernel, with
Nyström landmarks.

The kernel of two strings sums over their common subsequences of ``ORDER``
characters, each weighted by ``DECAY`` to the length that it spans in both,
so a gap or an inserted character weakens a match and does not end it.
Landmarks are strings that set the toxic documents of the training sample
apart, by being there or by how often they are; they are chosen until they
cover these documents, so that small languages get theirs.  A sentence's
similarity to a landmark is that of its best word; the Nyström map turns the
similarities into features of a linear machine.  It is trained on sentences:
all of a clean document's are clean, and of a toxic document those are toxic
that the machine finds worse than nearly all clean documents (chosen anew in
each round, first by whole documents).  A second linear machine judges the
document, from its worst sentence and from how many of its words, and what
share of them, match each landmark.  Its margin is put on a logistic scale fitted to documents that
the machines have not seen, with one half at the best cut.

Training reads at most ``TRAIN_DOCS`` labelled documents of either label,
picked by a hash of their ids, and runs on the driver; its result is a few
thousand numbers.  Scoring covers every whole text, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import (BLANK_BYTE, LOWER_BYTE, byte_table, learning_window, short_batches, span_hashes, text_chunks,
                              word_spans)

# Labelled documents of either label that the machine learns from, at most,
# and the characters of a longer text that it learns from (see learning_window).
TRAIN_DOCS = 2000
TRAIN_CHARS = 100_000
ORDER = 4
DECAY = 0.5
# Landmarks, at most; fewer if fewer tell toxic documents from clean ones.
LANDMARKS = 96
# Bytes of landmarks.
SIZES = (4, 5, 6, 7, 8, 9, 10, 11, 12)
# A landmark is chosen by the documents that have it at least so many times, for the best of 1 to TIMES.
TIMES = 4
# Strings that landmarks are chosen from, at most.
CANDIDATES = 10_000
# A word matches a landmark from these shares of the landmark's kernel with itself on: it holds it, or most of it.
LEVELS = (0.95, 0.5)
# Toxic sentences and documents below this quantile of the clean documents' worst sentences are left out of a fit.
USUAL = 0.95
# A clean document rejected costs as much as so many toxic ones passed, share by share.
FALSE_COST = 6.0
PLATEAU = 0.02
# Words longer than PIECE bytes are compared by overlapping pieces of that size.
PIECE = 24
SENTENCE_END = byte_table(lambda b: b in b".!?")
# Stands before every word, so that a match at its start counts more.
START = b"^"
_KIND = np.where(np.arange(256) > 0, np.uint64(1) << (np.arange(256) % 64).astype(np.uint64), np.uint64(0))
LETTER_BYTE = byte_table(lambda b: b >= 0x80 or 0x61 <= b <= 0x7A)


def subsequence_kernel(s: np.ndarray, s_len: np.ndarray, t: np.ndarray, t_len: np.ndarray,
                       order: int = ORDER, decay: float = DECAY) -> np.ndarray:
    """Kernel of row pairs of two padded byte matrices (0 pads), scaled so
    that one common contiguous substring of ``order`` bytes gives 1."""
    n, ls, lt = len(s), s.shape[1], t.shape[1]
    same = [[(s[:, x] == t[:, y]) & (x < s_len) & (y < t_len) for y in range(lt)] for x in range(ls)]
    square = decay * decay
    before = [[np.ones(n, np.float32)] * (lt + 1) for _ in range(ls + 1)]
    zero = np.zeros(n, np.float32)
    for _ in range(1, order):
        now = [[zero] * (lt + 1)]
        for x in range(ls):
            row, ending = [zero], zero
            for y in range(lt):
                ending = decay * ending + np.where(same[x][y], square * before[x][y], 0)
                row.append(decay * now[x][y + 1] + ending)
            now.append(row)
        before = now
    total = np.zeros(n, np.float32)
    for x in range(ls):
        for y in range(lt):
            total += np.where(same[x][y], before[x][y], 0)
    return total * np.float32(square / decay ** (2 * order))


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in strings], np.int64)
    m = np.zeros((len(strings), max(1, int(size.max(initial=0)))), np.uint8)
    m[np.arange(m.shape[1]) < size[:, None]] = np.frombuffer(b"".join(strings), np.uint8)
    return m, size


class Landmarks:
    """Similarities of words to the landmarks."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.codes, self.sizes = _matrix(strings)
        # For the bit-parallel longest common subsequence: positions of each byte value.
        self.places = np.zeros((256, len(strings)), np.uint16)
        for k, x in enumerate(strings):
            for i, c in enumerate(x):
                self.places[c, k] |= 1 << i
        # Kinds of bytes in each landmark, and how many of them a word must have for ORDER common bytes.
        self.kinds = np.array([np.bitwise_or.reduce(_KIND[np.frombuffer(x, np.uint8)]) for x in strings])
        self.shared = ORDER - (self.sizes - np.bitwise_count(self.kinds))
        self.full = np.array([(1 << len(x)) - 1 for x in strings], np.uint16)
        self.scale = np.sqrt(np.maximum(subsequence_kernel(self.codes, self.sizes, self.codes, self.sizes), 1e-9))

    def between(self) -> np.ndarray:
        m = len(self.strings)
        i, j = np.repeat(np.arange(m), m), np.tile(np.arange(m), m)
        k = subsequence_kernel(self.codes[i], self.sizes[i], self.codes[j], self.sizes[j]).reshape(m, m)
        return k / self.scale[:, None] / self.scale

    def _close(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (word, landmark) with a common subsequence of ORDER bytes; the kernel of others is 0."""
        kinds = np.bitwise_or.reduce(_KIND[codes], axis=1)
        w, m = np.nonzero(np.bitwise_count(kinds[:, None] & self.kinds) >= self.shared)
        v = self.full[m]
        for x in range(codes.shape[1]):
            u = v & self.places[codes[w, x], m]  # a pad has no places: nothing changes
            v = (v + u) | (v - u)
        common = self.sizes[m] - np.bitwise_count(v & self.full[m])
        return w[common >= ORDER], m[common >= ORDER]

    def similarities(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of byte spans: the numbers of those with a similarity above 0, and their rows."""
        size = ends - starts
        at, rows = [], []
        order = np.argsort(size, kind="stable")
        order = order[size[order] >= ORDER - 1]
        edges = np.searchsorted(size[order], [0, 6, 8, 10, 13, 17, PIECE + 1])
        for a, b in zip(edges, edges[1:]):
            for c in range(a, b, 1 << 14):
                k = order[c:min(b, c + (1 << 14))]
                width = int(size[k].max())
                col = np.arange(width)
                codes = np.full((len(k), width + 1), START[0], np.uint8)
                codes[:, 1:] = data[np.minimum(starts[k][:, None] + col, len(data) - 1)] * (col < size[k][:, None])
                w, m = self._close(codes)
                if not len(w):
                    continue
                value = subsequence_kernel(codes[w], size[k][w] + 1, self.codes[m], self.sizes[m]) / self.scale[m]
                row = np.zeros((len(k), len(self.strings)), np.float32)
                row[w, m] = value
                some = np.unique(w)
                at.append(k[some])
                rows.append(row[some])
        if not at:
            return np.zeros(0, np.int64), np.zeros((0, len(self.strings)), np.float32)
        return np.concatenate(at), np.concatenate(rows)


def sentence_words(data: np.ndarray, offs: np.ndarray):
    """(start, end, sentence number) of the words of texts and the text of
    each sentence.  Neighbouring words of one byte count as one word, and a
    word of over PIECE bytes as overlapping pieces."""
    starts, ends, text = word_spans(data, offs, ~BLANK_BYTE)
    if not len(starts):
        return starts, ends, text, text
    lines = np.cumsum(data == 0x0A)
    first = np.concatenate([[True], (text[1:] != text[:-1]) | (lines[starts[1:]] != lines[starts[:-1]])
                            | SENTENCE_END[data[ends[:-1] - 1]] & (ends[:-1] - starts[:-1] > 1)])
    sentence = np.cumsum(first) - 1
    of_text = text[first]
    # Spaced letters: a run of one-byte words inside a sentence.
    single = ends - starts == 1
    glued = np.concatenate([[False], single[1:] & single[:-1] & ~first[1:]])
    head = ~glued
    last = np.concatenate([head[1:], [True]])
    starts, ends, sentence = starts[head], ends[last], sentence[head]
    long = np.flatnonzero(ends - starts > PIECE)
    if len(long):
        half = PIECE // 2
        times = np.ones(len(starts), np.int64)
        times[long] = -(-(ends[long] - starts[long] - half) // half)
        which = np.repeat(np.arange(len(starts)), times)
        step = np.arange(len(which)) - np.repeat(np.cumsum(times) - times, times)
        starts, ends, sentence = starts[which] + half * step, ends[which], sentence[which]
        ends = np.minimum(ends, starts + PIECE)
    return starts, ends, sentence, of_text


def sentence_rows(landmarks: Landmarks, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks (first text, texts, text of each sentence with a similarity above 0, its similarities,
    features of the texts)."""
    m = len(landmarks.strings)
    for first, raw, offs in text_chunks(column):
        data = LOWER_BYTE[raw]
        starts, ends, sentence, of_text = sentence_words(data, offs)
        _, one, which = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        at, rows = landmarks.similarities(data, starts[one], ends[one])
        row_of = np.full(len(one), -1, np.int64)
        row_of[at] = np.arange(len(at))
        row = row_of[which.ravel()]
        some = np.flatnonzero(row >= 0)
        n = len(offs) - 1
        counts = np.zeros((n, len(LEVELS), m), np.float32)
        for k, level in enumerate(LEVELS):
            w, mark = np.nonzero(rows >= level * landmarks.scale)
            # Occurrences: the words' numbers among the distinct ones that match.
            held = np.isin(row, w)
            text, number = of_text[sentence[held]], row[held]
            begin, end = np.searchsorted(w, number), np.searchsorted(w, number, "right")
            size = end - begin
            at_mark = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
            counts[:, k] = np.bincount(np.repeat(text, size) * m + mark[at_mark], minlength=n * m).reshape(n, m)
        words = np.bincount(of_text[sentence], minlength=n) if len(sentence) else np.zeros(n)
        told = document_features(counts, words)
        if len(some):
            s = sentence[some]  # ascending
            begin = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            best = np.maximum.reduceat(rows[row[some]], begin, axis=0)
            yield first, n, of_text[s[begin]], best, told
        else:
            yield first, n, np.zeros(0, np.int64), np.zeros((0, m), np.float32), told


def document_features(counts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Of texts' matching words (text, level, landmark): how many, and what share of all words, both to 1."""
    many = np.log2(1 + np.minimum(counts, 7)) / 3
    share = np.minimum(1, 50 * counts / np.maximum(words, 50)[:, None, None])
    return np.concatenate([many, share], 1).reshape(len(counts), -1)


@dataclass
class Model:
    """Score of a document: logistic(slope * margin + shift)."""

    landmarks: Landmarks | None
    weights: np.ndarray  # per landmark similarity, the Nyström map included
    bias: float
    whole: np.ndarray  # of the document: worst sentence's margin, document features, bias
    slope: float
    shift: float
    constant: float = 0.0  # without both labels to learn from

    def margins(self, column) -> np.ndarray:
        """The margin of each text."""
        out = np.zeros(len(column))
        for first, n, x in self.rows(column):
            out[first:first + n] = x @ self.whole[:-1] + self.whole[-1]
        return out

    def rows(self, column) -> Iterator[tuple[int, int, np.ndarray]]:
        """Chunks (first text, texts, what the document's machine reads); every text has an empty sentence."""
        for first, n, text, rows, told in sentence_rows(self.landmarks, column):
            worst = np.full(n, self.bias)
            np.maximum.at(worst, text, rows @ self.weights + self.bias)
            yield first, n, np.concatenate([np.clip(worst, -3, 3)[:, None], told], 1)

    def scores(self, column) -> np.ndarray:
        if self.landmarks is None:
            return np.full(len(column), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(column) + self.shift, -40, 40)))


def _grams(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct strings of n letters in a text's words (their start counts as a letter): hashes, counts to
    TIMES, first places in the bytes that come last."""
    data = LOWER_BYTE[np.frombuffer(b" " + raw, np.uint8)]
    blank = BLANK_BYTE[data]
    data = np.where(blank, np.uint8(START[0]), data)
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), data
    letter = np.concatenate([[0], np.cumsum(LETTER_BYTE[data])])
    inner = letter[n:] - letter[1:len(letter) - n + 1] == n - 1
    at = np.flatnonzero(inner & (LETTER_BYTE[data[:len(data) - n + 1]] | blank[:len(data) - n + 1]))
    h, first, count = np.unique(span_hashes(data, at, at + n), return_index=True, return_counts=True)
    return h, np.minimum(count, TIMES), at[first], data


def _candidates(toxic: list[bytes], clean: list[bytes], n: int) -> list[tuple[float, float, bytes, np.ndarray]]:
    """(evidence, log odds, string, toxic texts with it) of the strings of n bytes that are more frequent in toxic texts."""
    found = [_grams(x, n) for x in toxic]
    h = np.concatenate([x[0] for x in found])
    if not len(h):
        return []
    times, text = np.concatenate([x[1] for x in found]), np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
    place = np.concatenate([x[2] for x in found])
    order = np.argsort(h, kind="stable")
    h, times, text, place = h[order], times[order], text[order], place[order]
    begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    end = np.append(begin[1:], len(h))
    often = end - begin >= 3
    begin, end = begin[often], end[often]
    if not len(begin):
        return []
    names = h[begin]
    which = np.repeat(np.arange(len(begin)), end - begin)
    inside = np.repeat(begin - (np.cumsum(end - begin) - (end - begin)), end - begin) + np.arange(len(which))
    df, other = np.zeros((TIMES, len(names))), np.zeros((TIMES, len(names)))
    for k in range(TIMES):
        df[k] = np.bincount(which[times[inside] > k], minlength=len(names))
    for x in clean:
        own, count, _, _ = _grams(x, n)
        at = np.minimum(np.searchsorted(names, own), len(names) - 1)
        hit = names[at] == own
        for k in range(TIMES):
            other[k, at[hit & (count > k)]] += 1
    # An odds ratio with add-one counts.
    odds = np.log((df + 1) / (len(toxic) + 2) / ((other + 1) / (len(clean) + 2)))
    value = np.where(df >= 3, df * odds, -1)
    best = value.argmax(0)
    value, odds = value.max(0), odds[best, np.arange(len(names))]
    out = []
    for i in np.argsort(-value, kind="stable")[:CANDIDATES]:
        if value[i] <= 0:
            break
        p = slice(begin[i], end[i])
        data = found[text[p.start]][3]
        out.append((float(value[i]), float(odds[i]), data[place[p.start]:place[p.start] + n].tobytes(), text[p][times[p] > best[i]]))
    return out


def choose_landmarks(toxic: list[bytes], clean: list[bytes]) -> list[bytes]:
    """Strings that far more toxic texts than clean ones have, or have so many times.

    Each is the best for the toxic texts that the ones before it leave: a text counts half after every landmark in it.
    Strings in the same texts as another are left out, longer forms of one that tell no more than it, and what is left
    when the rest tells no more than chance would among so many strings."""
    found = [x for n in SIZES for x in _candidates(toxic, clean, n)]
    found.sort(key=lambda x: (-x[0], -len(x[2]), x[2]))
    found = found[:CANDIDATES]
    least = np.log(max(2, len(found)))
    holds = np.zeros((len(found), len(toxic)), np.float32)
    for k, x in enumerate(found):
        holds[k, x[3]] = 1
    size = holds.sum(1)
    # Of equals the longer string.
    worth = np.array([x[1] * (1 + 0.01 * len(x[2])) for x in found], np.float32)
    left, open_ = np.ones(len(toxic), np.float32), np.ones(len(found), bool)
    chosen: list[bytes] = []
    while len(chosen) < LANDMARKS and open_.any():
        gain = np.where(open_, (holds @ left) * worth, -1)
        k = int(np.argmax(gain))
        if gain[k] < least and chosen:
            break
        chosen.append(found[k][2])
        left[holds[k] > 0] *= 0.5
        both = holds @ holds[k]
        open_ &= both <= 0.7 * (size + size[k] - both)
        open_ &= np.array([found[k][2].lstrip(START) not in x[2] or x[1] > found[k][1] + 1 for x in found])
        open_[k] = False
    return chosen or [b"none"]


def fit_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1.0) -> np.ndarray:
    """Linear machine with squared hinge loss (last weight: the bias), by Newton steps."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1)
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        new = np.linalg.solve(ridge + cost * a.T @ x[on], cost * a.T @ y[on])
        if np.allclose(new, w, atol=1e-9):
            break
        w = 0.5 * w + 0.5 * new if _ > 25 else new
    return w


def fit_logistic(margin: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the probability of label 1, by damped Newton steps."""
    x = np.stack([margin, np.ones(len(margin))], 1)
    w = np.zeros(2)
    # Targets drawn in a little, as for few documents.
    t = np.where(label == 1, (label.sum() + 1) / (label.sum() + 2), 1 / ((1 - label).sum() + 2))
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (t - p)) - 1e-3 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, g)
        step *= min(1, 5 / max(1e-9, np.abs(step).max()))
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(w[1])


def train(toxic: list[str], clean: list[str], share: float | None = None) -> Model:
    """``share``: how many of all labelled documents are toxic."""
    if not toxic or not clean:
        return Model(None, np.zeros(0), 0, np.zeros(0), 0, 0, constant=1.0 if toxic else 0.0)
    cut_t, cut_c = -(-3 * len(toxic) // 4), -(-3 * len(clean) // 4)
    strings = choose_landmarks([t.encode() for t in toxic[:cut_t]], [t.encode() for t in clean[:cut_c]])
    marks = Landmarks(strings)
    values, vectors = np.linalg.eigh(marks.between().astype(np.float64))
    inverse = np.where(values > 1e-3 * values.max(), 1 / np.sqrt(np.maximum(values, 1e-12)), 0)
    to_features = (vectors * inverse) @ vectors.T

    def sentences(texts):
        of, rows = [], []
        for first, _, text, x, _ in sentence_rows(marks, pa.array(texts, pa.string())):
            of.append(first + text)
            rows.append(x)
        return np.concatenate(of), np.concatenate(rows)

    of_t, x_t = sentences(toxic[:cut_t])
    of_c, x_c = sentences(clean[:cut_c])
    f_t, f_c = x_t @ to_features, x_c @ to_features
    # First by whole documents: the best similarity over all sentences.
    def whole(of, x):
        if not len(of):
            return np.zeros((0, len(strings)))
        begin = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        return np.maximum.reduceat(x, begin, axis=0) @ to_features

    pos, neg = whole(of_t, x_t), whole(of_c, x_c)
    w = None
    for _ in range(4):
        neg = np.concatenate([neg, np.zeros((1, len(strings)))])  # the empty sentence
        x, y = np.concatenate([pos, neg]), np.concatenate([np.ones(len(pos)), -np.ones(len(neg))])
        if not len(pos):
            return Model(None, np.zeros(0), 0, np.zeros(0), 0, 0, constant=float(share or 0))
        w = fit_machine(x, y, np.where(y > 0, len(x) / 2 / len(pos), len(x) / 2 / len(neg)))
        worst = f_t @ w[:-1]
        # A toxic document's sentences that are no worse than the worst of clean documents are left out.
        told = worst > np.quantile(_worst(of_c, f_c @ w[:-1], cut_c), USUAL)
        pos = f_t[told] if told.sum() > 5 else f_t
        neg = f_c
    model = Model(marks, to_features @ w[:-1], float(w[-1]), np.zeros(0), 1.0, 0.0)
    x = np.concatenate([x for _, _, x in model.rows(pa.array(toxic[:cut_t] + clean[:cut_c], pa.string()))])
    y = np.where(np.arange(len(x)) < cut_t, 1.0, -1.0)
    model.whole = fit_machine(x, y, np.where(y > 0, len(x) / 2 / cut_t, len(x) / 2 / cut_c))
    rest_t, rest_c = toxic[cut_t:] or toxic, clean[cut_c:] or clean
    margin = model.margins(pa.array(rest_t + rest_c, pa.string()))
    label = np.concatenate([np.ones(len(rest_t)), np.zeros(len(rest_c))])
    share = min(0.95, max(0.05, share if share is not None else len(toxic) / (len(toxic) + len(clean))))
    weight = np.where(label == 1, share * len(label) / len(rest_t), (1 - share) * len(label) / len(rest_c))
    model.slope = max(0.5, fit_logistic(margin, label, weight)[0])
    model.shift = -model.slope * best_cut(margin, label)
    return model


def best_cut(margin: np.ndarray, label: np.ndarray) -> float:
    """The margin that scores one half: the middle of those whose share of
    toxic documents above them, less FALSE_COST times that of clean ones, is
    within PLATEAU of the best."""
    order = np.argsort(-margin, kind="stable")
    m, y = margin[order], label[order]
    gain = np.cumsum(y) / y.sum() - FALSE_COST * np.cumsum(1 - y) / (1 - y).sum()
    last = np.concatenate([m[1:] < m[:-1], [True]])
    below = np.concatenate([m[1:], [m[-1] - 1]])
    good = last & (gain >= gain[last].max() - PLATEAU)
    return float((m[good].max() + below[good].min()) / 2)


def _worst(of: np.ndarray, value: np.ndarray, texts: int) -> np.ndarray:
    """The largest value of each text, 0 (the empty sentence) included."""
    out = np.zeros(texts)
    np.maximum.at(out, of, value)
    return out


def held_out(doc_id):
    """Whether a document is kept from learning (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Model:
    """The model from a sample of labelled documents that are not held out:
    at most ``most`` of either label, those of the smallest id hashes."""
    usable = (labels.select(labels["doc_id"].cast("bigint").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
              .where("doc_id is not null and toxic in (0, 1)").where(~held_out(F.col("doc_id"))).distinct())
    counts = {r[0]: r[1] for r in usable.groupBy("toxic").count().collect()}
    order = F.xxhash64("doc_id", F.lit(10))
    picked = None
    for label in counts:
        # A share of the hash range that holds about ``most`` ids, then the first of them.
        part = usable.where(F.col("toxic") == label)
        share = min(1.0, 1.2 * most / counts[label])
        part = part.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).orderBy(order, "doc_id").limit(most)
        picked = part if picked is None else picked.union(part)
    if picked is None:
        return Model(None, np.zeros(0), 0, np.zeros(0), 0, 0)
    text = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.coalesce(docs["text"], F.lit("")).alias("text"))
    rows = (text.join(F.broadcast(picked), "doc_id")  # at most 2 * most rows
            .select("doc_id", "toxic", learning_window(F.col("text"), TRAIN_CHARS).alias("text")).distinct()
            # Rows of one id beyond the bound go by their hashes, not by which task is first.
            .orderBy(order, F.xxhash64("text"), "toxic").limit(4 * most).collect())
    rows.sort(key=lambda r: (r[0] * 0x9E3779B97F4A7C15 & (1 << 64) - 1, r[2]))
    toxic, clean = [r[2] for r in rows if r[1] == 1], [r[2] for r in rows if r[1] == 0]
    return train(toxic, clean, counts.get(1, 0) / sum(counts.values()))


def score_toxicity(docs: DataFrame, model: Model, prefix: str = "") -> DataFrame:
    """``docs`` plus score (probability of label 1) and predicted (1 from 0.5
    on), names after ``prefix``; they replace columns of that name.

    Null or empty text scores as one empty sentence.  Rows are independent,
    so repeated rows repeat their results.  If only one label could be
    learnt, every score is that label; without labels it is 0."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c.lower() not in ((prefix + "score").lower(), (prefix + "predicted").lower())]
    at = docs.columns.index("text")
    keep = [docs.columns.index(c) for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = shared.value.scores(b.column(at))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(k) for k in keep), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))],
                [*names, prefix + "score", prefix + "predicted"])

    schema = docs.select(*names).schema
    return docs.mapInArrow(run, schema.add(prefix + "score", "double").add(prefix + "predicted", "integer"))
