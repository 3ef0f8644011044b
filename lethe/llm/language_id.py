"""Language ID: sparse multinomial logistic regression on TF-IDF of hashed
character n-grams, trained by follow-the-regularised-leader.

Texts are lower-cased, all but letters become blanks, and their 1- to
``LONGEST``-grams are hashed to ``DIMENSIONS`` features.  Document
frequencies come from all documents that may be learnt from.  The weights
are trained with elastic-net penalties (most become zero) on at most
``SAMPLE`` documents of each language (fewer of each if there are many
languages; none is left out), picked by a hash of doc_id and text; a part of
these, unseen, sets the temperature that makes the scores probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lethe.llm.common import learning_window, short_batches

# Documents of a language that the weights are trained on, at most; and of all
# languages, as long as each has LEAST.
SAMPLE, SAMPLE_ALL, LEAST = 600, 20_000, 10
# Of a longer text, so many consecutive characters are learnt from (see learning_window).
SAMPLE_CHARS = 100_000
DIMENSIONS = 1 << 15
LONGEST = 3
# Rate and penalties of the training.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
EPOCHS = 3
UNKNOWN = "und"

_letters: np.ndarray | None = None


def _is_letter() -> np.ndarray:
    global _letters
    if _letters is None:
        _letters = np.array([chr(i).isalpha() for i in range(0x110000)])
    return _letters


def features(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(feature, count) of a text, or None if it has no letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _is_letter()[c]
    if not letter.any():
        return None
    c = np.where(letter, c, np.uint32(32))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one blank after each word
    c = np.concatenate([[32], c[keep]]).astype(np.uint32)
    parts = []
    h = np.zeros(len(c), np.uint32)
    for n in range(1, LONGEST + 1):
        if len(c) < n:
            break
        h = h[:len(c) - n + 1] * np.uint32(0x01000193) + c[n - 1:] + np.uint32(n)
        x = h * np.uint32(0x9E3779B1)
        parts.append((x ^ (x >> np.uint32(15))) & np.uint32(DIMENSIONS - 1))
    counts = np.bincount(np.concatenate(parts), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray  # languages x features
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = (1 + np.log(count)) * self.idf[at]
        return x / max(1e-12, np.sqrt((x * x).sum()))

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.weights[at].T @ self.vector(at, count) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        f = features(text)
        if f is None or not self.languages:
            return UNKNOWN, 0.0
        p = softmax(self.logits(*f) / self.temperature)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray) -> Model:
    """``rows``: (language, features, counts), in a fixed order.  Every fifth of a language is kept for the temperature."""
    languages = sorted({r[0] for r in rows})
    k = {x: i for i, x in enumerate(languages)}
    model = Model(languages, idf, np.zeros((DIMENSIONS, len(languages))), np.zeros(len(languages)))
    held, used, seen = [], [], dict.fromkeys(languages, 0)
    for r in rows:
        seen[r[0]] += 1
        (held if seen[r[0]] % 5 == 0 else used).append(r)
    if len(rows) <= 10 * len(languages):
        used = rows
    z, n = np.zeros((DIMENSIONS + 1, len(languages))), np.zeros((DIMENSIONS + 1, len(languages)))

    def weights(at):
        w = -(z[at] - np.sign(z[at]) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(z[at]) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for language, at, count in used:
            at_b = np.append(at, DIMENSIONS)  # the bias is a feature of 1
            x = np.append(model.vector(at, count), 1.0)
            w = weights(at_b)
            p = softmax(x @ w)
            p[k[language]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[at_b] + g * g) - np.sqrt(n[at_b])) / ALPHA
            z[at_b] += g - sigma * w
            n[at_b] += g * g
    everything = weights(np.arange(DIMENSIONS + 1))
    model.weights, model.bias = everything[:-1], everything[-1]
    probe = held or used
    logits = np.array([model.logits(at, count) for _, at, count in probe]).reshape(len(probe), len(languages))
    truth = np.array([k[r[0]] for r in probe])

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(s)), truth]).mean()) if len(s) else 0.0

    a, b = np.log(0.05), np.log(20.0)  # golden section: the loss has one minimum
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    model.temperature = float(np.exp((a + b) / 2))
    return model


def held_out(doc_id):
    """Whether a document is kept from learning (a null id is not)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with a letter, and those with each feature: a vector per task,
    summed in two steps so that few vectors reach the driver."""
    def sums(of) -> bytes:
        return of.tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            for t in b.column(0):
                f = features(t.as_py())
                if f is not None:
                    df[f[0]] += 1
                    df[-1] += 1
        yield pa.RecordBatch.from_arrays([pa.array([sums(df)], pa.binary())], ["df"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIMENSIONS + 1, np.int64)
        for b in batches:
            for v in b.column(0):
                df += np.frombuffer(v.as_py(), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([sums(df)], pa.binary())], ["df"])

    parts = texts.mapInArrow(count, "df binary").repartition(16).mapInArrow(add, "df binary").collect()
    total = np.sum([np.frombuffer(r[0], np.int64) for r in parts], axis=0)
    return int(total[-1]), total[:-1]


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """The model from text and lang of documents that are not held out and have a lang."""
    short_batches(docs.sparkSession)
    rows = docs.select(docs["doc_id"].cast("bigint").alias("id"), docs["text"].alias("text"),
                       docs["lang"].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    texts, df = _document_frequencies(rows.select("text"))
    idf = np.log((1 + texts) / (1 + df)) + 1
    # Every language, and the smallest hash in it, so that none is left without a row.
    rows = rows.where(F.length("text") > 0).withColumn("o", F.xxhash64(F.coalesce("id", F.lit(0)), "text"))
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min("o").alias("first")).collect()
    if not counts:
        return Model([], idf, np.zeros((DIMENSIONS, 0)), np.zeros(0))
    sample = min(sample, max(LEAST, SAMPLE_ALL // len(counts)))
    # A share of the hash range that holds more than ``sample`` rows, then the first of them.
    part = 1 << 30
    shares = [(r.lang, r.first, int(part * min(1.0, (1.2 * sample + 50) / r.n))) for r in counts]
    table = docs.sparkSession.createDataFrame(shares, "lang string, first bigint, share bigint")
    keys = (rows.select("lang", "o").join(F.broadcast(table), "lang")  # a row per language
            .where((F.col("o") == F.col("first")) | (F.pmod("o", F.lit(part)) < F.col("share")))
            .select("lang", "o").distinct().collect())
    by_lang: dict[str, list[int]] = {}
    for r in keys:
        by_lang.setdefault(r.lang, []).append(r.o)
    chosen = [(lang, o) for lang, of in by_lang.items() for o in sorted(of)[:sample]]
    table = docs.sparkSession.createDataFrame(chosen, "lang string, o bigint")
    picked = (rows.join(F.broadcast(table), ["lang", "o"])  # two numbers a row of the sample
              .select("o", "lang", learning_window(F.col("text"), SAMPLE_CHARS).alias("text")).dropDuplicates(["lang", "o"]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for o, lang, text in zip(*(b.column(k) for k in range(3))):
                f = features(text.as_py())
                if f is not None:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([o.as_py()]), pa.array([lang.as_py()], pa.string()),
                         pa.array([f[0].astype("<i4").tobytes()], pa.binary()),
                         pa.array([f[1].astype("<i4").tobytes()], pa.binary())], ["o", "lang", "at", "n"])

    got = picked.mapInArrow(extract, "o bigint, lang string, at binary, n binary").collect()
    got.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    return train([(r[1], np.frombuffer(r[2], "<i4").astype(np.int64), np.frombuffer(r[3], "<i4")) for r in got], idf)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row per row of ``docs``.

    Null texts and those without a letter are ``und`` with score 0, as are
    all texts if no language could be learnt.  Rows are independent."""
    short_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [shared.value.predict(t.as_py()) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x for x, _ in got], pa.string()),
                 pa.array([min(1.0, s) for _, s in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return (docs.select(docs["doc_id"].cast("bigint"), held_out(docs["doc_id"]), docs["text"])
            .mapInArrow(run, "doc_id bigint, held_out boolean, lang_pred string, score double"))
