"""Quality rules: a learned decision list over text statistics.

Statistics of every text are DataFrame expressions.  From labelled documents
sequential covering learns rules for bad ones: a rule grows by the threshold
that gains most, until it covers no good document, and is pruned on rows it
has not seen; what it covers is taken away and the next one grows.  The
ordered rules are one Spark conditional expression.

Learning uses at most ``SAMPLE`` labelled rows of either label (picked by a
hash of doc_id), collected as plain numbers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lethe.functions.arrays import let
from lethe.llm.common import BLANKS

# Labelled rows of either label that are learnt from, at most.
SAMPLE = 2500
MAX_RULES, MAX_TERMS, CUTS = 16, 4, 48
# A rule must be right this often on the rows that prune it.
PRECISION = 0.95
STATISTICS = ("n_words", "word_size", "symbols", "dup_lines", "repeats", "distinct", "upper", "marks", "bars", "digits")


def words_of(text) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def repeat_words(words) -> Column:
    """Words inside 3-word windows found twice or more, the first included."""
    def covered(h):
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def count(s):
            same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
            found = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
            return F.size(F.array_distinct(F.flatten(F.transform(
                found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(order, count))

    hashes = F.when(F.size(words) < 3, F.array().cast("array<bigint>")).otherwise(F.transform(
        F.sequence(F.lit(0), F.size(words) - 3),
        lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))))
    return let(hashes, covered)


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, and the STATISTICS as one struct), a row per row of ``docs``.
    Null text has no words; all its statistics are 0 and it fails."""
    text = F.coalesce(docs["text"], F.lit(""))
    blank = F.lit(BLANKS)
    length = lambda c: F.char_length(c)
    only = lambda pattern: length(F.regexp_replace(text, pattern, ""))  # what is left without the pattern
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.char_length(F.btrim(x, blank)) > 0)
    by_words = let(words_of(text), lambda w: F.struct(
        F.size(w).cast("bigint").alias("n_words"), length(F.concat_ws("", w)).cast("bigint").alias("word_chars"),
        repeat_words(w).cast("bigint").alias("n_repeat_words"),
        F.size(F.array_distinct(w)).cast("bigint").alias("n_distinct")))
    by_lines = let(lines, lambda x: F.struct(
        (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
        F.size(x).cast("bigint").alias("n_lines")))
    rows = docs.select(
        docs["doc_id"].alias("doc_id"), by_words.alias("w"), by_lines.alias("l"), length(text).alias("n"),
        only(r"[^#*$%&|<>]+").cast("bigint").alias("n_symbols"), only(r"[^\p{Lu}]+").alias("n_upper"),
        only(r"[^!?]+").alias("n_marks"), only(r"[^|]+").alias("n_bars"), only(r"[^0-9]+").alias("n_digits"))
    share = lambda x, n: F.when(n > 0, x / n).otherwise(F.lit(0.0))
    n, words = F.col("w.word_chars"), F.col("w.n_words")
    return rows.select(
        "doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words",
        ((words < 50) | (100 * F.col("w.n_repeat_words") > 50 * words)).alias("base_failed"),
        F.struct(words.cast("double").alias("n_words"), share(n, words).alias("word_size"),
                 share(F.col("n_symbols"), words).alias("symbols"),
                 share(F.col("l.n_dup_lines"), F.col("l.n_lines")).alias("dup_lines"),
                 share(F.col("w.n_repeat_words"), words).alias("repeats"),
                 share(F.col("w.n_distinct"), words).alias("distinct"), share(F.col("n_upper"), n).alias("upper"),
                 share(F.col("n_marks"), words).alias("marks"), share(F.col("n_bars"), words).alias("bars"),
                 share(F.col("n_digits"), n).alias("digits")).alias("statistics"))


@dataclass(frozen=True)
class Term:
    statistic: str
    at_least: bool  # else: less than
    cut: float

    def holds(self, rows: np.ndarray) -> np.ndarray:
        """Which rows of a matrix (columns: STATISTICS) fulfil it."""
        return (rows[:, STATISTICS.index(self.statistic)] >= self.cut) == self.at_least

    def __str__(self) -> str:
        return f"{self.statistic} {'>=' if self.at_least else '<'} {self.cut:.6g}"


def covers(rule: list[Term], rows: np.ndarray) -> np.ndarray:
    out = np.ones(len(rows), bool)
    for t in rule:
        out &= t.holds(rows)
    return out


def _cuts(values: np.ndarray) -> np.ndarray:
    """Up to CUTS thresholds between the quantiles of a statistic."""
    distinct = np.unique(values)
    if len(distinct) > CUTS:
        distinct = np.unique(np.sort(values)[np.linspace(0, len(values) - 1, CUTS + 1).astype(int)])
    return (distinct[1:] + distinct[:-1]) / 2


def grow(bad: np.ndarray, good: np.ndarray) -> list[Term]:
    """A rule by greedy information gain until it covers no good row."""
    rule: list[Term] = []
    while len(bad) and len(good) and len(rule) < MAX_TERMS:
        before = np.log2(len(bad) / (len(bad) + len(good)))
        best, term = 1e-9, None
        for k, name in enumerate(STATISTICS):
            cuts = _cuts(np.concatenate([bad[:, k], good[:, k]]))
            if not len(cuts):
                continue
            below_p, below_n = (np.searchsorted(np.sort(x[:, k]), cuts) for x in (bad, good))
            for at_least in (True, False):
                p = len(bad) - below_p if at_least else below_p
                n = len(good) - below_n if at_least else below_n
                gain = np.where(p > 0, p * (np.log2(np.maximum(p, 1) / np.maximum(p + n, 1)) - before), 0)
                i = int(np.argmax(gain))
                if gain[i] > best:
                    best, term = gain[i], Term(name, at_least, float(cuts[i]))
        if term is None:
            break
        rule.append(term)
        bad, good = bad[term.holds(bad)], good[term.holds(good)]
    return rule


def prune(rule: list[Term], bad: np.ndarray, good: np.ndarray) -> list[Term]:
    """The shortest beginning of a rule with the best (p - n) / (p + n) on unseen rows."""
    def worth(r: list[Term]) -> float:
        p, n = covers(r, bad).sum(), covers(r, good).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=rule)


def learn_list(bad: np.ndarray, good: np.ndarray) -> list[list[Term]]:
    """Ordered rules for bad rows (matrices of STATISTICS)."""
    rules: list[list[Term]] = []
    while len(rules) < MAX_RULES:
        third_b, third_g = np.arange(len(bad)) % 3 == 0, np.arange(len(good)) % 3 == 0
        rule = prune(grow(bad[~third_b], good[~third_g]), bad[third_b], good[third_g])
        p, n = covers(rule, bad[third_b]).sum(), covers(rule, good[third_g]).sum()
        if not rule or p < 3 or p / (p + n) < PRECISION:
            break
        rules.append(rule)
        bad, good = bad[~covers(rule, bad)], good[~covers(rule, good)]
    return rules


def keep_expression(rules: list[list[Term]], statistics: Column) -> Column:
    """The list as one conditional expression: false from the first rule that holds, else true."""
    out = None
    for rule in rules:
        holds = None
        for t in rule:
            c = statistics[t.statistic] >= t.cut if t.at_least else statistics[t.statistic] < t.cut
            holds = c if holds is None else holds & c
        out = F.when(holds, False) if out is None else out.when(holds, False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Term]]:
    """Rules from labelled documents (quality 0 is bad, 1 is good)."""
    usable = (labels.select(labels["doc_id"].cast("bigint").alias("id"), labels["quality"].cast("int").alias("quality"))
              .where("id is not null and quality in (0, 1)").distinct())
    counts = {r[0]: r[1] for r in usable.groupBy("quality").count().collect()}
    if len(counts) < 2:
        return []
    order, picked = F.xxhash64("id", F.lit(8)), None
    for label in (0, 1):
        share = min(1.0, 1.2 * sample / counts[label])
        part = (usable.where((F.col("quality") == label) & (F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))))
                .orderBy(order, "id").limit(sample))
        picked = part if picked is None else picked.union(part)
    stats = base_statistics(docs.join(F.broadcast(picked), docs["doc_id"] == picked["id"])  # at most 2 * sample rows
                            .select(docs["doc_id"], docs["text"]))
    rows = (stats.join(F.broadcast(picked), stats["doc_id"] == picked["id"])
            .select("quality", "statistics", "id").distinct().orderBy(order, "id", "statistics", "quality")
            .limit(4 * sample).collect())
    split: dict[int, list] = {0: [], 1: []}
    for r in rows:
        split[r[0]].append(tuple(r[1]))
    return learn_list(*(np.array(split[k], float).reshape(-1, len(STATISTICS)) for k in (0, 1)))


def apply_rules(docs: DataFrame, rules: list[list[Term]]) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept), a row per row of ``docs``; without rules every
    document that passes the base is kept."""
    stats = base_statistics(docs)
    kept = ~F.col("base_failed") & keep_expression(rules, F.col("statistics"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        kept.alias("kept"))
