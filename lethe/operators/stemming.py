"""Porter stemming of ROUGE tokens (Porter, 1980, "An algorithm for
suffix stripping"), by default with the extensions that the widely used
ROUGE libraries' stemmer adds: irregular words, short -ies/-ied words, -y
only after a consonant, and a few changed suffixes.  The paper's rules are
the ``extended=False`` variant.

Stemming is a per-token string rewrite with no Spark equivalent, so it
runs in an Arrow UDF over the dictionary of a batch's tokens: no explode,
no shuffle, no loop over rows.  Each Python worker memoises stems (a bounded
cache), so a frequent word is stemmed once per worker.
Tokens of three characters or fewer are left unchanged (the ROUGE rule).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Suffix rules of the original Porter algorithm, steps 2-4
# (suffix, replacement), in the paper's order.
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
    ("izer", "ize"), ("abli", "able"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
    ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
    ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
    ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
    ("ful", ""), ("ness", ""),
)
STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
    "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)
# What the extended variant adds to or changes in step 2.
STEP2_EXTENDED = (("bli", "ble"), ("fulli", "ful"))
# Irregular words of the extended variant and their stems.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
    "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
    "exceed": "exceed", "succeed": "succeed",
}
# Tokens up to this length are not stemmed.
MIN_STEM_LEN = 3


class Letters:
    """A word with its letters marked consonant (c) or vowel (v); y is a
    vowel after a consonant."""

    def __init__(self, word: str):
        self.word = word
        marks = []
        for ch in word:
            vowel = ch in "aeiou" or (ch == "y" and bool(marks) and marks[-1] == "c")
            marks.append("v" if vowel else "c")
        self.marks = "".join(marks)

    def measure(self, n: int) -> int:
        """m in [C](VC)^m[V] of the first ``n`` letters."""
        return self.marks[:n].count("vc")

    def vowel(self, n: int) -> bool:
        return "v" in self.marks[:n]

    def double(self) -> bool:
        return len(self.word) > 1 and self.word[-1] == self.word[-2] and self.marks[-1] == "c"

    def short_end(self, n: int, extended: bool) -> bool:
        """Ends consonant, vowel, consonant other than w, x, y (extended:
        also a two-letter vowel, consonant)."""
        if n >= 3 and self.marks[n - 3:n] == "cvc" and self.word[n - 1] not in "wxy":
            return True
        return extended and n == 2 and self.marks[:2] == "vc"


def _first_longest(word: str, rules):
    """The rule of the longest suffix that the word ends in."""
    return max((r for r in rules if word.endswith(r[0])), key=lambda r: len(r[0]), default=None)


def _plural(w: str, extended: bool) -> str:
    if w.endswith("ies"):
        return w[:-1] if extended and len(w) == 4 else w[:-2]
    if w.endswith("sses"):
        return w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def _past(w: str, extended: bool) -> str:
    if extended and w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if Letters(w).measure(len(w) - 3) > 0 else w
    for suffix in ("ed", "ing"):
        if w.endswith(suffix) and Letters(w).vowel(len(w) - len(suffix)):
            break
    else:
        return w
    w = w[:-len(suffix)]
    x = Letters(w)
    if w.endswith(("at", "bl", "iz")):
        return w + "e"
    if x.double():
        return w if w[-1] in "lsz" else w[:-1]
    return w + "e" if x.measure(len(w)) == 1 and x.short_end(len(w), extended) else w


def _final_y(w: str, extended: bool) -> str:
    n = len(w) - 1
    if not w.endswith("y"):
        return w
    x = Letters(w)
    turns = (n > 1 and x.marks[n - 1] == "c") if extended else x.vowel(n)
    return w[:-1] + "i" if turns else w


def _second(w: str, extended: bool) -> str:
    rules = STEP2
    if extended:
        if w.endswith("alli") and Letters(w).measure(len(w) - 4) > 0:
            return _second(w[:-2], extended)
        if w.endswith("logi"):
            return w[:-1] if Letters(w).measure(len(w) - 3) > 0 else w
        rules = [r for r in STEP2 if r[0] != "abli"] + list(STEP2_EXTENDED)
    hit = _first_longest(w, rules)
    if hit and Letters(w).measure(len(w) - len(hit[0])) > 0:
        return w[:-len(hit[0])] + hit[1]
    return w


def porter_stem(w: str, extended: bool = True) -> str:
    """Stem one lower-case word."""
    if extended and w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    w = _second(_final_y(_past(_plural(w, extended), extended), extended), extended)
    hit = _first_longest(w, STEP3)
    if hit and Letters(w).measure(len(w) - len(hit[0])) > 0:
        w = w[:-len(hit[0])] + hit[1]
    hit = _first_longest(w, [(x, "") for x in STEP4])
    if hit:
        n = len(w) - len(hit[0])
        if Letters(w).measure(n) > 1 and (hit[0] != "ion" or w[n - 1] in "st"):
            w = w[:n]
    if w.endswith("e"):
        x, n = Letters(w), len(w) - 1
        if x.measure(n) > 1 or (x.measure(n) == 1 and not x.short_end(n, extended)):
            w = w[:-1]
    if w.endswith("ll") and Letters(w).measure(len(w) - 1) > 1:
        w = w[:-1]
    return w


@lru_cache(maxsize=1 << 18)
def stem_token(tok: str) -> str:
    return tok if len(tok) <= MIN_STEM_LEN else porter_stem(tok)


@F.arrow_udf(T.ArrayType(T.StringType()))
def _stem_arrays(tokens: pa.Array) -> pa.Array:
    """Each distinct token of the batch is stemmed once; the lists keep their
    shape, a null list stays null."""
    flat = tokens.flatten().dictionary_encode()
    stems = pa.array([None if t is None else stem_token(t) for t in flat.dictionary.to_pylist()], pa.string())
    size = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), stems.take(flat.indices),
                                    mask=tokens.is_null())


def stem_tokens(tokens: Column) -> Column:
    """Porter-stem every token of an array column (Arrow batches)."""
    return _stem_arrays(tokens)


def stem_token_arrays(df, key: str, cols) -> object:
    """Replace each array column of ``cols`` by its stemmed tokens."""
    for c in cols:
        df = df.withColumn(c, stem_tokens(F.col(c)))
    return df
