"""Text helpers as Column expressions: Python-compatible strip/split,
answer extraction, option letters, shell patterns and path parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, i.e. what
# str.strip() and str.split() remove.  Java's \s covers only six of them.
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
                 "\u2028\u2029\u202f\u205f\u3000")

# Singles up to 255 are one table in Java, all else a test each of every
# character, so the others are ranges where they can; ASCII texts need the table only.
_ASCII_WS = "[" + "".join(f"\\u{ord(c):04x}" for c in PY_WHITESPACE if c.isascii()) + "]+"
_WS_CLASS = _ASCII_WS[:-2] + r"\u0085\u00a0\u1680\u2000-\u200a\u2028-\u2029\u202f\u205f\u3000]+"

# Markers that precede the model's answer in generated text.
ASSISTANT_MARK = "ASSISTANT:"
ANSWER_MARK = "Answer:"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def py_strip(col) -> Column:
    """``str.strip()``: trims Python whitespace at both ends (no regex)."""
    return F.btrim(_c(col), F.lit(PY_WHITESPACE))


def py_split(col, most: int | None = None) -> Column:
    """``str.split()``: runs of whitespace separate, no empty tokens; with
    ``most`` the first so many tokens, and the text behind them is not split.
    Trimming first leaves no empty edge token, so no per-token filter
    (a lambda) is needed; the whole expression stays in codegen."""
    t = py_strip(col)
    limit = -1 if most is None else int(most) + 1
    ascii_only = F.octet_length(_c(col)) == F.char_length(_c(col))
    words = (F.when(t == "", F.array().cast("array<string>")).when(ascii_only, F.split(t, _ASCII_WS, limit))
             .otherwise(F.split(t, _WS_CLASS, limit)))
    return words if most is None else F.slice(words, 1, int(most))


def extract_response(col) -> Column:
    """Text between the first and second ``ASSISTANT:``, else between the
    first and second ``Answer:``, else the whole text; stripped."""
    t = _c(col)
    return (F.when(t.contains(ASSISTANT_MARK), py_strip(F.split_part(t, F.lit(ASSISTANT_MARK), F.lit(2))))
            .when(t.contains(ANSWER_MARK), py_strip(F.split_part(t, F.lit(ANSWER_MARK), F.lit(2))))
            .otherwise(py_strip(t)))


def option_letter(response, options) -> Column:
    """Upper-cased first character when it is a key of ``options``, else NULL."""
    r = _c(response)
    letter = F.upper(F.substring(r, 1, 1))
    return F.when((F.length(r) > 0) & F.map_contains_key(_c(options), letter), letter)


def glob_to_regex(pattern: str) -> str:
    """Shell pattern (``*``, ``?``, ``[seq]``, ``[!seq]``) as an anchored
    Java/RE2 regex matching the whole name; everything else is literal."""
    out, i, n = [], 0, len(pattern)
    while i < n:
        ch = pattern[i]
        i += 1
        if ch == "*":
            out.append(".*")
        elif ch == "?":
            out.append(".")
        elif ch == "[":
            j = i
            if j < n and pattern[j] == "!":
                j += 1
            if j < n and pattern[j] == "]":
                j += 1
            while j < n and pattern[j] != "]":
                j += 1
            if j >= n:                      # no closing bracket: literal '['
                out.append("\\[")
            else:
                body = pattern[i:j].replace("\\", "\\\\")
                if body.startswith("!"):
                    body = "^" + body[1:]
                elif body.startswith("^"):
                    body = "\\" + body
                out.append("[" + body + "]")
                i = j + 1
        else:
            out.append("\\" + ch if not ch.isalnum() and ch != "_" else ch)
    return "(?s)^" + "".join(out) + "\\z"


def matches_glob(col, pattern: str) -> Column:
    return _c(col).rlike(glob_to_regex(pattern))


def last_path_segment(col) -> Column:
    """``path.split('/')[-1]`` (empty after a trailing slash)."""
    return F.element_at(F.split(_c(col), "/"), -1)


def file_stem(col) -> Column:
    """Part of a file name before the first dot."""
    return F.split_part(_c(col), F.lit("."), F.lit(1))
