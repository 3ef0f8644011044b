"""Text helpers against Python's own semantics."""

import fnmatch

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lethe.functions.text import PY_WHITESPACE, file_stem, glob_to_regex, last_path_segment, py_split, py_strip

PATTERNS = ["*_questions.json", "*.json", "0?1_*", "[0-9]*.htm?", "[!a-c]*", "a[]]b", "[a-]x", "x[!]]y",
            "*[", "a.b", "(x)+", "*\\*", "^$"]
NAMES = ["001_questions.json", "001_generation_questions.json", "a.json", "021_x", "9.html", "d", "a]b",
         "-x", "ax", "x]y", "xzy", "ab[", "a.b", "axb", "(x)+", "a\\b", "^$", ""]


def test_glob_matches_fnmatch(spark):
    rows = [(p, n) for p in PATTERNS for n in NAMES]
    df = spark.createDataFrame(rows, "p string, n string")
    for p in PATTERNS:
        sub = df.where(F.col("p") == p).select("n", F.col("n").rlike(glob_to_regex(p)).alias("m")).collect()
        assert len(sub) == len(NAMES)
        for r in sub:
            assert r["m"] == fnmatch.fnmatchcase(r["n"], p), (p, r["n"])


texts = st.text(alphabet=st.sampled_from(list("ab ") + list(PY_WHITESPACE[:6]) + ["　", "\x85", "é"]),
                max_size=20)


@settings(max_examples=40, deadline=None)
@given(st.lists(texts, min_size=1, max_size=10))
def test_split_and_strip_match_python(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    out = {r["i"]: (r["s"], r["p"]) for r in df.select("i", py_split("t").alias("s"), py_strip("t").alias("p")).collect()}
    for i, v in enumerate(values):
        assert out[i][0] == v.split()
        assert out[i][1] == v.strip()


@pytest.mark.parametrize("path,last,stem", [("a/b/003.png", "003.png", "003"), ("003.tar.gz", "003.tar.gz", "003"),
                                            ("dir/", "", ""), ("x", "x", "x")])
def test_path_parts(spark, path, last, stem):
    r = spark.createDataFrame([(path,)], "p string").select(last_path_segment("p").alias("l")) \
        .select("l", file_stem("l").alias("s")).first()
    assert (r["l"], r["s"]) == (last, stem)
