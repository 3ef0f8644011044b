"""The benchmark's published id lists (FIXTURES.md section 4), read with
S3 from the folder named by ``LETHE_PUBLISHED_SPLITS`` (layout
``forget_{p}/forget_ids.json``, ``retain_{100-p}/retain_ids.json``;
skipped when unset): sizes follow E3, each pair is disjoint and covers
all ids, retain is the complement (E8)."""

import os

import pytest
from pyspark.sql import functions as F

from lethe.operators.splits import forget_size, retain_complement
from lethe.sources import read_id_list

ROOT = os.environ.get("LETHE_PUBLISHED_SPLITS", "")
pytestmark = pytest.mark.skipif(not ROOT or not os.path.isdir(ROOT), reason="LETHE_PUBLISHED_SPLITS not set")


def _ids(spark, kind, p):
    return read_id_list(spark, os.path.join(ROOT, f"{kind}_{p}", f"{kind}_ids.json")).select("id")


@pytest.mark.parametrize("p", [5, 10, 15])
def test_published_split(spark, p):
    forget = _ids(spark, "forget", p)
    retain = _ids(spark, "retain", 100 - p)
    f = {r["id"] for r in forget.collect()}
    r = {r["id"] for r in retain.collect()}
    n = len(f | r)
    assert n == 500 and not f & r
    k = spark.range(1).select(forget_size(F.lit(p), F.lit(n))).first()[0]
    assert len(f) == k
    everyone = forget.unionByName(retain)
    assert {x["id"] for x in retain_complement(everyone, forget).collect()} == r


def test_published_overlaps(spark):
    sets = {p: {r["id"] for r in _ids(spark, "forget", p).collect()} for p in (5, 10, 15)}
    assert (len(sets[5] & sets[10]), len(sets[5] & sets[15]), len(sets[10] & sets[15])) == (1, 3, 8)
