"""Every registered query against its DuckDB oracle on sf0.001 (the
driver runs the same pairs at sf0.01); queries without an oracle must
still run and keep a stable schema."""

import importlib.util
import os

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001

_spec = importlib.util.spec_from_file_location(
    "check_oracle", os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "scripts",
                                 "check_oracle.py"))
CO = importlib.util.module_from_spec(_spec)
_spec.loader.exec_module(CO)

# Those of the optional subpackage have tests of their own.
from lethe.plans.registry import ORACLES, QUERIES as _ALL  # noqa: E402

QUERIES = {name: fn for name, fn in E.queries().items() if name in _ALL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in CO.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


def test_every_query_has_an_oracle_or_is_listed():
    assert set(QUERIES) == set(ORACLES) == set(_ALL)
    assert set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    sdf = QUERIES[name](spark, SF0001)
    schema = sdf.schema
    pdf = sdf.toPandas()
    assert QUERIES[name](spark, SF0001).schema == schema
    if name not in ORACLES:
        assert len(pdf) > 0
        return
    ddf = duck.execute(ORACLES[name]).df()
    sc, sr = CO.rows_of(pdf)
    dc, dr = CO.rows_of(ddf)
    assert sc == dc
    assert len(sr) == len(dr)
    assert sr == dr


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() >= 0
    assert [f.name for f in df.schema.fields] == ["eval_set", "kind", "n_correct", "n_total", "accuracy"]
