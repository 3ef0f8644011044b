"""The registered queries on the smallest tables: whole results, their
columns, and the SQL twins where there are any."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001
from lethe.llm.queries import ORACLES, QUERIES

COLUMNS = {
    "op1_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
    "op2_substring_dedup": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op3_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_language_id": ["doc_id", "held_out", "lang_pred", "score"],
    "op5_url_filter": ["page_id", "host", "path", "rule", "verdict"],
    "op6_decontaminate": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op7_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op8_quality_rules": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                          "kept"],
    "op9_simhash": ["doc_id", "fingerprint", "component_id"],
    "op10_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op11_lexical_search": ["item_id", "rank", "doc_id", "score"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited",
                          "near_next"],
}

# The table whose ids a query returns, and rows an id; documents, once, unless said here.
TABLES = {"op5_url_filter": ("pages", "page_id", 1), "op11_lexical_search": ("benchmark", "item_id", 10),
          "op12_whitening": ("embeddings", "vec_id", 4)}


def test_thirteen_queries_and_the_pipeline():
    assert set(QUERIES) == set(COLUMNS)
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = E.queries()[name](spark, SF0001)
    assert df.columns[:len(COLUMNS[name])] == COLUMNS[name]
    rows = df.collect()
    table, key, each = TABLES.get(name, ("documents", "doc_id", 1))
    ids = [r[0] for r in spark.read.parquet(f"{SF0001}/{table}.parquet").select(key).collect()]
    assert sorted(r[0] for r in rows) == sorted(ids * each)
    if name in ORACLES:
        con = duckdb.connect()
        for t in ("documents", "benchmark", "pages", "labels"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
        assert sorted(map(tuple, rows)) == sorted(con.execute(ORACLES[name]).fetchall())
