"""The operators' queries on whole tables: their SQL where they have one, else columns and rows."""

import duckdb
import pytest

import __spark_entry__ as entry
from aislemetrics.llm.oracle import ORACLE_SQL
from aislemetrics.llm.queries import QUERIES

COLUMNS = {
    "op1_page_text": ["page_id", "url", "text", "n_chars"],
    "op2_grammar_shards": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op3_piece_round_trip": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op5_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept score".split(),
    "op6_simhash_groups": ["doc_id", "fingerprint", "component_id"],
    "op8_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op10_piece_counts": ["doc_id", "n_words", "n_tokens", "n_unknown"],
    "op12_url_filter": ["page_id", "host", "path", "rule", "verdict", "score"],
}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, folder, name):
    duck = duckdb.connect()
    for table in ("documents", "benchmark", "conversations", "labels", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet')")
    cursor = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    result = QUERIES[name](spark, folder)
    assert sorted(names) == sorted(result.columns)
    ours = sorted(tuple(row[n] for n in names) for row in result.collect())
    theirs = sorted(cursor.fetchall())
    assert len(ours) == len(theirs) > 0
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_one_row_a_record(spark, folder, name):
    result = QUERIES[name](spark, folder)
    assert result.columns == COLUMNS[name]
    source = "pages" if name in ("op1_page_text", "op12_url_filter") else "documents"
    assert result.count() == spark.read.parquet(f"{folder}/{source}.parquet").count()


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(entry.oracle_sql())
