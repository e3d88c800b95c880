"""The numbered queries: names, columns, and DuckDB where SQL can say the same."""

import duckdb
import pytest

from cohortspark.llm import queries
from tests.oracle import _rows

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_language": ["doc_id", "held_out", "lang_pred", "score"],
    "op2_topk": ["query_id", "rank", "vec_id", "score"],
    "op3_simhash": ["doc_id", "fingerprint", "component_id"],
    "op4_packing": ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
    "op5_quality": ["doc_id", "held_out", "score", "predicted"],
    "op6_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op7_lines": ["doc_id", "n_lines", "n_removed", "kept_sha256"],
    "op8_decontamination": ["doc_id", "item_id", "bm25", "overlap", "question_overlap", "answer_overlap"],
    "op9_secrets": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op10_substrings": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op11_trie": ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
    "op12_windows": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op13_negatives": ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"],
}


def test_all_queries():
    assert {k: v for k, v in COLUMNS.items()}.keys() == queries.QUERIES.keys()


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    assert queries.QUERIES[name](spark, SF).columns == COLUMNS[name]


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())
