"""The registered queries have the columns that their contracts name, over a small scale of the tables."""

import os

import pytest

from tidelog.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_voronoi": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "bigint"},
    "op2_language": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op4_winnow": {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"},
    "op5_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op7_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op9_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op10_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns(spark, name):
    df = queries()[name](spark, SF)
    assert {c: t for c, t in df.dtypes if c in COLUMNS[name]} == COLUMNS[name]
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert df.count() >= n if name != "op1_voronoi" else df.count() == 25 * 20


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", list(oracle_sql()))
def test_sql_gives_the_same_rows(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    want = con.execute(oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, df.select(names).collect())) == sorted(want.fetchall())
