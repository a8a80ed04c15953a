"""The queries of the llm operators and, where SQL can express one, its SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import sql
from tidelog.llm.knn import knn_join, quantised
from tidelog.llm.language import identify_language
from tidelog.llm.packing import pack_documents
from tidelog.llm.repeats import repeated_passages
from tidelog.llm.secrets import BASE, find_secrets, listed
from tidelog.llm.sharding import assign_shards
from tidelog.llm.simhash import near_duplicates
from tidelog.llm.token_counts import token_counts
from tidelog.llm.toxicity import toxicity
from tidelog.llm.winnow import find_benchmark, n_hit


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_voronoi(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("vec"))
    return knn_join(data, F.col("vec_id") % 20 == 0, k=20)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items >= 2).alias("contaminated"),
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = assign_shards(_table(spark, sf_dir, "documents"), shards=24)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"), carry=["doc_id"])
    base = F.filter("spans", lambda s: s.nr <= len(BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in BASE]
    return found.select("doc.doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {"op1_voronoi": op1_voronoi, "op2_language": op2_language, "op3_toxicity": op3_toxicity, "op4_winnow": op4_winnow, "op5_simhash": op5_simhash, "op6_repeats": op6_repeats, "op7_packing": op7_packing, "op8_sharding": op8_sharding, "op9_secrets": op9_secrets, "op10_token_counts": op10_token_counts}


def oracle_sql() -> dict[str, str]:
    return {"op1_voronoi": sql.OP1, "op4_winnow": sql.OP4}
