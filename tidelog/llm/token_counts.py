"""Token counts behind a cache of digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.tokenizing import counter
from tidelog.session import keep, scratch_path

SCHEMA = "digest binary, n_tokens long"
#: Characters handed to the tokenizer at once; a longer text goes alone.
BATCH_CHARS = 1_000_000


def tokenizer_version(path: str) -> str:
    """SHA-256 of the tokenizer's file: what a stored count holds for."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for b in batches:
            count = count or counter(path)
            texts, out, held, size = b.column(1), [], [], 0
            for t in texts:
                held.append(t.as_py())
                size += len(held[-1])
                if size >= BATCH_CHARS:
                    out += count(held)
                    held, size = [], 0
            out += count(held) if held else []
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], names=["digest", "n_tokens"])

    return run


def _stored(spark, cache_dir: str, version: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{cache_dir}/{version}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return spark.read.schema(SCHEMA).parquet(path.toString()) if fs.exists(path) else None


def token_counts(docs: DataFrame, tokenizer: str, cache_dir: str | None = None, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes long, n_tokens long, over_limit boolean)``: one row per row of ``docs``.

    Contents are digested (SHA-256 of the UTF-8 text, null as empty; nothing that could change a count
    is normalised away) and joined with the counts that ``cache_dir`` holds for this tokenizer's digest.
    Each distinct content that is missing is encoded once, by the row with its smallest
    doc_id, and appended; without ``cache_dir`` the cache is a fresh one in the shared folder.
    Hot contents: only digests are grouped, with partial aggregation, and the texts to encode are dealt
    by content and doc_id together. Cases: rows with null doc_id are counted as any other; empty and null
    texts have no tokens; an empty table gives no rows; further columns are ignored.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer)
    cache_dir = cache_dir or scratch_path(spark, "token-cache")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("digest", F.unhex(F.sha2("text", 256)))
    seen = keep(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    first = seen.groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    if (stored := _stored(spark, cache_dir, version)) is not None:
        first = first.join(stored, "digest", "left_anti")
    first = first.select(F.col("digest").alias("d"), F.col("doc_id").alias("i"))
    misses = rows.join(first, (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
    new = misses.select("digest", "text").mapInArrow(_counter(tokenizer), SCHEMA)
    new.write.mode("append").parquet(f"{cache_dir}/{version}")
    counts = _stored(spark, cache_dir, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    counts = keep(counts, "counts")
    return seen.join(counts, "digest", "left").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
