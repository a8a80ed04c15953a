"""From raw documents to packed training sequences, in five stages that each work on what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.packing import pack_documents
from tidelog.llm.secrets import redact_secrets
from tidelog.llm.simhash import drop_near_copies
from tidelog.llm.toxicity import fit, score_toxicity
from tidelog.llm.winnow import decontaminate
from tidelog.session import forget, keep, passing

#: A document goes from this score on.
TOXIC = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below TOXIC, by a model fitted to the labelled ones among them.

    Cases: null, empty and wordless texts stay; every unit of a very long text counts; rows of one text share their fate;
    with no labels of both kinds all stay; an empty table gives no rows; further columns pass through, whatever their names.
    """
    names = docs.columns
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_toxicity(docs, model).toDF(*[f"c{i}" for i in range(len(names))], "score")
    return scored.where(F.col("score") < TOXIC).select([F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest doc_id.

    Cases: rows of one doc_id and unlike texts are told apart and may all stay; of rows alike in id and text one stays; a null
    doc_id ranks last; null, empty and wordless texts are copies of one another; an empty table gives no rows; further columns
    pass through, whatever their names.
    """
    return drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with windows of two or more benchmark items go; from the others the windows' words are cut.

    Cases: null, empty and wordless texts stay as they are, as all do with an empty benchmark; very long texts are cut in one
    pass; repeated rows and null ids are rows of their own; an empty table gives no rows; further columns pass through.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret found.

    Cases: a null text stays null and an empty one empty; a very long text is cut in one pass; repeated rows and null ids are
    rows of their own; an empty table gives no rows; further columns pass through, whatever their names.
    """
    return redact_secrets(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences.

    Cases: null and empty texts are the end id alone; a very long text is cut into pieces of a whole sequence and a rest;
    repeated rows and null ids are documents of their own; an empty table gives no rows; further columns are ignored.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", one_of_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("secret scans", hide_secrets),
    ("packing", pack),
]

#: Scores, XXH64 and tokenizers are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What a stage kept, and its input, are removed once its result is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with passing(spark) as spare:
            docs = spare(keep(stage(spark, docs, sf_dir), name.replace(" ", "-")))
        if before is not None:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
