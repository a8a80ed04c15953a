"""Keys and values in and out of whatever Spark reads and writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.model import PUT


def puts(df: DataFrame, key: str | Column, value: str | Column) -> DataFrame:
    """(op, key, value) rows for ``Engine.apply_frame`` from any two columns or expressions."""
    key, value = (F.col(c) if isinstance(c, str) else c for c in (key, value))
    return df.select(F.lit(PUT).alias("op"), key.cast("binary").alias("key"), value.cast("binary").alias("value"))


def read_puts(spark: SparkSession, path: str, format: str, key: str, value: str | None = None, **options) -> DataFrame:
    """Puts from Parquet, ORC, CSV, JSON, text and so on; without ``value`` the whole row as JSON."""
    df = spark.read.format(format).options(**options).load(path)
    return puts(df, key, value or F.to_json(F.struct("*")))


def write_view(view: DataFrame, path: str, format: str = "parquet", text: bool = False, **options) -> None:
    """A (key, value) view to a folder; ``text`` writes both as strings, which CSV and JSON need."""
    if text:
        view = view.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    view.write.format(format).options(**options).save(path)
