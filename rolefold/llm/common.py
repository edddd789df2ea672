"""What several of the operators share: reading tables, words, and row identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"
GAPS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words(text: Column) -> Column:
    """The words of a text in order; no words for null."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(GAPS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, GAP))


def source_key(source: Column) -> Column:
    """A source as a key that is never null: null has a key of its own, which no source can have."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
