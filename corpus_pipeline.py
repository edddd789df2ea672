"""From raw documents to token ids: each stage works on all that its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from rolefold.llm.bpe import build_lexicon, encode_documents, read_spec
from rolefold.llm.common import GAPS
from rolefold.llm.mixing import mix_sources
from rolefold.llm.near_dup import drop_near_duplicates
from rolefold.llm.quality import keep_good
from rolefold.llm.site_lines import drop_site_lines
from rolefold.session import materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that are boilerplate in their source; blanks at a line's ends do not make it another line.

    Equal texts count once, and the first document that has a line keeps it, so of a large group of copies one text stays.
    """
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    same = F.transform(split, lambda line: F.btrim(line, F.lit(GAPS)))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text"))
    cleaned = drop_site_lines(docs, F.col("source"), split, same, first_by=order)
    text = F.when(F.col("n_dropped") > 0, F.array_join("kept_lines", "\n")).otherwise(F.col("text"))
    renewed = {"text": text} | ({"n_chars": F.when(F.col("n_dropped") > 0, F.char_length(text)).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return cleaned.select(*[renewed.get(c, F.col(c)).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return drop_near_duplicates(docs, width=5, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it, rounded to whole documents; documents without words are not taken."""
    copies = F.when(F.col("size") > 0, F.floor((F.col("taken") + F.col("size") / 2) / F.col("size"))).otherwise(0)
    mixed = mix_sources(docs, whole_rows=True)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(True), copies.cast("int")))).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document that is left, and their number."""
    spec = read_spec(public_tokenizers.path("word_bpe_49k.json"))
    encoded = encode_documents(docs, spec, build_lexicon(docs, spec))
    return encoded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("encode", encode)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
