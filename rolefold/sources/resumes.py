"""Résumé files → the flat résumé columns, whatever the input form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.resume_text import structure_resumes
from ..schemas import RESUME


def read_text_resumes(spark: SparkSession, path: str) -> DataFrame:
    """One résumé per text file; undecodable bytes become replacement characters."""
    texts = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("resume_id"), F.make_valid_utf8("value").alias("raw_text"))
    return structure_resumes(texts, "raw_text").select(*RESUME.fieldNames(), "raw_text")


def read_json_resumes(spark: SparkSession, path: str) -> DataFrame:
    """One résumé object per JSON file; a defective file gives a row of nulls."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("resume_id"), F.make_valid_utf8("value").alias("raw_text"))
    return json_resumes(files)


def json_resumes(df: DataFrame, text: str = "raw_text") -> DataFrame:
    """``resume_id, raw_text`` rows whose text is a résumé object, bare or under ``data``."""
    inner = F.coalesce(F.get_json_object(text, "$.data"), F.col(text))
    parsed = df.withColumn("__r", F.from_json(inner, RESUME))
    return parsed.select(
        "resume_id", *[F.col(f"__r.{c}").alias(c) for c in RESUME.fieldNames() if c != "resume_id"],
        F.col(text).alias("raw_text"))


DEFAULT_RESUME_TEXT = "Software and Data Engineer with AI automation experience."  # fixed value


def with_structure(resumes: DataFrame) -> DataFrame:
    """Résumés that are only text, as the structured columns beside that text; others as they are."""
    if set(resumes.columns) & set(RESUME.fieldNames()) - {"resume_id"} or "raw_text" not in resumes.columns:
        return resumes
    keyed = resumes if "resume_id" in resumes.columns else resumes.withColumn("resume_id", F.lit("given"))
    structured = structure_resumes(keyed, "raw_text").select(*RESUME.fieldNames(), "raw_text")
    return structured if "resume_id" in resumes.columns else structured.drop("resume_id")


def _from_text(spark: SparkSession, text: str) -> DataFrame:
    return with_structure(spark.createDataFrame([(text,)], "raw_text string"))


def resolve_resume(
    spark: SparkSession, resume: dict | str | None = None, text: str | None = None, base: DataFrame | None = None,
) -> DataFrame:
    """The one résumé of a run, as a single row: an object, JSON or raw text, the stored one, or a default."""
    if isinstance(resume, str) and resume:
        try:
            resume = json.loads(resume)
        except ValueError:
            resume = {"raw_text": resume}
    if isinstance(resume, dict) and resume:
        if set(resume) == {"raw_text"}:
            return _from_text(spark, resume["raw_text"])
        one = spark.createDataFrame([("given", json.dumps(resume))], "resume_id string, raw_text string")
        return json_resumes(one).drop("resume_id")
    if text:
        return _from_text(spark, text)
    if base is not None and not base.isEmpty():
        return base
    return _from_text(spark, DEFAULT_RESUME_TEXT)
