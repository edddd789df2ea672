"""Run a campaign from the command line.

    python -m rolefold --root STORE --landed DIR [--keywords "python, data engineer"] [--resume-path FILE] …

``DIR`` has one folder per source, named like the source: response files for the two feeds, Parquet
page snapshots for the four portals.
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession, functions as F

from .functions.text import keyword_terms
from .plans.campaign import run_campaign
from .plans.store import ListingStore
from .session import build_session
from .sources.registry import SOURCES, read_feed, read_pages
from .sources.resumes import read_json_resumes, read_text_resumes, resolve_resume

FEEDS = {"Himalayas", "Remotive"}


def landed_sources(spark: SparkSession, directory: str) -> dict:
    def reader(name: str):
        read = read_feed if name in FEEDS else read_pages
        return lambda: read(spark, f"{directory.rstrip('/')}/{name}")

    def exists(name: str) -> bool:
        try:
            spark.read.format("binaryFile").load(f"{directory.rstrip('/')}/{name}").limit(0)
            return True
        except AnalysisException:
            return False

    return {name: reader(name) for name in SOURCES if exists(name)}


def main(argv: list[str] | None = None) -> dict:
    parser = argparse.ArgumentParser(prog="rolefold")
    parser.add_argument("--root", required=True, help="folder of the stored tables")
    parser.add_argument("--landed", required=True, help="folder with one sub-folder per source")
    parser.add_argument("--keywords", help="comma-separated search terms")
    parser.add_argument("--min-score", type=int, default=70)
    parser.add_argument("--limit-per-source", type=int, help="first listings of each source only")
    parser.add_argument("--evaluate-limit", type=int, help="score so many listings at most")
    parser.add_argument("--tailor-limit", type=int, help="tailor so many applications at most")
    parser.add_argument("--sources", help="comma-separated source names; all when left out")
    parser.add_argument("--resume-path", help="résumé as a JSON or text file")
    args = parser.parse_args(argv)

    spark = build_session()
    resume = resolve_resume(spark)
    if args.resume_path:
        read = read_json_resumes if args.resume_path.endswith(".json") else read_text_resumes
        resume = read(spark, args.resume_path).drop("resume_id")
    metrics = run_campaign(
        spark, ListingStore(spark, args.root), landed_sources(spark, args.landed), F.current_timestamp(), resume,
        keyword_terms(args.keywords), args.min_score, args.limit_per_source,
        [s.strip() for s in args.sources.split(",")] if args.sources else None, args.evaluate_limit, args.tailor_limit)
    row = metrics.first().asDict()
    for name in ("total_scraped", "newly_stored", "evaluated", "ready", "status", "errors"):
        print(f"{name}: {row[name]}")
    return row


if __name__ == "__main__":
    main()
