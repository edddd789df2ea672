"""Which sources exist, and reading the chosen ones into one deduplicated set.

Each source is a job of its own that writes its own partition of the raw zone. A source that
fails is recorded and contributes nothing, or is raised where the whole is wanted; the union reads
only what was completed, and where nothing was completed, there is no result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T

from ..operators.dedup import first_wins, top_n
from ..operators.normalize import normalize_listings
from ..schemas import LISTING_NORM
from ..session import run_dir
from .cards import anchor_cards, guest_cards, link_cards, tuple_cards
from .feeds import flat_feed, item_texts, nested_feed

Reader = Callable[..., DataFrame]

PAYLOADS = T.StructType([T.StructField("payload_id", T.StringType()), T.StructField("body", T.StringType())])
PAGES = T.StructType([
    T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

SOURCES: dict[str, Reader] = {
    "LinkedIn": guest_cards,
    "Naukri": tuple_cards,
    "Wellfound": anchor_cards,
    "Hirist": link_cards,
    "Himalayas": nested_feed,
    "Remotive": flat_feed,
}
FEEDS = (nested_feed, flat_feed)     # readers that count what they leave out
ITEM_FILES = "*.jsonl"


class SourcesFailed(RuntimeError):
    """Sources that were to be read and could not be; ``errors`` has all that was recorded."""

    def __init__(self, errors: list[str]) -> None:
        super().__init__("; ".join(errors))
        self.errors = errors


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one file each; the file name orders them."""
    return spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("payload_id"), F.col("value").alias("body"))


def read_item_lines(spark: SparkSession, path: str, files: str = ITEM_FILES) -> DataFrame:
    """Landed items, one JSON value a line: ``payload_id, pos, text``. Blank lines are no items.

    Such a file is read by as many tasks as it has blocks, whatever its size. A block is a payload, named by its file and first byte, and
    ``pos`` orders the lines in it, so nothing is sorted to number the items; both depend on how Spark cuts the files, their order does not.
    """
    block = F.concat(F.col("_metadata.file_path"), F.lit("#"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"))
    lines = spark.read.option("pathGlobFilter", files).text(path).select(
        block.alias("payload_id"), F.monotonically_increasing_id().alias("pos"), F.col("value").alias("text"))
    return lines.where(F.btrim("text") != "")


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Items of a folder that may hold both layouts: files of item lines (``ITEM_FILES``), and whole bodies in all others."""
    bodies = spark.read.text(path, wholetext=True).where(~F.col("_metadata.file_path").endswith(ITEM_FILES.lstrip("*"))).select(
        F.col("_metadata.file_path").alias("payload_id"), F.col("value").alias("body"))
    return item_texts(bodies).withColumn("pos", F.col("pos").cast("long")).unionByName(read_item_lines(spark, path))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGES).parquet(path)


def chosen_sources(enabled: list[str] | None, sources: dict[str, Reader] = SOURCES) -> dict[str, Reader]:
    """None or an empty list selects all; unknown names select nothing."""
    return dict(sources) if not enabled else {k: v for k, v in sources.items() if k in enabled}


def source_listings(
    landed: DataFrame, name: str, keywords=None, limit: int | None = None, sources: dict[str, Reader] = SOURCES,
    defects: Observation | None = None,
) -> DataFrame:
    """Normalised listings of one source in reading order, cut to the first ``limit`` matches."""
    raw = sources[name](landed, keywords) if defects is None else sources[name](landed, keywords, defects=defects)
    unit = "payload_id" if "payload_id" in raw.columns else "page_id"
    if limit is not None:
        raw = top_n(raw, ["platform"], [unit, "pos"], limit)
    return normalize_listings(raw.withColumnRenamed(unit, "__unit"), name).withColumn(
        "unit", F.col("__unit").cast("string")).drop("__unit")


def collect_listings(
    landed: dict[str, DataFrame | Callable[[], DataFrame]],
    spark: SparkSession,
    keywords=None,
    limit_per_source: int | None = None,
    enabled: list[str] | None = None,
    sources: dict[str, Reader] = SOURCES,
    whole: bool = False,
) -> tuple[DataFrame, list[str]]:
    """All chosen sources, deduplicated first-wins, plus the errors of those that failed.

    First means: by source name, then reading order. Items of a feed that cannot be read are left out and their number is one of the
    errors; it is taken while the source is written. A source that is chosen by name and has not landed has failed.

    Raises ``SourcesFailed`` when sources failed and none is left, as that is not the same as no listings; with ``whole`` as soon as one fails.
    """
    base, done, errors, failed = run_dir(spark, "raw"), [], [], 0
    for number, name in enumerate(sorted(chosen_sources(enabled, sources))):
        if name not in landed and not enabled:
            continue
        try:
            if name not in landed:
                raise FileNotFoundError("nothing has landed")
            frame = landed[name]() if callable(landed[name]) else landed[name]
            path = f"{base}/source={number}"
            defects = Observation() if sources[name] in FEEDS else None
            source_listings(frame, name, keywords, limit_per_source, sources, defects).write.parquet(path)
            if defects is not None and (n := defects.get.get("defective")):
                errors.append(f"{name}: {n} items cannot be read")
            done.append((path, number))
        except Exception as exc:  # noqa: BLE001 - without ``whole`` any failure only takes out its own source
            errors.append(f"{name}: {type(exc).__name__}: {exc}".splitlines()[0])
            failed += 1
            if whole:
                raise SourcesFailed(errors) from exc
    if failed and not done:
        raise SourcesFailed(errors)
    frames = [spark.read.parquet(path).withColumn("source_no", F.lit(number)) for path, number in done]
    if not frames:
        return no_listings(spark), errors
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    return first_wins(merged, ["source_no", "unit", "pos"]), errors


def no_listings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], T.StructType([
        T.StructField("pos", T.LongType()), *LISTING_NORM.fields, T.StructField("unit", T.StringType()),
        T.StructField("source_no", T.IntegerType()),
    ]))
