"""Structured Streaming forms of listing ingest and of the stage board."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.dedup import top_n
from ..operators.lifecycle import latest_rows
from ..session import read_or_empty


def stream_files(spark: SparkSession, path: str, schema, per_trigger: int | None = None) -> DataFrame:
    """Stream of a Parquet table: a folder of part files, to which more may come, or a single file.

    A path that does not exist or holds no file is an error, not an empty stream.
    """
    files = spark.read.schema(schema).parquet(path).inputFiles()
    if not files:
        raise FileNotFoundError(f"no Parquet file under {path}")
    reader = spark.readStream.schema(schema)
    folder, _, name = path.rstrip("/").rpartition("/")
    if len(files) == 1 and files[0].rpartition("/")[2] == name:
        # A stream reads folders; a file is the only one of that name in its folder.
        reader, path = reader.option("pathGlobFilter", name), folder
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of all batches, with the number of the batch that stored them."""
    full = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return read_or_empty(spark, path, full)


def merge_batch(batch: DataFrame, batch_id: int, keys: list[str], order: list, target: str) -> None:
    """Store each key's first row of a batch unless an earlier batch has the key.

    A batch writes its own folder and overwrites it when it is replayed, so replaying changes nothing.
    """
    earlier = _stored(batch.sparkSession, target, batch.schema).filter(F.col("batch") < batch_id).select(*keys)
    fresh = top_n(batch, keys, order, 1).join(earlier, keys, "left_anti")
    fresh.write.mode("overwrite").parquet(f"{target}/batch={batch_id}")


def ingest_once(stream: DataFrame, keys: list[str], order: list, target: str, checkpoint: str) -> None:
    """Take in what has arrived since the last call. The known keys are the table itself, so no state
    grows in memory."""
    stream.writeStream.foreachBatch(
        lambda batch, batch_id: merge_batch(batch, batch_id, keys, order, target)
    ).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_ingested(spark: SparkSession, target: str, schema: T.StructType) -> DataFrame:
    return _stored(spark, target, schema).drop("batch")


def append_events(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Add events to the log; the log's file sink commits each micro-batch once."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start().awaitTermination()


def live_board(events: DataFrame, key: str, stage: str, order: list[str], column: Column | None = None) -> DataFrame:
    """Applications per current stage. Late events take their place by time, so no watermark is needed."""
    state = latest_rows(events, [key], order, [stage])
    return state.groupBy((column if column is not None else F.col(stage)).alias("stage")).agg(
        F.count(F.lit(1)).alias("n"))
