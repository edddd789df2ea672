"""Stream deduplication by Spark's own keyed state, kept in RocksDB and checkpointed with the stream.

The other form, ``ingest.ingest_once``, looks keys up in the table it has written. Here the known keys are the stream's state: a micro-batch costs what
it brings, however much has been stored, and the state lies on the executors' disks, with its changes in the checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Only changes are uploaded at each commit, not the whole state.
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def use_rocksdb(spark: SparkSession) -> None:
    for key, value in STATE_STORE.items():
        spark.conf.set(key, value)


def distinct_stream(stream: DataFrame, keys: list[str], time: str | None = None, horizon: str | None = None) -> DataFrame:
    """Rows of ``stream`` whose keys have not been seen before, one of each key.

    With a ``time`` column and a ``horizon`` such as ``"30 days"``, a key is forgotten that long after it was first seen, by the stream's own clock (the latest time that
    any row had, less the horizon); rows that come later than this are dropped. Without them every key is kept for good. Null keys are keys like others. Which row of a key in one
    micro-batch stays is not defined, so columns other than the keys should follow from them.
    """
    if (time is None) != (horizon is None):
        raise ValueError("a horizon needs a time column, and a time column a horizon")
    if time is None:
        return stream.dropDuplicates(keys)
    return stream.withWatermark(time, horizon).dropDuplicatesWithinWatermark(keys)


def ingest_distinct(
    stream: DataFrame, keys: list[str], target: str, checkpoint: str, time: str | None = None, horizon: str | None = None,
) -> StreamingQuery:
    """Take in what has arrived since the last call and store each new key's row once; returns the finished query.

    The file sink commits a micro-batch together with the state, so a run that died is repeated without storing anything twice.
    """
    use_rocksdb(stream.sparkSession)
    started = distinct_stream(stream, keys, time, horizon).writeStream.format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    started.awaitTermination()
    return started
