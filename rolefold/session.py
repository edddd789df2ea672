"""Session defaults and the shared working folder for materialised steps."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Joins on a key that holds a large share of the rows are split at run time.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def build_session(app_name: str = "rolefold", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shuffle_conf(input_bytes: int, bytes_per_partition: int = 256 << 20) -> dict[str, str]:
    """Initial shuffle partitions for an input of this size; adaptive execution merges what is small."""
    partitions = max(200, -(-input_bytes // bytes_per_partition))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(bytes_per_partition),
    }


def apply_session_conf(spark: SparkSession) -> SparkSession:
    """Set the runtime-changeable defaults on a session somebody else built."""
    for key, value in SESSION_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster it
    would not be visible to the other machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
    fallback = os.environ.get("ROLEFOLD_TEST_DIR") or tempfile.mkdtemp(prefix="run-")
    os.environ["ROLEFOLD_TEST_DIR"] = fallback
    return fallback


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A Parquet table, empty while its path does not exist. Any other fault is raised.

    The optimizer knows that the empty one is empty: what is joined to it is not shuffled for that.
    """
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
        return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def run_dir(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/rolefold/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage by writing a table in the shared folder and reading it back.

    Unlike cached blocks the files outlive any executor, and every reader sees
    the same rows in the same partitions.
    """
    path = run_dir(df.sparkSession, name)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
