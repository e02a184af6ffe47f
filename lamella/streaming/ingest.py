"""Streaming ingestion of mutations into epochs of runs.

Each micro-batch becomes one run folder, overwritten if the epoch runs again, and counts from when a marker of its epoch
exists; so a batch that is repeated after a failure changes nothing. Late rows need no watermark: seq decides. Paths may
be on any file system that Spark reads.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..model import MUTATION
from ..operators.resolve import visible
from ..sources.shared import file_system, materialize, shared_folder


def _markers(spark: SparkSession, store: str):
    """The file system of a store, and the folder of its markers."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/_epochs")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def publish(spark: SparkSession, store: str, epoch: int) -> None:
    fs, folder = _markers(spark, store)
    fs.create(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, str(epoch)), True).close()


def published(spark: SparkSession, store: str) -> list[int]:
    fs, folder = _markers(spark, store)
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []


def epoch_writer(store: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that writes an epoch's rows and then publishes it."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.sortWithinPartitions("key").write.mode("overwrite").parquet(f"{store}/epoch={epoch}")
        publish(batch.sparkSession, store, epoch)

    return write


def start(source: DataFrame, store: str, checkpoint: str) -> StreamingQuery:
    """Ingests what there is, in micro-batches, and stops; the next start goes on from there."""
    return source.writeStream.foreachBatch(epoch_writer(store)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, store: str) -> DataFrame:
    """All mutations of the published epochs; none of a store that has no epoch yet."""
    epochs = published(spark, store)
    if not epochs:
        return spark.createDataFrame([], MUTATION)
    return spark.read.parquet(*[f"{store}/epoch={e}" for e in epochs])


def demo_state(spark: SparkSession, log: DataFrame) -> DataFrame:
    """log written as files, ingested one file a micro-batch with one epoch repeated, and its current state."""
    folder = f"{shared_folder(spark)}/lamella-stream-{uuid.uuid4().hex}"
    log.repartition(3, "seq").write.parquet(f"{folder}/in")
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    store = f"{folder}/store"
    start(source, store, f"{folder}/checkpoint").awaitTermination()
    first = published(spark, store)[0]
    epoch_writer(store)(materialize(spark.read.parquet(f"{store}/epoch={first}"), "epoch"), first)
    return visible(ingested(spark, store))
