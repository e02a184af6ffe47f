"""Sorted runs as Parquet: disjoint key ranges over files, sorted by key within, with a Bloom filter on the key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import MUTATION


def write_run(log: DataFrame, path: str, n_files: int = 1, bloom: bool = True) -> dict | None:
    """Writes a run and returns its statistics; nothing, and None, for an empty one.

    n_files ranges of keys become files, so a range of keys is in few of them, and row groups have narrow ranges.
    """
    ranged = log.repartitionByRange(n_files, "key") if n_files > 1 else log.coalesce(1)
    writer = ranged.sortWithinPartitions("key").write.mode("overwrite")
    if bloom:
        writer = writer.option("parquet.bloom.filter.enabled#key", "true")
    writer.parquet(path)
    stats = read_run(log.sparkSession, [path]).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("deleted").alias("n_tombstones"), F.hex(F.min("key")).alias("first_key"), F.hex(F.max("key")).alias("last_key"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"), F.sum(9 + F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0))).alias("bytes"),
    ).first()
    return None if not stats["n_items"] else stats.asDict()


def read_run(spark: SparkSession, paths: list[str]) -> DataFrame:
    return spark.read.schema(MUTATION).parquet(*paths) if paths else spark.createDataFrame([], MUTATION)
