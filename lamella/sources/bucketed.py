"""Mutation logs bucketed and sorted by key, so that reconciliation needs no shuffle.

For a log that is read far more often than it is written: the shuffle is paid once, at the writing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from .shared import shared_folder


def write_bucketed(log: DataFrame, n_buckets: int, name: str | None = None, path: str | None = None) -> str:
    """Saves a table of n_buckets files (rows are brought together by key first) and returns its name."""
    spark = log.sparkSession
    name = name or f"lamella_{uuid.uuid4().hex}"
    path = path or f"{shared_folder(spark)}/{name}"
    log.repartition(n_buckets, "key").write.bucketBy(n_buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
    return name


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)
