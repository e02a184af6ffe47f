"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only in a local session where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lamella-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: cuts the lineage, survives lost executors.

    The files go with discard(), else when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lamella-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    fs, where = file_system(spark, path)
    fs.deleteOnExit(where)
    table = spark.read.schema(df.schema).parquet(path)
    table._lamella_path = path
    return table


def discard(table: DataFrame) -> None:
    """Deletes the files of a materialized table that nothing reads any more."""
    fs, where = file_system(table.sparkSession, table._lamella_path)
    fs.delete(where, True)
