"""Reconciliation: which mutation of a key counts.

All forms are one shuffle by key. The row_number form lets Spark keep one row a key on the map side already
(WindowGroupLimit), so a key with very many mutations sends one row a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: Sequence[str] = ("key",), order: str = "seq") -> DataFrame:
    """One row a key, the one with the largest order; tombstones stay."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(order)))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def versions(log: DataFrame, horizon: int, keys: Sequence[str] = ("key",), order: str = "seq") -> DataFrame:
    """What reads at horizon or later can tell apart: all rows above it, and of each key the latest of those up to it."""
    late = F.col(order) > horizon
    return log.where(late).unionByName(latest(log.where(~late), keys, order))


def latest_by_aggregate(log: DataFrame, keys: Sequence[str] = ("key",), order: str = "seq") -> DataFrame:
    """latest() as an aggregate; binary columns make Spark sort for it."""
    rest = [c for c in log.columns if c not in keys]
    best = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_best"))
    return best.select(*keys, *[F.col("_best")[c].alias(c) for c in rest]).select(*log.columns)


def visible(log: DataFrame, keys: Sequence[str] = ("key",), order: str = "seq") -> DataFrame:
    """The current state: the latest mutation of each key, unless it is a tombstone.

    Filters on keys are pushed below by Spark; filters on values or deleted must stay above, as here.
    """
    return latest(log, keys, order).where(~F.col("deleted")).drop("deleted")


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log as it was once seq had been written."""
    return log.where(F.col("seq") <= seq)


def tombstones(log: DataFrame) -> DataFrame:
    return latest(log).where("deleted")


def merge_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """K-way merge of runs, the newest first: a key's row of the first run that has it; tombstones stay."""
    tagged = [r.withColumn("priority", F.lit(i)) for i, r in enumerate(runs)]
    return merge_by_priority(reduce(DataFrame.unionByName, tagged)).drop("priority")


def merge_by_priority(log: DataFrame, priority: str = "priority") -> DataFrame:
    """Of each key the row with the smallest priority, and of those in one run the newest."""
    rank = F.row_number().over(W.partitionBy("key").orderBy(priority, F.desc("seq")))
    return log.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
