"""Reads over a mutation log: scans, point and multi-key lookups."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codecs import after_prefix
from ..model import DELETED, FOUND, NOT_FOUND
from ..sources.shared import materialize
from .resolve import latest, visible


def in_range(log: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Rows with start <= key <= end; None or a bound of length zero means no bound. Reaches the file scan."""
    if start is not None and len(start):
        log = log.where(F.col("key") >= F.lit(start))
    if end is not None and len(end):
        log = log.where(F.col("key") <= F.lit(end))
    return log


def scan(log: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """(key, value, ...) of the current state within inclusive bounds; order by key where order matters."""
    return visible(in_range(log, start, end))


def ordered_scan(log: DataFrame, start: Any = None, end: Any = None, limit: int | None = None) -> DataFrame:
    rows = scan(log, start, end).orderBy("key")
    return rows if limit is None else rows.limit(limit)


def with_prefix(rows: DataFrame, prefix: str | bytes) -> DataFrame:
    """All rows whose key has a prefix, as the range that holds them, so that files and row groups are skipped; nothing is reconciled."""
    if isinstance(prefix, str):
        return rows.where(F.col("key").startswith(prefix))
    rows, end = in_range(rows, prefix), after_prefix(prefix)
    return rows if end is None else rows.where(F.col("key") < F.lit(end))


def prefix_scan(log: DataFrame, prefix: str | bytes) -> DataFrame:
    """The current state of the keys with a prefix."""
    return visible(with_prefix(log, prefix))


def keys(log: DataFrame) -> DataFrame:
    """Keys of the current state; values are not read."""
    return visible(log.select("key", "deleted", "seq")).select("key")


def values(log: DataFrame) -> DataFrame:
    return visible(log).select("value")


def get(log: DataFrame, key: Any) -> DataFrame:
    """The current row of one key, if it has any."""
    return visible(log.where(F.col("key") == F.lit(key)))


def lookup(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """wanted (key, ...) with result (Found, Deleted or NotFound), value and seq of the latest mutation.

    The log is reduced to the keys wanted before it is reconciled; a wanted row that repeats stays repeated.
    """
    asked = wanted.select("key").distinct()
    found = latest(log.join(asked, "key", "left_semi")).select("key", "value", "deleted", "seq")
    result = F.when(F.col("deleted").isNull(), NOT_FOUND).when(F.col("deleted"), DELETED).otherwise(FOUND)
    return wanted.join(found, "key", "left").select(*wanted.columns, result.alias("result"), F.when(~F.col("deleted"), F.col("value")).alias("value"), "seq")


def leased_get(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """(key, value, found, deleted): an empty value that is there counts as found."""
    rows = lookup(wanted, log)
    return rows.select(*wanted.columns, "value", (F.col("result") == FOUND).alias("found"), (F.col("result") == DELETED).alias("deleted"))


def multi_get(wanted: DataFrame, log: DataFrame, order: str = "ord") -> DataFrame:
    """wanted (ord, key) with value or null, repeated keys kept; ord is the order of the request."""
    return lookup(wanted, log).select(order, "key", "value")


def nullable_get(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """Values, with an empty one read as none."""
    return lookup(wanted, log).select(*wanted.columns, F.when(F.octet_length("value") > 0, F.col("value")).alias("value"))


def existing(wanted: DataFrame, log: DataFrame) -> DataFrame:
    """The rows of wanted whose key has a value that isn't empty."""
    live = visible(log.join(wanted.select("key").distinct(), "key", "left_semi")).where(F.octet_length("value") > 0)
    return wanted.join(live.select("key"), "key", "left_semi")


def exists_below(wanted: DataFrame, log: DataFrame, level: int) -> DataFrame:
    """The rows of wanted whose key has any mutation, tombstones too, at this level or deeper (log with a level)."""
    return wanted.join(log.where(F.col("level") >= level).select("key"), "key", "left_semi")


def locate(wanted: DataFrame, index: DataFrame) -> DataFrame:
    """wanted with the last block whose first key is not above the key (null: before all); index: (block, first_key).

    A range join without a cross product: keys and first keys are put in one order, and each key takes the last first
    key before it. The order is cut into as many ranges as Spark has shuffle partitions; what each range ends with is
    carried into the next.
    """
    both = wanted.select(F.col("key").alias("_k"), F.lit(1).alias("_side"), F.struct(*wanted.columns).alias("_row"), F.lit(None).cast(index.schema["block"].dataType).alias("_block")).unionByName(
        index.select(F.col("first_key").alias("_k"), F.lit(0).alias("_side"), F.lit(None).cast(wanted.schema).alias("_row"), F.col("block").alias("_block"))
    )
    order = W.partitionBy("_part").orderBy("_k", "_side", "_block")
    # written once: the ranges come from a sample and must be the same wherever they are used
    ranged = materialize(both.repartitionByRange("_k").withColumn("_part", F.spark_partition_id()), "ranges")
    inside = ranged.withColumn("_last", F.last("_block", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    ends = ranged.groupBy("_part").agg(F.max_by("_block", F.when(F.col("_side") == 0, F.struct("_k", "_block"))).alias("_end"))
    before = ends.withColumn("_carried", F.last("_end", ignorenulls=True).over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", "_carried")
    return inside.where("_side = 1").join(before, "_part", "left").select("_row.*", F.coalesce("_last", "_carried").alias("block"))
