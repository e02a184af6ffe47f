"""The write-ahead log as a table of operations: positions, commit markers, batches and replay.

Order along the log is computed in two steps: within segments of the log, in parallel, and over one row a segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import BEGIN, COMMIT, DELETE, END, PUT

#: Operations in a segment.
SEGMENT = 1_000_000
#: Bytes of an entry besides its key and value, of a commit marker, and of a batch marker.
ENTRY, COMMIT_SIZE, MARKER_SIZE = 9, 12, 4
IS_ENTRY = f"op in ('{PUT}', '{DELETE}')"


def size_of() -> Column:
    """Encoded bytes of an operation (op, key, value); a tombstone's value takes none."""
    value = F.when(F.col("op") == PUT, F.coalesce(F.octet_length("value"), F.lit(0))).otherwise(0)
    entry = ENTRY + F.coalesce(F.octet_length("key"), F.lit(0)) + value
    return F.when(F.expr(IS_ENTRY), entry).when(F.col("op") == COMMIT, COMMIT_SIZE).otherwise(MARKER_SIZE).cast("long")


def positions(ops: DataFrame, order: str = "ord", segment: int = SEGMENT) -> DataFrame:
    """ops with size and pos, the byte at which each starts in the order of a unique integer column."""
    rows = ops.withColumn("size", size_of()).withColumn("_seg", F.floor(F.col(order) / segment))
    totals = rows.groupBy("_seg").agg(F.sum("size").alias("_sum"))
    base = totals.withColumn("_base", F.coalesce(F.sum("_sum").over(W.orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    before = F.coalesce(F.sum("size").over(W.partitionBy("_seg").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_in", before).join(base.select("_seg", "_base"), "_seg").withColumn("pos", F.col("_base") + F.col("_in")).drop("_seg", "_in", "_base")


def commit_offset(log: DataFrame, legacy: int | None = None) -> DataFrame:
    """(committed): what the last commit marker says, not the largest one; a legacy offset where there is none, else 0."""
    last = F.max_by("committed_upto", "pos")
    return log.where(F.col("op") == COMMIT).agg(F.coalesce(F.nullif(last, F.lit(0)), F.lit(legacy).cast("long"), F.lit(0)).cast("long").alias("committed"))


def end_of_log(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max(F.col("pos") + F.col("size")), F.lit(0)).alias("position"))


def all_committed(log: DataFrame) -> DataFrame:
    """(all_committed): whether no entry ends behind the last commit marker's offset."""
    end = log.where(IS_ENTRY).agg(F.coalesce(F.max(F.col("pos") + F.col("size")), F.lit(0)).alias("_end"))
    return end.crossJoin(commit_offset(log)).select((F.col("_end") <= F.col("committed")).alias("all_committed"))


def value_at(log: DataFrame, pos: int) -> DataFrame:
    return log.where(IS_ENTRY).where(F.col("pos") == pos).select("pos", "key", "value")


def complete_batches(log: DataFrame, segment_bytes: int = 64 << 20) -> DataFrame:
    """The entries (put, del) that replay emits: those outside batches, and those of batches that end.

    A begin drops a batch that hasn't ended; an end without begin does nothing. Each entry looks at the last batch marker
    before and the first after it: within its segment, else in the segments' own first and last markers.
    """
    marker = F.when(F.col("op").isin(BEGIN, END), F.col("op"))
    rows = log.withColumn("_m", marker).withColumn("_seg", F.floor(F.col("pos") / segment_bytes))
    order = W.partitionBy("_seg").orderBy("pos")
    rows = rows.withColumn("_before", F.last("_m", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    rows = rows.withColumn("_after", F.first("_m", ignorenulls=True).over(order.rowsBetween(1, W.unboundedFollowing)))
    at = F.when(F.col("_m").isNotNull(), F.col("pos"))
    ends = rows.groupBy("_seg").agg(F.min_by("_m", at).alias("_first"), F.max_by("_m", at).alias("_last"))
    line = W.orderBy("_seg")
    ends = ends.select(
        "_seg",
        F.last("_last", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, -1)).alias("_carried"),
        F.first("_first", ignorenulls=True).over(line.rowsBetween(1, W.unboundedFollowing)).alias("_coming"),
    )
    rows = rows.where(IS_ENTRY).join(ends, "_seg")
    inside = F.coalesce("_before", "_carried", F.lit(END)) == BEGIN
    closed = F.coalesce(F.coalesce("_after", "_coming") == END, F.lit(False))
    return rows.where(~inside | closed).drop("_m", "_seg", "_before", "_after", "_carried", "_coming")


def uncommitted(log: DataFrame) -> DataFrame:
    """Entries that start at or behind the committed offset, as the log has them."""
    return log.where(IS_ENTRY).crossJoin(commit_offset(log)).where("pos >= committed").drop("committed")


def replay(log: DataFrame, segment_bytes: int = 64 << 20) -> DataFrame:
    """What is applied after a crash: operations from the committed offset on, batches only if they end."""
    rest = log.crossJoin(commit_offset(log)).where("pos >= committed").drop("committed")
    return complete_batches(rest, segment_bytes)


def checkpoint(log: DataFrame, run: str) -> DataFrame:
    """(run, committed_upto): the start of each run's last entry, which a replay applies once more."""
    return log.where(IS_ENTRY).groupBy(run).agg(F.max("pos").alias("committed_upto"))


def apply_batches(ops: DataFrame, batch: str = "batch_id") -> DataFrame:
    """Mutations of the batches that are whole: ops (key, value, deleted, seq, batch_id, complete), all or nothing."""
    return ops.where("complete").drop("complete")


def mutations(entries: DataFrame) -> DataFrame:
    """Log entries as mutations: the position is the sequence number."""
    deleted = F.col("op") == DELETE
    return entries.select("key", F.when(~deleted, F.col("value")).alias("value"), deleted.alias("deleted"), F.col("pos").alias("seq"))
