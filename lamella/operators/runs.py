"""Sorted runs: statistics, overlap, block packing, and the planning of compactions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..model import BLOCK_HEADER, BLOCK_SIZE, ITEM_HEADER, ITEM_SLOT, LARGEST_ITEM
from ..sources.shared import materialize
from .reads import locate
from .resolve import latest


def run_stats(log: DataFrame, run: str) -> DataFrame:
    """Per run: items, tombstones, first and last key, smallest and largest seq."""
    return log.groupBy(run).agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if("deleted").alias("n_tombstones"), F.min("key").alias("first_key"), F.max("key").alias("last_key"),
        F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"),
    )


def overlaps(a: DataFrame, b: DataFrame, run: str = "run_id") -> DataFrame:
    """(a, b): pairs of runs whose key ranges meet. Both are run statistics: a row a run, thousands at most."""
    x, y = a.alias("x"), b.alias("y")
    meet = (F.col("x.first_key") <= F.col("y.last_key")) & (F.col("y.first_key") <= F.col("x.last_key"))
    return x.join(y, meet).select(F.col(f"x.{run}").alias("a"), F.col(f"y.{run}").alias("b"))


def without_overlap(a: DataFrame, b: DataFrame, run: str = "run_id") -> DataFrame:
    """The runs of a that meet none of b."""
    return a.join(overlaps(a, b, run).select(F.col("a").alias(run)).distinct(), run, "left_anti")


def is_disjoint(stats: DataFrame) -> DataFrame:
    """(disjoint): whether runs sorted by first key don't meet; only neighbours are compared."""
    before = F.max("last_key").over(W.orderBy("first_key", "last_key").rowsBetween(W.unboundedPreceding, -1))
    return stats.withColumn("_before", before).agg(F.coalesce(F.bool_and(F.col("_before").isNull() | (F.col("_before") < F.col("first_key"))), F.lit(True)).alias("disjoint"))


def disjoint_levels(stats: DataFrame) -> DataFrame:
    """(level, disjoint): for each level whether its runs, sorted by first key, don't meet."""
    order = W.partitionBy("level").orderBy("first_key", "last_key").rowsBetween(W.unboundedPreceding, -1)
    apart = F.col("_before").isNull() | (F.col("_before") < F.col("first_key"))
    return stats.withColumn("_before", F.max("last_key").over(order)).groupBy("level").agg(F.bool_and(apart).alias("disjoint"))


def pick_for_key(stats: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, run_id) for each run that may hold a key wanted, whatever the runs' ranges.

    The ranges' ends cut the keys into segments with the same runs all over, at most twice as many as runs; a key is
    located in its segment by a range join, then meets that segment's runs by number.
    """
    edge = lambda c, side: F.struct(F.col(c).alias("k"), F.lit(side).alias("side"))
    # a segment begins at each first key, and right behind each last key; a key wanted stands between the two
    cuts = stats.select(edge("first_key", 0).alias("first_key")).unionAll(stats.select(edge("last_key", 2))).distinct()
    cuts = materialize(cuts.withColumn("block", F.row_number().over(W.orderBy("first_key"))), "segments")
    number = lambda at, name: cuts.select(F.col("first_key").alias(at), F.col("block").alias(name))
    spans = stats.select("run_id", edge("first_key", 0).alias("_a"), edge("last_key", 2).alias("_b")).join(number("_a", "_from"), "_a").join(number("_b", "_to"), "_b")
    covered = spans.select("run_id", F.explode(F.sequence(F.col("_from"), F.col("_to") - 1)).alias("block"))
    return locate(wanted.select(edge("key", 1).alias("key")), cuts).join(covered, "block").select(F.col("key.k").alias("key"), "run_id")


def pick_in_level(level: DataFrame, wanted: DataFrame) -> DataFrame:
    """(key, run_id) for the run of a level with disjoint runs that may hold each key: located by first keys."""
    index = level.select(F.col("run_id").alias("block"), "first_key")
    found = locate(wanted, index).where("block is not null")
    return found.join(level.select(F.col("run_id").alias("block"), "last_key"), "block").where("key <= last_key").select("key", F.col("block").alias("run_id"))


def merge(log: DataFrame, drop_tombstones: bool = False) -> DataFrame:
    """What a merge of runs writes: the latest mutation of each key.

    Tombstones stay, unless the runs merged are all that may hold their keys.
    """
    rows = latest(log)
    return rows.where(~F.col("deleted")) if drop_tombstones else rows


def next_run_ids(stats: DataFrame) -> DataFrame:
    return stats.groupBy("level").agg((F.max("run_id") + 1).alias("next_run_id"))


def compaction_candidates(stats: DataFrame, capacities: DataFrame, share: float = 0.8) -> DataFrame:
    """Levels with more runs than this share of their capacity, the last level excepted; deepest first."""
    last = capacities.agg(F.max("level").alias("_last"))
    counts = stats.groupBy("level").agg(F.count(F.lit(1)).alias("n_runs"))
    return counts.join(capacities, "level").crossJoin(last).where((F.col("n_runs") > share * F.col("capacity")) & (F.col("level") < F.col("_last"))).select("level", "n_runs", "capacity")


def pick_from_first_level(stats: DataFrame) -> DataFrame:
    """(run_id, with_run): the oldest run of level 1 with each run of level 2 it meets (null: none)."""
    oldest = stats.where("level = 1").orderBy("run_id").limit(1)
    below = stats.where("level = 2")
    pairs = overlaps(oldest, below).select(F.col("a").alias("run_id"), F.col("b").alias("with_run"))
    return oldest.select("run_id").join(pairs, "run_id", "left")


def pick_from_level(stats: DataFrame, level: int) -> DataFrame:
    """(run_id, n_overlaps): the run of a sorted level that meets fewest runs of the next one, in order of first key.

    With no overlap it can move as it is.
    """
    own, below = stats.where(F.col("level") == level), stats.where(F.col("level") == level + 1)
    meets = overlaps(own, below).groupBy(F.col("a").alias("run_id")).agg(F.count(F.lit(1)).alias("n_overlaps"))
    rows = own.join(meets, "run_id", "left").withColumn("n_overlaps", F.coalesce("n_overlaps", F.lit(0)).cast("long"))
    return rows.orderBy("n_overlaps", "first_key", "run_id").limit(1).select("run_id", "n_overlaps")


def item_space(deleted: Column | None = None) -> Column:
    """Bytes that a (key, value) takes in a block."""
    value = F.coalesce(F.octet_length("value"), F.lit(0))
    return ITEM_SLOT + ITEM_HEADER + F.octet_length("key") + (value if deleted is None else F.when(deleted, 0).otherwise(value))


def oversize(log: DataFrame) -> DataFrame:
    """Items whose key and value together don't fit any block."""
    return log.where(F.octet_length("key") + F.coalesce(F.octet_length("value"), F.lit(0)) > LARGEST_ITEM)


def rough_blocks(log: DataFrame, run: str) -> DataFrame:
    """log with block: the running sum of spaces in key order over a block's capacity. A block may be overfull by one item."""
    upto = F.sum(F.col("space")).over(W.partitionBy(run).orderBy("key", "seq"))
    return log.withColumn("space", item_space(F.col("deleted")).cast("long")).withColumn("block", F.floor((upto - 1) / (BLOCK_SIZE - BLOCK_HEADER)))


_ROOM = BLOCK_SIZE - BLOCK_HEADER


def _next_block(space: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """For a block that begins with an item, the item with which the next one begins."""
    return np.maximum(np.arange(len(space)) + 1, np.searchsorted(upto, upto - space + _ROOM, side="right"))


def _transfer(space: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    """What a segment does to the block that is open before it.

    The running spaces of its first items, a block's worth: they tell which item doesn't fit the open block. If that is
    item i, the segment begins counts[i] blocks, and used[i] bytes of the last of them are used behind it.
    """
    upto = np.cumsum(space)
    after, last = _next_block(space, upto), np.arange(min(len(space), int(np.searchsorted(upto, _ROOM, side="right")) + 1))
    head, counts = upto[: len(last)], np.ones(len(last), dtype=np.int64)
    while (more := after[last] < len(space)).any():
        last = np.where(more, after[last], last)
        counts += more
    return head.tolist(), counts.tolist(), (upto[-1] - upto[last] + space[last]).tolist()


def _fill(part: pd.DataFrame, block: int, used: int) -> pd.DataFrame:
    """The blocks of a segment's items, the first of them the one that is open before it, as far as items fit."""
    space = part["space"].to_numpy()
    upto = np.cumsum(space)
    after, i, starts = _next_block(space, upto).tolist(), int(np.searchsorted(upto, _ROOM - used, side="right")), []
    numbers = [block] if i else []
    edges = [0] if i else []
    while i < len(space):
        edges.append(i)
        starts.append(i)
        i = after[i]
    numbers += range(block + 1, block + 1 + len(starts))
    return pd.DataFrame({"run": part["run"].iloc[0], "block": numbers, "n_items": np.diff([*edges, len(space)]), "used": np.add.reduceat(space, edges), "first_key": part["key"].iloc[edges].to_numpy()})


def pack_blocks(log: DataFrame, run: str, segment: int = 100_000) -> DataFrame:
    """(run, block, n_items, used, first_key): greedy filling in key order, as blocks are written.

    An item too large for any block has one of its own. Runs are cut into segments of about so many items in key order.
    Each segment says what it does to the block that is open before it, in a table of a block's items at most; these are
    followed through along each run; then all segments are filled in parallel, and a block over a seam is put together.
    """
    key = log.schema["key"].dataType.simpleString()
    rows = log.select(F.col(run).cast("long").alias("run"), "key", "seq", item_space(F.col("deleted")).cast("long").alias("space"))
    # written once: the ranges come from a sample and must be the same wherever they are used
    ranged = rows.repartitionByRange(max(1, -(-log.count() // segment)), "run", "key", "seq").withColumn("segment", F.spark_partition_id())
    ranged = materialize(ranged, "segments")

    def transfers(at: tuple, part: pd.DataFrame) -> pd.DataFrame:
        space = part.sort_values(["key", "seq"])["space"].to_numpy()
        head, counts, used = _transfer(space)
        return pd.DataFrame({"run": [at[0]], "segment": [at[1]], "total": [space.sum()], "head": [head], "counts": [counts], "used": [used]})

    def follow(part: pd.DataFrame) -> pd.DataFrame:
        # a run begins with no block, as if nothing fitted
        block, used, out = -1, BLOCK_SIZE, []
        part = part.sort_values("segment")
        for total, head, counts, left in zip(part["total"], part["head"], part["counts"], part["used"], strict=True):
            out.append((block, used))
            i = int(np.searchsorted(head, _ROOM - used, side="right"))
            block, used = (block + int(counts[i]), int(left[i])) if i < len(head) else (block, used + int(total))
        return part[["run", "segment"]].assign(block=[b for b, _ in out], used=[u for _, u in out])

    def fill(part: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        return _fill(part.sort_values(["key", "seq"]), int(before["block"].iloc[0]), int(before["used"].iloc[0]))

    tables = ranged.groupBy("run", "segment").applyInPandas(transfers, "run long, segment int, total long, head array<long>, counts array<long>, used array<long>")
    before = tables.groupBy("run").applyInPandas(follow, "run long, segment int, block long, used long")
    parts = ranged.groupBy("run", "segment").cogroup(before.groupBy("run", "segment")).applyInPandas(fill, f"run long, block long, n_items long, used long, first_key {key}")
    return parts.groupBy("run", "block").agg(F.sum("n_items").alias("n_items"), F.sum("used").alias("used"), F.min("first_key").alias("first_key"))


def block_index(blocks: DataFrame, run: str) -> DataFrame:
    """The first key of each block."""
    return blocks.groupBy(run, "block").agg(F.min("key").alias("first_key"))
