"""Schemas and constants of the data model.

A mutation is (key, value, deleted, seq): an upsert, or a tombstone with deleted true and value null. seq is the only
notion of recency: of two mutations of a key the one with the larger seq is the newer one, whatever run holds it.
"""

from __future__ import annotations

from pyspark.sql import types as T

MUTATION = T.StructType(
    [T.StructField("key", T.BinaryType(), False), T.StructField("value", T.BinaryType()), T.StructField("deleted", T.BooleanType(), False), T.StructField("seq", T.LongType(), False)]
)
LOG = T.StructType(
    [T.StructField("pos", T.LongType()), T.StructField("op", T.StringType()), T.StructField("key", T.BinaryType()), T.StructField("value", T.BinaryType()), T.StructField("committed_upto", T.LongType())]
)
RUN_META = T.StructType(
    [
        T.StructField("level", T.IntegerType()), T.StructField("run_id", T.IntegerType()), T.StructField("path", T.StringType()),
        T.StructField("n_items", T.LongType()), T.StructField("n_tombstones", T.LongType()),
        T.StructField("first_key", T.BinaryType()), T.StructField("last_key", T.BinaryType()),
        T.StructField("min_seq", T.LongType()), T.StructField("max_seq", T.LongType()), T.StructField("bytes", T.LongType()),
    ]
)

PUT, DELETE, COMMIT, BEGIN, END = "put", "del", "commit", "begin", "end"
#: Bytes of a block, of its header, and of an item's slot and header.
BLOCK_SIZE, BLOCK_HEADER, ITEM_SLOT, ITEM_HEADER = 4096, 4, 4, 4
#: The most bytes of key and value that fit a block.
LARGEST_ITEM = BLOCK_SIZE - BLOCK_HEADER - ITEM_SLOT - ITEM_HEADER
FOUND, DELETED, NOT_FOUND = "Found", "Deleted", "NotFound"


def level_capacity(level: int, l1_max_runs: int = 6, first_level_max_runs: int = 2, fanout: float = 4) -> int:
    """Runs that a level may hold: l1_max_runs at level 1, then first_level_max_runs times fanout for each level more."""
    if level < 1:
        raise ValueError("levels start at 1")
    if level == 1:
        return l1_max_runs
    whole = first_level_max_runs * fanout ** (level - 2)
    return int(whole) + (whole > int(whole))
