"""Membership filters of 16-bit fingerprints: three slots of a key XOR to its fingerprint.

No key that was put in is ever missed; another passes with a probability of about 2^-16. A filter takes about 2.5 bytes a
key; those of a run are built for parts of its keys, by hash.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hashes import murmur3, murmur3_key

#: Keys of a log in a part, about.
KEYS = 100_000
_HEAD = "<QQ"


def _spread(hashes: np.ndarray, seed: int) -> np.ndarray:
    x = hashes + np.uint64(seed)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _slots(mixed: np.ndarray, third: int) -> np.ndarray:
    """A slot in each third of the table, by multiply-shift of three 32-bit views."""
    out = np.empty((len(mixed), 3), dtype=np.int64)
    for k, turn in enumerate((0, 21, 42)):
        view = ((mixed << np.uint64(turn)) | (mixed >> np.uint64(64 - turn))) if turn else mixed
        out[:, k] = ((view & np.uint64(0xFFFFFFFF)) * np.uint64(third) >> np.uint64(32)).astype(np.int64) + k * third
    return out


def _mark(mixed: np.ndarray) -> np.ndarray:
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def build(hashes: np.ndarray) -> bytes:
    """A filter of these 64-bit hashes (repeated ones count once): seed, slots of a third, table."""
    keys = np.unique(hashes.astype(np.uint64))
    third = (max(36, 3 + int(1.23 * len(keys))) + 2) // 3
    for attempt in range(1, 1000):
        seed = (attempt * 0x9E3779B97F4A7C15) & (2**64 - 1)
        mixed = _spread(keys, seed)
        slots = _slots(mixed, third)
        order, at = _peel(slots, 3 * third)
        if len(order) == len(keys):
            table, marks = [0] * (3 * third), _mark(mixed).tolist()
            rows = slots.tolist()
            for i, s in zip(reversed(order), reversed(at), strict=True):
                a, b, c = rows[i]
                table[s] = 0
                table[s] = marks[i] ^ table[a] ^ table[b] ^ table[c]
            return struct.pack(_HEAD, seed, third) + np.array(table, dtype="<u2").tobytes()
    raise RuntimeError("no seed peels")


def _peel(slots: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """Keys in an order in which each has a slot of its own once those before are gone, and these slots."""
    count = np.bincount(slots.ravel(), minlength=n).tolist()
    keyed = np.zeros(n, dtype=np.int64)
    np.bitwise_xor.at(keyed, slots.ravel(), np.repeat(np.arange(len(slots)), 3))
    keyed, rows = keyed.tolist(), slots.tolist()
    alone = [s for s in range(n) if count[s] == 1]
    order, at = [], []
    while alone:
        s = alone.pop()
        if count[s] != 1:
            continue
        i = keyed[s]
        order.append(i)
        at.append(s)
        for t in rows[i]:
            count[t] -= 1
            keyed[t] ^= i
            if count[t] == 1:
                alone.append(t)
    return order, at


def may_contain(blob: bytes, hashes: np.ndarray) -> np.ndarray:
    """For each hash whether the filter may hold it."""
    seed, third = struct.unpack_from(_HEAD, blob)
    table = np.frombuffer(blob, dtype="<u2", offset=struct.calcsize(_HEAD))
    mixed = _spread(hashes.astype(np.uint64), seed)
    slots = _slots(mixed, third)
    return table[slots[:, 0]] ^ table[slots[:, 1]] ^ table[slots[:, 2]] == _mark(mixed)


def n_parts(log: DataFrame, keys: int = KEYS) -> int:
    """Parts into which a log's keys are hashed, so that a run's filter of a part has about so many keys at most."""
    return max(1, -(-log.count() // keys))


def _part(hash_: Column, parts: int) -> Column:
    return F.pmod(F.shiftrightunsigned(hash_, 7), F.lit(parts)).cast("int")


def build_filters(log: DataFrame, parts: int, run: str = "src") -> DataFrame:
    """(run, part, filter): filters of each run's keys, by part; no task has all keys of a run."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"run": [rows["run"].iloc[0]], "part": [rows["part"].iloc[0]], "filter": [build(rows["h"].to_numpy().view(np.uint64))]})

    hashed = log.select(F.col(run).cast("long").alias("run"), murmur3_key(F.col("key")).alias("h")).distinct().withColumn("part", _part(F.col("h"), parts))
    return hashed.groupBy("run", "part").applyInPandas(one, "run long, part int, filter binary")


def probe_filters(wanted: DataFrame, filters: DataFrame, parts: int) -> DataFrame:
    """(key, run): the runs that may hold each key of wanted (key), asked once. Keys and filters meet by part.

    A part has about KEYS keys of the log and as large a share of those wanted; nothing is broadcast or crossed.
    """

    def one(asked: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        hashes = asked["h"].to_numpy().view(np.uint64)
        found = [pd.DataFrame({"key": asked["key"][may_contain(bytes(f), hashes)], "run": r}) for r, f in zip(own["run"], own["filter"], strict=True)] if len(asked) else []
        return pd.concat(found) if found else pd.DataFrame({"key": [], "run": []})

    keys = wanted.select("key").where("key is not null").distinct().withColumn("h", murmur3_key(F.col("key"))).withColumn("part", _part(F.col("h"), parts))
    return keys.groupBy("part").cogroup(filters.groupBy("part")).applyInPandas(one, f"key {wanted.schema['key'].dataType.simpleString()}, run long")
