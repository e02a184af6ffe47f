"""MurmurHash3 (second half of x64-128, seed 0), a 16-bit FNV-1a fold and CRC-32, over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_C1, _C2 = np.uint64(0x87C37B91114253D5), np.uint64(0x4CF5AD432745937F)


def _rotate(x: np.ndarray, bits: int) -> np.ndarray:
    return (x << np.uint64(bits)) | (x >> np.uint64(64 - bits))


def _final(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _by_length(keys: list[bytes], kind: type, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """of() over a matrix of the keys of each length."""
    out = np.zeros(len(keys), dtype=kind)
    sizes = np.array([len(k) for k in keys], dtype=np.int64)
    for n in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == n)
        out[rows] = of(np.frombuffer(b"".join(keys[i] for i in rows), dtype=np.uint8).reshape(len(rows), n))
    return out


def _murmur(block: np.ndarray) -> np.ndarray:
    count, n = block.shape
    padded = np.zeros((count, -(-max(n, 1) // 16) * 16), dtype=np.uint8)
    padded[:, :n] = block
    lanes = padded.view("<u8")
    h1, h2 = np.zeros(count, dtype=np.uint64), np.zeros(count, dtype=np.uint64)
    for i in range(n // 16):
        h1 ^= _rotate(lanes[:, 2 * i] * _C1, 31) * _C2
        h1 = (_rotate(h1, 27) + h2) * np.uint64(5) + np.uint64(0x52DCE729)
        h2 ^= _rotate(lanes[:, 2 * i + 1] * _C2, 33) * _C1
        h2 = (_rotate(h2, 31) + h1) * np.uint64(5) + np.uint64(0x38495AB5)
    if n % 16:
        h2 ^= _rotate(lanes[:, -1] * _C2, 33) * _C1
        h1 ^= _rotate(lanes[:, -2] * _C1, 31) * _C2
    h1, h2 = h1 ^ np.uint64(n), h2 ^ np.uint64(n)
    h1 = h1 + h2
    h2 = h2 + h1
    h1, h2 = _final(h1), _final(h2)
    return h2 + h1 + h2


def murmur3(keys: list[bytes]) -> np.ndarray:
    """The second 64 bits of MurmurHash3 x64-128 with seed 0, as unsigned integers."""
    return _by_length(keys, np.uint64, _murmur)


def _fnv(block: np.ndarray) -> np.ndarray:
    h = np.full(len(block), 2166136261, dtype=np.uint32)
    for column in block.T:
        h = (h ^ column) * np.uint32(16777619)
    return ((h >> np.uint32(16)) ^ h) & np.uint32(0xFFFF)


def fnv16(keys: list[bytes]) -> np.ndarray:
    """FNV-1a of 32 bits, folded to 16."""
    return _by_length(keys, np.uint32, _fnv)


@F.pandas_udf(T.LongType())
def _murmur_udf(keys: pd.Series) -> pd.Series:
    null = keys.isna()
    values = pd.Series(murmur3([b"" if n else bytes(k) for k, n in zip(keys, null, strict=True)]).view(np.int64), dtype="Int64")
    return values.mask(null.reset_index(drop=True))


@F.pandas_udf(T.IntegerType())
def _fnv_udf(keys: pd.Series) -> pd.Series:
    null = keys.isna()
    values = pd.Series(fnv16([b"" if n else bytes(k) for k, n in zip(keys, null, strict=True)]).astype(np.int32), dtype="Int32")
    return values.mask(null.reset_index(drop=True))


def murmur3_key(key: Column) -> Column:
    """murmur3() of a binary column as a signed integer (null: null)."""
    return _murmur_udf(key.cast("binary"))


def fnv16_key(key: Column) -> Column:
    return _fnv_udf(key.cast("binary"))


def crc32_key(value: Column) -> Column:
    return F.crc32(value.cast("binary"))
