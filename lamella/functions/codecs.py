"""Order-preserving encodings of typed keys as bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text_key(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def int_key(number: Column) -> Column:
    """Eight bytes, big-endian with the sign bit flipped, so that bytes order as the numbers do."""
    flipped = number.cast("bigint").bitwiseXOR(F.lit(-(2**63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def int_of_key(key: Column) -> Column:
    """The number of int_key()."""
    high = F.conv(F.substring(F.hex(key), 1, 8), 16, 10).cast("bigint")
    low = F.conv(F.substring(F.hex(key), 9, 8), 16, 10).cast("bigint")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(2**63)))


def after_prefix(prefix: bytes) -> bytes | None:
    """The smallest key above all keys with the prefix; None if there is none."""
    bare = prefix.rstrip(b"\xff")
    return bare[:-1] + bytes([bare[-1] + 1]) if bare else None
