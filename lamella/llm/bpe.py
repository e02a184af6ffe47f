"""Byte-level BPE: whole pre-tokens by a minimal perfect hash over the vocabulary, all others by a heap over linked bytes.

The tables (a few MB, bounded by the vocabulary) travel with the function; texts are encoded in Arrow batches without a
shuffle. A worker keeps a bounded memo of pre-tokens.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Pre-tokens that a memo holds, and the characters up to which one is put there.
MEMO, MEMO_CHARS = 300_000, 64
#: Characters from which on a text's pre-tokens are taken one at a time instead of as a list.
LONG = 1_000_000
#: Bytes of text that are put into one output batch.
BATCH_BYTES = 4_000_000


@dataclass(frozen=True)
class PerfectHash:
    """Hash-and-displace: as many slots as keys. A bucket of one key stores its slot (negative), others a displacement."""

    displacement: list[int]
    n: int

    @staticmethod
    def build(keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        n_buckets = max(1, n // 3)
        hashes = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], dtype=np.uint64)
        if len(np.unique(hashes)) < n:
            raise ValueError("two keys are equal, or equal by 64-bit hash")
        bucket = (hashes % np.uint64(n_buckets)).astype(np.int64)
        first = ((hashes >> np.uint64(17)) % np.uint64(n)).astype(np.int64)
        step = ((hashes >> np.uint64(37)) % np.uint64(max(1, n - 1))).astype(np.int64) + 1
        used, displacement = np.zeros(n, dtype=bool), [0] * n_buckets
        by = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[by], np.arange(n_buckets + 1))
        sizes = np.diff(starts)
        singles = []
        for b in np.argsort(-sizes, kind="stable"):
            own = by[starts[b] : starts[b + 1]]
            if len(own) == 0:
                break
            if len(own) == 1:
                singles.append(b)
                continue
            d = 0
            while True:
                tries = np.arange(d, d + 64)
                # (d >> 8) breaks the cycles that a step sharing a factor with n would run in
                slots = (first[own][None, :] + tries[:, None] * step[own][None, :] + (tries[:, None] >> 8)) % n
                good = ~used[slots].any(axis=1)
                ordered = np.sort(slots, axis=1)
                good &= (np.diff(ordered, axis=1) > 0).all(axis=1)
                if good.any():
                    k = int(np.argmax(good))
                    used[slots[k]] = True
                    displacement[b] = d + k
                    break
                d += 64
                if d > 1 << 22:
                    raise ValueError("no displacement found")
        for b, slot in zip(singles, np.flatnonzero(~used), strict=False):
            displacement[b] = -int(slot) - 1
        return PerfectHash(displacement, n)

    def slot(self, key: bytes) -> int:
        """The slot of a key; of any other string, some slot."""
        h = xxhash.xxh3_64_intdigest(key)
        d = self.displacement[h % len(self.displacement)]
        if d < 0:
            return -d - 1
        return ((h >> 17) % self.n + d * ((h >> 37) % max(1, self.n - 1) + 1) + (d >> 8)) % self.n


class Memo(dict):
    """Pre-token to the bytes of its ids; forgets all when full."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder

    def __missing__(self, token: str) -> bytes:
        ids = self.encoder.encode_token(token.encode())
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[token] = ids
        return ids


class Encoder:
    """Encodes as ranks and pattern say; ids are kept as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.pattern = pattern
        self.ranks = ranks
        keys = list(ranks)
        self.hash = PerfectHash.build(keys)
        self.slots: list[bytes] = [b""] * len(keys)
        for k in keys:
            self.slots[self.hash.slot(k)] = k
        self.words = dict(sorted((r, k) for k, r in ranks.items()))

    def encode_token(self, token: bytes) -> bytes:
        found = self.slots[self.hash.slot(token)]
        return struct.pack("<I", self.ranks[found]) if found == token else struct.pack(f"<{len(m := self.merge(token))}I", *m)

    def merge(self, word: bytes) -> list[int]:
        """Merges the pair of lowest rank, leftmost first, until none is left; parts are linked, pairs in a heap."""
        n, rank = len(word), self.ranks.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1 if (r := rank(word[i : i + 2])) is None else r for i in range(n - 1)] + [-1]
        heap = [r * n + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:
                continue
            j = after[i]
            after[i] = k = after[j]
            pair[i] = pair[j] = -1
            if k < n:
                before[k] = i
                if (r := rank(word[i : after[k]])) is not None:
                    pair[i] = r
                    heapq.heappush(heap, r * n + i)
            if (p := before[i]) >= 0:
                pair[p] = -1
                if (r := rank(word[p:k])) is not None:
                    pair[p] = r
                    heapq.heappush(heap, r * n + p)
        ids, i = [], 0
        while i < n:
            ids.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return ids

    def encoding(self):
        """A function from text to the bytes of its ids, with a memo of its own."""
        pattern, memo = regex.compile(self.pattern), Memo(self)

        def encode(text: str) -> bytes:
            if len(text) < LONG:
                return b"".join(map(memo.__getitem__, pattern.findall(text)))
            out = bytearray()
            for m in pattern.finditer(text):
                out += memo[m[0]]
            return bytes(out)

        return encode

    def decode(self, ids: bytes) -> bytes:
        words = self.words
        return b"".join([words[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


def load_encoder(path: str | None = None, pattern: str | None = None) -> Encoder:
    """From a rank file of a public tokenizer; path and pattern default to the installed multilingual one."""
    import public_tokenizers

    return Encoder(load_ranks(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, encoder: Encoder, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary): each row's text as little-endian unsigned 32-bit ids; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder.encoding()
        for b in batches:
            for part in slices(b):
                ids = [to_ids(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary")


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about so many bytes of a text column, one row at least: bounds what is in memory at once."""
    lengths = np.array([0 if x is None else x for x in pa.compute.binary_length(batch.column(column)).to_pylist()], dtype=np.int64)
    group, at = np.cumsum(lengths) // limit, 0
    for stop in [*np.flatnonzero(np.diff(group)) + 1, len(lengths)]:
        if stop > at:
            yield batch.slice(at, stop - at)
        at = stop


def round_trip(docs: DataFrame, encoder: Encoder, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each text, then decodes the ids; with_ids: ids, too.

    A null text counts as empty (no tokens); repeated rows give repeated results; an empty table gives none; texts
    of any length are encoded whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids, sha = encoder.encoding(), hashlib.sha256
        for b in batches:
            for part in slices(b):
                ids = [to_ids(t or "") for t in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([sha(x).hexdigest() for x in ids], pa.string()), pa.array([sha(encoder.decode(x)).hexdigest() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * with_ids], names=names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"), load_encoder())
