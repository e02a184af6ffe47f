"""Suffix-array dedup: removes bytes covered by a 50-byte string that also starts in a document with a smaller id.

1. Batches. Texts are cut into pieces that overlap by 49 bytes, so that each 50-byte string starts in one piece, and packed
   into compressed batches of bounded size, whatever the length of a text.
2. Anchors. Each 50-byte string has an anchor: the least hash of its 20-byte substrings. Equal strings have equal
   anchors. Neighbouring strings with one anchor are a run, its text a context (at most 80 bytes). Each batch asks about
   its distinct anchors, with how many runs they have and whether in several documents; the answer names those that
   another document has, too. Strings with other anchors are found nowhere else.
3. Contexts of such anchors are cut from the batches and meet by anchor, in blocks of about 300 kB. What is shuffled is a
   row for each batch and group of blocks, so that rows don't grow with the product of batches and blocks. Those of an anchor
   that FREQUENT runs have are cut into single strings; equal ones of a batch become one entry of its smallest document,
   and they meet by their own hash, first within groups of SALT batches, then what is left of each group: nothing makes
   an unbounded group.
4. Suffix arrays. The different contexts of a block, compared as bytes, are sorted by two-stage suffix sorting; neighbours
   with a common prefix of 50 bytes are one string, and the smallest id of all its occurrences decides.
5. Spans are merged by document and cut from the text.

Hashes only bring candidates together, anchors by 32 bits within a bucket; what is removed is decided by comparing bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import discard, materialize, read
from .shingles import BYTE, mix, powers

LENGTH = 50
ANCHOR = 20
#: Runs of an anchor from which on their contexts are cut into single strings (less than 2 ** 15).
FREQUENT = 20_000
#: Anchors, and bytes of contexts, that one block holds about.
BLOCK_ANCHORS, BLOCK_BYTES = 400_000, 300_000
#: Buckets of anchors, and groups of blocks, from which on they grow instead of their number, up to so many anchors and bytes.
MANY, MOST_ANCHORS, GROUP_BYTES, MOST_BYTES = 256, 1_600_000, 4_000_000, 16_000_000
#: Bytes of text in a batch, and strings that start in a piece, at most.
BATCH_BYTES, PIECE = 2_000_000, 500_000
#: Batches whose frequent strings meet first.
SALT = 1024
#: An anchor's entry of a batch: the number of its runs below, whether several documents have it above.
_MOST, _SEVERAL = (1 << 15) - 1, 1 << 15
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
# case counts here, unlike in shingles
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * BYTE[ord("z")])


class Hashes:
    """Hashes of any substrings of an array, from a running sum of its bytes times powers of an odd base."""

    def __init__(self, data: np.ndarray):
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * powers(_BASE, len(data)), out=self.sums[1:])
        self.inverse = powers(_INVERSE, len(data) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def all_of(self, length: int) -> np.ndarray:
        return mix((self.sums[length:] - self.sums[:-length]) * self.inverse[: len(self.inverse) - length])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of all texts its text, the first and last start of its strings in the joined texts, and its anchor."""
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    if len(data) < LENGTH:
        none = np.zeros(0, dtype=np.int64)
        return none, np.zeros((0, 2), dtype=np.int64), none.astype(np.uint64)
    hashes = Hashes(data)
    width = LENGTH - ANCHOR + 1
    least = sliding_least(hashes.all_of(ANCHOR), width)
    text = np.repeat(np.arange(len(texts)), sizes)
    n = len(least)
    there = np.arange(n) + LENGTH <= np.cumsum(sizes)[text[:n]]
    new = there.copy()
    new[1:] &= (least[1:] != least[:-1]) | ~there[:-1] | (text[1:n] != text[: n - 1])
    # a run longer than its anchor alone can make it (repeated text) is cut, so that contexts stay short
    place = np.arange(n)
    since = place - np.maximum.accumulate(np.where(new, place, 0))
    new |= there & (since % width == 0)
    ends = there.copy()
    ends[:-1] &= new[1:] | ~there[1:]
    first, last = np.flatnonzero(new), np.flatnonzero(ends)
    return text[first], np.stack([first, last], axis=1), least[first]


def _pack(x: np.ndarray) -> bytes:
    return x.astype("<i8").tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x, dtype="<i8")


def suffix_order(data: np.ndarray, words: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
    """Starts of all suffixes (of those wanted at least), ordered by their first 56 bytes at least, by two-stage sorting.

    Suffixes smaller than their successor are sorted directly, by eight bytes at a time (words). All others are induced
    by one scan over the buckets of first bytes: where a suffix stands, its predecessor, if greater, comes next in the
    bucket of its first byte. Besides those wanted, the scan needs what follows them up to the next that is sorted.
    """
    n = len(data)
    changes = np.flatnonzero(data[1:] != data[:-1])
    to_change = np.searchsorted(changes, np.arange(n))
    at_end = to_change == len(changes)
    j = np.where(at_end, n - 1, np.append(changes, n - 1)[to_change])
    smaller = np.where(at_end, False, data[j] < data[np.minimum(j + 1, n - 1)])
    run = j - np.arange(n) + 1
    needed = np.ones(n, dtype=bool)
    if wanted is not None:
        ends = np.flatnonzero(wanted & ~np.append(wanted[1:], False))
        sorted_at = np.append(np.flatnonzero(smaller), n - 1)
        chain = np.zeros(n + 1, dtype=np.int64)
        np.add.at(chain, ends, 1)
        np.add.at(chain, sorted_at[np.searchsorted(sorted_at, ends)] + 1, -1)
        needed = wanted | (np.cumsum(chain[:-1]) > 0)

    order = np.flatnonzero(smaller & needed)
    order = order[np.argsort(words[order], kind="stable")]
    same = np.zeros(len(order), dtype=bool)
    if len(order):
        same[1:] = words[order[1:]] == words[order[:-1]]
    for k in range(1, 7):
        tied = same.copy()
        tied[:-1] |= same[1:]
        rows = np.flatnonzero(tied)
        if not len(rows):
            break
        group = np.cumsum(~same)[rows]
        word = words[order[rows] + 8 * k]
        by = np.lexsort((word, group))
        order[rows] = order[rows][by]
        word, group = word[by], group[by]
        same[rows[1:]] &= word[1:] == word[:-1]

    chars = np.flatnonzero(np.bincount(data, minlength=256))
    own_edges = np.searchsorted(data[order], np.arange(257))
    long_runs = np.flatnonzero(~smaller & needed & (run > 64))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(data[-1])].append(np.array([n - 1]))
    needed[-1] = True
    out = []
    for c in chars.tolist():
        level = np.concatenate(waiting[c]) if waiting[c] else np.zeros(0, dtype=np.int64)
        bucket = []
        for _ in range(64):
            if not len(level):
                break
            bucket.append(level)
            level = level[level > 0] - 1
            level = level[(data[level] == c) & needed[level]]
        bucket.append(long_runs[data[long_runs] == c])
        bucket.append(order[own_edges[c] : own_edges[c + 1]])
        sequence = np.concatenate(bucket)
        out.append(sequence)
        before = sequence[sequence > 0] - 1
        before = before[(data[before] > c) & needed[before]]
        if len(before):
            by = np.argsort(data[before], kind="stable")
            before = before[by]
            edges = np.flatnonzero(np.diff(data[before])) + 1
            for part in np.split(before, edges):
                waiting[int(data[part[0]])].append(part)
    return np.concatenate(out)


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """At each place the next eight bytes as a big-endian integer, zeros after the end; 64 places more."""
    x = np.concatenate([data, np.zeros(72, dtype=np.uint8)]).astype(np.uint64)
    for span in (1, 2, 4):
        x = (x[:-span] << np.uint64(8 * span)) | x[span:]
    return x


def common_prefix(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes a[i] and b[i], at most LENGTH."""
    length, alike = np.zeros(len(a), dtype=np.int64), np.ones(len(a), dtype=bool)
    for k in range(0, LENGTH, 8):
        differ = words[a + k] ^ words[b + k]
        # leading zero bytes, from the exponent of the highest set bit
        zeros = np.where(differ == 0, 8, 7 - (np.frexp(np.maximum(differ >> np.uint64(1), 1).astype(np.float64))[1] // 8))
        zeros = np.clip(zeros, 0, 8)
        if k + 8 > LENGTH:
            full = (differ >> np.uint64(8 * (k + 8 - LENGTH))) == 0
            length += np.where(alike, np.where(full, LENGTH - k, np.minimum(zeros, LENGTH - k - 1)), 0)
        else:
            length += np.where(alike, np.where(differ == 0, 8, np.minimum(zeros, 7)), 0)
            alike &= differ == 0
    return length


def distinct(sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different contexts among those in data: their bytes and sizes, and which of them each context is."""
    raw, ends = data.tobytes(), np.cumsum(sizes)
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(raw[a:b], len(number)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], dtype=np.int64)
    return np.frombuffer(b"".join(number), dtype=np.uint8), np.array([len(x) for x in number], dtype=np.int64), which


def smaller_elsewhere(docs: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of data whether a string starts there that a smaller document has, too; and the byte's context.

    Context i is sizes[i] bytes of document docs[i]; data holds all contexts one after the other. The suffix array holds
    each different context once; a string's smallest document is that of all occurrences of the contexts it is in.
    """
    context = np.repeat(np.arange(len(sizes)), sizes)
    if not len(data):
        return np.zeros(0, dtype=bool), context
    text, size, which = distinct(sizes, data)
    smallest = np.full(len(size), np.iinfo(np.int64).max)
    np.minimum.at(smallest, which, docs)
    least = np.full(len(text), np.iinfo(np.int64).max)
    words, of = eight_bytes(text), np.repeat(np.arange(len(size)), size)
    whole = np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size) + LENGTH <= size[of]
    order = suffix_order(text, words, whole)
    order = order[whole[order]]
    if len(order):
        new = np.ones(len(order), dtype=bool)
        new[1:] = common_prefix(words, order[1:], order[:-1]) < LENGTH
        least[order] = np.minimum.reduceat(smallest[of[order]], np.flatnonzero(new))[np.cumsum(new) - 1]
    # from the different contexts to all their occurrences
    inside = np.arange(len(data)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return least[np.repeat((np.cumsum(size) - size)[which], sizes) + inside] < docs[context], context


def repeated(docs: np.ndarray, starts: np.ndarray, sizes: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans (document, first byte, end) of contexts, which start at starts, that a string of a smaller document covers."""
    gone, context = smaller_elsewhere(docs, sizes, data)
    return _spans(gone, context, docs, starts + sizes - np.cumsum(sizes))


def _spans(gone: np.ndarray, context: np.ndarray, docs: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of marked starts of strings, within a context, as spans of bytes of its document."""
    place = np.flatnonzero(gone)
    if not len(place):
        return place, place, place
    cut = np.ones(len(place), dtype=bool)
    cut[1:] = (np.diff(place) > 1) | (context[place[1:]] != context[place[:-1]])
    a, b = place[cut], place[np.append(np.flatnonzero(cut)[1:] - 1, len(place) - 1)]
    return docs[context[a]], a + shift[context[a]], b + shift[context[a]] + LENGTH


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.RecordBatch]]:
    """Parts of sorted batches with one value of their first column at a time."""
    parts, bucket = [], None
    for b in batches:
        own = np.asarray(b.column(0))
        edges = [0, *(np.flatnonzero(np.diff(own)) + 1).tolist(), len(own)] if len(own) else []
        for i, j in pairwise(edges):
            if parts and own[i] != bucket:
                yield parts
                parts = []
            bucket = own[i]
            parts.append(b.slice(i, j - i))
    if parts:
        yield parts


def _values(parts: list[pa.RecordBatch], column: int, kind: str = "<i8") -> np.ndarray:
    """A binary column's packed integers of all rows, one after the other, without a Python object for each row."""
    found = []
    for p in parts:
        x = p.column(column).cast(pa.large_binary())
        _, offsets, data = x.buffers()
        at = np.frombuffer(offsets, dtype=np.int64)[[x.offset, x.offset + len(x)]]
        found.append(np.frombuffer(data, dtype=np.uint8)[at[0] : at[1]].tobytes() if data is not None else b"")
    return np.frombuffer(b"".join(found), dtype=kind)


def pieces(docs: DataFrame) -> DataFrame:
    """(batch, docs, offsets, sizes, n_bytes, packed): docs (doc_id, text) in compressed batches; short texts are left out.

    A piece is offsets[i] bytes into the text of docs[i], and ends 49 bytes behind its last start of a string.
    """
    schema = pa.schema([("batch", pa.int64()), ("docs", pa.binary()), ("offsets", pa.binary()), ("sizes", pa.binary()), ("n_bytes", pa.int64()), ("packed", pa.binary())])

    def row(number: int, ids: list[int], offsets: list[int], parts: list[bytes]) -> pa.RecordBatch:
        whole = b"".join(parts)
        columns = [[number], [_pack(np.array(ids))], [_pack(np.array(offsets))], [_pack(np.array([len(x) for x in parts]))], [len(whole)], [pa.Codec("zstd").compress(whole, asbytes=True)]]
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, size, ids, offsets, parts = 0, 0, [], [], []
        for b in batches:
            for part in slices(b, limit=4_000_000):
                for doc, text, task in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    raw = (text or "").encode()
                    for at in range(0, len(raw) - LENGTH + 1, PIECE):
                        parts.append(raw[at : at + PIECE + LENGTH - 1])
                        ids.append(doc)
                        offsets.append(at)
                        size += len(parts[-1])
                        if size >= BATCH_BYTES:
                            yield row((task << 31) + number, ids, offsets, parts)
                            number, size, ids, offsets, parts = number + 1, 0, [], [], []
        if parts:
            yield row((task << 31) + number, ids, offsets, parts)

    rows = docs.select("doc_id", "text", F.spark_partition_id().alias("task"))
    return rows.mapInArrow(run, "batch long, docs binary, offsets binary, sizes binary, n_bytes long, packed binary")


def _open(r: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A batch's bytes, and of each run of its pieces the document, the shift from the bytes to the text, the places and the anchor."""
    whole = pa.Codec("zstd").decompress(r["packed"], r["n_bytes"], asbytes=True)
    sizes = _unpack(r["sizes"])
    begin = np.cumsum(sizes) - sizes
    piece, place, h = [], [], []
    group = begin // PIECE
    for own in np.split(np.arange(len(sizes)), np.flatnonzero(np.diff(group)) + 1):
        t, p, x = anchors([whole[begin[i] : begin[i] + sizes[i]] for i in own.tolist()])
        piece.append(own[t])
        place.append(p + begin[own[0]])
        h.append(x)
    piece, place, h = np.concatenate(piece), np.concatenate(place), np.concatenate(h)
    return np.frombuffer(whole, dtype=np.uint8), _unpack(r["docs"])[piece], (_unpack(r["offsets"]) - begin)[piece], place[:, 0], place[:, 1], h


def _keys(h: np.ndarray, n_buckets: int) -> np.ndarray:
    """What tells anchors apart: the bucket, and 32 bits within it."""
    return ((h >> np.uint64(32)) % np.uint64(n_buckets) << np.uint64(32)) | (h & np.uint64(0xFFFFFFFF))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _ask(n_buckets: int):
    """The distinct anchors of each batch, by bucket, with their entries."""
    schema = pa.schema([("bucket", pa.int64()), ("batch", pa.int64()), ("anchors", pa.binary()), ("entries", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            _, doc, _, _, _, h = _open(r)
            key = _keys(h, n_buckets)
            by = np.argsort(key, kind="stable")
            key, doc = key[by], doc[by]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
            if not len(first):
                continue
            several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
            entry = np.minimum(np.diff(np.append(first, len(key))), _MOST) + several * _SEVERAL
            key = key[first]
            bucket = (key >> np.uint64(32)).astype(np.int64)
            edges = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(key)).tolist()
            out = [{"bucket": int(bucket[a]), "batch": r["batch"], "anchors": key[a:b].astype("<u4").tobytes(), "entries": entry[a:b].astype("<u2").tobytes()} for a, b in pairwise(edges)]
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each batch and bucket the anchors that another document has, too, and whether they are frequent; and how many runs of both kinds."""
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int64()), ("anchors", pa.binary()), ("frequent", pa.binary()), ("n_open", pa.int64()), ("n_frequent", pa.int64())])
    for parts in _groups(batches):
        anchor, entry = _values(parts, 2, "<u4"), _values(parts, 3, "<u2").astype(np.int64)
        batch, bucket = np.concatenate([np.asarray(p.column(1)) for p in parts]), parts[0].column(0)[0].as_py()
        sizes = np.concatenate([np.asarray(pa.compute.binary_length(p.column(3))) for p in parts]) // 2
        of = np.repeat(np.arange(len(batch)), sizes)
        by = np.argsort(anchor, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], anchor[by[1:]] != anchor[by[:-1]]]))
        n = np.diff(np.append(first, len(by)))
        shared = np.empty(len(by), dtype=bool)
        shared[by] = np.repeat((n > 1) | (np.maximum.reduceat(entry[by], first) >= _SEVERAL), n)
        runs = entry & _MOST
        frequent = np.empty(len(by), dtype=bool)
        frequent[by] = np.repeat(np.add.reduceat(runs[by], first) >= FREQUENT, n)
        out = []
        at = np.flatnonzero(shared)
        for part in np.split(at, np.flatnonzero(np.diff(of[at])) + 1) if len(at) else []:
            often = frequent[part]
            out.append({"batch": int(batch[of[part[0]]]), "bucket": bucket, "anchors": anchor[part].tobytes(), "frequent": often.astype(np.uint8).tobytes(), "n_open": int(runs[part][~often].sum()), "n_frequent": int(runs[part][often].sum())})
        yield pa.RecordBatch.from_pylist(out, schema)


def _ranges(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """begin[i] and the n[i] - 1 integers after it, for each i."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _few(whole: int, small: int, large: int) -> int:
    """Into how many parts of small size whole goes, if they are at most MANY; else MANY, or parts of large size."""
    return max(1, min(whole // small, MANY), whole // large)


def _cut_contexts(n_buckets: int, n_blocks: int, n_groups: int, n_salts: int):
    """The contexts of each batch's shared anchors, packed by the group of the block in which they meet; and spans of frequent strings
    that a smaller document of the batch has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            data, doc, shift, first, last, h = _open(r)
            asked = np.concatenate([np.frombuffer(x["anchors"], dtype="<u4").astype(np.uint64) | np.uint64(x["bucket"] << 32) for x in r["answers"]])
            often = np.concatenate([np.frombuffer(x["frequent"], dtype=np.uint8) for x in r["answers"]])
            by = np.argsort(asked)
            asked, often = asked[by], often[by]
            key = _keys(h, n_buckets)
            at = np.minimum(np.searchsorted(asked, key), len(asked) - 1)
            shared = asked[at] == key
            rows = np.flatnonzero(shared & (often[at] == 0))
            out = _by_block(data, first[rows], last[rows] - first[rows] + LENGTH, doc[rows], first[rows] + shift[rows], (h[rows] % np.uint64(n_blocks)).astype(np.int64), n_groups)
            rows = np.flatnonzero(shared & (often[at] == 1))
            if len(rows):
                n = last[rows] - first[rows] + 1
                single = np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
                own, start = np.repeat(doc[rows], n), single + np.repeat(shift[rows], n)
                hashed = Hashes(data)(single, single + LENGTH)
                salt = int(mix(np.array([r["batch"]], dtype=np.uint64))[0] % np.uint64(n_salts))
                block = (hashed % np.uint64(n_blocks)).astype(np.int64)
                meet = -1 - (block % n_groups * n_salts + salt)
                for part in _parts(hashed, 50_000):
                    text = np.ascontiguousarray(data[single[part][:, None] + np.arange(LENGTH)])
                    spans, entries = _equal_strings(text, own[part], start[part])
                    out += _by_hash(text.tobytes(), entries, meet[part], block[part])
                    if len(spans):
                        out.append({"bucket": r["batch"] % n_groups, "spans": _pack(spans)})
            yield pa.RecordBatch.from_pylist(out, _CONTEXTS)

    return run


_CONTEXTS = pa.schema([("bucket", pa.int64()), ("docs", pa.binary()), ("starts", pa.binary()), ("sizes", pa.binary()), ("data", pa.binary()), ("spans", pa.binary()), ("blocks", pa.binary())])
_CONTEXTS_SQL = "bucket long, docs binary, starts binary, sizes binary, data binary, spans binary, blocks binary"


def _merged(doc: np.ndarray, start: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, first byte, end) of strings whose starts ascend within a group, those that overlap or touch as one; and
    which string opens each."""
    cut = np.flatnonzero(np.concatenate([[True], (np.diff(start) > LENGTH) | (np.diff(doc) != 0) | (np.diff(group) != 0)])[: len(start)])
    ends = np.append(cut[1:] - 1, len(start) - 1)[: len(cut)]
    return np.stack([doc[cut], start[cut], start[ends] + LENGTH], axis=1), cut


def _equal_strings(text: np.ndarray, docs: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Strings (rows of LENGTH bytes), compared as a whole: spans (document, first byte, end) of those that a smaller
    document has; and an entry for each different string with the spans of its smallest document.

    Entries: at (a row that is the string), docs, counts (of spans) and spans (first byte, end).
    """
    string = np.unique(text.view(f"V{LENGTH}").ravel(), return_inverse=True)[1].ravel()
    by = np.lexsort((starts, docs, string))
    string, docs, starts = string[by], docs[by], starts[by]
    new = np.flatnonzero(np.concatenate([[True], np.diff(string) != 0]))
    least = docs == docs[new][string]
    spans, _ = _merged(docs[~least], starts[~least], string[~least])
    own, opens = _merged(docs[least], starts[least], string[least])
    return spans, {"at": by[new], "docs": docs[new], "counts": np.bincount(string[least][opens], minlength=len(new)), "spans": own[:, 1:]}


def _by_hash(data: bytes, entries: dict[str, np.ndarray], bucket: np.ndarray, block: np.ndarray) -> list[dict]:
    """Entries of single strings packed by the bucket in which they meet."""
    text = np.frombuffer(data, dtype=np.uint8).reshape(-1, LENGTH)[entries["at"]]
    bucket, block, counts = bucket[entries["at"]], block[entries["at"]], entries["counts"]
    by = np.argsort(bucket, kind="stable")
    begin, out = np.cumsum(counts) - counts, []
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        n = counts[part]
        out.append({"bucket": int(bucket[part[0]]), "docs": _pack(entries["docs"][part]), "starts": _pack(entries["spans"][_ranges(begin[part], n)]), "sizes": _pack(n), "data": text[part].tobytes(), "blocks": block[part].astype("<u4").tobytes()})
    return out


def _parts(hashed: np.ndarray, size: int) -> list[np.ndarray]:
    """All entries in parts of about size, equal hashes together."""
    part = (hashed >> np.uint64(40)) % np.uint64(-(-len(hashed) // size))
    by = np.argsort(part, kind="stable")
    return np.split(by, np.flatnonzero(np.diff(part[by])) + 1)


def _by_block(data: np.ndarray, first: np.ndarray, size: np.ndarray, doc: np.ndarray, start: np.ndarray, block: np.ndarray, n_groups: int) -> list[dict]:
    """Contexts packed by the group of the block in which they meet."""
    bucket = block % n_groups
    by = np.lexsort((block, bucket))
    out = []
    for part in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1) if len(by) else []:
        n = size[part]
        out.append({"bucket": int(bucket[part[0]]), "docs": _pack(doc[part]), "starts": _pack(start[part]), "sizes": _pack(n), "data": data[_ranges(first[part], n)].tobytes(), "blocks": block[part].astype("<u4").tobytes()})
    return out


def _sort_blocks(n_salts: int):
    """(doc_id, a, b): spans of bytes to remove, from what meets in one block at a time: contexts, or single strings. A bucket has
    the blocks of a group.

    Of single strings that met within groups of batches, those that no smaller document has there go on to meet those of
    other groups of batches (bucket, docs, starts, sizes, data, blocks).
    """
    names = ["doc_id", "a", "b", "bucket", "docs", "starts", "sizes", "data", "blocks"]
    kinds = [pa.int64()] * 4 + [pa.binary()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for parts in _groups(batches):
            found, rest = [_values(parts, 5).reshape(-1, 3)], []
            docs, starts, sizes, data, bucket = _values(parts, 1), _values(parts, 2), _values(parts, 3), _values(parts, 4, "u1"), parts[0].column(0)[0].as_py()
            block, width = _values(parts, 6, "<u4"), sizes if bucket >= 0 else np.full(len(docs), LENGTH)
            begin, gone = np.cumsum(width) - width, np.zeros(len(docs), dtype=bool)
            by = np.argsort(block, kind="stable")
            for own in np.split(by, np.flatnonzero(np.diff(block[by])) + 1) if len(by) else []:
                text = data[_ranges(begin[own], width[own])]
                if bucket >= 0:
                    found.append(np.stack(repeated(docs[own], starts[own], sizes[own], text), axis=1))
                else:
                    gone[own] = smaller_elsewhere(docs[own], width[own], text)[0][::LENGTH]
            if bucket < 0:
                spans, hit = starts.reshape(-1, 2), np.repeat(gone, sizes)
                found.append(np.column_stack([np.repeat(docs, sizes)[hit], spans[hit]]))
                if n_salts > 1:
                    left = np.flatnonzero(~gone)
                    entries = {"at": left, "docs": docs[left], "counts": sizes[left], "spans": spans[~hit]}
                    rest = _by_hash(data.tobytes(), entries, np.full(len(docs), -1 - (-1 - bucket) // n_salts), block)
            spans = np.concatenate(found).T
            columns = [pa.array(np.ascontiguousarray(x)) for x in spans] + [pa.nulls(spans.shape[1], k) for k in kinds[3:]]
            yield pa.RecordBatch.from_arrays(columns, names=names)
            if rest:
                yield pa.RecordBatch.from_arrays([pa.nulls(len(rest), k) for k in kinds[:3]] + [pa.array([x[c] for x in rest], k) for c, k in zip(names[3:], kinds[3:], strict=True)], names=names)

    return run


_FOUND_SQL = "doc_id long, a long, b long, bucket long, docs binary, starts binary, sizes binary, data binary, blocks binary"


def repeated_spans(docs: DataFrame) -> list[DataFrame]:
    """(doc_id, a, b) of docs (doc_id, text; no null ids), in several tables: spans to remove, which may overlap or touch."""
    batches = materialize(pieces(docs), "batches")
    n_bytes, n_batches = batches.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.count(F.lit(1))).first()
    n_buckets = _few(n_bytes, 17 * BLOCK_ANCHORS, 17 * MOST_ANCHORS)
    asked = batches.mapInArrow(_ask(n_buckets), "bucket long, batch long, anchors binary, entries binary")
    answers = materialize(asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, "batch long, bucket long, anchors binary, frequent binary, n_open long, n_frequent long"), "answers")
    n_open, n_frequent = answers.agg(F.coalesce(F.sum("n_open"), F.lit(0)), F.coalesce(F.sum("n_frequent"), F.lit(0))).first()
    n_met = 67 * n_open + 17 * LENGTH * n_frequent // 4
    n_blocks, n_groups, n_salts = max(1, n_met // BLOCK_BYTES), _few(n_met, GROUP_BYTES, MOST_BYTES), max(1, -(-n_batches // SALT))
    own = answers.groupBy("batch").agg(F.collect_list(F.struct("bucket", "anchors", "frequent")).alias("answers"))
    contexts = batches.join(own.hint("shuffle_hash"), "batch").mapInArrow(_cut_contexts(n_buckets, n_blocks, n_groups, n_salts), _CONTEXTS_SQL)
    found = materialize(contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_blocks(n_salts), _FOUND_SQL), "spans")
    discard(batches)
    discard(answers)
    spans = [found.where("doc_id is not null").select("doc_id", "a", "b")]
    if n_salts > 1:
        rest = found.where("doc_id is null").select("bucket", "docs", "starts", "sizes", "data", F.lit(None).cast("binary").alias("spans"), "blocks")
        spans.append(materialize(rest.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_sort_blocks(1), _FOUND_SQL), "spans").select("doc_id", "a", "b"))
    return spans


def squeeze(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) as (doc_id, n_bytes, packed), the text's bytes compressed, for a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            for part in slices(b):
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array([codec.compress(t, asbytes=True) for t in raw], pa.binary())], names=["doc_id", "n_bytes", "packed"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, packed binary")


def without(raw: bytes, a: np.ndarray, b: np.ndarray) -> tuple[bytes, int, int]:
    """raw without spans that may overlap, touch or end behind it; how many bytes and how many maximal runs go."""
    a, b = a[a < len(raw)], np.minimum(b, len(raw))[a < len(raw)]
    if not len(a):
        return raw, 0, 0
    by = np.argsort(a, kind="stable")
    a, b = a[by], np.maximum.accumulate(b[by])
    cut = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
    first, last = a[cut], b[np.append(cut[1:] - 1, len(b) - 1)]
    kept = [raw[x:y] for x, y in zip([0, *last.tolist()], [*first.tolist(), len(raw)], strict=True)]
    return b"".join(kept), int((last - first).sum()), len(first)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept binary) of each row.

    A text is its UTF-8 bytes (null: empty). Strings are judged on the input. Rows that repeat an id are one document:
    each loses what any of them has in common with a smaller id, at the same places. Rows with a null id are left whole
    and remove nothing. An empty table gives none; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    spans = reduce(DataFrame.unionAll, repeated_spans(texts.where("doc_id is not null")))
    spans = spans.groupBy("doc_id").agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for b in batches:
            for part in slices(b, 2, 700_000):
                out = []
                ends = [part.column(k) for k in (3, 4)]
                for i, (doc, n, packed) in enumerate(zip(*(part.column(k).to_pylist() for k in range(3)), strict=True)):
                    raw = codec.decompress(packed, n, asbytes=True)
                    own = [np.asarray(x[i].values) if x[i].is_valid else np.zeros(0, dtype=np.int64) for x in ends]
                    rest, removed, runs = without(raw, *own)
                    out.append((doc, n, removed, runs, hashlib.sha256(rest).hexdigest(), rest))
                columns = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.int64()] * 4 + [pa.string(), pa.binary()], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return squeeze(texts).join(spans, "doc_id", "left").select("doc_id", "n_bytes", "packed", "a", "b").mapInArrow(run, schema)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")
