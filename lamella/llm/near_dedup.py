"""MinHash near-dedup with odd sketches.

Texts with the same shingle set are one class, represented by their smallest id. Banded MinHash buckets give candidate
pairs, odd sketches (MinHash samples folded into a parity bitmap, compared by XOR and population count) drop those
that are clearly too different, and the full shingle sets confirm the rest.

A bucket doesn't give all its pairs: each member is compared with the bucket's smallest first. Only members that are
then still in different components are compared with one another, by their sketches, in blocks of bounded size. Components
are found by star contraction over tables in the shared folder; links and components never come to the driver.

A pair at the threshold of 0.8 shares none of the 32 bands of 4 with a probability of 5e-8; the sketch filter is 8
standard deviations wide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import HOT_SHARE, discard, join_by_key, materialize, read
from .shingles import mix, shingle_sets

BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: An odd sketch is so many 64-bit integers.
SKETCH = 8
#: Members of a block in which a bucket's members are compared.
BLOCK = 4096
#: Pairs of one document that are confirmed together, about.
PARTNERS = 500
#: Documents, and characters of their texts, that a tile holds about.
TILE, TILE_CHARS = 512, 4_000_000
_rng = np.random.default_rng(7)
_A = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """SAMPLES minima of a set that isn't empty."""
    best = np.full(SAMPLES, 2**64 - 1, dtype=np.uint64)
    for i in range(0, len(shingles), 2048):
        np.minimum(best, (shingles[i : i + 2048, None] * _A + _B).min(axis=0), out=best)
    return best


def bands(samples: np.ndarray) -> np.ndarray:
    """Keys of the bands, different for different bands."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in samples.reshape(BANDS, ROWS).T:
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + column)
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """SKETCH integers whose bit b is the parity of the samples that fall on b."""
    at = mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) % np.uint64(64 * SKETCH)
    parity = (np.bincount(at.astype(np.int64), minlength=64 * SKETCH) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.int64)


def most_bits(threshold: float, deviations: float = 8.0) -> int:
    """The most differing bits of two odd sketches at which their sets may still be alike enough."""
    differ = min(SAMPLES, SAMPLES * (1 - threshold) + deviations * math.sqrt(SAMPLES * threshold * (1 - threshold)))
    bits = 64 * SKETCH
    mean = bits / 2 * (1 - (1 - 2 / bits) ** (2 * differ))
    return math.ceil(mean + deviations * math.sqrt(bits) / 8)


def estimate(bits: int) -> float:
    """The similarity that so many differing bits of two odd sketches speak for."""
    n = 64 * SKETCH
    return 1 + n / (4 * SAMPLES) * math.log(max(1e-9, 1 - 2 * bits / n))


def features(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, digest, bands, s0..s7) of each row; the last three null for a text without words."""
    names = ["doc_id", "n_shingles", "digest", "bands", *(f"s{i}" for i in range(SKETCH))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, limit=2_000_000):
                n, digest, keys, sketch = [], [], [], []
                for s in shingle_sets([(t or "").encode() for t in part.column(1).to_pylist()], width):
                    n.append(len(s))
                    if not len(s):
                        digest.append(None)
                        keys.append(None)
                        sketch.append([None] * SKETCH)
                        continue
                    samples = minhash(s)
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    keys.append(bands(samples))
                    sketch.append(odd_sketch(samples).tolist())
                columns = [part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x, pa.int64()) for x in zip(*sketch, strict=True))], names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_shingles long, digest binary, bands array<long>, " + ", ".join(f"s{i} long" for i in range(SKETCH)))


def _differing() -> Column:
    """How many bits of the sketches as0.. and bs0.. differ."""
    return reduce(Column.__add__, (F.bit_count(F.col(f"as{i}").bitwiseXOR(F.col(f"bs{i}"))) for i in range(SKETCH)))


def _keyed(batches: Iterator[pa.RecordBatch], n_keys: int, limit: int = 4096) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Sorted batches cut where the first n_keys columns change, with these columns' values."""
    for b in batches:
        for at in range(0, b.num_rows, limit):
            part = b.slice(at, limit)
            keys = list(zip(*(part.column(k).to_pylist() for k in range(n_keys)), strict=True))
            begin = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[begin]:
                    yield keys[begin], part.slice(begin, i - begin)
                    begin = i


def confirm(pairs: DataFrame, texts: DataFrame, width: int, threshold: float) -> DataFrame:
    """The pairs (u, v) whose full shingle sets are alike enough; texts: (doc_id, text). Materialized.

    100 * intersection >= 100 * threshold * union, in integers. The pairs of a u are cut into groups of about PARTNERS; the
    text of u comes once a group, before the texts of its partners, so no u is too frequent.
    """
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: np.ndarray | None = None
        for b in batches:
            for part in slices(b, 3, 2_000_000):
                u, v = (part.column(k).to_pylist() for k in (0, 2))
                good = []
                for i, y in enumerate(shingle_sets([(t or "").encode() for t in part.column(3).to_pylist()], width)):
                    if v[i] is None:
                        own = y
                        continue
                    x = own
                    both = len(np.intersect1d(x, y, assume_unique=True)) if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) else 0
                    if both > 0 and 100 * both >= percent * (len(x) + len(y) - both):
                        good.append((u[i], v[i]))
                yield pa.RecordBatch.from_arrays([pa.array([g[k] for g in good], pa.int64()) for k in (0, 1)], names=["u", "v"])

    groups = F.ceil(F.col("n") / PARTNERS).cast("int")
    sizes = pairs.groupBy("u").agg(F.count(F.lit(1)).alias("n")).select("u", groups.alias("groups"))
    heads = sizes.select("u", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.lit(None).cast("long").alias("v"), F.col("u").alias("doc_id"))
    # a u with very many pairs: the number of its groups is a small row
    partners = join_by_key(pairs, sizes, ["u"]).select("u", F.pmod(F.xxhash64("v"), F.col("groups")).cast("int").alias("part"), "v", F.col("v").alias("doc_id"))
    # all texts go through one shuffle, in the same way at every size
    needed = heads.unionAll(partners).join(texts.select("doc_id", "text").hint("merge"), "doc_id").select("u", "part", "v", "text")
    rows = needed.repartition("u", "part").sortWithinPartitions("u", "part", F.asc_nulls_first("v"))
    return materialize(rows.mapInArrow(run, "u long, v long"), "links")


class _Sets:
    """Shingle sets of documents, for the exact likeness of many pairs of them."""

    def __init__(self, ids: list[int], sets: list[np.ndarray]):
        last = {d: k for k, d in enumerate(ids)}
        self.ids = np.array(sorted(last), dtype=np.int64)
        sets = [sets[last[d]] for d in self.ids.tolist()]
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        different, number = np.unique(np.concatenate(sets), return_inverse=True)
        self.members = np.split(number.astype(np.int32), np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(len(different), dtype=bool)

    def alike(self, u: np.ndarray, v: np.ndarray, percent: int) -> np.ndarray:
        """Whether 100 * intersection >= percent * union, of each pair."""
        x, y = np.searchsorted(self.ids, u), np.searchsorted(self.ids, v)
        good = np.zeros(len(u), dtype=bool)
        near = np.flatnonzero(100 * np.minimum(self.sizes[x], self.sizes[y]) >= percent * np.maximum(self.sizes[x], self.sizes[y]))
        near = near[np.argsort(x[near], kind="stable")]
        for pairs in np.split(near, np.flatnonzero(np.diff(x[near])) + 1) if len(near) else []:
            own, n = self.members[x[pairs[0]]], self.sizes[y[pairs]]
            self.mark[own] = True
            both = np.add.reduceat(self.mark[np.concatenate([self.members[k] for k in y[pairs].tolist()])], np.cumsum(n) - n, dtype=np.int64)
            self.mark[own] = False
            good[pairs] = (both > 0) & (100 * both >= percent * (len(own) + n - both))
        return good


def tiled(pairs: DataFrame, texts: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """pairs (u, v) with the two tiles (a, b) they are in; and (a, b, doc_id): the documents of both that have pairs there.

    groups: (doc_id, g); which documents have one g matters for the number of rows only.
    """
    sizes = materialize(texts.select("doc_id", F.length("text").alias("chars")).join(groups, "doc_id"), "sizes")
    n = F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum("chars") / TILE_CHARS)).cast("int")
    placed = join_by_key(sizes, sizes.groupBy("g").agg(n.alias("n")), ["g"])
    placed = materialize(placed.select("doc_id", F.xxhash64("g", F.pmod(F.xxhash64("doc_id"), F.col("n"))).alias("tile")).groupBy("doc_id").agg(F.min("tile").alias("tile")), "tiles")
    of = lambda name, tile: placed.select(F.col("doc_id").alias(name), F.col("tile").alias(tile))
    met = pairs.join(of("u", "tu"), "u").join(of("v", "tv"), "v")
    met = materialize(met.select(F.least("tu", "tv").alias("a"), F.greatest("tu", "tv").alias("b"), "u", "v"), "met")
    needed = met.select("a", "b", F.col("u").alias("doc_id")).unionAll(met.select("a", "b", "v")).distinct()
    return met, needed


def confirm_in_tiles(pairs: DataFrame, texts: DataFrame, groups: DataFrame, width: int, threshold: float) -> DataFrame:
    """What confirm() gives, where documents of the same groups have very many pairs with one another. Materialized.

    Groups (doc_id, g) are cut into tiles. For each two tiles their texts come once, before the pairs of their documents,
    so what is shuffled grows with the documents and not, as the pairs, with their square.
    """
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, ids, sets, index = None, [], [], None
        for b in batches:
            for part in slices(b, 4, 2_000_000):
                for key, own in _keyed(iter([part]), 2):
                    if key != before:
                        before, ids, sets, index = key, [], [], None
                    n = own.column(3).null_count
                    ids += own.column(2)[:n].to_pylist()
                    sets += shingle_sets([(t or "").encode() for t in own.column(4)[:n].to_pylist()], width)
                    if n < own.num_rows:
                        index = index or _Sets(ids, sets)
                        u, v = np.asarray(own.column(2)[n:]), np.asarray(own.column(3)[n:])
                        good = index.alike(v, u, percent)  # sorted by v
                        yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], names=["u", "v"])

    met, needed = tiled(pairs, texts, groups)
    rows = needed.join(texts.select("doc_id", "text").hint("merge"), "doc_id").select("a", "b", F.col("doc_id").alias("u"), F.lit(None).cast("long").alias("v"), "text")
    rows = rows.unionAll(met.select("a", "b", "u", "v", F.lit(None).cast("string").alias("text")))
    return materialize(rows.repartition("a", "b").sortWithinPartitions("a", "b", F.asc_nulls_first("v")).mapInArrow(run, "u long, v long"), "links")


def _tie(rows: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """rows (a, b) with m of least (a, m, n; materialized), where some ids may have a large share of all rows."""
    return join_by_key(rows, least.select("a", "m"), ["a"], hot=least.where(F.col("n") >= max(1000, total * HOT_SHARE)).select("a"))


def _open_ends(edges: DataFrame) -> tuple[int, int]:
    """How many edges (a, b), b < a, there are; and how many a have several b, or are a b themselves: none if all are stars."""
    ends = edges.select(F.col("a").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return tuple(ends.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count_if((F.col("up") > 1) | ((F.col("up") == 1) & (F.col("down") == 1)))).first())


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over links (u, v), for each id in links.

    Large-star and small-star by turns: each id's neighbours are tied to its smallest neighbour, until there are
    only stars; about log2(longest path) rounds, each over as many rows as there are links.
    """
    sides = links.where("u <> v")
    edges = materialize(sides.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "edges")
    while True:
        total, open_ends = _open_ends(edges)
        if not open_ends:
            break
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("n")), "least")
        large = materialize(_tie(both, least, 2 * total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "large")
        small = materialize(large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")), "small")
        tied = _tie(large, small, total).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new = materialize(tied.unionAll(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
        for table in (edges, least, large, small):
            discard(table)
        edges = new
    # all edges are stars now
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _near_in_blocks(rows: DataFrame, bits: list[str], most: int) -> DataFrame:
    """(u, v): members of different components in a pair of blocks whose sketches differ in few bits.

    rows: key, i, j (two blocks of a bucket), own (which of both), rep, c (component) and the sketch.
    """
    columns = ["key", "i", "j", "own", "rep", "c", *bits]

    def near(group: list[pa.RecordBatch]) -> pa.RecordBatch:
        own, rep, c, *sketch = (np.concatenate([np.asarray(g.column(k)) for g in group]) for k in range(3, len(columns)))
        sketch, i = np.stack(sketch, axis=1).view(np.uint64), group[0].column(1)[0].as_py()
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own != i) if (own != i).any() else left
        if group[0].column(2)[0].as_py() != i and right is left:
            right = left[:0]
        out = [np.zeros((0, 2), dtype=np.int64)]
        step = max(1, 1_000_000 // (8 * max(1, len(right))))
        for at in range(0, len(left), step):
            rows = left[at : at + step]
            close = np.bitwise_count(sketch[rows][:, None] ^ sketch[right][None]).sum(axis=2, dtype=np.int64) <= most
            x, y = np.nonzero(close & (c[rows][:, None] != c[right][None]))
            out.append(np.stack([np.minimum(rep[rows[x]], rep[right[y]]), np.maximum(rep[rows[x]], rep[right[y]])], axis=1))
        pairs = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, group = None, []
        for key, part in _keyed(batches, 3):
            if key != before and group:
                yield near(group)
                group = []
            before = key
            group.append(part)
        if group:
            yield near(group)

    return rows.select(*columns).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "u long, v long").distinct()


def link(reps: DataFrame, docs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(id, component) of the representatives that have links; reps: (rep, bands, s0..s7), docs: (doc_id, text)."""
    bits = [f"s{i}" for i in range(SKETCH)]
    sketches = reps.select("rep", *bits)
    members = reps.select("rep", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("rep").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = materialize(buckets, "buckets")
    hot = materialize(buckets.where(F.col("n") >= max(1000, reps.count() * BANDS * HOT_SHARE)).select("key"), "hot")
    members = materialize(join_by_key(members, buckets, ["key"], hot=hot), "members")

    pairs = materialize(members.where("rep <> leader").select(F.col("leader").alias("u"), F.col("rep").alias("v")).distinct(), "pairs")
    of = lambda name, side: reps.select(F.col("rep").alias(name), *[F.col(c).alias(f"{side}{c}") for c in bits])
    near = join_by_key(pairs, of("u", "a"), ["u"]).join(of("v", "b"), "v").where(_differing() <= most_bits(threshold))
    tested = materialize(near.select("u", "v"), "pairs")
    # texts that share a bucket with another go through one shuffle, in the same way at every size
    shared = members.select(F.col("rep").alias("doc_id")).distinct()
    texts = materialize(docs.join(shared.hint("merge"), "doc_id", "left_semi"), "texts")
    links = confirm(tested, texts, width, threshold)
    found = materialize(components(links), "components")

    # members of a bucket that are not in one component yet: compared with one another, a block with a block at a time
    state = members.where("n > 2").join(found, F.col("rep") == F.col("id"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c"))
    state = materialize(state, "state")
    apart = state.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("key")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    near = materialize(join_by_key(state, apart, ["key"], "left_semi", hot), "apart")
    rows = near.join(sketches, "rep").withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    rows = rows.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "c", *bits)
    more = materialize(_near_in_blocks(rows, bits, most_bits(threshold)).join(tested, ["u", "v"], "left_anti"), "pairs")
    if not more.isEmpty():
        # in a large bucket pairs grow with the square of its members: texts come by tiles of them
        # of a member's buckets, and of those of the members it meets there, the largest names its group
        own = near.groupBy("rep").agg(F.max(F.struct("n", "key")).alias("most"))
        met = near.select("rep", "key").join(own, "rep").groupBy("key").agg(F.max("most").alias("most"))
        groups = join_by_key(near.select("rep", "key"), met, ["key"], hot=hot).groupBy(F.col("rep").alias("doc_id")).agg(F.max("most").alias("most"))
        groups = groups.select("doc_id", F.col("most.key").alias("g"))
        found = components(links.unionAll(confirm_in_tiles(more, texts, groups, width, threshold)))
    discard(texts)
    return found


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each row of docs.

    Words are lower-cased (A-Z) runs without ASCII white space; a text with fewer than width words is one shingle. Texts
    without words, null or empty, and rows with a null id are linked with nothing. Rows that repeat an id and its text
    are kept or not together (deduplicate() leaves one of them). An empty table gives none; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = materialize(features(texts, width), "features")
    payload = F.struct("doc_id", "bands", *(f"s{i}" for i in range(SKETCH)))
    reps = found.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min(payload).alias("r"))
    reps = materialize(reps.select("digest", F.col("r.doc_id").alias("rep"), "r.bands", *(f"r.s{i}" for i in range(SKETCH))), "classes")
    linked = link(reps, texts, width, threshold)

    whole = reps.select("digest", "rep").join(linked, F.col("rep") == F.col("id"), "left").select("digest", F.coalesce("component", "rep").alias("component"))
    rows = join_by_key(found.where("digest is not null").select("doc_id", "n_shingles", "digest"), whole, ["digest"], "left").select("doc_id", "n_shingles", "component")
    rows = rows.unionAll(found.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component")))
    component = F.when(F.col("doc_id").isNotNull(), F.col("component"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, width: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs (doc_id, text, ...) with exactly one row of each component: of its smallest id, null after all others.

    Of rows that repeat an id and its text (equal, or null id and equal text) the one with the least hash of all its
    columns stays. Rows without words, null or empty texts, are in no component: all of them stay.
    """
    names = docs.columns
    digest = F.xxhash64("text")
    # rows without an id get one by their text, above any that is there
    key = F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(digest, 2).bitwiseOR(F.lit(1 << 62)))
    rows = docs.select(F.struct(*names).alias("_row"), key.alias("_key"), digest.alias("_digest"), F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False)).alias("_words"))
    found = near_duplicates(rows.select(F.col("_key").alias("doc_id"), F.col("_row.text").alias("text")), width, threshold)
    drop = found.where(~F.col("kept")).select(F.col("doc_id").alias("_key")).distinct()
    again = materialize(rows.where("_words").groupBy("_key", "_digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_key", "_digest"), "repeated")
    rows = rows.join(drop.hint("merge"), "_key", "left_anti")
    if again.isEmpty():
        return rows.select("_row.*")
    # neither side is shuffled by a key that repeats: copies of a row are brought down to one in each task first
    single = rows.join(again, ["_key", "_digest"], "left_anti").select("_row")
    best = rows.where("_words").join(again, ["_key", "_digest"], "left_semi").groupBy("_key", "_digest").agg(F.min_by("_row", F.xxhash64("_row")).alias("_row")).select("_row")
    return single.unionAll(best).select("_row.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-word shingles, as the contract says; in the pipeline they have five words."""
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)
