"""Mixing sources to target weights by a min-cost flow from membership patterns to source quotas.

Documents are aggregated by the set of sources they belong to. The flow routes each pattern's words to the quotas of its
sources; further copies cost more and more. Sources that share no document with another need no network: all of such a
source's target flows from its one pattern, so they stay a table, however many there are. Only the patterns and sources
of documents that belong to several come to the driver. Documents of a pattern are then taken in a seeded order up to the
pattern's flow: an exact cut in that order is found from a histogram of hash ranges and the rows of the one range that
holds it.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import HOT_SHARE, join_by_key, let, materialize, numbered, read, words

MAX_COPIES = 3
#: Hash ranges of a pattern's histogram.
RANGES = 4096


def default_weight(position: Column) -> Column:
    return (position % 3 + 1).cast("double")


def fill_targets(sizes: Sequence[int], weights: Sequence[float], copies: int = MAX_COPIES) -> list[float]:
    """Shares of sum(sizes) by weight, none above copies times its size; the excess is shared again by weight."""
    targets, free, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(sum(sizes))
    while free and left > 0:
        total = sum(weights[i] for i in free)
        full = [i for i in free if left * weights[i] / total > copies * sizes[i]]
        if not full:
            for i in free:
                targets[i] = left * weights[i] / total
            break
        for i in full:
            targets[i] = float(copies * sizes[i])
        left -= sum(targets[i] for i in full)
        free = [i for i in free if i not in set(full)]
    return targets


def min_cost_flow(supply: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], costs: Sequence[int] = (0, 1, 3)) -> list[dict[int, int]]:
    """Words from each pattern to each of its sources.

    A pattern can send its supply once at costs[0] a word, again at costs[1] and so on (convex); a source takes at
    most its quota. Successive shortest paths with potentials; of the largest flows, the cheapest.
    """
    n_p, n_s = len(supply), len(quotas)
    source, sink = n_p + n_s, n_p + n_s + 1
    graph: list[list[int]] = [[] for _ in range(n_p + n_s + 2)]
    to, room, cost = [], [], []

    def edge(a: int, b: int, cap: int, c: int) -> int:
        for x, y, k, w in ((a, b, cap, c), (b, a, 0, -c)):
            graph[x].append(len(to))
            to.append(y)
            room.append(k)
            cost.append(w)
        return len(to) - 2

    routes = []
    for p in range(n_p):
        for c in costs:
            edge(source, p, supply[p], c)
        routes.append({s: edge(p, n_p + s, len(costs) * supply[p], 0) for s in members[p]})
    for s in range(n_s):
        edge(n_p + s, sink, quotas[s], 0)
    potential = [0] * len(graph)
    while True:
        dist: list[float] = [float("inf")] * len(graph)
        dist[source], came, queue = 0, [-1] * len(graph), [(0, source)]
        while queue:
            d, x = heapq.heappop(queue)
            if d > dist[x]:
                continue
            for e in graph[x]:
                if room[e] > 0 and (nd := d + cost[e] + potential[x] - potential[to[e]]) < dist[to[e]]:
                    dist[to[e]], came[to[e]] = nd, e
                    heapq.heappush(queue, (nd, to[e]))
        if came[sink] < 0:
            return [{s: room[e ^ 1] for s, e in r.items()} for r in routes]
        potential = [p + int(d) if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
        path, x = [], sink
        while x != source:
            path.append(came[x])
            x = to[came[x] ^ 1]
        flow = min(room[e] for e in path)
        for e in path:
            room[e] -= flow
            room[e ^ 1] += flow


def _order(id_col: str, seed: int) -> tuple[Column, Column]:
    """The seeded place of a document among those of its pattern, and the hash range it is in."""
    order = F.xxhash64(F.col(id_col), F.lit(seed))
    return order, F.shiftrightunsigned(order, 64 - RANGES.bit_length() + 1).cast("int")


def source_targets(sources: DataFrame, total: int, weight: Callable[[Column], Column] = default_weight) -> DataFrame:
    """sources (source, size) with target: what fill_targets() gives, for any number of sources. Materialized.

    A source is full at MAX_COPIES times its size if the others' level, words a unit of weight, is above that. The level
    rises as sources fill up; each round is one aggregate, and few are needed. Where sources overlap, so that their sizes
    add up to more than total, targets shrink alike.
    """
    rows = numbered(sources, "source", "_position").withColumn("_weight", F.when(F.col("size") > 0, weight(F.col("_position"))).otherwise(0.0))
    rows = materialize(rows, "sources")
    most, level = MAX_COPIES * F.col("size"), 0.0
    whole = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    while True:
        free = F.lit(level) * F.col("_weight") <= most
        capped, weights = rows.agg(F.coalesce(F.sum(F.when(~free, most)), F.lit(0)), F.coalesce(F.sum(F.when(free, F.col("_weight"))), F.lit(0.0))).first()
        if weights <= 0 or (risen := (whole - capped) / weights) <= level:
            break
        level = risen
    target = F.least(F.lit(level) * F.col("_weight"), most.cast("double")) * (total / whole if whole else 0.0)
    return rows.select("source", "size", target.alias("target"))


def plan_mix(docs: DataFrame, sources: Column, *, weight: Callable[[Column], Column] = default_weight, seed: int = 0, max_patterns: int = 10_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Sizes of all rows (doc_id, pattern, size), and what to take of each pattern; both materialized.

    sources: an array of the sources of a row (an element may be null: a source of its own, after all others). Per
    pattern: pattern, size, n, laps (how often all of it is taken), cut_spot, cut_hash and cut_id (up to which documents
    are taken once more; null: none), source_size and target of its first source, flow (source, words). Patterns that share a
    source with another go through the driver's network: more than max_patterns of those are an error.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.array_sort(F.array_distinct(sources)).alias("pattern"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    rows = materialize(rows, "sizes")
    order, spot = _order("doc_id", seed)
    cells = materialize(rows.groupBy("pattern", spot.alias("spot")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "cells")
    patterns = materialize(cells.groupBy("pattern").agg(F.sum("size").alias("size"), F.sum("n").alias("n")), "patterns")
    members = patterns.select("pattern", "size", F.explode("pattern").alias("source"))
    total = patterns.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    targets = materialize(source_targets(members.groupBy("source").agg(F.sum("size").alias("size")), total, weight), "targets")
    of = lambda c, name: F.col(c).eqNullSafe(F.col(name))
    several = members.where(F.size("pattern") > 1).select(F.col("source").alias("_s")).distinct()
    tied = materialize(members.join(several, of("source", "_s"), "left_semi").select("pattern").distinct().join(patterns, "pattern"), "tied")
    own = tied.limit(max_patterns + 1).collect()
    if len(own) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns that share sources: raise max_patterns or merge sources")
    flows = _network(own, targets.join(several, of("source", "_s"), "left_semi").collect() if own else [])
    apart = members.join(tied.select("pattern"), "pattern", "left_anti").join(targets.select(F.col("source").alias("_s"), "target"), of("source", "_s"))
    words_ = F.bround("target").cast("long")
    flow = apart.select("pattern", words_.alias("words"), F.array(F.struct("source", words_.alias("words"))).alias("flow"))
    kind = "pattern array<string>, words bigint, flow array<struct<source:string,words:bigint>>"
    flow = flow.unionAll(docs.sparkSession.createDataFrame([(p, sum(x for _, x in f), f) for p, f in flows], kind))
    lead = targets.select(F.col("source").alias("_s"), F.col("size").alias("source_size"), "target")
    plans = patterns.join(flow, "pattern", "left").withColumn("_lead", F.get("pattern", F.lit(0))).join(lead, F.col("_lead").eqNullSafe(F.col("_s")), "left")
    some = F.col("size") > 0
    laps, rest = F.when(some, F.floor(F.col("words") / F.col("size"))).otherwise(0), F.when(some, F.col("words") % F.col("size")).otherwise(0)
    plans = plans.select("pattern", "size", "n", F.coalesce(laps, F.lit(0)).cast("int").alias("laps"), F.coalesce(rest, F.lit(0)).alias("rest"), "source_size", "target", "flow")
    return rows, _cut(rows, cells, order, spot, materialize(plans, "plans"))


def _network(patterns: list, targets: list) -> list[tuple[list, list[tuple]]]:
    """(pattern, [(source, words)]) for patterns (pattern, size) that share sources (source, size, target)."""
    at = {r["source"]: i for i, r in enumerate(targets)}
    patterns = sorted(patterns, key=lambda r: [(x is None, x or "") for x in r["pattern"]])
    flows = min_cost_flow([r["size"] for r in patterns], [[at[s] for s in r["pattern"]] for r in patterns], [round(r["target"]) for r in targets])
    return [(r["pattern"], [(targets[i]["source"], v) for i, v in sorted(f.items())]) for r, f in zip(patterns, flows, strict=True)]


def _cut(rows: DataFrame, cells: DataFrame, order: Column, spot: Column, plans: DataFrame) -> DataFrame:
    """plans with cut_spot, cut_hash and cut_id: of those with a rest, the last document, by hash and id, whose middle lies within the rest."""
    upto = F.sum("size").over(W.partitionBy("pattern").orderBy("spot"))
    edge = cells.join(plans.where("rest > 0").select("pattern", "rest"), "pattern").withColumn("upto", upto)
    edge = materialize(edge.where("upto >= rest and upto - size < rest").select("pattern", "spot", (F.col("rest") - F.col("upto") + F.col("size")).alias("left")), "edges")
    # of a pattern's rows one hash range in RANGES; rows that repeat an id count together
    within, own = F.sum("size").over(W.partitionBy("pattern").orderBy("h", "doc_id")), F.sum("size").over(W.partitionBy("pattern", "h", "doc_id"))
    inside = rows.select("doc_id", "pattern", "size", order.alias("h"), spot.alias("spot")).join(edge, ["pattern", "spot"])
    inside = inside.withColumns({"within": within, "own": own}).where(F.col("within") - F.col("own") / 2 <= F.col("left"))
    last = inside.groupBy("pattern").agg(F.max(F.struct("h", "doc_id")).alias("last"))
    cuts = edge.select("pattern", F.col("spot").alias("cut_spot")).join(last, "pattern", "left").select("pattern", "cut_spot", F.col("last.h").alias("cut_hash"), F.col("last.doc_id").alias("cut_id"))
    return materialize(plans.join(cuts, "pattern", "left").drop("rest"), "plans")


def copies(rows: DataFrame, plans: DataFrame, seed: int = 0, pattern: str = "pattern", id_col: str = "doc_id") -> DataFrame:
    """rows with source_size, target and copies (0 to 3) by the plans: a projection over a join by pattern.

    Patterns with a large share of all rows are answered by a broadcast of their plans, all others by the ordinary join.
    """
    n = plans.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = plans.where(F.col("n") >= max(1000, n * HOT_SHARE)).select(F.col("pattern").alias(pattern))
    info = plans.select(F.col("pattern").alias(pattern), "source_size", "target", *[F.col(c).alias(f"_lamella_{c}") for c in ("laps", "cut_spot", "cut_hash", "cut_id")])
    order, spot = _order(id_col, seed)
    laps, cut, h, last = (F.col(f"_lamella_{c}") for c in ("laps", "cut_spot", "cut_hash", "cut_id"))
    before = (order < h) | ((order == h) & (F.coalesce(F.col(id_col), F.lit(-(2**63))) <= F.coalesce(last, F.lit(-(2**63)))))
    more = cut.isNotNull() & ((spot < cut) | ((spot == cut) & F.coalesce(before, F.lit(False))))
    joined = join_by_key(rows, info, [pattern], "left", hot)
    return joined.withColumn("copies", F.coalesce(laps + more.cast("int"), F.lit(0))).drop(*[f"_lamella_{c}" for c in ("laps", "cut_spot", "cut_hash", "cut_id")])


def mix(docs: DataFrame, source_col: str = "source", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies) of each row of docs.

    taken = copies * size, copies 0 to 3. A null or empty text has size 0 and takes nothing; a null source is a source
    of its own, after the others; rows that repeat a doc_id within a source share their fate; an empty table gives an
    empty result; other columns are ignored.
    """
    rows, plans = plan_mix(docs, F.array(F.col(source_col)), **options)
    done = copies(rows, plans, options.get("seed", 0))
    return done.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "copies")


def resample(docs: DataFrame, source_col: str = "source", **options) -> DataFrame:
    """docs with each row as often as the mix takes it (0 to 3 times)."""
    _, plans = plan_mix(docs, F.array(F.col(source_col)), **options)
    whole = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id"), F.array(F.col(source_col)).alias("pattern"))  # own names only
    times = copies(whole, plans, options.get("seed", 0)).where(F.col("copies") > 0)
    return times.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_row.*")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))
