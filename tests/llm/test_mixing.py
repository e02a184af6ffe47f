"""Targets, flows and selection."""

import random
from itertools import pairwise

from pyspark.sql import functions as F

from lamella.llm import mixing


def test_targets():
    assert mixing.fill_targets([10, 10, 10], [1, 2, 3]) == [5.0, 10.0, 15.0]
    t = mixing.fill_targets([1, 100, 100], [3, 1, 1])
    assert t[0] == 3.0 and abs(sum(t) - 201) < 1e-9 and t[1] == t[2]
    assert mixing.fill_targets([], []) == [] and mixing.fill_targets([0, 5], [1, 1]) == [0.0, 5.0]


def test_flow_meets_quotas_at_least_cost():
    supply, members, quotas = [10, 10, 10], [[0], [0, 1], [1]], [25, 15]
    flows = mixing.min_cost_flow(supply, members, quotas)
    assert [sum(f.get(s, 0) for f in flows) for s in (0, 1)] == quotas
    cost = sum(sum(min(max(sum(f.values()) - k * 10, 0), 10) * c for k, c in enumerate((0, 1, 3))) for f in flows)
    best = min(
        sum(sum(min(max(x - k * 10, 0), 10) * c for k, c in enumerate((0, 1, 3))) for x in (a, b + c, d))
        for a in range(31) for b in [25 - a] if 0 <= b <= 30 for c in range(31 - b) for d in [15 - c] if 0 <= d <= 30
    )
    assert cost == best
    assert sum(mixing.min_cost_flow([5], [[0]], [100])[0].values()) == 15


def test_mix(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 200])), rng.choice(["a"] * 30 + ["b", "c", None])) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("copies", F.lit(1))
    got = mixing.mix(docs).collect()
    again = {r["doc_id"]: r for r in mixing.mix(docs.repartition(7)).collect()}
    assert len(got) == len(rows) and all(again[r["doc_id"]] == r for r in got)
    source = {i: s for i, _, s in rows}
    size = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in ("a", "b", "c", None)}
    targets = mixing.fill_targets([size[s] for s in ("a", "b", "c", None)], [1, 2, 3, 1])
    for s, t in zip(("a", "b", "c", None), targets, strict=True):
        own = [r for r in got if source[r["doc_id"]] == s]
        assert {r["source_size"] for r in own} == {size[s]} and all(abs(r["target"] - t) < 1e-6 for r in own)
        assert abs(sum(r["taken"] for r in own) - t) <= 200
        assert all(0 <= r["taken"] <= 3 * r["size"] for r in own)
    more = mixing.resample(docs)
    assert more.columns == docs.columns and more.count() == sum(r["copies"] for r in got)


def test_hard_rows(spark, hard):
    got = mixing.mix(hard).collect()
    assert len(got) == hard.count() and all(r["taken"] == r["copies"] * r["size"] for r in got)
    assert mixing.mix(hard.limit(0)).count() == 0 and mixing.resample(hard.limit(0)).count() == 0
    assert mixing.resample(hard).columns == hard.columns


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, "w " * 10, ["x", "y"] if i % 3 == 0 else ["x"] if i % 3 == 1 else ["y"]) for i in range(600)], "doc_id long, text string, sources array<string>")
    rows, plans = mixing.plan_mix(docs, F.col("sources"), weight=lambda i: F.when(i == 0, 1.0).otherwise(3.0))
    found = sorted(plans.collect(), key=lambda p: p["pattern"])
    assert [p["pattern"] for p in found] == [["x"], ["x", "y"], ["y"]]
    total = {s: sum(n for p in found for x, n in p["flow"] if x == s) for s in ("x", "y")}
    assert abs(total["x"] - 1500) <= 1 and abs(total["y"] - 4500) <= 1
    taken = mixing.copies(rows, plans).agg(F.sum(F.col("size") * F.col("copies"))).first()[0]
    assert abs(taken - 6000) <= 30
    assert all(a <= b for a, b in pairwise(sorted(p["laps"] for p in found)))


def test_many_sources(spark):
    """More sources than the driver's network would take; every decision against a plain version."""
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 8])), None if i % 5000 == 1 else f"s{rng.randrange(12_000)}" if i % 3 else "hot") for i in range(40_000)]
    rows += [(7, "w w w", "hot")] * 40 + [(None, "w w", "hot")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 as laps", "2 as cut_spot", "3 as pattern", "4 as target")
    got = mixing.mix(docs).collect()
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    assert len(names) > 10_000 and len(got) == len(rows)
    size = dict.fromkeys(names, 0)
    for _, t, s in rows:
        size[s] += len(t.split())
    targets = dict(zip(names, mixing.fill_targets([size[s] for s in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    key = spark.createDataFrame([(r[0],) for r in rows], "doc_id long").select("doc_id", F.xxhash64("doc_id", F.lit(0)).alias("h")).distinct().collect()
    order = {r["doc_id"]: r["h"] % 2**64 for r in key}
    by = {}
    for i, t, s in rows:
        by.setdefault(s, {}).setdefault(i, []).append(len(t.split()))
    want = {}
    for s, own in by.items():
        laps, rest = divmod(round(targets[s]), size[s]) if size[s] else (0, 0)
        upto, last = 0, None
        ranked = sorted(own, key=lambda i: (order[i] >> 52, order[i] - (order[i] >> 63 << 64), -(2**63) if i is None else i))
        for i in ranked:
            upto += sum(own[i])
            if upto - sum(own[i]) / 2 <= rest:
                last = i
        for k, i in enumerate(ranked):
            want[s, i] = laps + (rest > 0 and last is not None and k <= ranked.index(last)) if size[s] else 0
    source = {}
    for i, _, s in rows:
        source.setdefault(i, set()).add(s)
    for r in got:
        mine = [s for s in source[r["doc_id"]] if size[s] == r["source_size"] and abs(targets[s] - r["target"]) < 1e-6]
        assert mine and (not r["size"] or any(r["copies"] == want[s, r["doc_id"]] for s in mine)) and r["taken"] == r["copies"] * r["size"]
