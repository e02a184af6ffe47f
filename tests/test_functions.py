"""Hashes, filters, codecs, the binary log and block packing."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella import model
from lamella.functions import codecs, filters, hashes
from lamella.operators import log as wal
from lamella.operators import runs
from lamella.sources import log_file


def test_hash_vectors(spark):
    keys = [b"", b"hello", b"key_00005000", b"The quick brown fox jumps over the lazy dog"]
    assert [f"{int(x):016x}" for x in hashes.murmur3(keys)] == ["0" * 16, "5b1e906a48ae1d19", "3d95940429a5ef09", "7a433ca9c49a9347"]
    assert hashes.fnv16(keys[:3]).tolist() == [7385, 25396, 26424]
    df = spark.createDataFrame([(k,) for k in [*keys, None]], "k binary")
    got = df.select(hashes.murmur3_key(F.col("k")), hashes.fnv16_key(F.col("k")), hashes.crc32_key(F.col("k"))).collect()
    assert [None if r[0] is None else r[0] % 2**64 for r in got] == [*map(int, hashes.murmur3(keys)), None]
    assert [r[2] for r in got] == [*map(zlib.crc32, keys), None] and got[-1][1] is None


@pytest.mark.parametrize("n", [0, 1, 100, 1000, 10_000])
def test_filter(n):
    here, absent = (hashes.murmur3([f"{w}-{i}".encode() for i in range(m)]) for w, m in (("present", n), ("absent", 10_000)))
    blob = filters.build(np.concatenate([here, here[: n // 2]]))
    assert filters.may_contain(blob, here).all() and filters.may_contain(blob, absent).mean() < 0.02


def test_codecs(spark):
    numbers = [0, -1, 1, 2**63 - 1, -(2**63), 255, -256, 2**40]
    df = spark.createDataFrame([(x,) for x in numbers], "x long").withColumn("k", codecs.int_key(F.col("x")))
    assert [r["x"] for r in df.orderBy("k").collect()] == sorted(numbers)
    assert {(r["x"], r["y"]) for r in df.select("x", codecs.int_of_key(F.col("k")).alias("y")).collect()} == {(x, x) for x in numbers}
    assert codecs.after_prefix(b"ab") == b"ac" and codecs.after_prefix(b"a\xff\xff") == b"b" and codecs.after_prefix(b"\xff") is None


def test_log_file(spark, tmp_path):
    w = log_file.LogWriter(tmp_path / "a.log")
    assert [w.put(b"answer", b"42"), w.commit(0), w.put(b"age", b"23")] == [0, 17, 29]
    w.begin(), w.put(b"k", None), w.end(), w.put(b"", b"")
    w.close()
    with (tmp_path / "a.log").open("ab") as f:
        f.write(b"\x05\0\0\0torn")
    spark.dataSource.register(log_file.LogSource)
    for path in (tmp_path, tmp_path / "a.log"):
        df = spark.read.format("lamella_log").load(str(path))
        assert df.schema == model.LOG
        got = [(r["op"], r["pos"]) for r in df.orderBy("pos").collect()]
        assert got == [("put", 0), ("commit", 17), ("put", 29), ("begin", 43), ("del", 47), ("end", 57), ("put", 61)]
    sized = df.withColumn("size", wal.size_of())
    assert wal.end_of_log(sized).first()[0] == 70 == log_file.whole_size(tmp_path / "a.log")
    assert [bytes(r["key"]) for r in wal.replay(df).orderBy("pos").collect()] == [b"answer", b"age", b"k", b""]
    assert wal.commit_offset(df.limit(0), 7).first()[0] == 7


def test_replay_of_random_logs(spark):
    """Bracket semantics against a sequential replay, in segments so small that batches span them."""
    rng = random.Random(5)
    for _ in range(4):
        ops = [(i * 3, rng.choice(["put"] * 4 + ["del", "begin", "end", "commit"])) for i in range(60)]
        committed = rng.choice([0, 30, 90])
        df = spark.createDataFrame([(p, op, b"k", b"v", committed if op == "commit" else None) for p, op in ops], model.LOG)
        upto = committed if any(op == "commit" for _, op in ops) else 0
        want, pending, inside = [], [], False
        for p, op in ops:
            if p < upto:
                continue
            if op == "begin":
                pending, inside = [], True
            elif op == "end":
                want += pending
                pending, inside = [], False
            elif op in ("put", "del"):
                (pending if inside else want).append(p)
        for segment in (10, 1 << 20):
            assert sorted(r["pos"] for r in wal.replay(df, segment).collect()) == sorted(want)


def test_packing(spark):
    rng = random.Random(3)
    rows = [(r, f"{i:05d}".encode(), bytes(rng.randrange(3000)), rng.random() < 0.1, i) for r in range(3) for i in range(80)]
    rows += [(9, b"aaaaaaaa", bytes(4076), False, 0), (9, b"bbbbbbbb", b"small", False, 1), (9, b"cccccccc", bytes(5000), False, 2)]
    df = spark.createDataFrame(rows, "run int, key binary, value binary, deleted boolean, seq long")
    want = []
    for run in (0, 1, 2, 9):
        used, n, block, first = 0, 0, 0, None
        for _, key, value, deleted, _ in sorted(x for x in rows if x[0] == run):
            space = 8 + len(key) + (0 if deleted else len(value))
            if n and 4 + used + space > 4096:
                want.append((run, block, n, used, first))
                used, n, block = 0, 0, block + 1
            first = key if not n else first
            used, n = used + space, n + 1
        want.append((run, block, n, used, first))
    for segment in (5, 40, 100_000):
        assert sorted((r["run"], r["block"], r["n_items"], r["used"], bytes(r["first_key"])) for r in runs.pack_blocks(df, "run", segment).collect()) == want
    assert [bytes(r["key"]) for r in runs.oversize(df).collect()] == [b"cccccccc"]


def test_runs_of_keys(spark):
    """Runs that overlap, nest, touch or stand alone, against all pairs; in a level of disjoint runs, too."""
    rng = random.Random(9)
    ranges = [(i, *sorted(rng.choices(range(100), k=2))) for i in range(12)] + [(20, 5, 5), (21, 5, 5), (22, 0, 99)]
    wanted = [(k,) for k in [*range(-3, 104, 2), 5, 5]]
    asked = spark.createDataFrame(wanted, "key long")
    got = runs.pick_for_key(spark.createDataFrame(ranges, "run_id int, first_key long, last_key long"), asked).collect()
    assert sorted(map(tuple, got)) == sorted((k, r) for (k,) in wanted for r, a, b in ranges if a <= k <= b)
    level = [(i, 10 * i, 10 * i + 6) for i in range(9)]
    got = runs.pick_in_level(spark.createDataFrame(level, "run_id int, first_key long, last_key long"), asked).collect()
    assert sorted(map(tuple, got)) == sorted((k, r) for (k,) in wanted for r, a, b in level if a <= k <= b)


def test_filters_by_part(spark):
    log = spark.createDataFrame([(i % 3, b"k%d" % (i // 2)) for i in range(4000)], "src int, key binary")
    wanted = spark.createDataFrame([(b"k%d" % i,) for i in range(1500, 6000)] + [(None,), (b"k1",), (b"k1",)], "key binary")
    for parts in (1, 7):
        blobs = filters.build_filters(log, parts)
        found = {(bytes(r["key"]), r["run"]) for r in filters.probe_filters(wanted, blobs, parts).collect()}
        there = {(b"k%d" % (i // 2), i % 3) for i in range(4000)} & {(bytes(k), r) for (k,) in wanted.where("key is not null").collect() for r in range(3)}
        assert there <= found and len(found) < len(there) + 20
    assert filters.probe_filters(wanted, filters.build_filters(log.limit(0), 1), 1).count() == 0 and filters.n_parts(log.limit(0)) == 1


def test_plan_shapes(spark, tmp_path):
    """Reconciliation keeps one row a key before the shuffle; key predicates and columns reach the scan."""
    from lamella.operators import reads, resolve

    spark.createDataFrame([(b"k", b"v", False, 1)], model.MUTATION).write.parquet(str(tmp_path / "t"))
    log = spark.read.parquet(str(tmp_path / "t"))
    plan = reads.scan(log, b"a", b"m")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "GreaterThanOrEqual(key" in plan and "LessThanOrEqual(key" in plan
    keys = reads.keys(log)._jdf.queryExecution().executedPlan().toString()
    assert "value" not in keys[keys.index("ReadSchema") :]
    assert "EqualTo(deleted" not in resolve.visible(log)._jdf.queryExecution().executedPlan().toString()


def test_buckets_need_no_shuffle(spark):
    from lamella.operators import resolve
    from lamella.sources.bucketed import read_bucketed, write_bucketed

    log = spark.createDataFrame([(b"%d" % (i % 50), b"v", i % 9 == 0, i) for i in range(500)], model.MUTATION)
    table = read_bucketed(spark, write_bucketed(log, 4))
    state = resolve.visible(table)
    assert "Exchange" not in state._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, state.collect())) == sorted(map(tuple, resolve.visible(log).collect()))
