"""What several operators share: tables in the shared folder, hot keys, words, let-bindings, bisection and running sums."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import discard, materialize

__all__ = ["chunks", "cut", "discard", "first_true", "hot_keys", "join_by_key", "let", "materialize", "numbered", "read", "running", "running_sum", "words"]

#: ASCII white space, as everywhere in the contracts.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot when it has at least this share of the rows, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 200


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, however often body or its lambdas use it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(steps: Column, combine: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """Inclusive running combination, from 0, of an array of integers; appends in blocks, so it stays near-linear."""

    def merge(acc: Column, b: Column, all_steps: Column) -> Column:
        inner = F.aggregate(
            F.slice(all_steps, b * block + 1, block),
            F.struct(acc["pos"].alias("pos"), F.array().cast("array<bigint>").alias("out")),
            lambda a, s: let(combine(a["pos"], s), lambda v: F.struct(v.alias("pos"), F.concat(a["out"], F.array(v)).alias("out"))),
        )
        return let(inner, lambda r: F.struct(r["pos"].alias("pos"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

    def scan(v: Column) -> Column:
        blocks = F.sequence(F.lit(0), ((F.size(v) - 1) / block).cast("int"))
        zero = F.struct(F.lit(0).cast("bigint").alias("pos"), F.array().cast("array<array<bigint>>").alias("out"))
        return F.flatten(F.aggregate(blocks, zero, lambda acc, b: merge(acc, b, v))["out"])

    empty = F.array().cast("array<bigint>")
    return let(F.transform(steps, lambda s: s.cast("bigint")), lambda v: F.when(F.size(v) > 0, scan(v)).otherwise(empty))


def running_sum(steps: Column) -> Column:
    return running(steps, lambda a, b: a + b)


def first_true(n: Column, test: Callable[[Column], Column]) -> Column:
    """The smallest i from 0 to n - 1 for which test(i) holds, n if none; once it holds it must hold on. By bisection."""

    def halve(r: Column, _: Column) -> Column:
        middle = F.shiftright(r["lo"] + r["hi"], 1)
        right, left = F.struct((middle + 1).alias("lo"), r["hi"].alias("hi")), F.struct(r["lo"].alias("lo"), middle.alias("hi"))
        return F.when(r["lo"] >= r["hi"], r).when(test(middle), left).otherwise(right)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(n + 1)).cast("int"))
    return F.aggregate(steps, F.struct(F.lit(0).alias("lo"), n.cast("int").alias("hi")), halve)["lo"]


def chunks(text: Column, size: int = 4096) -> Column:
    """A text in pieces of size characters, for cut()."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cut(pieces: Column, a: Column, b: Column, size: int = 4096) -> Column:
    """Characters a to b (end exclusive) of the text of chunks(): costs what it takes, wherever it is in the text."""
    i, j = F.shiftright(a, size.bit_length() - 1), F.shiftright(b, size.bit_length() - 1)
    first, last = F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, j), F.lit(""))
    inner = F.slice(pieces, i + 2, F.greatest(j - i - 1, F.lit(0)))
    long = F.concat(first.substr(a - i * size + 1, F.lit(size)), F.array_join(inner, ""), last.substr(F.lit(1), b - j * size))
    return F.when(b <= a, "").when(i == j, first.substr(a - i * size + 1, b - a)).otherwise(long)


def words(text: Column) -> Column:
    """The words of a text (null: none), without empty strings."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACE, -1))


def numbered(df: DataFrame, key: str, name: str) -> DataFrame:
    """df with name, the number from 0 of each row in the order of key, nulls last; equal keys in any order.

    Rows are put into ranges of the key and numbered there; only the ranges' sizes are added up in one task.
    """
    ranged = df.repartitionByRange(F.asc_nulls_last(key)).withColumn("_part", F.spark_partition_id())
    # written once: the ranges come from a sample and must be the same wherever they are used
    ranged = materialize(ranged, "ranges")
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", before.alias("_base"))
    inside = F.row_number().over(W.partitionBy("_part").orderBy(F.asc_nulls_last(key)))
    return ranged.withColumn("_in", inside).join(base, "_part").withColumn(name, F.col("_base") + F.col("_in") - 1).drop("_part", "_in", "_base")


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """The keys with at least this share of the rows, by exact counts: at most 1 / share rows."""
    least = max(1000, df.count() * share)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least).select(*keys)


def join_by_key(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", hot: DataFrame | None = None) -> DataFrame:
    """left join right, where right has one row of small columns a key and keys of left may be hot.

    Hot keys (at most 1 / HOT_SHARE, so the broadcast is bounded) are answered by a broadcast of their rows of
    right; all other rows go through the ordinary shuffle.
    """
    keys = list(keys)
    hot = hot_keys(left, keys) if hot is None else hot
    # mostly nothing is hot: no table is written for that
    if hot.isEmpty():
        return left.join(right, keys, how)
    some = F.broadcast(materialize(hot, "hot"))
    rare = left.join(some, keys, "left_anti").join(right, keys, how)
    busy = left.join(F.broadcast(right.join(some, keys, "left_semi")), keys, how).join(some, keys, "left_semi")
    return rare.unionByName(busy)
