"""Order MinHash against a plain version, and the succession of documents."""

import hashlib
import random
from functools import reduce
from itertools import pairwise

import regex
import xxhash
from pyspark.sql import functions as F

from lamella.llm import fingerprints


def edited(a, b):
    q = len(a) // 4
    return a[: len(a) - q] + b[:q]


def test_query_texts_and_successors(spark, tmp_path):
    rng = random.Random(6)
    rows = [(rng.randrange(10**12) - 5 * 10**11, " ".join(f"é{rng.randrange(900)}" for _ in range(rng.choice([0, 1, 3, 30, 200])))) for _ in range(300)] + [(10**13, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_at", F.lit(1))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    ordered = sorted((i, t or "") for i, t in rows)
    for group in (7, 1000):
        base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
        got = {r["doc_id"]: (r["_text"], r["next__text"]) for r in fingerprints.with_next(base, ["_text"], group).collect()}
        assert got == {i: (t, ordered[(k + 1) % len(ordered)][1]) for k, (i, t) in enumerate(ordered)}
    out = {r["doc_id"]: r for r in fingerprints.op3_fingerprints(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows)
    of = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(docs).collect()}
    for k, (i, t) in enumerate(ordered):
        e = edited(t, ordered[(k + 1) % len(ordered)][1])
        assert out[i]["n_chars"] == len(t) and out[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert out[i]["fingerprint"] == of[i]
        assert (out[i]["near_edited"] == 1.0) == (out[i]["fingerprint"] == out[i]["edited_fingerprint"])
    long = [out[i] for i, t in ordered if len(t) > 500]
    assert all(r["near_edited"] > 0.15 and r["near_next"] < 0.1 for r in long)


def likeness(spark, a, b):
    s = spark.createDataFrame([(a, b)], "a string, b string")
    return s.select(fingerprints.likeness(fingerprints.signature(F.col("a")), fingerprints.signature(F.col("b")))).first()[0]


def test_sensitive_to_order_and_edits(spark):
    words = [f"w{i}" for i in range(2000)]
    text = " ".join(words)
    blocks = [words[i : i + 20] for i in range(0, 2000, 20)]
    random.Random(1).shuffle(blocks)
    moved = " ".join(w for b in blocks for w in b)
    few = " ".join(w if i % 100 else "new" for i, w in enumerate(words))
    many = " ".join(w if i % 8 else "new" for i, w in enumerate(words))
    assert likeness(spark, text, text) == 1.0
    assert likeness(spark, text, few) > 0.8 > likeness(spark, text, many) > 0.2
    assert 0.2 < likeness(spark, text, moved) < 0.75
    assert likeness(spark, "a b a b", "a b a b a b a b") < 1.0
    assert likeness(spark, "", "") == 1.0 and likeness(spark, "", " ") == 0.0 and likeness(spark, "x", "y") == 0.0


def test_insertions_in_texts_without_spaces(spark):
    rng = random.Random(4)
    for low, high in ((0x4E00, 0x9FFF), (0x20000, 0x2A6DF), (0x61, 0x7A)):
        text = "".join(chr(rng.randint(low, high)) for _ in range(3000))
        assert likeness(spark, text, text[:10] + chr(low) + text[10:]) > 0.8
        assert likeness(spark, text, text[:1500] + text[1501:]) > 0.8
    tokens = spark.createDataFrame([("ab \U00020000cdefghij\n12345678",)], "t string").select(F.regexp_extract_all("t", F.lit(fingerprints.TOKEN), F.lit(1))).first()[0]
    assert tokens == ["ab", "\U00020000cdefghi", "cdefghij", "12345678"]


def test_occurrence_numbers(spark):
    for text in ("a " * 9, "a b " * 300 + "c", "x y z " * 7 + "a " * 40):
        tokens = text.split()
        kmers = list(zip(tokens, tokens[1:], strict=False))
        want = sorted((kmers[i], kmers[:i].count(kmers[i])) for i in range(len(kmers)))
        packed = F.sort_array(F.transform(F.lit([hash(k) % 1000 for k in kmers]), lambda h, i: F.shiftleft(h.cast("long"), 30).bitwiseOR(i.cast("long"))))
        got = spark.range(1).select(packed.alias("s")).select(F.transform("s", lambda x, i: F.struct(x.bitwiseAND(F.lit((1 << 30) - 1).cast("long")).alias("i"), fingerprints._occurrence(F.col("s"), x, i).alias("n")))).first()[0]
        by_hash = {}
        assert len(got) == len(want)
        for i, k in enumerate(kmers):
            by_hash.setdefault(hash(k) % 1000, []).append(i)
        assert all(by_hash[hash(kmers[r["i"]]) % 1000].index(r["i"]) == r["n"] for r in got)


def test_hard_rows(spark, hard, tmp_path):
    assert fingerprints.fingerprints(hard).count() == hard.count() and fingerprints.fingerprints(hard.limit(0)).count() == 0
    hard.write.parquet(f"{tmp_path}/a/documents.parquet")
    hard.limit(1).write.parquet(f"{tmp_path}/b/documents.parquet")
    hard.limit(0).write.parquet(f"{tmp_path}/c/documents.parquet")
    assert fingerprints.op3_fingerprints(spark, f"{tmp_path}/a").count() == hard.count()
    assert fingerprints.op3_fingerprints(spark, f"{tmp_path}/b").select("near_next").first()[0] == 1.0
    assert fingerprints.op3_fingerprints(spark, f"{tmp_path}/c").count() == 0


def plain_signature(text):
    """signature() with lists and dictionaries."""
    xx = lambda *values: reduce(lambda seed, v: xxhash.xxh64_intdigest(v, seed), values, 42)
    long, short = (lambda v: v.to_bytes(8, "little")), (lambda v: v.to_bytes(4, "little"))
    tokens = [m[1].encode() for m in regex.finditer(fingerprints.TOKEN, text)]
    kmers = [xx(a, b) for a, b in pairwise(tokens)] if len(tokens) > 1 else [xx(t) for t in tokens]
    bins, seen = {}, {}
    for place, h in enumerate(kmers):
        key = h & (2**33 - 1)
        seen[key] = n = seen.get(key, -1) + 1
        hashed = xx(long(key), short(n)) >> 31
        bins.setdefault(hashed >> 27, []).append((hashed, place))
    out = []
    for b, own in sorted(bins.items()):
        smallest = sorted(sorted(own)[:2], key=lambda x: x[1])
        out.append((b << 32) | (xx(*[long(h) for h, _ in smallest]) & 0xFFFFFFFF))
    return out or [(64 << 32) | (xx(text.encode()) & 0xFFFFFFFF)]


def test_against_a_plain_version(spark):
    rng = random.Random(12)
    texts = ["", " \n ", "one", "a b", "a b a b a b", "same " * 300, "x" * 500, "é中\U00020000 " * 40, "line of words\n" * 30]
    texts += [" ".join(rng.choice(["ab", "cde", "f" * 11, "中文字", "g"]) for _ in range(rng.choice([3, 60, 400, 3000]))) for _ in range(20)]
    texts += ["".join(chr(rng.randint(0x4E00, 0x4EFF)) for _ in range(1200))]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", fingerprints.signature(F.col("t")).alias("s"))
    assert {r["i"]: r["s"] for r in df.collect()} == {i: plain_signature(t) for i, t in enumerate(texts)}
