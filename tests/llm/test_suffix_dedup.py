"""Suffix arrays, and removal of repeats against a table of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from lamella.llm import suffix_dedup


def brute(rows):
    least = {}
    coded = [(i, (t or "").encode()) for i, t in rows]
    for i, t in coded:
        for p in range(len(t) - 49):
            w = t[p : p + 50]
            least[w] = min(i, least.get(w, i))
    out = {}
    for i, t in coded:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - 49):
            if least[t[p : p + 50]] < i:
                gone[p : p + 50] = True
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = np.frombuffer(t, dtype=np.uint8)[~gone].tobytes()
        out[i] = (len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
    return out


def corpus(n=150, seed=4):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé中") for _ in range(rng.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rng.choice([8, 12, 40]))) for _ in range(12)] + ["ab" * 200, "z" * 300, "x" * 50]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.choice([0, 1, 2, 5])):
            p = rng.choice(passages)
            a = rng.randrange(len(p))
            parts += [" ".join(word() for _ in range(rng.randrange(20))), p[a : a + rng.choice([30, 50, 51, 80, 500])] if rng.random() < 0.6 else p]
        texts.append("".join(parts))
    texts += [None, "", "short", texts[3], texts[5], texts[5], "y" * 2000]
    ids = rng.sample(range(10**6), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("frequent", [20_000, 3])
@pytest.mark.parametrize("partitions", [1, 6])
@pytest.mark.parametrize("small", [False, True])
def test_against_all_strings(spark, monkeypatch, frequent, partitions, small):
    """small: pieces shorter than texts, many batches, and groups of two batches."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 5_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK_ANCHORS", 200)
    if small:
        monkeypatch.setattr(suffix_dedup, "PIECE", 70)
        monkeypatch.setattr(suffix_dedup, "BATCH_BYTES", 2_000)
        monkeypatch.setattr(suffix_dedup, "SALT", 2)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(partitions).selectExpr("*", "1 spans")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("frequent", [20_000, 3])
def test_rows_are_not_batches_times_blocks(spark, monkeypatch, frequent):
    """A batch sends a row for each group of blocks, of which there are few, and not for each block."""
    for name, value in {"FREQUENT": frequent, "BLOCK_BYTES": 500, "BATCH_BYTES": 2_000, "SALT": 2, "MANY": 4, "GROUP_BYTES": 5_000}.items():
        monkeypatch.setattr(suffix_dedup, name, value, raising=False)
    sent, batches, cut, pieces = spark.sparkContext.accumulator(0), [], suffix_dedup._cut_contexts, suffix_dedup.pieces

    def counted(*args):
        run = cut(*args)

        def count(parts):
            for b in run(parts):
                sent.add(b.num_rows)
                yield b

        return count

    monkeypatch.setattr(suffix_dedup, "_cut_contexts", counted)
    monkeypatch.setattr(suffix_dedup, "pieces", lambda docs: (found := pieces(docs), batches.append(found.count()))[0])
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute(rows)
    assert batches[0] > 10 and 0 < sent.value <= 10 * batches[0]


@pytest.mark.parametrize("frequent", [20_000, 3])
def test_hashes_decide_nothing(spark, monkeypatch, frequent):
    """With anchors of two bits and hashes of four, which collide all the time, the same bytes go."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "_keys", lambda h, n_buckets: h & np.uint64(3))
    weak = suffix_dedup.Hashes.__call__
    monkeypatch.setattr(suffix_dedup.Hashes, "__call__", lambda self, a, b: weak(self, a, b) & np.uint64(15))
    rows = corpus(60, 7)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == brute(rows)


def test_a_very_long_text(spark):
    """20 MB in one row, half of which a smaller document has, too, in another order."""
    rng = np.random.default_rng(2)
    blocks = [rng.integers(97, 123, 1_000_000, dtype=np.uint8).tobytes().decode() for _ in range(20)]
    rows = [(5, "".join(blocks)), (3, "".join(reversed(blocks[:10])))]
    got = {r["doc_id"]: r for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[3]["n_removed"], got[5]["n_removed"]) == (0, 10_000_000) and got[5]["kept_sha256"] == hashlib.sha256("".join(blocks[10:]).encode()).hexdigest()


def test_spans_are_merged():
    raw = bytes(range(100))
    a, b = np.array([50, 10, 5, 90, 60, 120]), np.array([60, 20, 12, 150, 61, 130])
    assert suffix_dedup.without(raw, a, b) == (raw[:5] + raw[20:50] + raw[61:90], 36, 3)


def test_suffix_order_and_prefixes():
    rng = random.Random(1)
    for _ in range(120):
        alphabet = rng.choice([b"ab", b"abcd", bytes(range(1, 256)), b"a"])
        data = bytes(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 60, 300, 2000])))
        data = data * 3 + b"z" * 100 if rng.random() < 0.3 else data[:40] * 20 if rng.random() < 0.2 else data
        a = np.frombuffer(data, dtype=np.uint8)
        words = suffix_dedup.eight_bytes(a)
        order = suffix_dedup.suffix_order(a, words).tolist()
        assert sorted(order) == list(range(len(data)))
        ranked = [data[i : i + 50] for i in order]
        assert ranked == sorted(ranked)
        wanted = np.array([rng.random() < 0.2 for _ in range(len(data))])
        some = suffix_dedup.suffix_order(a, words, wanted).tolist()
        assert len(set(some)) == len(some) and {i for i in range(len(data)) if wanted[i]} <= set(some)
        ranked = [data[i : i + 50] for i in some]
        assert ranked == sorted(ranked)
        i, j = (np.array([rng.randrange(len(data)) for _ in range(40)]) for _ in range(2))
        for x, y, n in zip(i, j, suffix_dedup.common_prefix(words, i, j), strict=True):
            p, q = ((data[k:] + bytes(80))[:50] for k in (x, y))
            assert n == next((k for k in range(50) if p[k] != q[k]), 50)


def test_anchors_depend_on_the_string_alone():
    rng = random.Random(8)
    texts = [bytes(rng.choice(b"abc ") for _ in range(rng.randrange(200))) for _ in range(30)]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    text, place, h = suffix_dedup.anchors(texts)
    begin = np.cumsum([0, *map(len, texts)])
    of = {}
    for t, (a, b), x in zip(text, place, h, strict=True):
        for p in range(a, b + 1):
            assert begin[t] <= p and p + 50 <= begin[t + 1]
            assert of.setdefault(data[p : p + 50].tobytes(), x) == x
    assert all(b - a <= 30 for a, b in place)
    assert sum(b - a + 1 for a, b in place) == sum(max(0, len(t) - 49) for t in texts)


def test_hard_rows(spark, hard):
    got = suffix_dedup.remove_repeats(hard).collect()
    assert len(got) == hard.count() and all(r["n_removed"] == 0 for r in got)
    assert suffix_dedup.remove_repeats(hard.limit(0)).count() == 0
    longer = hard.unionByName(hard.selectExpr("doc_id + 100 doc_id", "text", "lang", "source", "n_chars", "size", "_t"))
    removed = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup.remove_repeats(longer).collect() if r["doc_id"] is not None and r["doc_id"] > 100}
    assert all(n == gone if n >= 50 else gone == 0 for n, gone in removed.values())
