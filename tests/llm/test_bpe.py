"""Byte-level BPE against the tiktoken library, and token counts against a character-by-character attribution."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lamella.llm import bpe, token_counts

TEXTS = [
    None, "", " ", "\n\n  x", "it's we'll I'd", "Hello world  and   more\t\ttabs \n", "中文字符 и кириллица \U0001f600\U0001f468‍\U0001f469", "a" * 3000, "zqxjkv" * 400, "0123456789" * 50, "<|endoftext|>", "é    x", "ſtrange K",
]


@pytest.fixture(scope="module")
def encoder():
    return bpe.load_encoder()


@pytest.fixture(scope="module")
def reference():
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash(encoder):
    slots = {encoder.hash.slot(k) for k in encoder.ranks}
    assert slots == set(range(len(encoder.ranks)))
    assert all(encoder.slots[encoder.hash.slot(k)] == k for k in encoder.ranks)


def test_same_ids(encoder, reference):
    rng = random.Random(5)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abc'st é\n 0一") for _ in range(rng.randrange(300))) for _ in range(300)]
    encode = encoder.encoding()
    for t in texts:
        ids = encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == reference.encode_ordinary(t)
        assert encoder.decode(ids) == t.encode()


def test_round_trip(spark, hard, encoder, reference):
    docs = hard.unionByName(spark.createDataFrame([(100 + i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string"), allowMissingColumns=True)
    want = sorted((str(r["doc_id"]), len(ids := reference.encode_ordinary(t := r["text"] or "")), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for r in docs.collect())
    assert sorted((str(r[0]), *r[1:]) for r in bpe.round_trip(docs, encoder).collect()) == want
    assert bpe.round_trip(docs.limit(0), encoder).count() == 0
    assert bpe.encode(docs, encoder).count() == docs.count()


def brute(text, ids, encoder, ends, rule):
    """Gives each token to a section by looking at each of its characters."""
    of_byte = [i for i, c in enumerate(text) for _ in c.encode()]
    section = [next(k for k, e in enumerate(ends) if i < e) for i in range(len(text))]
    counts, at = [0] * len(ends), 0
    for i in ids:
        n = len(encoder.words[i])
        chars = sorted(set(of_byte[at : at + n]))
        at += n
        votes = [section[c] for c in chars]
        counts[votes[0] if rule == "first" else min(set(votes), key=lambda k: (-votes.count(k), k))] += 1
    return counts


def test_token_counts(spark, hard, encoder, reference):
    lengths = np.array([len(encoder.words[i]) for i in range(len(encoder.words))])
    rng = random.Random(2)
    for rule in token_counts.RULES:
        for t in [*(x for x in TEXTS if x), "a\n\n\nb  \n \n c中\n文"]:
            for ends in (token_counts.line_sections(t), sorted({*rng.sample(range(1, len(t) + 1), min(len(t), 9)), len(t)})):
                ids = reference.encode_ordinary(t)
                assert token_counts.attribute(t, np.array(ids), lengths, ends, rule).tolist() == brute(t, ids, encoder, ends, rule)
    rows = token_counts.count_tokens(hard, encoder).collect()
    assert sum(r["n_tokens"] for r in rows if r["doc_id"] == 8) == rows[[r["doc_id"] for r in rows].index(8)]["doc_tokens"]
    assert [(r["section"], r["n_tokens"]) for r in rows if r["doc_id"] == 1] == [(0, 0)]
    assert token_counts.count_tokens(hard.limit(0), encoder).count() == 0


def test_very_long_texts(spark, encoder, reference):
    """Megabytes in one row, of words and of line breaks alone: the same ids, and every section in bounded batches."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdeé中 ", k=rng.randrange(1, 12))) for _ in range(5000)]
    prose = "\n".join(" ".join(rng.choices(vocabulary, k=12)) for _ in range(40_000))
    assert len(prose) > 2 * bpe.LONG
    ids = encoder.encoding()(prose)
    assert np.array_equal(np.frombuffer(ids, "<u4"), reference.encode_ordinary(prose)) and encoder.decode(ids) == prose.encode()
    breaks = "\n" * 1_500_000
    docs = spark.createDataFrame([(1, prose), (2, breaks), (None, "x\ny")], "doc_id long, text string")
    found = token_counts.count_tokens(docs, encoder).groupBy("doc_id").agg({"section": "count", "n_tokens": "sum", "doc_tokens": "max", "char_end": "max"}).collect()
    got = {r["doc_id"]: (r["count(section)"], r["sum(n_tokens)"], r["max(char_end)"]) for r in found}
    assert all(r["sum(n_tokens)"] == r["max(doc_tokens)"] for r in found)
    assert got == {1: (40_000, len(ids) // 4, len(prose)), 2: (1_500_000, len(encoder.encoding()(breaks)) // 4, 1_500_000), None: (2, 3, 3)}
    with_most = token_counts.attribute(breaks[:9], np.array(reference.encode_ordinary(breaks[:9])), np.array([len(encoder.words[i]) for i in range(len(encoder.words))]), token_counts.line_sections(breaks[:9]))
    assert with_most.sum() == len(reference.encode_ordinary(breaks[:9]))
