"""Near-duplicate components against all pairs."""

import random
import re

import numpy as np
import pytest

from lamella.llm import common, near_dedup, shingles
from lamella.sources import shared

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text, width):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width, percent=80):
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(n=400, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" if i % 5 == 0 else f"é{i}" for i in range(300)]
    texts = []
    while len(texts) < n:
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 5, 20, 60, 200]))]
        chain = base
        for _ in range(rng.choice([1, 1, 1, 2, 6, 15])):
            texts.append(" ".join(chain))
            chain = list(chain if rng.random() < 0.6 else base)
            for _ in range(rng.choice([0, 1, 1, 3, 8])):
                chain[rng.randrange(len(chain))] = rng.choice(vocabulary)
    texts += [None, "", " \n\t", texts[0].upper(), "\v".join(texts[1].split(" "))]
    rng.shuffle(texts)
    return [(3 * i + 7, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("width", [2, 5])
def test_components(spark, width):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 key", "2 rep", "3 _gone", "4 _key", "5 _row", "6 _digest", "7 _words", "8 kept")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs, width).collect()}
    assert got == {i: (n, c, c == i) for i, (n, c) in brute(rows, width).items()}
    kept = near_dedup.deduplicate(docs, width)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, x in got.items() if x[2]}


def test_hard_rows(spark, hard):
    got = near_dedup.near_duplicates(hard).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in got) == sorted(
        [("1", "1", True), ("2", "2", True), ("3", "3", True), ("4", "4", True), ("4", "4", True), ("5", "5", True), ("6", "6", True), ("7", "7", True), ("8", "8", True), ("9", "4", False), ("None", "None", True)]
    )
    assert near_dedup.near_duplicates(hard.limit(0)).count() == 0 and near_dedup.deduplicate(hard).count() == hard.count() - 2


def test_one_row_of_each_component(spark):
    """Repeated rows and rows without an id, too; the same row whatever the order."""
    rows = [(1, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (2, "A B C D", "z"), (None, "a b c d", "z"), (None, "q r s", "k"), (None, "q r s", "l"), (5, "q r s t", "m"), (3, "u", "n"), (3, "v", "n"), (None, " ", "o"), (None, " ", "o"), (4, None, "p"), (4, None, "p")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(map(tuple, near_dedup.deduplicate(docs).collect()), key=str)
    assert got == sorted(map(tuple, near_dedup.deduplicate(docs.repartition(3)).collect()), key=str)
    kept = [(i, t) for i, t, _ in got]
    assert sorted(map(str, kept)) == sorted(map(str, [(1, "a b c d"), (None, "q r s"), (5, "q r s t"), (3, "u"), (3, "v"), (None, " "), (None, " "), (4, None), (4, None)]))


def test_a_leader_of_many(spark, monkeypatch):
    """3,000 documents alike to one, in groups of 50 partners, and a hub in the links."""
    monkeypatch.setattr(near_dedup, "PARTNERS", 50)
    monkeypatch.setattr(near_dedup, "HOT_SHARE", 1e-4)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*base, f"x{i}"])) for i in range(3000)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == 3000 and {r["component_id"] for r in got} == {0}


def test_a_bucket_of_many_apart(spark, monkeypatch):
    """20,000 members of one bucket that aren't alike: none is lost, and pairs that are alike are found."""
    rng = np.random.default_rng(5)
    n = 20_000
    sketch = rng.integers(-(2**63), 2**63, (n, near_dedup.SKETCH))
    for k in range(0, n, 1000):
        sketch[k + 1] = sketch[k]
    rows = [(i, [7], *map(int, sketch[i])) for i in range(n)]
    bits = [f"s{i}" for i in range(near_dedup.SKETCH)]
    reps = spark.createDataFrame(rows, "rep long, bands array<long>, " + ", ".join(f"{b} long" for b in bits)).repartition(4)
    docs = spark.createDataFrame([(i, f"t{i - i % 1000 if i % 1000 < 2 else i}") for i in range(n)], "doc_id long, text string").repartition(4)
    got = {r["id"]: r["component"] for r in near_dedup.link(reps, docs, 2, 0.8).collect()}
    assert got == {i + d: i for i in range(0, n, 1000) for d in (0, 1)}


def test_long_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, 500 + i) for i in range(300)] + [(2, 2)]
    random.Random(0).shuffle(links)
    got = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 1: 1, **{500 + i: 1 for i in range(300)}}
    assert near_dedup.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_members_apart_from_their_leader(spark, monkeypatch):
    """Two documents alike to each other but not to the bucket's smallest; blocks of two members."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    rng = random.Random(9)
    base = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(60):
        words = list(base)
        for k in rng.sample(range(40), rng.choice([3, 4, 5])):
            words[k] = f"x{rng.randrange(5)}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 1).collect()}
    assert got == brute(rows, 1)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(4)
    for share in (0.6, 0.8, 0.95):
        found = []
        for _ in range(60):
            both = rng.integers(0, 2**63, 400, dtype=np.uint64)
            rest = rng.integers(0, 2**63, (2, round(400 * (1 / share - 1) / 2)), dtype=np.uint64)
            a, b = (near_dedup.odd_sketch(near_dedup.minhash(np.concatenate([both, x]))) for x in rest)
            bits = int(np.bitwise_count((a ^ b).view(np.uint64)).sum())
            found.append(near_dedup.estimate(bits))
            assert share < 0.8 or bits <= near_dedup.most_bits(0.8)
        assert abs(np.mean(found) - share) < 0.03
    assert near_dedup.most_bits(0.8) < 160


def test_shingle_sets_have_the_right_sizes():
    texts = [t or "" for _, t in corpus(60)]
    for width in (1, 2, 5):
        assert [len(s) for s in shingles.shingle_sets([t.encode() for t in texts], width)] == [len(shingle_set(t, width)) for t in texts]


def test_texts_of_a_large_bucket_come_by_tiles(spark, monkeypatch):
    """Many documents that share buckets but few links: no step sends a text for each of their pairs."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(200)]
    changed = lambda words, n: [f"x{rng.random()}" if k in spots else w for spots in [set(rng.sample(range(len(words)), n))] for k, w in enumerate(words)]
    texts = [changed(base, 12) for _ in range(240)]
    texts += [changed(texts[k], 1) for k in range(0, 240, 8)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sent, confirm, tiled = [], near_dedup.confirm, getattr(near_dedup, "tiled", None)
    monkeypatch.setattr(near_dedup, "confirm", lambda pairs, *rest: (sent.append(pairs.count()), confirm(pairs, *rest))[1])
    monkeypatch.setattr(near_dedup, "TILE", 64, raising=False)
    if tiled:
        monkeypatch.setattr(near_dedup, "tiled", lambda *a: (found := tiled(*a), sent.append(found[1].count()))[0])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(docs, 5).collect()}
    assert got == brute(rows, 5) and 200 < len({c for _, c in got.values()}) < 245
    assert len(sent) == 2 and max(sent) < 8 * len(rows)


def test_confirmed_in_tiles(spark):
    """All pairs of a corpus, groups or not, against the plain confirmation."""
    rows = [(i, t) for i, t in corpus(150) if shingle_set(t, 2)]
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    pairs = spark.createDataFrame([(a, b) for a, _ in rows for b, _ in rows if a < b], "u long, v long")
    plain = sorted(map(tuple, near_dedup.confirm(pairs, texts, 2, 0.8).collect()))
    for g in ("0", "doc_id", "doc_id % 3"):
        got = near_dedup.confirm_in_tiles(pairs, texts, texts.selectExpr("doc_id", f"{g} as g"), 2, 0.8)
        assert sorted(map(tuple, got.collect())) == plain and plain


def test_no_table_is_written_without_need(spark, monkeypatch):
    """Stars need no round of the components, a chain only as many as change it; where nothing is hot there is no table of hot keys."""
    written = []
    counted = lambda df, name: written.append(name) or shared.materialize(df, name)
    monkeypatch.setattr(near_dedup, "materialize", counted)
    monkeypatch.setattr(common, "materialize", counted)
    stars = [(1, i) for i in range(2, 40)] + [(i, 50) for i in range(51, 90)] + [(1, 2), (7, 7)]
    got = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame(stars, "u long, v long")).collect()}
    assert got == {**{i: 1 for i in range(1, 40)}, **{i: 50 for i in range(50, 90)}} and written == ["edges"]
    written.clear()
    got = {r["id"]: r["component"] for r in near_dedup.components(spark.createDataFrame([(1, 2), (2, 3)], "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1} and written == ["edges", "least", "large", "small", "edges"]
    written.clear()
    rows = corpus(200)
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == {i: c for i, (_, c) in brute(rows, 2).items()} and written.count("hot") == 1


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_hot_keys_join_as_others(spark, how):
    left = spark.createDataFrame([(1 if i % 2 else i, i) for i in range(5000)] + [(None, -1), (9001, -2)], "k long, x long")
    right = spark.createDataFrame([(i, 10 * i) for i in range(4000)], "k long, y long")
    assert not common.hot_keys(left, ["k"]).isEmpty()
    assert sorted(map(str, common.join_by_key(left, right, ["k"], how).collect())) == sorted(map(str, left.join(right, ["k"], how).collect()))
