"""Language ID of code-switched text by a linear-chain conditional random field over words.

A word's features are its letter bigrams and trigrams, its first and last four bytes (hashed into a table of weights)
and the lexicons of frequent words it is in; learned transitions tie neighbours. Forward-backward gives each word's
posterior, whose mean over the words gives the document's language and score.

The model is fitted in the driver on a bounded number of documents of each language; it has some hundred KB. All
documents are labelled whole, in Arrow batches without a shuffle. The chain of a long document is cut into blocks whose
transfer matrices are multiplied first, so work is linear and done in numpy for all documents of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import slices
from .common import read
from .shingles import BYTE, mix, powers

TABLE = 1 << 15
STEPS = 32
UNDETERMINED = "und"
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15 | 1)


@dataclass
class Words:
    """The words of a batch: hashed features of each letter, where each word's letters begin, and each text's words."""

    letters: np.ndarray
    at: np.ndarray
    affixes: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray


def word_features(texts: list[str]) -> Words:
    """Words are runs of letters (any non-ASCII character counts as one here), in lower case."""
    coded = [t.lower().encode() for t in texts]
    data = np.frombuffer(b"    " + b" ".join([*coded, b"    "]), dtype=np.uint8)
    inside = _LETTER[data]
    change = np.diff(inside.astype(np.int8), prepend=0)
    begin, end = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    bounds = 4 + np.concatenate([[0], np.cumsum([len(t) + 1 for t in coded])])
    x = np.where(inside, data, 32).astype(np.uint32)
    own = np.flatnonzero(inside)
    bi = (x[own] << 8) | x[own + 1]
    tri = (bi << 8) | x[own - 1]
    hashed = lambda v, salt: ((v.astype(np.uint64) * _PRIME + np.uint64(salt)) * _PRIME >> np.uint64(49)).astype(np.int32)
    letters = np.stack([hashed(bi, 1), hashed(tri, 2)], axis=1)
    length = end - begin
    at = np.cumsum(length) - length
    first, last = np.zeros(len(begin), dtype=np.uint32), np.zeros(len(begin), dtype=np.uint32)
    for k in range(4):
        there = length > k
        first = (first << 8) | np.where(there, x[begin + np.minimum(k, length - 1)], 0)
        last = (last << 8) | np.where(there, x[np.maximum(end - 1 - k, begin)], 0)
    affixes = np.stack([hashed(first, 3), hashed(last, 4)], axis=1)
    place = np.arange(len(own)) - np.repeat(at, length)
    values = BYTE[x[own]] * powers(_PRIME, int(length.max(initial=1)))[place]
    hashes = mix(np.add.reduceat(values, at) + length.astype(np.uint64)) if len(at) else np.zeros(0, dtype=np.uint64)
    return Words(letters, at, affixes, hashes, np.searchsorted(begin, bounds))


def has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


@dataclass
class Crf:
    """langs; weights of hashed features; known words with the lexicons they are in; weights of those; transitions."""

    langs: list[str]
    table: np.ndarray
    known: np.ndarray
    member: np.ndarray
    lexicon: np.ndarray
    move: np.ndarray

    def in_lexicon(self, w: Words) -> np.ndarray:
        if not len(self.known):
            return np.zeros((len(w.hashes), len(self.langs)), dtype=np.float32)
        at = np.minimum(np.searchsorted(self.known, w.hashes), len(self.known) - 1)
        return self.member[at] * (self.known[at] == w.hashes)[:, None]

    def emissions(self, w: Words) -> np.ndarray:
        if not len(w.at):
            return np.zeros((0, len(self.langs)), dtype=np.float32)
        grams = np.add.reduceat(self.table[w.letters[:, 0]] + self.table[w.letters[:, 1]], w.at, axis=0)
        return grams + self.table[w.affixes[:, 0]] + self.table[w.affixes[:, 1]] + self.in_lexicon(w) @ self.lexicon

    def posteriors(self, emissions: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Of each word, given all words of its text; texts are the words between starts."""
        n_langs = len(self.langs)
        move = np.exp(self.move - self.move.max(initial=0))
        counts = np.diff(starts)
        blocks = -(-counts // STEPS)
        n_blocks = int(blocks.sum())
        if not n_blocks or not n_langs:
            return np.zeros((len(emissions), n_langs))
        first = np.cumsum(blocks) - blocks
        of_word = np.repeat(np.arange(len(counts)), counts)
        rank = np.arange(len(emissions)) - np.repeat(starts[:-1] - starts[0], counts)
        row, step = first[of_word] + rank // STEPS, rank % STEPS
        p = np.zeros((STEPS, n_blocks, n_langs))
        p[step, row] = np.exp(emissions - emissions.max(axis=1, keepdims=True)) + 1e-30
        there = np.zeros((STEPS, n_blocks, 1), dtype=bool)
        there[step, row] = True
        opens = np.zeros(n_blocks, dtype=bool)
        opens[first[counts > 0]] = True

        # transfer matrix of each block; a text's first word has no transition before it
        m = np.broadcast_to(np.eye(n_langs), (n_blocks, n_langs, n_langs)).copy()
        for t in range(STEPS):
            moved = m @ move
            if t == 0:
                moved[opens] = m[opens]
            moved = moved * p[t][:, None, :]
            moved /= moved.max(axis=(1, 2), keepdims=True) + 1e-300
            m = np.where(there[t][:, :, None], moved, m)
        # vectors before and after each block
        before, after = np.ones((n_blocks, n_langs)), np.ones((n_blocks, n_langs))
        for k in range(1, int(blocks.max())):
            rows = first[blocks > k] + k
            v = np.einsum("bi,bij->bj", before[rows - 1], m[rows - 1])
            before[rows] = v / v.max(axis=1, keepdims=True)
            rows = (first + blocks - 1)[blocks > k] - k
            v = np.einsum("bij,bj->bi", m[rows + 1], after[rows + 1])
            after[rows] = v / v.max(axis=1, keepdims=True)
        alpha, a = np.empty_like(p), before
        for t in range(STEPS):
            moved = a @ move
            if t == 0:
                moved[opens] = a[opens]
            moved = moved * p[t]
            a = np.where(there[t], moved / (moved.max(axis=1, keepdims=True) + 1e-300), a)
            alpha[t] = a
        out, b = np.empty_like(p), after
        for t in reversed(range(STEPS)):
            both = alpha[t] * b
            out[t] = both / (both.sum(axis=1, keepdims=True) + 1e-300)
            moved = (b * p[t]) @ move.T
            b = np.where(there[t], moved / (moved.max(axis=1, keepdims=True) + 1e-300), b)
        return out[step, row]

    def label(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score of each text."""
        w = word_features([t or "" for t in texts])
        word = self.posteriors(self.emissions(w), w.starts)
        found = []
        for t, a, b in zip(texts, w.starts[:-1].tolist(), w.starts[1:].tolist(), strict=True):
            if not self.langs or a == b or not has_letter(t):
                found.append((UNDETERMINED, 0.0))
                continue
            mean = word[a:b].mean(axis=0)
            k = int(np.argmax(mean))
            found.append((self.langs[k], float(min(1.0, mean[k]))))
        return found


def fit(texts: list[str], langs: list[str], *, epochs: int = 3, rate: float = 0.2, length: int = 48, batch: int = 128, seed: int = 1) -> Crf:
    """Fits a field to texts, all words of which bear the text's language.

    Sequences of training are runs of words of several texts in a row, so that transitions learn both to stay and to
    switch. Adagrad on the log-likelihood, with exact forward-backward gradients. No texts: a model without languages.
    """
    names = sorted(set(langs))
    n = len(names)
    model = Crf(names, np.zeros((TABLE, n), dtype=np.float32), np.zeros(0, dtype=np.uint64), np.zeros((0, n), dtype=np.float32), np.eye(n, dtype=np.float32), np.eye(n) * 1.0)
    if not texts:
        return model
    words = word_features(texts)
    of = np.repeat([names.index(x) for x in langs], np.diff(words.starts))
    known, back = np.unique(words.hashes, return_inverse=True)
    seen = np.zeros((len(known), n), dtype=np.float32)
    np.add.at(seen, (back, of), 1)
    frequent = (seen.sum(axis=1) >= 5) & (seen.max(axis=1) > 0.6 * seen.sum(axis=1))
    model.known, model.member = known[frequent], (seen[frequent] > 0.6 * seen[frequent].sum(axis=1, keepdims=True)).astype(np.float32)
    if n < 2:
        return model
    rng = np.random.default_rng(seed)
    lengths = np.diff(np.append(words.at, len(words.letters)))
    lexical = model.in_lexicon(words)
    pieces = [(a, min(a + k, int(hi))) for lo, hi in zip(words.starts[:-1], words.starts[1:], strict=True) if hi > lo for k in [int(rng.integers(8, length))] for a in range(int(lo), int(hi), k)]
    sums = {"table": np.full_like(model.table, 1e-6), "lexicon": np.full((n, n), 1e-6), "move": np.full((n, n), 1e-6)}
    for _ in range(epochs):
        order = rng.permutation(len(pieces))
        for i in range(0, len(order), 4 * batch):
            chosen = [pieces[k] for k in order[i : i + 4 * batch]]
            index = np.concatenate([np.arange(a, b) for a, b in chosen])
            rows = np.repeat(lengths[index].cumsum() - lengths[index], lengths[index])
            letter = np.repeat(words.at[index], lengths[index]) + np.arange(len(rows)) - rows
            at = lengths[index].cumsum() - lengths[index]
            part = Words(words.letters[letter], at, words.affixes[index], words.hashes[index], np.zeros(0))
            # four pieces make a sequence
            sizes = [sum(b - a for a, b in chosen[k : k + 4]) for k in range(0, len(chosen), 4)]
            starts = np.concatenate([[0], np.cumsum(sizes)])
            e = model.emissions(part)
            unary, pair = _expectations(model, e, starts)
            y = of[index]
            g = -unary
            g[np.arange(len(y)), y] += 1
            inner = np.ones(len(y), dtype=bool)
            inner[starts[:-1]] = False
            moves = np.zeros((n, n))
            np.add.at(moves, (y[:-1][inner[1:]], y[1:][inner[1:]]), 1)
            grads = {"lexicon": lexical[index].T @ g, "move": moves - pair}
            spread = np.repeat(g, lengths[index], axis=0)
            ids = np.concatenate([part.letters[:, 0], part.letters[:, 1], part.affixes[:, 0], part.affixes[:, 1]])
            grads["table"] = np.stack([np.bincount(ids, np.concatenate([spread[:, k], spread[:, k], g[:, k], g[:, k]]), TABLE) for k in range(n)], axis=1)
            for name, grad in grads.items():
                sums[name] += grad**2
                setattr(model, name, (getattr(model, name) + rate * grad / np.sqrt(sums[name])).astype(getattr(model, name).dtype))
    return model


def _expectations(model: Crf, e: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of all words, and expected numbers of transitions, of short sequences."""
    sizes, n = np.diff(starts), len(model.langs)
    longest = int(sizes.max())
    move = np.exp(model.move - model.move.max())
    seq, step = np.repeat(np.arange(len(sizes)), sizes), np.arange(len(e)) - np.repeat(starts[:-1], sizes)
    p = np.zeros((longest, len(sizes), n))
    p[step, seq] = np.exp(e - e.max(axis=1, keepdims=True)) + 1e-30
    there = (np.arange(longest)[:, None] < sizes[None, :])[:, :, None]
    alpha = np.empty_like(p)
    alpha[0] = p[0] / p[0].sum(axis=1, keepdims=True)
    for t in range(1, longest):
        a = (alpha[t - 1] @ move) * p[t]
        alpha[t] = np.where(there[t], a / (a.sum(axis=1, keepdims=True) + 1e-300), alpha[t - 1])
    unary, pair, beta = np.empty_like(p), np.zeros((n, n)), np.ones((len(sizes), n))
    for t in reversed(range(longest)):
        both = alpha[t] * beta
        unary[t] = both / (both.sum(axis=1, keepdims=True) + 1e-300)
        if t:
            b = p[t] * beta
            joint = alpha[t - 1][:, :, None] * move[None] * b[:, None, :]
            total = joint.sum(axis=(1, 2), keepdims=True)
            pair += np.where(there[t][:, :, None], joint / (total + 1e-300), 0).sum(axis=0)
            back = b @ move.T
            beta = np.where(there[t], back / (back.max(axis=1, keepdims=True) + 1e-300), beta)
    return unary[step, seq], pair


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3; never for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, per_lang: int = 300, max_bytes: int = 64_000_000, **options) -> Crf:
    """Fits to per_lang documents of each language at most, held-out ones excepted, and max_bytes of text in all.

    Those first by a hash of the id are taken, whole; languages in turn, as long as they fit max_bytes. Rows that repeat
    an id and a language are one document, the one with the least hash of its text.
    """
    ids = docs.where("lang is not null and text is not null").where(~held_out(F.col("doc_id")))
    ids = ids.select(F.col("lang").alias("g"), F.col("doc_id").cast("long").alias("i"), F.xxhash64("text").alias("t"), F.octet_length("text").alias("n"), F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    # far more than per_lang of each language remain, by their hashes, but no more at any size of the table
    counts = ids.groupBy("g").agg(F.approx_count_distinct("i").alias("c"))
    share = F.least(F.lit(1.0), 4 * (per_lang + 64) / F.col("c"))
    some = ids.join(counts, "g").where((F.shiftrightunsigned("h", 11) / float(1 << 53)) <= share)
    one = some.groupBy("g", "i", "h").agg(F.min(F.struct("t", "n")).alias("r"))
    rank = F.row_number().over(W.partitionBy("g").orderBy("h", "i"))
    chosen = one.select("g", "i", "r.t", "r.n", rank.alias("k")).where(F.col("k") <= per_lang).orderBy("k", "g").collect()
    upto = np.cumsum([r["n"] for r in chosen]) if chosen else np.zeros(0)
    chosen = docs.sparkSession.createDataFrame([(r["g"], r["i"], r["t"]) for r, n in zip(chosen, upto, strict=True) if n <= max_bytes], "g string, i long, t long")
    whole = docs.select(F.col("doc_id").cast("long").alias("i"), F.col("lang").alias("g"), F.col("text").alias("text"), F.xxhash64("text").alias("t"))
    rows = whole.join(F.broadcast(chosen), ["i", "g", "t"]).dropDuplicates(["i", "g", "t"]).select("i", "g", "text").collect()
    rows.sort(key=lambda r: (r["i"] is None, r["i"] or 0, r["g"]))
    return fit([r["text"] for r in rows], [r["g"] for r in rows], **options)


def predict(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of each row by its text alone.

    und with score 0 for a text that is null, empty or has no letter. Repeated rows give repeated results; an empty
    table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, limit=2_000_000):
                found = model.label(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double")


def op6_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
