"""Quality classifier by co-training: a view of the text and a view of the page's metadata teach each other.

Both are logistic regressions. Each round, each view labels all unlabelled documents, and of those it is most sure of
some pass to the other's training set. Then both are calibrated on labelled documents kept aside, and their log-odds are
combined. Fitting takes a bounded sample of labelled rows (max_labelled) and of pseudo-labels (max_pseudo a round, view
and kind), whose features, not texts, come to the driver; all documents are scored in Arrow batches without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import slices
from .common import discard, materialize, read
from .shingles import mix, word_hashes

GRAMS = 1024
META = 256
DENSE = ("upper", "digit", "mark", "symbol", "other", "lines", "word", "distinct", "same", "again", "line_again", "size")
CUTS = 12
_CLASS = np.zeros(256, dtype=np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 2
_CLASS[[c for c in range(33, 127) if not chr(c).isalnum()]] = 4
_CLASS[[ord(c) for c in "#*$%&|<>"]] = 5
_CLASS[[9, 10, 11, 12, 13, 32]] = 6


def text_view(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Square roots of the shares of hashed byte trigrams (letters by class, other bytes as they are), and DENSE."""
    coded = [t.encode() for t in texts]
    data = np.frombuffer(b"\n".join([*coded, b""]), dtype=np.uint8)
    kind = _CLASS[data]
    symbol = np.where((kind >= 1) & (kind <= 3), kind, data).astype(np.uint32)
    gram = (symbol << 16)
    gram[1:] |= symbol[:-1] << 8
    gram[2:] |= symbol[:-2]
    gram = ((gram.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int32)
    words, starts = word_hashes(coded)
    windows = np.zeros(max(0, len(words) - 7), dtype=np.uint64)
    for k in range(8):
        windows = windows * np.uint64(0xD6E8FEB86659FD93) + words[k : k + len(windows)]
    grams, dense = np.zeros((len(texts), GRAMS), dtype=np.float32), np.zeros((len(texts), len(DENSE)), dtype=np.float32)
    at = 0
    for i, t in enumerate(coded):
        n, (a, b) = len(t), starts[i : i + 2].tolist()
        if n:
            grams[i] = np.sqrt(np.bincount(gram[at : at + n], minlength=GRAMS) / n)
            c = np.bincount(kind[at : at + n], minlength=7)
            own = words[a:b]
            w = max(1, b - a)
            lines = [x for x in t.split(b"\n") if x.strip()]
            again = 1 - len(np.unique(windows[a : b - 7])) / (b - a - 7) if b - a > 8 else 0.0
            dense[i] = (
                c[1] / n, c[3] / n, c[4] / n, c[5] / w, c[0] / n, len(lines) / w, (n - c[6]) / w, len(np.unique(own)) / w,
                np.count_nonzero(own[1:] == own[:-1]) / w, again, 1 - len(set(lines)) / max(1, len(lines)), np.log1p(n),
            )
        at += n + 1
    return grams, dense


def meta_view(source: list, lang: list, n_chars: list) -> np.ndarray:
    """Hashed indicators of source, language, length and language with length, META columns."""
    out = np.zeros((len(source), META), dtype=np.float32)
    for i, (s, g, n) in enumerate(zip(source, lang, n_chars, strict=True)):
        size = -1 if n is None else int(np.log2(max(1, n)) * 2)
        for name in (f"s{s}", f"l{g}", f"n{size}", f"x{g} {size}"):
            out[i, xxhash.xxh3_64_intdigest(name) % META] = 1
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 150, start: np.ndarray | None = None) -> np.ndarray:
    """Weights, the last for the constant, of a regularized logistic regression (accelerated gradient steps)."""
    x = np.concatenate([x, np.ones((len(x), 1), dtype=np.float32)], axis=1)
    w = np.zeros(x.shape[1], dtype=np.float32) if start is None else start.copy()
    scale = np.full(len(w), penalty, dtype=np.float32)
    scale[-1] = 1e-3
    # a bound of the curvature, by a few power iterations
    v = np.ones(len(w), dtype=np.float32)
    for _ in range(8):
        v = x.T @ ((x @ v) * weight) / 4
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate, z, before = 1 / (1.2 * top + penalty), w.copy(), w.copy()
    for k in range(1, steps + 1):
        w = z - rate * (x.T @ (weight * (sigmoid(x @ z) - y)) + scale * z)
        z, before = w + (k - 1) / (k + 2) * (w - before), w
    return w.astype(np.float32)


@dataclass
class QualityModel:
    """Cuts of the dense features, weights of both views, their calibrations and the threshold to keep."""

    cuts: np.ndarray
    text: np.ndarray
    meta: np.ndarray
    calibration: list[tuple[float, float]] = field(default_factory=lambda: [(1.0, 0.0), (1.0, 0.0)])
    combine: tuple[float, float, float] = (1.0, 1.0, 0.0)
    threshold: float = 0.0

    def expand(self, grams: np.ndarray, dense: np.ndarray) -> np.ndarray:
        return expand(grams, dense, self.cuts)

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of good quality by text, by metadata and by both."""
        odds = [a * (x @ w[:-1] + w[-1]) + b for x, w, (a, b) in zip((text, meta), (self.text, self.meta), self.calibration, strict=True)]
        both = self.combine[0] * odds[0] + self.combine[1] * odds[1] + self.combine[2]
        return sigmoid(odds[0]), sigmoid(odds[1]), sigmoid(both)


def expand(grams: np.ndarray, dense: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Trigram shares, and for each dense feature the cuts it passes."""
    passed = (dense[:, :, None] > cuts[None]).reshape(len(dense), cuts.size)
    return np.concatenate([grams, passed.astype(np.float32)], axis=1)


def _calibrate(odds: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and constant of a logistic regression of y on the odds, with Platt's smoothed targets."""
    odds = odds.reshape(len(y), -1).astype(np.float32)
    good = y.sum()
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2)).astype(np.float32)
    return tuple(float(v) for v in logistic(odds, target, np.ones(len(y), dtype=np.float32), 1e-2, 300))


class CoTrainer:
    """Labelled rows, with y 1 (good) or 0 (bad), and what each view has been told by the other.

    Every fourth labelled row only calibrates and sets the threshold.
    """

    def __init__(self, text: np.ndarray, dense: np.ndarray, meta: np.ndarray, y: np.ndarray):
        self.cuts = np.quantile(dense, np.linspace(0, 1, CUTS + 2)[1:-1], axis=0).T.astype(np.float32) if len(y) else np.zeros((len(DENSE), CUTS), dtype=np.float32)
        views, own = [expand(text, dense, self.cuts), meta], np.arange(len(y)) % 4 > 0
        self.aside, self.aside_y = [v[~own] for v in views], y[~own]
        self.rows, self.believed, self.trust = ([[v[own]] for v in views], [[y[own]], [y[own]]], [[np.ones(own.sum())], [np.ones(own.sum())]])
        self.weights: list[np.ndarray] = [np.zeros(v.shape[1] + 1, dtype=np.float32) for v in views]
        self.ready = len(set(y[own].tolist())) == 2 == len(set(y[~own].tolist()))

    def fit(self) -> None:
        for k in (0, 1):
            x, y, trust = (np.concatenate(part[k]).astype(np.float32) for part in (self.rows, self.believed, self.trust))
            self.weights[k] = logistic(x, y, trust, start=self.weights[k] if self.weights[k].any() else None)

    def odds(self, k: int, x: np.ndarray) -> np.ndarray:
        return x @ self.weights[k][:-1] + self.weights[k][-1]

    def calibration(self, k: int) -> tuple[float, float]:
        """Only as sure as it is right: what a view calls sure is held against the rows aside."""
        return _calibrate(self.odds(k, self.aside[k]), self.aside_y)

    def tell(self, k: int, text: np.ndarray, dense: np.ndarray, meta: np.ndarray, y: np.ndarray) -> None:
        """View k learns these rows, as the other view labels them."""
        self.rows[k].append(meta if k else expand(text, dense, self.cuts))
        self.believed[k].append(y)
        self.trust[k].append(np.full(len(y), 0.3))

    def model(self, max_loss: float) -> QualityModel:
        """Both views calibrated and combined; the threshold is the highest that rejects no more than max_loss of the good rows aside."""
        model = QualityModel(self.cuts, *self.weights)
        if not self.ready:
            return model
        odds = np.stack([self.odds(k, self.aside[k]) for k in (0, 1)], axis=1)
        model.calibration = [_calibrate(odds[:, k], self.aside_y) for k in (0, 1)]
        model.combine = _calibrate(odds * [a for a, _ in model.calibration] + [b for _, b in model.calibration], self.aside_y)
        good = np.sort(model.scores(*self.aside)[2][self.aside_y == 1])
        model.threshold = float(min(0.5, good[int(max_loss * len(good))]))
        return model


def _features(texts: list, source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    grams, dense = text_view([t or "" for t in texts])
    return grams, dense, meta_view(source, lang, n_chars)


def _columns(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("source"), F.col("lang"), F.col("n_chars").cast("long").alias("n_chars")]


def _chosen_features(docs: DataFrame, chosen: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Features of the documents whose id is in chosen (_lamella_id, a bounded number), one row for each id, in a fixed order.

    Of rows that repeat an id, the one with the least hash of its columns.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, 1, 1_000_000):
                parts = _features(*[part.column(k).to_pylist() for k in range(1, 5)])
                packed = [pa.array([x.astype(np.float16 if k == 0 else np.float32).tobytes() for x in v], pa.binary()) for k, v in enumerate(parts)]
                yield pa.RecordBatch.from_arrays([part.column(0), *packed], names=["doc_id", "text", "dense", "meta"])

    rows = docs.select(*_columns(docs)).join(F.broadcast(chosen), F.col("doc_id") == F.col("_lamella_id"))
    rest = ("text", "source", "lang", "n_chars")
    one = rows.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("r")).select("doc_id", *[f"r.{c}" for c in rest])
    got = one.mapInArrow(run, "doc_id long, text binary, dense binary, meta binary").collect()
    got.sort(key=lambda r: int(mix(np.array([r["doc_id"]]).astype(np.uint64))[0]))
    unpack = lambda x, kind: np.frombuffer(x, dtype=kind).astype(np.float32)
    return {r["doc_id"]: (unpack(r["text"], np.float16), unpack(r["dense"], np.float32), unpack(r["meta"], np.float32)) for r in got}


def _stacked(features: dict, ids: list[int]) -> list[np.ndarray]:
    widths = (GRAMS, len(DENSE), META)
    return [np.stack([features[i][k] for i in ids]) if ids else np.zeros((0, w), dtype=np.float32) for k, w in enumerate(widths)]


def _all_odds(docs: DataFrame, trainer: CoTrainer) -> DataFrame:
    """(doc_id, odds0, odds1) of each row with an id, by the views' present weights, calibrated."""
    cuts, weights, fitted = trainer.cuts, trainer.weights, [trainer.calibration(k) for k in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, limit=2_000_000):
                grams, dense, meta = _features(*[part.column(k).to_pylist() for k in range(1, 5)])
                odds = [a * (x @ w[:-1] + w[-1]) + c for x, w, (a, c) in zip((expand(grams, dense, cuts), meta), weights, fitted, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.float64()) for x in odds)], names=["doc_id", "odds0", "odds1"])

    return docs.select(*_columns(docs)).where("doc_id is not null").mapInArrow(run, "doc_id long, odds0 double, odds1 double")


def train(docs: DataFrame, labels: DataFrame, *, max_labelled: int = 4000, max_pseudo: int = 1000, rounds: int = 2, per_round: float = 0.05, sure: float = 0.95, max_loss: float = 0.005) -> QualityModel:
    """Co-trains on labelled (labels: doc_id, quality) and all unlabelled documents.

    Of the labelled ones, max_labelled at most take part, those first by a hash of their id. Each round each view labels
    all unlabelled documents; its surest per_round on each side, if it is sure of them, are what the other view learns
    from, of which at most max_pseudo of a kind, first by a hash, are taken. A document labelled both ways counts as bad;
    rows that repeat an id are one document. Without labels of both kinds: a model that keeps all.
    """
    by_id = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_lamella_id")).agg(F.min("quality").alias("_lamella_y"))
    some = by_id.orderBy(F.xxhash64("_lamella_id"), "_lamella_id").limit(max_labelled)
    quality = {r["_lamella_id"]: r["_lamella_y"] for r in some.collect()}
    features = _chosen_features(docs, some.select("_lamella_id"))
    trainer = CoTrainer(*_stacked(features, list(features)), np.array([quality[i] for i in features], dtype=np.int64))
    if not trainer.ready:
        return trainer.model(max_loss)
    told: list[set[int]] = [set(), set()]
    edge = math.log(sure / (1 - sure))
    trainer.fit()
    for _ in range(rounds):
        odds = materialize(_all_odds(docs, trainer).join(by_id.select(F.col("_lamella_id").alias("doc_id")), "doc_id", "left_anti"), "odds")
        low0, low1, high0, high1 = odds.agg(*[F.percentile_approx(f"odds{k}", q, 1000) for q in (per_round, 1 - per_round) for k in (0, 1)]).first()
        if low0 is None:
            break
        picks = []
        for k, low, high in ((0, low0, high0), (1, low1, high1)):
            c = F.col(f"odds{k}")
            for y, rule in ((0, (c <= low) & (c < -edge)), (1, (c >= high) & (c > edge))):
                ids = odds.where(rule).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(k)), "doc_id").limit(max_pseudo)
                picks.append(ids.select(F.col("doc_id").alias("_lamella_id"), F.lit(k).alias("view"), F.lit(y).alias("y")))
        found = [tuple(r) for r in reduce(DataFrame.unionAll, picks).collect()]
        new = _chosen_features(docs, docs.sparkSession.createDataFrame(sorted({(i,) for i, _, _ in found}), "_lamella_id long"))
        discard(odds)
        for k in (0, 1):
            # a document that repeats an id may be sure of both kinds: it is left out
            sides = Counter(i for i, v, _ in found if v == k)
            own = sorted((i, y) for i, v, y in found if v == k and sides[i] == 1 and i not in told[1 - k] and i in new)
            told[1 - k] |= {i for i, _ in own}
            trainer.tell(1 - k, *_stacked(new, [i for i, _ in own]), np.array([y for _, y in own], dtype=np.int64))
        trainer.fit()
    return trainer.model(max_loss)


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, p_text, p_meta, score, kept) of each row of docs (doc_id, text, source, lang, n_chars).

    A null text counts as empty; null metadata are values of their own; repeated rows give repeated results; an empty
    table gives none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, limit=2_000_000):
                grams, dense, meta = _features(*[part.column(k).to_pylist() for k in range(1, 5)])
                p = model.scores(model.expand(grams, dense), meta)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x, pa.float64()) for x in p), pa.array(p[2] >= model.threshold)], names=["doc_id", "p_text", "p_meta", "score", "kept"])

    return docs.select(*_columns(docs)).mapInArrow(run, "doc_id long, p_text double, p_meta double, score double, kept boolean")


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows of docs, with all their columns, that the model keeps; no shuffle."""
    at = [docs.columns.index(c) for c in ("text", "source", "lang", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, at[0], 2_000_000):
                grams, dense, meta = _features(*[part.column(k).to_pylist() for k in at])
                yield part.filter(pa.array(model.scores(model.expand(grams, dense), meta)[2] >= model.threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, train(docs, read(spark, sf_dir, "labels")))
