"""From raw documents to training tokens: five stages, each over all rows that the one before kept.

Quality classifier (rejected documents go), near-dedup (one document of each group stays), secret scans (secrets are
replaced), mixing (documents as often as the mix takes them), byte-level BPE (ids, decoded again as a check).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lamella.llm import bpe, mixing, near_dedup, quality_classifier, secrets
from lamella.llm.common import materialize, read


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier doesn't reject; it learns from labels and from docs."""
    return quality_classifier.keep_good(docs, quality_classifier.train(docs, read(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of documents linked by 0.8 of their five-word shingles."""
    return near_dedup.deduplicate(docs, width=5, threshold=0.8)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with [SECRET] in place of each secret and n_chars counted anew."""
    return secrets.redact(docs, secrets.train(secrets.labelled_samples(spark)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often (0 to 3 times) as the mix of sources takes it."""
    return mixing.resample(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (little-endian unsigned 32-bit), and digests of the ids and of the bytes they decode to."""
    return bpe.round_trip(docs, bpe.load_encoder(), with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: SQL can express neither the classifier nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result but the last is written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
