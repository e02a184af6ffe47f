"""Token counts of sections: documents are encoded once as a whole, tokens are given to sections by their characters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import Encoder, load_encoder, slices
from .common import read

#: What decides on a token over a boundary: the section of its first character, or the one with most of its
#: characters (the earlier of equals).
RULES = ("first", "most")


#: Tokens that are attributed, and rows that are put into a batch, at a time.
TOKENS, ROWS = 1 << 18, 1 << 17


def line_sections(text: str) -> np.ndarray:
    """Ends of a text's lines, each with its line break, in characters; an empty text has one empty section."""
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    breaks = np.flatnonzero(data == 10)
    if len(data) != len(text):
        breaks -= np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), breaks)
    return breaks + 1 if len(breaks) and breaks[-1] + 1 == len(text) else np.append(breaks + 1, len(text))


def attribute(text: str, ids: np.ndarray, lengths: np.ndarray, ends: np.ndarray | list[int], rule: str = "most") -> np.ndarray:
    """Tokens of each section, given the tokens' ids, their bytes (by id) and the sections' ends in characters.

    A token's characters are those that hold its bytes; characters that several tokens share belong to each.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    ends_ = np.asarray(ends, dtype=np.int64)
    counts = np.zeros(len(ends_), dtype=np.int64)
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    inner = np.flatnonzero((data & 0xC0) == 0x80) if len(data) != len(text) else None
    begin = 0
    for k in range(0, len(ids), TOKENS):
        stop = begin + np.cumsum(lengths[ids[k : k + TOKENS]])
        first, last = np.concatenate([[begin], stop[:-1]]), stop - 1
        begin = int(stop[-1])
        if inner is not None:
            # bytes to characters, less the bytes up to there that continue one
            first, last = (x - np.searchsorted(inner, x, side="right") for x in (first, last))
        at = np.searchsorted(ends_, first, side="right")
        if rule == "most":
            far = np.searchsorted(ends_, last, side="right")
            over = np.flatnonzero(far > at)
            if len(over):
                at[over] = _most(first[over], last[over], at[over], far[over], ends_)
        np.add.at(counts, np.minimum(at, len(ends_) - 1), 1)
    return counts


def _most(first: np.ndarray, last: np.ndarray, at: np.ndarray, far: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of sections at to far, the one with most characters of a token from first to last, the earlier of equals."""
    n = far - at + 1
    begin = np.cumsum(n) - n
    section = np.repeat(at - begin, n) + np.arange(int(n.sum()))
    low = np.maximum(np.where(section > 0, ends[section - 1], 0), np.repeat(first, n))
    inside = np.minimum(np.append(ends, np.iinfo(np.int64).max)[section], np.repeat(last + 1, n)) - low
    best = inside == np.repeat(np.maximum.reduceat(inside, begin), n)
    return section[np.flatnonzero(best)[np.searchsorted(np.flatnonzero(best), begin)]]


def count_tokens(docs: DataFrame, encoder: Encoder, sections: Callable[[str], np.ndarray | list[int]] = line_sections, rule: str = "most", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, section, char_start, char_end, n_tokens, doc_tokens), a row for each section of each row of docs.

    Sections are numbered from 0; their tokens add up to doc_tokens. A null text counts as empty: one section without
    tokens. Repeated rows give repeated results, an empty table none; other columns are ignored. Texts of any length and
    any number of sections are counted whole; what is put out at once is bounded.
    """
    lengths = np.zeros(max(encoder.words) + 1, dtype=np.int64)
    for i, w in encoder.words.items():
        lengths[i] = len(w)
    names = ["doc_id", "section", "char_start", "char_end", "n_tokens", "doc_tokens"]

    def batch(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        whole = np.concatenate(parts, axis=1)
        for i in range(0, whole.shape[1], ROWS):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + ROWS], mask=whole[6, i : i + ROWS] == 1 if k == 0 else None) for k, x in enumerate(whole[:6])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to_ids = encoder.encoding()
        parts, n = [], 0
        for b in batches:
            for part in slices(b):
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    text = text or ""
                    ends, ids = np.asarray(sections(text), dtype=np.int64), np.frombuffer(to_ids(text), dtype="<u4")
                    one = np.empty((7, len(ends)), dtype=np.int64)
                    one[0], one[1], one[2] = doc or 0, np.arange(len(ends)), np.concatenate([[0], ends[:-1]])
                    one[3], one[4], one[5], one[6] = ends, attribute(text, ids, lengths, ends, rule), len(ids), doc is None
                    parts.append(one)
                    n += len(ends)
                    if n >= ROWS:
                        yield from batch(parts)
                        parts, n = [], 0
        if parts:
            yield from batch(parts)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{x} long" for x in names))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each line of all documents."""
    return count_tokens(read(spark, sf_dir, "documents"), load_encoder())
