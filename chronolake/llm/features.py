"""Hashed word features of texts, shared by the classifiers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

#: Marks that are taken off both ends of a word.
MARKS = ",;:\"'()[]{}<>*_-!?.…«»„“”‘’"


def word_codes(words: pa.Array, dimension: int) -> np.ndarray:
    """A feature in 0 .. dimension - 1 for each word, without case and outer marks."""
    coded = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=MARKS)
    hashed = pd.util.hash_array(np.asarray(plain.to_pylist(), dtype=object), categorize=False) if len(plain) else np.zeros(0, np.uint64)
    return (hashed % np.uint64(dimension)).astype(np.int64)[np.asarray(coded.indices, dtype=np.int64)]


#: Beginnings of words that are features too, in characters.
STEMS = (3, 4, 5, 6, 7)


def word_and_stem_codes(words: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(features of each distinct word: itself and its beginnings, -1 where it is too short; the distinct word of each word)."""
    coded = words.dictionary_encode()
    plain = pc.utf8_trim(pc.utf8_lower(coded.dictionary), characters=MARKS)
    longs = np.asarray(pc.utf8_length(plain), dtype=np.int64)
    columns = []
    for k in (0, *STEMS):
        part = np.asarray((pc.utf8_slice_codeunits(plain, 0, k) if k else plain).to_pylist(), dtype=object)
        hashed = ((pd.util.hash_array(part, categorize=False) + np.uint64(7919 * k)) % np.uint64(dimension)).astype(np.int64) if len(part) else np.zeros(0, np.int64)
        columns.append(np.where(longs >= max(k, 1), hashed, -1))
    return np.stack(columns, axis=1), np.asarray(coded.indices, dtype=np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logit(p):
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def pairs_of(owner: np.ndarray, codes: np.ndarray, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, code) pairs."""
    both = np.unique(owner * dimension + codes)
    return both // dimension, both % dimension


def telling(docs: np.ndarray, codes: np.ndarray, labels: np.ndarray, dimension: int, least_docs: int = 5, least_z: float = 4.0) -> np.ndarray:
    """Features whose share of documents differs between the labels by ``least_z`` standard errors."""
    ones = np.bincount(codes, weights=labels[docs].astype(float), minlength=dimension)
    return telling_counts(np.bincount(codes, minlength=dimension), ones, int(labels.sum()), len(labels), least_docs, least_z)


def telling_counts(held: np.ndarray, ones: np.ndarray, positive: int, n: int, least_docs: int = 5, least_z: float = 4.0) -> np.ndarray:
    """The same from counts: documents, and positive documents, that hold each feature."""
    n1, n0 = max(1, positive), max(1, n - positive)
    p1, p0, p = ones / n1, (held - ones) / n0, held / max(1, n)
    z = np.abs(p1 - p0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    return np.flatnonzero((held >= least_docs) & (z >= least_z))
