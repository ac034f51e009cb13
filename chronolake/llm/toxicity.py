"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence is toxic with probability sigmoid(bias + sum of the weights of its words and their beginnings), a
document with 1 - product over its sentences of (1 - probability): noisy-or. Only documents have labels; the likelihood
of these trains the word weights, and the sentence probabilities then show where the toxic sentences are.

The model is fitted on at most ``most_labels`` labelled documents (those of smallest hash), read with Spark as feature
codes; scoring covers every whole text, in bounded slices, with a weight table of fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, in_short_batches, ragged, slices, starts_of, sums_by, texts_of
from .features import sigmoid, telling_counts, word_and_stem_codes

SENTENCE_END = r"[.!?\n]+"
DIMENSION = 1 << 18
SLICE_BYTES = 1 << 20
HELD_OUT = 2


@dataclass
class Model:
    """weights has DIMENSION entries."""

    bias: float
    weights: np.ndarray


def sentences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document of each sentence, its number there; sentence of each word, its distinct word; features of these).

    Each text has one sentence at least.
    """
    parts, doc = ragged(pc.split_pattern_regex(texts, SENTENCE_END))
    number = np.arange(len(doc)) - starts_of(doc, len(texts))[doc] if len(doc) else np.zeros(0, np.int64)
    words, owner = ragged(pc.utf8_split_whitespace(parts))
    codes, which = word_and_stem_codes(words, DIMENSION)
    return doc, number, owner, which, codes


def noisy_or(doc: np.ndarray, p: np.ndarray, n: int) -> np.ndarray:
    return 1 - np.exp(sums_by(doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n))


def slope_of(p: np.ndarray, bag: np.ndarray, doc: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How the negative log likelihood of the bags' labels ``y`` changes with each sentence's score: p for y = 0, p * (1 - 1 / bag) for y = 1."""
    return p * np.where(y[doc] == 1, 1 - 1 / bag[doc], 1.0)


def sentence_scores(model: Model, n: int, owner: np.ndarray, which: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The weights of a word are summed once for each distinct word."""
    own = np.where(codes >= 0, model.weights[codes], 0.0).sum(axis=1)
    return sigmoid(model.bias + sums_by(owner, own[which], n))


def held_out(doc_id="doc_id"):
    """Rows that no label is learned from."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 4 == HELD_OUT


def training_bags(docs: DataFrame, labels: DataFrame, most_labels: int) -> DataFrame:
    """doc_id, toxic, n_sentences, sentence, code (32-bit integers as bytes): at most ``most_labels`` labels, those of smallest hash.

    Of the rows of one doc_id one counts, that of the smallest bag.
    """
    chosen = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            doc, number, owner, which, codes = sentences(texts_of(batch))
            at, column = np.nonzero(codes[which] >= 0)
            sentence, code = owner[at], codes[which[at], column]
            bounds = starts_of(doc[sentence], batch.num_rows) if len(sentence) else np.zeros(batch.num_rows + 1, np.int64)
            spans = list(zip(bounds[:-1], bounds[1:], strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("toxic"),
                    pa.array(np.bincount(doc, minlength=batch.num_rows).astype(np.int32)),
                    pa.array([number[sentence[a:b]].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                    pa.array([code[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary()),
                ],
                names=["doc_id", "toxic", "n_sentences", "sentence", "code"],
            )

    made = in_short_batches(texts).mapInArrow(bags, "doc_id long, toxic int, n_sentences int, sentence binary, code binary")
    one = made.groupBy("doc_id", "toxic").agg(F.min(F.struct("n_sentences", "sentence", "code")).alias("_bag"))
    return one.select("doc_id", "toxic", "_bag.*")


def feature_counts(bags: DataFrame) -> DataFrame:
    """code, held, ones: documents, and toxic documents, that hold each feature; DIMENSION rows at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ones = np.zeros(DIMENSION, np.int64), np.zeros(DIMENSION, np.int64)
        for batch in batches:
            for toxic, code in zip(batch.column("toxic").to_pylist(), batch.column("code").to_pylist(), strict=True):
                own = np.unique(np.frombuffer(code, np.int32))
                held[own] += 1
                ones[own] += toxic
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(held[some]), pa.array(ones[some])], names=["code", "held", "ones"])

    return bags.select("toxic", "code").mapInArrow(counted, "code long, held long, ones long").groupBy("code").agg(F.sum("held").alias("held"), F.sum("ones").alias("ones")).where(F.col("held") >= 5)


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 8000, steps: int = 300, ridge: float = 1e-3) -> Model:
    """The model of the training rows of ``labels`` (doc_id, toxic); without any of one kind, all weights are 0.

    Of several rows of a labelled document one counts; a document labelled twice is toxic if either says so. Only
    features that tell the labels apart are trained and collected.
    """
    weights = np.zeros(DIMENSION)
    bags = cut(training_bags(docs, labels, most_labels))
    y_n, y_1 = bags.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    y_1 = y_1 or 0
    if not y_1 or y_1 == y_n:
        return Model(float(np.log(1e-3)) if not y_1 else 0.0, weights)
    held, ones = np.zeros(DIMENSION), np.zeros(DIMENSION)
    for r in feature_counts(bags).collect():
        held[r["code"]], ones[r["code"]] = r["held"], r["ones"]
    used = telling_counts(held, ones, y_1, y_n)
    place = np.full(DIMENSION, -1)
    place[used] = np.arange(len(used))

    def telling_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for s, c in zip(batch.column("sentence").to_pylist(), batch.column("code").to_pylist(), strict=True):
                own = place[np.frombuffer(c, np.int32)]
                out.append((np.frombuffer(s, np.int32)[own >= 0].tobytes(), own[own >= 0].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "toxic", "n_sentences")), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=batch.schema.names) if out else batch

    rows = sorted(bags.mapInArrow(telling_only, bags.schema).collect(), key=lambda r: (r["doc_id"], r["n_sentences"]))
    y = np.array([r["toxic"] for r in rows], dtype=np.int64)
    doc = np.repeat(np.arange(len(rows)), [r["n_sentences"] for r in rows])
    before = np.concatenate([[0], np.cumsum([r["n_sentences"] for r in rows])])
    owner = np.concatenate([np.frombuffer(r["sentence"], np.int32).astype(np.int64) + before[k] for k, r in enumerate(rows)])
    feature = np.concatenate([np.frombuffer(r["code"], np.int32).astype(np.int64) for r in rows])

    n, w, bias = len(rows), np.zeros(len(used)), -4.0
    moment, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        p = sigmoid(bias + sums_by(owner, w[feature], len(doc)))
        bag = np.clip(noisy_or(doc, p, n), 1e-9, 1 - 1e-9)
        slope = slope_of(p, bag, doc, y)
        grad = np.append(np.bincount(feature, weights=slope[owner], minlength=len(used)), slope.sum()) / n + np.append(ridge * w, 0.0)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = 0.1 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    weights[used] = w
    return Model(float(bias), weights)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, keep_sentences: bool = False, passing: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``passing`` of ``docs``, score, predicted, n_sentences, worst_sentence, worst_score (and sentences: number and score of each at the threshold or above).

    One row for each row of ``docs``. A null or empty text is one sentence without words: it gets the bias alone.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passing) + ", score double, n_sentences int, worst_sentence int, worst_score double" + ", sentences array<struct<number: int, score: double>>" * keep_sentences

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text", SLICE_BYTES):
            n = batch.num_rows
            doc, number, owner, which, codes = sentences(texts_of(batch))
            p = sentence_scores(own, len(doc), owner, which, codes)
            bounds = starts_of(doc, n)
            worst = np.maximum.reduceat(p, bounds[:-1])
            first = np.full(n, -1)
            at = np.flatnonzero(p == worst[doc])[::-1]
            first[doc[at]] = number[at]
            columns = [*(batch.column(c) for c in passing), pa.array(noisy_or(doc, p, n)), pa.array(np.diff(bounds).astype(np.int32)), pa.array(first.astype(np.int32)), pa.array(worst)]
            if keep_sentences:
                over = np.flatnonzero(p >= threshold)
                offsets = np.searchsorted(doc[over], np.arange(n + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(number[over].astype(np.int32)), pa.array(p[over])], ["number", "score"])
                columns.append(pa.ListArray.from_arrays(pa.array(offsets), spans))
            yield pa.RecordBatch.from_arrays(columns, names=[*passing, "score", "n_sentences", "worst_sentence", "worst_score"] + ["sentences"] * keep_sentences)

    return in_short_batches(docs).select(*dict.fromkeys([*passing, "text"])).mapInArrow(scored, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
