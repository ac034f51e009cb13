"""Quality by hierarchical empirical Bayes.

A document's own evidence is the log odds of a logistic classifier (words and shape of the text). Sites sharpen it: the
expected number of good documents of a host, and of each path of the host, give posteriors that are shrunk towards
the level above, the host towards the corpus and the path towards the host. How strongly follows from the data: the
prior counts as many documents as make the spread between hosts (paths) what it is, so a sparse site says little. A
document's prior is then the posterior of its path without the document itself, and Bayes' rule joins the two:
log odds = evidence - log odds of the training labels + log odds of that prior.

The levels are grouped sums over all documents; only sums are shuffled, and partially summed before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, starts_of, sums_by, texts_of, words_of
from .features import logit, pairs_of, sigmoid, telling, word_codes

DIMENSION = 1 << 18
SLICE_BYTES = 2 << 20
#: Shape of a text: logs of its words, share of letters, of white space, of distinct words, mean length of words.
SHAPE = 5
#: A level's prior counts for these many documents at least and at most.
LEAST_PRIOR, MOST_PRIOR = 2.0, 1e6


@dataclass
class Model:
    """weights: of DIMENSION words; shape: of the SHAPE numbers, standardised by mean and spread; prior: share of good labels."""

    bias: float
    weights: np.ndarray
    shape: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    prior: float


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, code) pairs and the shape of each text."""
    n = len(texts)
    words, owner = words_of(texts)
    codes = word_codes(words, DIMENSION)
    doc, code = pairs_of(owner, codes, DIMENSION)
    count, distinct = np.diff(starts_of(owner, n)), np.bincount(doc, minlength=n)
    chars = np.asarray(pc.utf8_length(texts), dtype=float)
    letters = chars - np.asarray(pc.count_substring_regex(texts, r"[^\pL\s]"), dtype=float)
    held = sums_by(owner, np.asarray(pc.utf8_length(words), dtype=float), n)
    shape = np.stack([np.log1p(count), letters / np.maximum(chars, 1), held / np.maximum(chars, 1), distinct / np.maximum(count, 1), held / np.maximum(count, 1)], axis=1)
    return doc, code, shape


def fit(docs: DataFrame, labels: DataFrame, most_labels: int = 6000, steps: int = 300, ridge: float = 1e-3, test_bin: int = 2) -> Model:
    """A logistic classifier of at most ``most_labels`` labelled documents (of smallest hash; those with
    crc32(doc_id) mod 4 = ``test_bin`` left for tests). With labels of one kind or none, it says the prior of all."""
    chosen = (
        labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != test_bin))
        .groupBy("doc_id")
        .agg(F.max("quality").cast("int").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labels)
    )

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            doc, code, shape = text_features(texts_of(batch))
            bounds = starts_of(doc, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("quality"), pa.array([code[a:b].astype(np.int32) for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.list_(pa.int32())), pa.array(list(shape), pa.list_(pa.float64()))],
                names=["doc_id", "quality", "code", "shape"],
            )

    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    made = texts.mapInArrow(features, "doc_id long, quality int, code array<int>, shape array<double>")
    # Of several rows of a labelled document one counts, so no more rows than labels are collected.
    one = made.groupBy("doc_id", "quality").agg(F.min(F.struct("code", "shape")).alias("_row")).select("doc_id", "quality", "_row.*")
    rows = sorted(one.collect(), key=lambda r: r["doc_id"])
    y = np.array([r["quality"] for r in rows], dtype=np.int64)
    flat = Model(0.0, np.zeros(DIMENSION), np.zeros(SHAPE), np.zeros(SHAPE), np.ones(SHAPE), 0.5)
    if not len(y) or y.min() == y.max():
        return flat
    prior = float(y.mean())
    shape = np.array([r["shape"] for r in rows])
    mean, spread = shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-9)
    shape = (shape - mean) / spread
    doc = np.repeat(np.arange(len(rows)), [len(r["code"]) for r in rows])
    code = np.concatenate([np.asarray(r["code"], dtype=np.int64) for r in rows])
    used = telling(doc, code, y, DIMENSION)
    place = np.full(DIMENSION, -1)
    place[used] = np.arange(len(used))
    keep = place[code] >= 0
    doc, feature = doc[keep], place[code[keep]]

    n, k = len(rows), len(used)
    theta = np.zeros(k + SHAPE + 1)
    theta[-1] = logit(prior)
    moment, square = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        slope = (sigmoid(sums_by(doc, theta[feature], n) + shape @ theta[k:-1] + theta[-1]) - y) / n
        grad = np.concatenate([np.bincount(feature, weights=slope[doc], minlength=k), shape.T @ slope, [slope.sum()]]) + ridge * np.append(theta[:-1], 0.0)
        moment = 0.9 * moment + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        theta = theta - 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros(DIMENSION)
    weights[used] = theta[:k]
    return Model(float(theta[-1]), weights, theta[k:-1], mean, spread, prior)


def evidence(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, host, path, evidence: the classifier's log odds for each row of ``docs`` (doc_id, text, host, path)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, "text", SLICE_BYTES):
            doc, code, shape = text_features(texts_of(batch))
            value = own.bias + sums_by(doc, own.weights[code], batch.num_rows) + ((shape - own.mean) / own.spread) @ own.shape
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("host"), batch.column("path"), pa.array(value)], names=["doc_id", "host", "path", "evidence"])

    return docs.select("doc_id", "text", "host", "path").mapInArrow(scored, "doc_id long, host string, path string, evidence double")


def _prior_count(level: DataFrame) -> Column:
    """As many documents as a beta prior counts, whose spread is that of the groups' means ``m`` beyond sampling noise.

    ``level``'s columns, one row for each group: n, good (expected good documents), up (the mean of the level above).
    """
    noise = F.col("up") * (1 - F.col("up"))
    between = F.sum(F.col("n") * (F.col("good") / F.col("n") - F.col("up")) ** 2) / F.sum("n")
    within = F.sum(noise) / F.sum("n")  # sum of n * noise / n over the sum of n
    level_noise = F.sum(F.col("n") * noise) / F.sum("n")
    spread = between - within
    return F.least(F.lit(MOST_PRIOR), F.greatest(F.lit(LEAST_PRIOR), F.when(spread > 0, level_noise / spread - 1).otherwise(F.lit(MOST_PRIOR))))


def posteriors(scored: DataFrame, train_prior: float, keep_at: float = 0.5) -> DataFrame:
    """doc_id, host, path, evidence, host_posterior, path_posterior, quality, keep: one row for each row of ``scored``.

    Null hosts form one host, null paths one path of their host. The levels' priors are single rows; the path table joins
    by (host, path), where Spark splits partitions of hot paths.
    """
    rows = scored.withColumn("_h", F.coalesce(F.concat(F.lit("h"), F.col("host")), F.lit(""))).withColumn("_p", F.coalesce(F.concat(F.lit("p"), F.col("path")), F.lit(""))).withColumn("_good", 1 / (1 + F.exp(-F.col("evidence"))))
    paths = cut(rows.groupBy("_h", "_p").agg(F.count(F.lit(1)).alias("n"), F.sum("_good").alias("good")))
    corpus = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    overall = float(np.clip((corpus["good"] or 0.0) / max(1, corpus["n"] or 0), 1e-6, 1 - 1e-6))
    hosts = paths.groupBy("_h").agg(F.sum("n").alias("n"), F.sum("good").alias("good")).withColumn("up", F.lit(overall))
    k_host = hosts.agg(_prior_count(hosts)).first()[0] or LEAST_PRIOR
    hosts = hosts.select("_h", ((F.col("good") + k_host * F.col("up")) / (F.col("n") + k_host)).alias("host_posterior"))
    levels = paths.join(hosts, "_h").withColumn("up", F.col("host_posterior"))
    k_path = levels.agg(_prior_count(levels)).first()[0] or LEAST_PRIOR
    levels = levels.select("_h", "_p", "n", "good", "host_posterior")
    prior = (F.col("good") - F.col("_good") + k_path * F.col("host_posterior")) / (F.col("n") - 1 + k_path)
    bounded = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), prior))
    odds = F.col("evidence") - float(logit(train_prior)) + F.log(bounded / (1 - bounded))
    return (
        rows.join(levels, ["_h", "_p"])
        .withColumn("path_posterior", (F.col("good") + k_path * F.col("host_posterior")) / (F.col("n") + k_path))
        .withColumn("quality", 1 / (1 + F.exp(-odds)))
        .select("doc_id", "host", "path", "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= keep_at).alias("keep"))
    )


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, **options) -> DataFrame:
    """Quality of every row of ``docs`` (doc_id, text); see ``posteriors``. A null text counts as empty."""
    model = fit(docs, labels, **options)
    scored = cut(evidence(docs.select("doc_id", "text", host.cast("string").alias("host"), path.cast("string").alias("path")), model))
    return posteriors(scored, model.prior)
