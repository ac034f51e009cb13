"""Nearest neighbours by largest inner product, with randomly rotated one-bit codes.

A vector's difference from the centre is rotated by a fixed random rotation and kept as the signs of its coordinates,
packed in 64-bit words, with three correction scalars: its length, its product with the centre's direction, and how far
the signs point along it. A query is quantised to bit planes; products of its planes with a code are counts of common
bits, and the scalars turn them into an unbiased estimate of the inner product with a known error. In each block the
``first`` best estimates are scored exactly; then every vector whose estimate plus its error bound reaches the k-th best
exact score is scored exactly too. Only those are reranked, in double precision, on the original vectors.

Every vector is coded once; codes and scalars are stored beside it. Queries and vectors are dealt into blocks of bounded
bytes; each task compares one block of queries with one of codes and touches the originals of the chosen rows only, so no
side is broadcast or collected, and each block passes on k rows for a query. Vectors of different lengths never meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, join_by_key

#: Bytes of vectors in a block of queries and in one of candidates.
QUERY_BYTES, VECTOR_BYTES = 256 << 10, 8 << 20
#: Bits of a quantised query coordinate.
QUERY_BITS = 8
#: Standard errors in the bound on an estimate: a vector beyond it is missed with a chance of about one in a thousand.
SIGMAS = 3.0
SEED = 20240611


@cache
def rotation(dimension: int) -> np.ndarray:
    """A random orthogonal matrix, the same on every machine."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def packed(signs: np.ndarray) -> np.ndarray:
    """Rows of booleans as rows of 64-bit words."""
    words = -(-signs.shape[1] // 64)
    wide = np.zeros((len(signs), words * 64), np.uint8)
    wide[:, : signs.shape[1]] = signs
    return np.packbits(wide, axis=1, bitorder="little").view("<u8")


def encode(vectors: np.ndarray, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, lengths of the differences from the centre, product of each code's direction with its vector's)."""
    rest = vectors - centre
    length = np.sqrt((rest**2).sum(axis=1))
    turned = (rest / np.maximum(length, 1e-300)[:, None]) @ rotation(vectors.shape[1]).T
    along = np.abs(turned).sum(axis=1) / np.sqrt(vectors.shape[1])
    return packed(turned > 0), length, np.maximum(along, 1e-9)


class Block:
    """Coded vectors, with what does not depend on the query."""

    def __init__(self, vectors: np.ndarray, centre: np.ndarray, coded: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        codes, length, self.along = coded or encode(vectors, centre)
        d = vectors.shape[1]
        self.centre, self.words = centre, [np.ascontiguousarray(codes[:, w]) for w in range(codes.shape[1])]
        self.ones = np.bitwise_count(codes).sum(axis=1).astype(np.float64)
        self.longest = np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max())
        self.scale = length / self.along
        self.spread = length * np.sqrt(np.maximum(1 - self.along**2, 0)) / self.along * SIGMAS / np.sqrt(max(d - 1, 1))

    def estimates(self, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Estimated inner products of a query with the vectors, and the bound on their error."""
        d = len(query)
        turned = rotation(d) @ query
        low, high = turned.min(), turned.max()
        step = max((high - low) / ((1 << QUERY_BITS) - 1), 1e-300)
        levels = np.rint((turned - low) / step).astype(np.int64)
        common = np.zeros(len(self.ones), np.int32)
        for bit in range(QUERY_BITS):
            plane = packed((levels >> bit & 1).astype(bool)[None, :])[0]
            for word, mask in zip(self.words, plane, strict=True):
                common += np.bitwise_count(word & mask).astype(np.int32) << bit
        quantised = low + step * levels
        product = (2 * (low * self.ones + step * common) - quantised.sum()) / np.sqrt(d)
        norm = np.sqrt((query**2).sum())
        return self.centre @ query + self.scale * product, norm * self.spread + self.scale * (step / 2 * np.sqrt(d))


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products, summed in the order of the coordinates."""
    total = np.zeros(len(vectors))
    for k in range(len(query)):
        total += vectors[:, k] * query[k]
    return total


def best_of_block(own_rows: np.ndarray, queries: np.ndarray, rows: np.ndarray, ids: np.ma.MaskedArray, vectors: np.ndarray, centre: np.ndarray, k: int, first: int = 64, coded=None):
    """(number of the query, row of the vector, score): each query's k best of a block of vectors, its own row left out.

    Ties go to the smaller id, rows without one last, then to the smaller row.
    """
    out, block, slack, first = [], Block(vectors, centre, coded), 1e-12, max(first, 2 * k)
    for number, (own, query) in enumerate(zip(own_rows, queries, strict=True)):
        guess, error = block.estimates(query)
        guess[rows == own] = -np.inf
        tried = np.argpartition(-guess, min(first, len(rows)) - 1)[:first]
        tried = tried[np.isfinite(guess[tried])]
        if len(tried) >= k:
            scores = vectors[tried] @ query
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            more = np.flatnonzero(guess + error >= least - slack * np.abs(least))
            tried = np.union1d(tried, more[rows[more] != own])
            # Matrix products round equal rows differently, so they only screen; what can be among the k best is summed in order.
            scores = vectors[tried] @ query
            least = np.partition(scores, len(scores) - k)[len(scores) - k]
            tried = tried[scores >= least - slack * np.sqrt((query**2).sum()) * block.longest]
        scores = exact(query, vectors[tried])
        order = np.lexsort((rows[tried], ids.data[tried], np.ma.getmaskarray(ids)[tried], -scores))[:k]
        out.append((np.full(len(order), number), tried[order], scores[order]))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def usable(vector: Column) -> Column:
    """True for vectors that are neither null nor zero and hold neither nulls nor non-finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & fine & F.exists(vector, lambda x: x != 0)


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes of the numbers they are made of."""
    for batch in batches:
        lists = batch.column("_v")
        sizes = np.asarray(pc.list_value_length(lists), dtype=np.int32)
        flat = np.asarray(lists.flatten())
        ends = np.cumsum(sizes, dtype=np.int64)
        each = [flat[b - n : b].tobytes() for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("_id"), pa.array(sizes), pa.array(each, pa.binary())], names=["_row", "_id", "_d", "_v"])


def _doubles(column: pa.Array | pa.ChunkedArray, kind: str, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(-1, d).astype(np.float64)


def centres_of(flat: DataFrame, kind: str) -> DataFrame:
    """_d, centre (bytes of the mean of all vectors of that length), n: one row for each length, from sums of each slice."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, vectors = np.asarray(batch.column("_d")), batch.column("_v")
            for d in np.unique(lengths).tolist():
                own = _doubles(vectors.filter(pa.array(lengths == d)), kind, d)
                yield pa.table({"_d": np.full(d, d, np.int32), "at": np.arange(d, dtype=np.int32), "n": np.full(d, len(own)), "total": own.sum(axis=0)}).to_batches()[0]

    means = flat.select("_d", "_v").mapInArrow(sums, "_d int, at int, n long, total double").groupBy("_d", "at").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean"))
    return means.groupBy("_d").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("at", "mean"))), lambda x: x["mean"]).alias("centre"))


def _coded(kind: str):
    """Rows (_row, _id, _d, _v, centre) -> these, and code (bytes), length, along."""

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lengths, out = np.asarray(batch.column("_d")), [None] * batch.num_rows
            for d in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == d)
                own = batch.column("_v").take(pa.array(at))
                codes, length, along = encode(_doubles(own, kind, d), np.array(batch.column("centre")[int(at[0])].as_py()))
                for k, place in enumerate(at.tolist()):
                    out[place] = (codes[k].tobytes(), float(length[k]), float(along[k]))
            made = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.binary(), pa.float64(), pa.float64()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_row", "_id", "_d", "_v")), *made], names=["_row", "_id", "_d", "_v", "code", "length", "along"])

    return coded


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of each row whose id is divisible by ``every``.

    Vectors that are null, empty, zero or hold nulls or non-finite numbers take no part. Every other row is a candidate of
    every query of its length but its own: rows that repeat an id, or a vector, count one by one, and a repeated query id
    is asked once for each of its rows. Rows without id are candidates, not queries. Ties go to the smaller id, those
    without one last. With fewer than k candidates all are returned; with none, nothing. Other columns are not read.
    """
    kind = "f8" if "double" in vectors.schema[vector_column].dataType.simpleString() else "f4"
    own = F.col(vector_column).cast("array<double>" if kind == "f8" else "array<float>")
    rows = vectors.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).cast("long").alias("_id"), own.alias("_v")).where(usable(F.col("_v")))
    flat = rows.mapInArrow(_as_bytes, "_row long, _id long, _d int, _v binary")
    centres = cut(centres_of(flat, kind))
    coded = cut(join_by_key(flat, centres.select("_d", "centre"), "_d", F.col("_row")).mapInArrow(_coded(kind), "_row long, _id long, _d int, _v binary, code binary, length double, along double"))

    asked = F.coalesce(F.col("_id") % every == 0, F.lit(False))
    width = 4 if kind == "f4" else 8
    blocks = lambda n, most: F.greatest(F.lit(1), F.ceil(n * F.col("_d") * width / most)).cast("int")
    counts = coded.groupBy("_d").agg(F.count(F.lit(1)).alias("n"), F.count_if(asked).alias("n_asked")).where("n_asked > 0")
    shape = cut(counts.join(centres.select("_d", "centre"), "_d").select("_d", "centre", blocks(F.col("n"), VECTOR_BYTES).alias("_bs"), blocks(F.col("n_asked"), QUERY_BYTES).alias("_qs")))
    dealt = join_by_key(coded, shape, "_d", F.col("_row"))
    block = lambda count, salt: F.pmod(F.xxhash64(F.lit(salt), "_row"), F.col(count)).cast("int")
    others = lambda count: F.explode(F.sequence(F.lit(0), F.col(count) - 1))
    queries = dealt.where(asked).withColumn("_q", block("_qs", 1)).withColumn("_b", others("_bs")).select(*[F.col(c).alias(c) for c in ("_d", "_q", "_b", "_row", "_id", "_v", "centre")])
    against = dealt.withColumn("_b", block("_bs", 2)).withColumn("_q", others("_qs")).select("_d", "_q", "_b", "_row", "_id", "_v", "code", "length", "along")
    def compared(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        ids = right.column("_id").combine_chunks()
        if left.num_rows and right.num_rows:
            d = left.column("_d")[0].as_py()
            codes = np.frombuffer(b"".join(right.column("code").to_pylist()), "<u8").reshape(right.num_rows, -1)
            stored = (codes, np.asarray(right.column("length")), np.asarray(right.column("along")))
            plain = np.ma.array(np.asarray(pc.fill_null(ids, 0)), mask=np.asarray(ids.is_null()))
            found = best_of_block(np.asarray(left.column("_row")), _doubles(left.column("_v"), kind, d), np.asarray(right.column("_row")), plain, _doubles(right.column("_v"), kind, d), np.array(left.column("centre")[0].as_py()), k, coded=stored)
        at, to = pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())
        return pa.table({"_ask": left.column("_row").take(at), "query_id": left.column("_id").take(at), "_row": right.column("_row").take(to), "vec_id": ids.take(to), "score": pa.array(found[2], pa.float64())})

    key = ("_d", "_q", "_b")
    pairs = queries.groupBy(*key).cogroup(against.groupBy(*key)).applyInArrow(compared, "_ask long, query_id long, _row long, vec_id long, score double")
    order = Window.partitionBy("_ask").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last(), "_row")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def oracle(k: int = 20, every: int = 20) -> str:
    """DuckDB SQL for ``nearest``, by comparing all rows of one length."""
    return f"""
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.rid AS ask, v.rid, q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % {every} = 0 AND q.rid <> v.rid AND len(q.e) = len(v.e))
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY score DESC, vec_id NULLS LAST, rid) AS rank FROM p) WHERE rank <= {k}
"""
