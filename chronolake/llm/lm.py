"""Stupid-backoff scores of documents by n-gram counts of the whole corpus.

A word scores log(count of the longest n-gram ending at it that the table holds / count of its context), plus
log(``backoff``) for every order it had to back off; n-grams of two words and more are in the table from ``least`` places
on. The empty n-gram, whose count is the number of words, is the context of single words.

The count tables are partitioned by hash. Documents are dealt into blocks of bounded size; a block sends its distinct
n-grams, as sorted 64-bit hashes with counts, to the partitions of the tables, packed: one row for each block and
partition that it has any for, so never more rows than n-grams. Blocks travel compressed. A partition adds the counts up and joins them back to each block's n-grams, in the order they came in, so only
counts return. The block joins them to its words' n-grams and sums per document. A frequent n-gram comes once from each
block however often it stands there, so no key is hot, and no count is dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, starts_of, sums_by, words_of

#: Bytes of text in a block, and partitions of the tables for each block: what one task holds at a time.
BLOCK_BYTES, PARTS = 12 << 20, 2
PACK_BYTES, CODEC = 4 << 20, pa.Codec("zstd", compression_level=1)
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[1]
    x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return x ^ (x >> np.uint64(31))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, doc_id, text) -> rows (block, ids, lengths, size, texts): a block's texts of a slice, compressed together."""
    for batch in slices(batches, "text", PACK_BYTES):
        block = np.asarray(batch.column("block"))
        order = np.argsort(block, kind="stable")
        edges = np.concatenate([[0], np.flatnonzero(np.diff(block[order])) + 1, [len(order)]])
        out = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = batch.take(pa.array(order[a:b]))
            texts = [x.encode() for x in rows.column("text").to_pylist()]
            whole = b"".join(texts)
            out.append((int(block[order[a]]), rows.column("doc_id").to_pylist(), [len(x) for x in texts], len(whole), CODEC.compress(whole, asbytes=True)))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary()), strict=True)], names=["block", "ids", "lengths", "size", "texts"])


def ngram_words(rows: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(ids of a block's texts; text of each word, its place there, its hash), a pack at a time."""
    owners, places, hashes, n = [], [], [], 0
    for lengths, size, data in zip(rows.column("lengths").to_pylist(), rows.column("size").to_pylist(), rows.column("texts").to_pylist(), strict=True):
        whole = CODEC.decompress(data, decompressed_size=size) if size else pa.py_buffer(b"")
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        texts = pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), whole)
        words, owner = words_of(pc.ascii_lower(texts))
        coded = words.dictionary_encode()
        plain = np.asarray(coded.dictionary.to_pylist(), dtype=object)
        hashes.append(_mixed((pd.util.hash_array(plain, categorize=False) if len(plain) else np.zeros(0, np.uint64))[np.asarray(coded.indices, dtype=np.int64)] + _MIX[0]))
        places.append((np.arange(len(owner)) - starts_of(owner, len(texts))[owner]).astype(np.int32) if len(owner) else np.zeros(0, np.int32))
        owners.append((owner + n).astype(np.int32))
        n += len(lengths)
    return rows.column("ids").combine_chunks().flatten(), np.concatenate(owners), np.concatenate(places), np.concatenate(hashes)


def orders(one: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For k = 0 .. order the hash of the k words that end at each word."""
    yield np.full(len(one), _MIX[0])
    now = one
    yield now
    for _ in range(2, order + 1):
        longer = np.zeros(len(one), np.uint64)
        longer[1:] = _mixed(now[:-1] * _MIX[0] + one[1:])
        now = longer
        yield now


def _counted(hashes: np.ndarray, place: np.ndarray, k: int):
    """(distinct hashes, sorted; count of each; which words have a k-gram; the distinct hash of each of these)."""
    have = np.flatnonzero(place >= k - 1).astype(np.int32)
    distinct, which, count = np.unique(hashes[have], return_inverse=True, return_counts=True)
    return distinct, count.astype(np.uint32), have, which.astype(np.int32)


def _planes(values: np.ndarray) -> bytes:
    """Byte after byte of all values: high bytes, mostly zero, lie together, where compression finds them."""
    return CODEC.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T), asbytes=True)


def _from_planes(data: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    data = CODEC.decompress(data, decompressed_size=n * width)
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _packs(distinct: np.ndarray, parts: int) -> Iterator[tuple[int, int, int]]:
    """(part, from, to) of sorted hashes for each of ``parts`` equal ranges of hashes that holds any: as many as there are
    hashes at most, however many parts there are."""
    part = ((distinct >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    edges = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(part)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            yield int(part[a]), a, b


def score_documents(docs: DataFrame, order: int = 3, backoff: float = 0.4, least: int = 2) -> DataFrame:
    """doc_id, n_words, log_score (sum over its words), score (their mean), n_backoffs: one row for each row of ``docs``.

    Words stand between ASCII white space, A-Z lowered. A null or empty text has no words: log_score 0, score null.
    Repeated rows count as often as they stand there.
    """
    text = F.coalesce("text", F.lit(""))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = max(1, -(-size // BLOCK_BYTES))
    n_parts = n_blocks * PARTS
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block"), "doc_id", "text")
    blocks = dealt.mapInArrow(packed, "block int, ids array<long>, lengths array<int>, size long, texts binary").repartition(n_blocks, "block")

    def sent(rows: pa.Table) -> pa.Table:
        _, _, place, one = ngram_words(rows)
        block, out = rows.column("block")[0].as_py(), []
        for k, hashes in enumerate(orders(one, order)):
            distinct, count, _, _ = _counted(hashes, place, k)
            out += [(part, block, k, b - a, _planes(np.diff(distinct[a:b], prepend=np.uint64(0))), _planes(count[a:b])) for part, a, b in _packs(distinct, n_parts)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "k", "n", "hashes", "counts"])

    def added(rows: pa.Table) -> pa.Table:
        n = rows.column("n").to_pylist()
        each = [np.cumsum(_from_planes(x, m, np.uint64)) for x, m in zip(rows.column("hashes").to_pylist(), n, strict=True)]
        counts = np.concatenate([_from_planes(x, m, np.uint32) for x, m in zip(rows.column("counts").to_pylist(), n, strict=True)])
        _, which = np.unique(np.concatenate(each), return_inverse=True)
        totals = np.bincount(which, weights=counts).astype(np.uint64)[which]
        back = [_planes(x) for x in np.split(totals, np.cumsum(n)[:-1])]
        return pa.table([rows.column("block"), rows.column("k"), rows.column("part"), rows.column("n"), pa.array(back, pa.binary())], names=["block", "k", "part", "n", "totals"])

    def scored(rows: pa.Table, totals: pa.Table) -> pa.Table:
        ids, owner, place, one = ngram_words(rows)
        n = len(ids)
        parts = sorted(zip(totals.column("k").to_pylist(), totals.column("part").to_pylist(), totals.column("n").to_pylist(), totals.column("totals").to_pylist(), strict=True), key=lambda x: x[:2])
        value, backs, context = np.zeros(len(owner)), np.zeros(len(owner), np.int8), None
        for k, hashes in enumerate(orders(one, order)):
            _, _, have, which = _counted(hashes, place, k)
            total = np.concatenate([_from_planes(x, m, np.uint64) for j, _, m, x in parts if j == k] or [np.zeros(0, np.uint64)])
            count = np.zeros(len(owner))
            count[have] = total[which]
            if k:
                held = np.flatnonzero((count >= (least if k > 1 else 1)) & (place >= k - 1))
                value[held] = np.log(count[held]) - np.log(context[held - 1] if k > 1 else context[held])
                backs[held] = order - k
            context = count
        value += backs * np.log(backoff)
        words = np.bincount(owner, minlength=n)
        log_score = sums_by(owner, value, n)
        mean = pa.array(log_score / np.maximum(words, 1), mask=words == 0)
        return pa.table([ids, pa.array(words.astype(np.int64)), pa.array(log_score), mean, pa.array(sums_by(owner, backs, n).astype(np.int64))], names=["doc_id", "n_words", "log_score", "score", "n_backoffs"])

    counts = blocks.groupBy("block").applyInArrow(sent, "part int, block int, k int, n int, hashes binary, counts binary")
    totals = counts.groupBy("part").applyInArrow(added, "block int, k int, part int, n int, totals binary")
    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInArrow(scored, "doc_id long, n_words long, log_score double, score double, n_backoffs long")

