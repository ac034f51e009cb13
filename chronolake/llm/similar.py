"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, each link checked exactly.

A text is its set of shingle hashes; equal sets meet by a digest. Candidates come from MinHash bands: two sets have the same
smallest hash with a chance of their similarity, whatever their sizes, so a key of 6 such minima is shared with 0.26 at 0.8,
and all of 40 keys differ with 5e-6. Components of the candidates, which hold more than near copies, bring together sets that
are then compared whole: a link is what has the similarity. Large groups are dealt into cells of two parts.

With ``prints`` the links of SimHash fingerprints (made and found as in ``simhash``) count beside these: a group is what
links of either kind reach.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import simhash
from .common import cut, in_short_batches, slices, starts_of, texts_of
from .simhash import SLICE_BYTES, components, shingle_hashes

#: Sets, and shingle hashes, of a part of a group, at most about.
CELL_ROWS, CELL_HASHES = 512, 1 << 18
#: Words of a shingle, and differing bits of linked fingerprints, of SimHash.
PRINT_WIDTH, PRINT_RADIUS = 3, 2


@dataclass(frozen=True)
class Bands:
    """Words of a shingle, least Jaccard similarity of linked sets, minima of a key, and keys of a set."""

    width: int = 5
    similarity: float = 0.8
    rows: int = 6
    bands: int = 40


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th 64-bit word that a hash stands for: a bijective mix, independent for each k."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return x ^ x >> np.uint64(31)


def sets_of(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each text in ascending order, and the number of its text for each."""
    hashes, owner = shingle_hashes(texts, width)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[first], owner[first]


def band_keys(hashes: np.ndarray, owner: np.ndarray, n: int, shape: Bands) -> np.ndarray:
    """(n, bands): for each set and band a hash of the set's ``rows`` minima under as many hash functions; 0 for empty sets."""
    keys, bounds = np.zeros((n, shape.bands), np.uint64), starts_of(owner, n)
    have = np.flatnonzero(np.diff(bounds))
    if not len(have):
        return keys
    begins, low = bounds[:-1][have], (hashes >> np.uint64(32)).astype(np.uint32)
    chosen = np.random.default_rng(42).integers(0, 1 << 32, (shape.bands, shape.rows, 2), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for b in range(shape.bands):
            key = np.zeros(len(have), np.uint64)
            for flip, factor in chosen[b]:
                least = np.minimum.reduceat((low ^ flip) * (factor | np.uint32(1)), begins)
                key = mixed(key ^ least, b)
            keys[have, b] = key
    return keys


def sketches(docs: DataFrame, shape: Bands, passing: tuple[str, ...] = ("doc_id",), adding: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``passing`` and fp, a 64-bit digest of the set of shingles, of every row. A null text counts as empty.

    ``adding`` takes "keys" (array of longs), "print" (the SimHash fingerprint) and "shingles" (binary: the set, ascending).
    """

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            hashes, owner = sets_of(texts_of(batch), shape.width)
            bounds, n = starts_of(owner, batch.num_rows), batch.num_rows
            raw = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            out = [*(batch.column(c) for c in passing), pa.array(np.array([xxhash.xxh64_intdigest(r) for r in raw], dtype=np.uint64).view(np.int64))]
            if "keys" in adding:
                flat = band_keys(hashes, owner, n, shape).view(np.int64).ravel()
                out.append(pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * shape.bands, pa.int32()), pa.array(flat)))
            if "print" in adding:
                out.append(pa.array(simhash.fingerprints_of(*shingle_hashes(texts_of(batch), PRINT_WIDTH), n).view(np.int64)))
            if "shingles" in adding:
                out.append(pa.array(raw, pa.binary()))
            yield pa.RecordBatch.from_arrays(out, names=[*passing, "fp", *(c for c in ("keys", "print", "shingles") if c in adding)])

    fields = [docs.schema[c] for c in passing] + [T.StructField("fp", T.LongType())]
    fields += [T.StructField(c, kind) for c, kind in (("keys", T.ArrayType(T.LongType())), ("print", T.LongType()), ("shingles", T.BinaryType())) if c in adding]
    return in_short_batches(docs).select(*dict.fromkeys([*passing, "text"])).mapInArrow(made, T.StructType(fields))


def candidate_links(distinct: DataFrame) -> DataFrame:
    """u, v: each of ``distinct`` (fp, keys, without repeats) tied to the smallest fp of every key that it shares."""
    dealt = distinct.select("fp", F.explode("keys").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("fp").alias("v"), F.max("fp").alias("_most")).where("v < _most").select("key", "v")
    return dealt.join(shared, "key").where(F.col("fp") > F.col("v")).select(F.col("fp").alias("u"), "v").distinct()


def linked(hashes: np.ndarray, owner: np.ndarray, n: int, similarity: float) -> np.ndarray:
    """For each of n sets the first of those that links of exactly ``similarity`` or more reach from it.

    A set is compared with all sets that are not reached yet, through lists of the sets that hold a hash.
    """
    root, sizes = np.full(n, -1), np.bincount(owner, minlength=n)
    _, word, count = np.unique(hashes, return_inverse=True, return_counts=True)
    word, own = word[count[word] > 1], owner[count[word] > 1]  # what one set alone holds is in no intersection
    order, bounds = np.argsort(word, kind="stable"), starts_of(own, n)
    holders, begins, lengths = own[order], np.cumsum(count * (count > 1)) - count * (count > 1), count
    left = n
    for start in range(n):
        if root[start] >= 0:
            continue
        root[start], waiting, left = start, [start], left - 1
        while waiting and left:
            x = waiting.pop()
            held = word[bounds[x] : bounds[x + 1]]
            many = lengths[held]
            at = np.arange(many.sum()) + np.repeat(begins[held] - (np.cumsum(many) - many), many)
            both = np.bincount(holders[at], minlength=n)
            near = np.flatnonzero((root < 0) & (both > 0))
            near = near[both[near] / (sizes[x] + sizes[near] - both[near]) >= similarity]
            root[near], left = start, left - len(near)
            waiting += near.tolist()
    return root


def _compare(shape: Bands):
    """Rows (group, i, j, fp, shingles) that come sorted by cell -> links (u, v), u > v, that span the linked sets of each cell."""

    def links(fps: list[int], raws: list[bytes]) -> pa.RecordBatch:
        order = np.argsort(np.array(fps, dtype=np.int64))
        fp, own = np.array(fps, dtype=np.int64)[order], [raws[k] for k in order]
        owner = np.repeat(np.arange(len(own)), [len(r) // 8 for r in own])
        root = linked(np.frombuffer(b"".join(own), "<u8"), owner, len(own), shape.similarity)
        to = np.flatnonzero(root != np.arange(len(own)))
        return pa.RecordBatch.from_arrays([pa.array(fp[to]), pa.array(fp[root[to]])], names=["u", "v"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fps, raws, last = [], [], None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("group", "i", "j", "fp", "shingles")]
            for group, i, j, fp, raw in zip(*columns, strict=True):
                if (group, i, j) != last:
                    if len(fps) > 1:
                        yield links(fps, raws)
                    fps, raws, last = [], [], (group, i, j)
                fps.append(fp)
                raws.append(raw)
        if len(fps) > 1:
            yield links(fps, raws)

    return compared


def near_links(sets: DataFrame, shape: Bands) -> DataFrame:
    """u, v: links that span the near copies within each group of ``sets`` (group, fp, shingles; an fp stands once)."""
    hashes = F.length("shingles") / 8
    parts = F.ceil(F.greatest(F.count(F.lit(1)) / CELL_ROWS, F.sum(hashes) / CELL_HASHES))
    large = sets.groupBy("group").agg(parts.alias("_many")).where("_many > 1")
    cell = F.struct(F.least("_part", "_other").alias("i"), F.greatest("_part", "_other").alias("j"))
    rows = (
        sets.join(large, "group", "left")
        .withColumn("_parts", F.coalesce("_many", F.lit(1).cast("long")))
        .withColumn("_part", F.pmod(F.xxhash64("fp"), F.col("_parts")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        .select("group", cell.alias("_cell"), "fp", "shingles")
        .select("group", "_cell.i", "_cell.j", "fp", "shingles")
    )
    return in_short_batches(rows).repartition("group", "i", "j").sortWithinPartitions("group", "i", "j").mapInArrow(_compare(shape), "u long, v long").distinct()


def print_links(prints: DataFrame) -> DataFrame:
    """u, v: links between the sets (fp) of texts whose fingerprints (print) SimHash links; ``prints``: fp, print, no repeats.

    All sets of a fingerprint are tied to the smallest of them, and a link of two fingerprints ties their smallest sets, so
    components of these links are those that the linked fingerprints make.
    """
    least = cut(prints.groupBy("print").agg(F.min("fp").alias("_least")))
    own = prints.join(least, "print").select(F.col("fp").alias("u"), F.col("_least").alias("v"))
    ends = [least.select(F.col("print").alias(c), F.col("_least").alias(f"_{c}")) for c in ("u", "v")]
    across = simhash.near_links(least.select(F.col("print").alias("fp")), PRINT_RADIUS).join(ends[0], "u").join(ends[1], "v")
    return own.where("u > v").unionByName(across.select(F.greatest("_u", "_v").alias("u"), F.least("_u", "_v").alias("v")).where("u > v")).distinct()


def near_copies(docs: DataFrame, shape: Bands = Bands(), prints: bool = False) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included), component: one row for each of ``docs``.

    As ``simhash.near_duplicates``: null and empty texts are equal to each other; a null doc_id takes part. Only texts
    whose set is a candidate are read again, one row for each set (more where ids repeat).
    """
    rows = cut(sketches(docs, shape, adding=("keys", "print") if prints else ("keys",)))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("_least"), F.first("keys").alias("keys")))
    likely = components(candidate_links(distinct))
    groups = cut(likely.select(F.col("node").alias("fp"), F.col("root").alias("group")).unionByName(likely.select(F.col("root").alias("fp"), F.col("root").alias("group")).distinct()))
    wanted = distinct.join(groups, "fp").select(F.col("_least").alias("_id")).distinct()
    again = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    sets = cut(sketches(again, shape, adding=("shingles",)).select("fp", "shingles").join(groups, "fp").dropDuplicates(["fp"]))
    links = near_links(sets, shape)
    roots = components(links.unionByName(print_links(cut(rows.select("fp", "print").distinct()))).distinct() if prints else links)
    distinct = distinct.select("fp", "_least")
    tied = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root")))
    ids = tied.join(tied.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("fp", "component_id", F.col("_root").alias("component"))
    return rows.select("doc_id", "fp").join(ids, "fp").select("doc_id", "fp", "component_id", "component")


def keep_one(docs: DataFrame, shape: Bands = Bands(), prints: bool = False) -> DataFrame:
    """``docs`` with one row of each group of near copies, as ``simhash.keep_one``."""
    return simhash.keep_one(docs, lambda d: near_copies(d, shape, prints), lambda d, passing: sketches(d, shape, passing))
