"""SimHash near-duplicates: fingerprints, all links within a radius, and their components.

Fingerprints are made where the texts lie, in bounded slices. Equal fingerprints meet in a grouped sum, so copies never
reach the comparison. Two different fingerprints within ``radius`` bits agree on ``BANDS - radius`` of ``BANDS`` bands;
each fingerprint is dealt out under every choice of so many bands, which loses no link. What shares a key (or a salted
cell of a large key) is compared in blocks, bit-sliced: the bits of a block stand in vertical planes, one machine word
for 64 candidates; distances are counted with carry-save bitwise counters that start so that a carry out means "beyond
the radius"; a block is abandoned once all its counters have carried out. From each block only the links that span its
groups are passed on, so a dense group of n costs n - 1 rows, and components come from alternating star contractions.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_ROWS, cut, gathered, in_short_batches, join_by_key, slices, starts_of, texts_of, words_of

SLICE_BYTES = 1 << 20
SEED = 42
BANDS = 4
#: Rows of a key that are compared at once; larger keys are dealt into cells of two such parts.
CELL_ROWS = 2048
#: Links of a node above which they are joined apart from those of other nodes.
HUB = 1024


def shingle_hashes(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of every run of ``width`` words (fewer words: of all), and the number of its text."""
    import pyarrow.compute as pc

    words, owner = words_of(pc.ascii_lower(texts))
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    lengths = np.asarray(pc.binary_length(words), dtype=np.int64)
    ends = np.cumsum(lengths + 1)
    begins = ends - lengths - 1
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), " ")[0].as_buffer()
    view = memoryview(joined)
    bounds = starts_of(owner, len(texts))
    last = bounds[owner + 1] - 1
    at = np.arange(len(words))
    first = at[(at + width - 1 <= last) | (at == bounds[owner])]
    until = np.minimum(first + width - 1, last[first])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(view[a:b], SEED) for a, b in zip(begins[first].tolist(), (ends[until] - 1).tolist(), strict=True)]
    return np.array(hashes, dtype=np.uint64), owner[first]


def fingerprints_of(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Bit i of a text is 1 if it is in over half of its hashes; 0 for texts without any."""
    out = np.zeros(n, np.uint64)
    if len(hashes):
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        bounds = starts_of(owner, n)
        have = np.flatnonzero(np.diff(bounds))
        ones = np.add.reduceat(bits, bounds[:-1][have], axis=0, dtype=np.int32)
        major = (2 * ones > np.diff(bounds)[have][:, None]).astype(np.uint8)
        out[have] = np.packbits(major, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, width: int = 3, passing: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``passing`` and fp (the 64 bits as a long) of every row of ``docs``. A null text counts as empty: 0."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE_BYTES):
            fp = fingerprints_of(*shingle_hashes(texts_of(batch), width), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passing), pa.array(fp.view(np.int64))], names=[*passing, "fp"])

    return in_short_batches(docs).select(*dict.fromkeys([*passing, "text"])).mapInArrow(made, T.StructType([docs.schema[c] for c in passing] + [T.StructField("fp", T.LongType())]))


def planes_of(fps: np.ndarray) -> np.ndarray:
    """Bit planes (64, words): bit k of word j of plane b is bit b of fingerprint 64 j + k."""
    padded = np.zeros(-(-len(fps) // 64) * 64, np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def links_within(fps: np.ndarray, radius: int, queries: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of distinct fingerprints that differ in ``radius`` bits or fewer, by bit-sliced comparison."""
    n = len(fps)
    planes = planes_of(fps)
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    n_counters = max(1, radius.bit_length())
    bias = (1 << n_counters) - 1 - radius
    found_i, found_j = [], []
    for begin in range(0, n, queries):
        rows, q, left = np.arange(begin, min(n, begin + queries)), fps[begin : begin + queries], begin // 64
        part = planes[:, left:]
        counters = [np.full((len(rows), part.shape[1]), ones if bias >> k & 1 else 0, np.uint64) for k in range(n_counters)]
        beyond = np.zeros((len(rows), part.shape[1]), np.uint64)
        for b in range(64):
            mask = np.where(q >> np.uint64(b) & np.uint64(1), ones, np.uint64(0))
            carry = part[b] ^ mask[:, None]
            for counter in counters:
                spare = counter & carry
                counter ^= carry
                carry = spare
            beyond |= carry
            if b % 8 == 7 and b < 63:
                alive = (beyond != ones).any(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if alive.mean() < 0.7:
                    rows, q, beyond, counters = rows[alive], q[alive], beyond[alive], [c[alive] for c in counters]
        if len(rows):
            near = np.unpackbits((~beyond).astype("<u8").view(np.uint8).reshape(len(rows), -1), axis=1, bitorder="little")
            at, to = np.nonzero(near)
            i, j = rows[at], to + 64 * left
            keep = (j > i) & (j < n)
            found_i.append(i[keep])
            found_j.append(j[keep])
    return (np.concatenate(found_i), np.concatenate(found_j)) if found_i else (np.zeros(0, int), np.zeros(0, int))


def spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The smallest member of each of 0 .. n - 1's component under the links (i, j)."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return root


def _compare(radius: int):
    """Rows (combo, key, i, j, fp) that come sorted by cell -> links (u, v), u > v, that span the groups of each block."""

    def block(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fps = np.unique(fps)
        signed = np.sort(fps.view(np.int64))
        fps = signed.view(np.uint64)
        root = spanning(*links_within(fps, radius), len(fps))
        to = np.flatnonzero(root != np.arange(len(fps)))
        return signed[to], signed[root[to]]

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Whole cells fill a block; the last cell of a batch waits for the rows that may follow.
        cells, rows, waiting, last = [], 0, [], None

        def links():
            if rows:
                u, v = block(np.concatenate(cells))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([np.asarray(batch.column(c), dtype=np.int64) for c in ("combo", "key", "i", "j")], axis=1)
            fps = np.asarray(batch.column("fp"), dtype=np.int64).view(np.uint64)
            edges = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(fps)]])
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                cell = tuple(keys[a])
                if cell != last:
                    size = sum(map(len, waiting))
                    if rows + size > 2 * CELL_ROWS and rows:
                        yield from links()
                        cells, rows = [], 0
                    cells, rows, waiting, last = cells + waiting, rows + size, [], cell
                waiting.append(fps[a:b])
        size = sum(map(len, waiting))
        if rows + size > 2 * CELL_ROWS and rows:
            yield from links()
            cells, rows = [], 0
        cells, rows = cells + waiting, rows + size
        yield from links()

    return compared


def near_links(distinct: DataFrame, radius: int) -> DataFrame:
    """u, v: links that span the components of ``distinct`` (fp, without repeats) under ``radius`` bits."""
    width = 64 // BANDS
    combos = list(itertools.combinations(range(BANDS), BANDS - radius))
    masks = [sum(((1 << width) - 1) << (width * band) for band in combo) for combo in combos]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("combo"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(signed)])).alias("_at")).select("fp", "_at.combo", "_at.key")
    shared = dealt.groupBy("combo", "key").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    parts = F.ceil(F.col("_n") / CELL_ROWS)
    cell = F.struct(F.least("_part", "_other").alias("i"), F.greatest("_part", "_other").alias("j"))
    rows = (
        dealt.join(shared, ["combo", "key"])
        .withColumn("_parts", parts)
        .withColumn("_part", F.pmod(F.xxhash64("fp"), F.col("_parts")))
        .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
        .select("combo", "key", cell.alias("_cell"), "fp")
        .select("combo", "key", "_cell.i", "_cell.j", "fp")
    )
    return rows.repartition("combo", "key", "i", "j").sortWithinPartitions("combo", "key", "i", "j").mapInArrow(_compare(radius), "u long, v long").distinct()


def _looked_up(rows: DataFrame, table: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` (at most ``most``) left-joined with ``table`` (key, _m).

    Keys of more than ``HUB`` rows are few; their rows are joined apart, by broadcast or salted, so that no task gets all
    rows of a hub.
    """
    if most <= HUB:
        return rows.join(table, key, "left")
    hubs = cut(gathered(rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > HUB).select(key).join(table, key, "left"), most // HUB))
    n = hubs.count()
    if not n:
        return rows.join(table, key, "left")
    if n <= BROADCAST_ROWS:
        marked = rows.join(F.broadcast(hubs.withColumn("_hub", F.lit(True))), key, "left")
        heavy, light = marked.where("_hub").drop("_hub"), marked.where("_hub IS NULL").drop("_hub", "_m")
    else:
        heavy, light = join_by_key(rows, hubs, key, F.xxhash64("u", "v")), rows.join(hubs.select(key), key, "left_anti")
    return light.join(table, key, "left").unionByName(heavy)


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component), for each node but the roots, of ``links`` (u, v) with u > v.

    Alternating star contractions: a round first moves every link to the smallest neighbour of its smaller end, then ties
    the smaller neighbours of each node to the smallest of them. A logarithmic number of rounds settles it; every round's
    links are written to the checkpoint folder, in as many parts as their number fills.
    """
    now, before = cut(links), None
    n = now.count()
    now = gathered(now, n)
    while True:
        least = now.groupBy("u").agg(F.min("v").alias("_m"))
        large = gathered(_looked_up(now, least.withColumnRenamed("u", "v"), "v", n).select("u", F.coalesce("_m", "v").alias("v")), n).distinct()
        large = cut(gathered(large, n)) if n > HUB else large
        tied = _looked_up(large, large.groupBy("u").agg(F.min("v").alias("_m")), "u", n)
        both = tied.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("_m").alias("v")), F.struct("u", F.col("_m").alias("v")))).alias("_l")).select("_l.u", "_l.v").where(F.col("u") != F.col("v"))
        now = cut(gathered(gathered(both, n).distinct(), n))
        state = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before, n = state, state[0]


def near_duplicates(docs: DataFrame, radius: int = 2, width: int = 3) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included), component (its smallest fingerprint
    as a long): one row for each row of ``docs``.

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id takes part; a component of nothing
    but these has a null id. Only doc_id and text of ``docs`` are read.
    """
    rows = cut(fingerprints(docs, width))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("_least")))
    roots = components(near_links(distinct.select("fp"), radius))
    tied = cut(distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root")))
    ids = tied.join(tied.groupBy("_root").agg(F.min("_least").alias("component_id")), "_root").select("fp", "component_id", F.col("_root").alias("component"))
    return rows.join(ids, "fp").select("doc_id", "fp", "component_id", "component")


def keep_one(docs: DataFrame, grouped=near_duplicates, printed=fingerprints) -> DataFrame:
    """``docs`` with one row of each component of ``grouped``: that of the smallest doc_id (then fingerprint, then text).

    ``printed`` gives the fingerprints that ``grouped`` goes by, with the columns asked for. The columns of ``docs`` travel
    as one, so they may have any names.

    Texts are shuffled once, to meet the ids that stay. Only the rows of ids that several rows have (repeated rows, or
    rows without an id) have their fingerprints taken again, to tell them apart.
    """
    rows = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    found = cut(grouped(rows.select("doc_id", "text")))
    ids = found.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("_many"), F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("_stays"))
    staying = cut(ids.where("_stays").select(F.col("doc_id").alias("_id"), "_many"))
    kept = rows.join(staying, rows["doc_id"].eqNullSafe(staying["_id"]))
    if not staying.where("_many").limit(1).count():
        return kept.select("row.*")
    again = printed(kept.where("_many").select("doc_id", "text", "row"), passing=("doc_id", "text", "row"))
    rest = [F.col("row").getField(c) for c in docs.columns if c not in ("doc_id", "text") and not isinstance(docs.schema[c].dataType, T.MapType)]
    first = Window.partitionBy("component").orderBy("fp", "text", *rest)
    same = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id", "fp", "component").distinct()
    told = again.alias("a").join(same.alias("s"), F.col("a.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("a.fp") == F.col("s.fp")))
    one = told.select("a.*", "s.component").withColumn("_row", F.row_number().over(first)).where("_row = 1")
    return kept.where(~F.col("_many")).select("row.*").unionByName(one.select("row.*"))


def hex_of(fp="fp"):
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
