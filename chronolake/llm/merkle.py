"""Document fingerprints: a Merkle tree over sections and paragraphs.

A text's leaves are its paragraphs: lines, cut after sentence ends so that a text without line feeds has leaves too. A
paragraph of more than ``LONG`` characters is cut further by its content, after words whose last character says so (one in
four), so what stands before and after an edit keeps its leaves; and the beginning of every text is cut into short pieces,
so the shortest texts have several leaves too. A section is a run of paragraphs that ends where a paragraph's hash says so (one in eight on average) or with a line feed
after such a run, so an edit moves section bounds near itself only. A section's hash covers its paragraphs' hashes, the
root its sections' hashes. Equal roots mean equal texts; otherwise the sections that two trees share are skipped and
only the differing branches are opened, which finds the edited paragraphs.

The likeness of two trees is the share of characters, in both, that stands in paragraphs both have (as multisets).
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

#: What a paragraph ends with: a line feed, or the white space after a sentence end. Found in one pass, whatever the text.
BREAK = re.compile(r"\n|(?<=[.!?])[ \t]+")
#: Characters at a text's beginning, and of each piece of these; the most of a paragraph that isn't cut by its words.
HEAD, PIECE, LONG = 32, 4, 160
SPACE = re.compile(r"[ \t]+")
#: A section ends after a paragraph whose hash's first byte is a multiple of this.
SECTION = 8
SLICE_BYTES = 4 << 20
#: Rows, and bytes, of a range that one task reads in order, and the most ranges: beyond, ranges get longer, and as rows
#: stream through a task one after the other, only its sort grows (on disk).
RANGE_ROWS, RANGE_BYTES, MOST_RANGES = 4096, 16 << 20, 20_000


def _hash(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass
class Tree:
    """sections: (hash, its paragraphs as (hash, characters, offset)); root: the hash of all."""

    root: bytes
    sections: list[tuple[bytes, list[tuple[bytes, int, int]]]]
    size: int


def _words_apart(paragraph: str) -> Iterator[str]:
    """A long paragraph, cut after the space behind words whose last character's code is a multiple of four; what is still
    long is cut every ``LONG`` characters."""
    begin, ends = 0, [m.end() for m in SPACE.finditer(paragraph) if m.start() and ord(paragraph[m.start() - 1]) % 4 == 0]
    for end in [*ends, len(paragraph)]:
        while begin < end:
            upto = min(end, begin + LONG)
            yield paragraph[begin:upto]
            begin = upto


def paragraphs(text: str) -> Iterator[str]:
    for k in range(0, min(HEAD, len(text)), PIECE):
        yield text[k : min(k + PIECE, HEAD)]
    begin = HEAD
    for found in [*BREAK.finditer(text, HEAD), None]:
        end = found.end() if found else len(text)
        if end - begin > LONG:
            yield from _words_apart(text[begin:end])
        elif end > begin:
            yield text[begin:end]
        begin = end


def tree_of(text: str) -> Tree:
    sections, part, at = [], [], 0
    for paragraph in paragraphs(text):
        h = _hash(b"p" + paragraph.encode("utf-8", "surrogatepass"))
        part.append((h, len(paragraph), at))
        at += len(paragraph)
        if h[0] % SECTION == 0:
            sections.append((_hash(b"s" + b"".join(x[0] for x in part)), part))
            part = []
    if part:
        sections.append((_hash(b"s" + b"".join(x[0] for x in part)), part))
    return Tree(_hash(b"r" + b"".join(x[0] for x in sections)), sections, at)


def differing(a: Tree, b: Tree) -> tuple[list[tuple[bytes, int, int]], list[tuple[bytes, int, int]]]:
    """Paragraphs of ``a`` that ``b`` lacks, and the other way round, opening only sections that the other lacks."""
    if a.root == b.root:
        return [], []
    have = Counter(h for h, _ in a.sections)
    have.subtract(Counter(h for h, _ in b.sections))

    def opened(tree: Tree, sign: int) -> list[tuple[bytes, int, int]]:
        left, out = {h: sign * n for h, n in have.items() if sign * n > 0}, []
        for h, part in reversed(tree.sections):
            if left.get(h, 0) > 0:
                left[h] -= 1
                out += part
        return out

    mine, theirs = opened(a, 1), opened(b, -1)
    extra = Counter(x[0] for x in mine)
    extra.subtract(Counter(x[0] for x in theirs))

    def lacking(part, sign):
        left, out = {h: sign * n for h, n in extra.items() if sign * n > 0}, []
        for x in part:
            if left.get(x[0], 0) > 0:
                left[x[0]] -= 1
                out.append(x)
        return out

    return lacking(mine, 1), lacking(theirs, -1)


def likeness(a: Tree, b: Tree) -> float:
    """0 to 1; two empty texts are alike."""
    if a.root == b.root:
        return 1.0
    whole = a.size + b.size
    mine, theirs = differing(a, b)
    return max(0.0, 1 - (sum(x[1] for x in mine) + sum(x[1] for x in theirs)) / whole) if whole else 1.0


def _range_of(rows: DataFrame, ranges: int) -> tuple[Column, int]:
    """The number of a row's range, and how many there are: ranges follow quantiles of doc_id; an id that fills several
    of them is a range of its own, dealt into as many parts by the order of its texts' hashes. Rows without id are such an id.
    """
    nulls, there = rows.agg(F.count_if(F.col("doc_id").isNull()), F.count("doc_id")).first()
    shares = [k / ranges for k in range(1, ranges)]
    cuts = [int(x) for x in rows.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", shares, 0.2 / ranges)] if there and shares else []
    many = Counter(cuts)
    hot = {x: n + 1 for x, n in many.items() if n > 1}
    bounds = sorted(set(cuts) | {x + 1 for x in hot})
    # Range k holds the ids from bounds[k - 1] to below bounds[k]; the last is that of rows without id.
    parts = [1] + [hot.get(x, 1) for x in bounds] + [max(1, -(-nulls * ranges // max(1, nulls + there)))]
    before = list(itertools.accumulate(parts, initial=0))
    ends = F.array(*[F.lit(x) for x in bounds]).cast("array<bigint>")
    middle = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
    at = F.aggregate(
        F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length()))),
        F.struct(F.lit(0).alias("a"), F.lit(len(bounds)).alias("b")),
        lambda s, _: F.when(s["a"] >= s["b"], s)
        .when(F.get(ends, middle(s)) <= F.col("doc_id"), F.struct((middle(s) + 1).alias("a"), s["b"].alias("b")))
        .otherwise(F.struct(s["a"].alias("a"), middle(s).alias("b"))),
        lambda s: s["a"],
    )
    at = F.when(F.col("doc_id").isNull(), F.lit(len(parts) - 1)).otherwise(at)
    share = F.shiftrightunsigned("_h", 32) / float(1 << 32)
    literal = lambda numbers: F.array(*[F.lit(x) for x in numbers])
    if max(parts) == 1:
        return at, len(parts)
    return F.get(literal(before), at) + F.floor(share * F.get(literal(parts), at)).cast("int"), before[-1]


def in_order(docs: DataFrame) -> DataFrame:
    """_range, doc_id, text, _lead: rows sorted by doc_id within ranges of it, each range ending with the row after it.

    Rows with one doc_id (or none: these come last) are ordered by a hash of the text, then the text. The first row of a
    range is copied to the end of the range before (_lead), the very first to the last.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    # Hashes in the order of their bits taken as a number without sign.
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_h"))
    n, size = rows.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    placed_at, n_ranges = _range_of(rows, max(1, min(MOST_RANGES, max(-(-n // RANGE_ROWS), -(-(size or 0) // RANGE_BYTES)))))
    placed = rows.withColumn("_range", placed_at).withColumn("_h", F.col("_h").bitwiseXOR(F.lit(-(1 << 63))))
    heads = placed.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_h")).alias("first"))
    firsts = sorted((r["_range"], r["first"]["doc_id"], r["first"]["_h"]) for r in heads.collect())  # one row for each range
    if not firsts:
        return placed.withColumn("_lead", F.lit(0))
    before = [(*firsts[k], firsts[k - 1][0]) for k in range(len(firsts))]
    leads = spark.createDataFrame(before, "_range int, _id long, _first long, _to int")
    met = (placed["_range"] == leads["_range"]) & placed["doc_id"].eqNullSafe(leads["_id"]) & (placed["_h"] == leads["_first"])
    first_rows = placed.join(F.broadcast(leads), met).groupBy("_to").agg(F.min(F.struct(placed["doc_id"], placed["_h"], placed["text"])).alias("_row"))
    lead = first_rows.select("_row.doc_id", "_row.text", "_row._h", F.col("_to").alias("_range"), F.lit(1).alias("_lead"))
    both = placed.withColumn("_lead", F.lit(0)).unionByName(lead)
    sorted_ = both.repartitionById(n_ranges, F.col("_range")).sortWithinPartitions("_range", "_lead", F.col("doc_id").asc_nulls_last(), "_h", "text")
    return sorted_.select("_range", "doc_id", "text", "_lead")


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "n_sections", "n_paragraphs", "first_edit"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int32(), pa.int32(), pa.int64()]
    held = None  # (range, doc_id, text, tree) of the row that waits for the next
    for batch in slices(batches, "text", SLICE_BYTES):
        out = []
        for where, doc_id, text, lead in zip(*(batch.column(c).to_pylist() for c in ("_range", "doc_id", "text", "_lead")), strict=True):
            tree = tree_of(text)
            if held is not None and held[0] == where:
                _, own_id, own, mine = held
                cut_at = len(own) - len(own) // 4
                edited = own[:cut_at] + text[: len(own) // 4]
                other = tree_of(edited)
                gone = differing(mine, other)[0]
                out.append((own_id, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), mine.root.hex(), other.root.hex(), likeness(mine, other), likeness(mine, tree), len(mine.sections), sum(len(x[1]) for x in mine.sections), min((x[2] for x in gone), default=None)))
            held = None if lead else (where, doc_id, text, tree)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Every document's fingerprint, that of its edited text, and how alike they are; see the module's head.

    The edited text is the text with its last quarter of characters replaced by as many of the next document, in the
    order of doc_id, the first following the last. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, n_sections, n_paragraphs, first_edit (offset of the first paragraph that
    the edited text lacks), one row for each row. A null text counts as empty. A single document follows itself. Rows of
    one doc_id stand in the order of their texts' hashes, rows without doc_id last. Other columns are not read.
    """
    return in_order(docs).mapInArrow(
        _with_next,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_sections int, n_paragraphs int, first_edit long",
    )
