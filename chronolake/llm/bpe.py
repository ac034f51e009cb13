"""Byte-level BPE encoding and decoding with DuckDB's recursive queries inside each task.

Spark deals the documents out; a task cuts its texts into pieces by the tokenizer's pattern and encodes the distinct
pieces it has not met yet, in bounded batches. One row stands for one token at its position in a piece, at first one for
each byte. A recursive query joins neighbouring rows with the merge table and contracts each piece's leftmost pair of
least rank, until a round changes nothing. For long pieces a round contracts all places of that pair, from the left: a
merge can only make pairs of higher rank, so the order is the same. Token ids come back as bytes by an ordered
aggregation over the vocabulary.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_short_batches, kept, slices

SLICE_BYTES = 1 << 20
#: Bytes of pieces in one recursive query; pieces above LONG bytes go through the second form.
QUERY_BYTES, LONG = 400_000, 48
#: Pieces that a worker remembers; then it keeps those that came more than once, half of that at most.
REMEMBERED = 400_000

#: Contracts one pair of each piece in a round.
_ONE = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM bytes_in
  UNION ALL
  (WITH p AS MATERIALIZED (SELECT *, lead(tok) OVER o AS next, lag(pos) OVER o AS before FROM t WINDOW o AS (PARTITION BY w ORDER BY pos)),
   b AS (SELECT p.w, min((m.merged::BIGINT << 32) | p.pos) AS best FROM p JOIN merges m ON m.a = p.tok AND m.b = p.next GROUP BY p.w)
   SELECT p.w, p.pos, CASE WHEN p.pos = b.best & 4294967295 THEN (b.best >> 32)::INTEGER ELSE p.tok END, p.step + 1
   FROM p JOIN b ON b.w = p.w WHERE p.before IS NULL OR p.before <> b.best & 4294967295)
)
"""
#: Contracts all places of each piece's least pair in a round; in a run of overlapping places every second one, from the left.
_ALL = """
WITH RECURSIVE t(w, pos, tok, step) AS (
  SELECT w, pos, tok, 0 FROM bytes_in
  UNION ALL
  SELECT w, pos, CASE WHEN starts THEN merged ELSE tok END, step + 1
  FROM (SELECT *, lag(starts) OVER (PARTITION BY w ORDER BY pos) AS gone
        FROM (SELECT *, least AND (row_number() OVER (PARTITION BY w, least, island ORDER BY pos)) % 2 = 1 AS starts
              FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY pos) - row_number() OVER (PARTITION BY w, least ORDER BY pos) AS island
                    FROM (SELECT *, coalesce(merged = min(merged) OVER (PARTITION BY w), FALSE) AS least, min(merged) OVER (PARTITION BY w) AS lowest
                          FROM (SELECT p.*, m.merged FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS next FROM t) p LEFT JOIN merges m ON m.a = p.tok AND m.b = p.next)))))
  WHERE lowest IS NOT NULL AND NOT coalesce(gone, FALSE)
)
"""
_LAST = """
, done AS (SELECT t.w, t.pos, t.tok FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) l ON l.w = t.w AND l.step = t.step)
SELECT d.w, list(d.tok ORDER BY d.pos) AS ids, unhex(string_agg(v.hexed, '' ORDER BY d.pos)) AS bytes FROM done d JOIN vocabulary v ON v.id = d.tok GROUP BY d.w ORDER BY d.w
"""
_DECODE = "SELECT i.w, unhex(string_agg(v.hexed, '' ORDER BY i.pos)) AS bytes FROM ids_in i JOIN vocabulary v ON v.id = i.tok GROUP BY i.w ORDER BY i.w"


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) of a rank file, one base64 token and its rank in a line."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(token), int(rank)) for token, rank in map(bytes.split, lines)]


class Coder:
    """A vocabulary in DuckDB. One connection in each worker, one thread, bounded memory, nothing on disk."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str):
        self.source, self.ranks = ranks, dict(ranks)
        self.pattern = regex.compile(pattern)
        self.known: dict[str, bytes] = {}  # a piece's ids, as 32-bit integers
        self.odd: dict[str, bytes] = {}  # what its ids decode to, where that isn't the piece itself
        self.again: set[str] = set()
        self.duck = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": "", "preserve_insertion_order": False})
        merges = [(self.ranks[t[:k]], self.ranks[t[k:]], r) for t, r in ranks for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks]
        columns = dict(zip(("a", "b", "merged"), map(np.array, zip(*merges, strict=True)), strict=True)) if merges else {c: np.zeros(0, np.int64) for c in ("a", "b", "merged")}
        self._table("merges", pa.table({k: pa.array(v.astype(np.int32)) for k, v in columns.items()}))
        self._table("vocabulary", pa.table({"id": pa.array([r for _, r in ranks], pa.int32()), "hexed": pa.array([t.hex() for t, _ in ranks], pa.string())}))
        self.of_byte = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)

    def _table(self, name: str, rows: pa.Table) -> None:
        self.duck.register("incoming", rows)
        self.duck.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM incoming")
        self.duck.unregister("incoming")

    @staticmethod
    def _rows(items: list[np.ndarray]) -> pa.Table:
        lengths = np.array([len(x) for x in items])
        w = np.repeat(np.arange(len(items), dtype=np.int32), lengths)
        pos = (np.arange(len(w)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        return pa.table({"w": w, "pos": pos, "tok": np.concatenate(items).astype(np.int32)})

    def merge(self, pieces: list[bytes], form: str) -> list[tuple[list[int], bytes]]:
        """Token ids of each piece by the recursive query, and the bytes these decode to."""
        self._table("bytes_in", self._rows([self.of_byte[np.frombuffer(p, np.uint8)] for p in pieces]))
        made = self.duck.sql(form + _LAST).to_arrow_table()
        return list(zip(made.column("ids").to_pylist(), made.column("bytes").to_pylist(), strict=True))

    def decode(self, ids: list[list[int]]) -> list[bytes]:
        """The bytes of each list of ids, none empty."""
        self._table("ids_in", self._rows([np.asarray(x, dtype=np.int32) for x in ids]))
        return self.duck.sql(_DECODE).to_arrow_table().column("bytes").to_pylist()

    def learn(self, pieces) -> None:
        """Encodes the pieces not known yet. A piece that is a token is that token."""
        new = [p for p in pieces if p not in self.known]
        self.again.update(p for p in pieces if p in self.known)
        if len(self.known) + len(new) > REMEMBERED:
            kept = self.again if len(self.again) <= REMEMBERED // 2 else set()
            self.known, self.again = {p: self.known[p] for p in self.known if p in kept}, set()
            self.odd = {p: back for p, back in self.odd.items() if p in self.known}
            new = [p for p in pieces if p not in self.known]
        short, long, one = [], [], []
        for p in new:
            data = p.encode("utf-8", "surrogatepass")
            (one if data in self.ranks else short if len(data) <= LONG else long).append((p, data))
        for form, some in ((None, one), (_ONE, short), (_ALL, long)):
            begin = 0
            while begin < len(some):
                end, size = begin, 0
                while end < len(some) and (end == begin or size + len(some[end][1]) <= QUERY_BYTES):
                    size, end = size + len(some[end][1]), end + 1
                part = some[begin:end]
                if form is None:
                    ids = [[self.ranks[data]] for _, data in part]
                    made = zip(ids, self.decode(ids), strict=True)
                else:
                    made = self.merge([data for _, data in part], form)
                for (p, data), (own, back) in zip(part, made, strict=True):
                    self.known[p] = np.array(own, np.int32).tobytes()
                    if back != data:
                        self.odd[p] = back
                begin = end

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """(ids as 32-bit integers, the bytes they decode to) of each text."""
        cut = [self.pattern.findall(t) for t in texts]
        self.learn(set().union(*cut))
        known, odd, out = self.known, self.odd, []
        for text, pieces in zip(texts, cut, strict=True):
            ids = b"".join([known[p] for p in pieces])
            # Ids of a text decode piece by piece. Where every piece gives its own bytes and nothing lies between them, that is the text.
            if sum(map(len, pieces)) == len(text) and (not odd or odd.keys().isdisjoint(pieces)):
                back = text.encode("utf-8", "surrogatepass")
            else:
                back = b"".join([odd[p] if p in odd else p.encode("utf-8", "surrogatepass") for p in pieces])
            out.append((ids, back))
        return out


def _coder(ranks: list[tuple[bytes, int]], pattern: str) -> Coder:
    """This worker's coder; one vocabulary at a time."""
    coder = kept.get("bpe")
    if coder is None or coder.source is not ranks or coder.pattern.pattern != pattern:
        coder = kept["bpe"] = None  # the old one goes before the new one is made
        coder = kept["bpe"] = Coder(ranks, pattern)
    return coder


def tokenize(docs: DataFrame, ranks: list[tuple[bytes, int]], pattern: str, passing: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``passing`` of ``docs``, token_ids (array<int>) and decoded (binary, from the ids): one row for each row.

    A null text counts as empty: no ids, no bytes. Texts are encoded whole, without special tokens. ``ranks`` (see
    ``read_ranks``) must rank every single byte; it is read where this is called and sent to the tasks.
    """
    missing = set(range(256)) - {t[0] for t, _ in ranks if len(t) == 1}
    if missing:
        raise ValueError(f"the vocabulary lacks the bytes {sorted(missing)[:5]} ...")
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    names = [*passing, "token_ids", "decoded"]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passing) + ", token_ids array<int>, decoded binary"

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in slices(batches, "text", SLICE_BYTES, "bpe"):
            coder = coder or _coder(sent.value, pattern)
            made = coder.encode([t or "" for t in batch.column("text").to_pylist()])
            offsets = np.cumsum([0, *(len(ids) // 4 for ids, _ in made)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids for ids, _ in made), np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in passing), ids, pa.array([back for _, back in made], pa.binary())], names=names)

    return in_short_batches(docs).select(*dict.fromkeys([*passing, "text"])).mapInArrow(encoded, fields)


def decode(rows: DataFrame, ranks: list[tuple[bytes, int]], ids: str = "token_ids", passing: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``passing`` and decoded (binary): the bytes of each row's ids. Null and empty ids: no bytes. An id that
    the vocabulary lacks adds nothing."""
    sent = rows.sparkSession.sparkContext.broadcast(ranks)
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in passing) + ", decoded binary"

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, "")
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                lists = [x or [] for x in part.column(ids).to_pylist()]
                some = [k for k, x in enumerate(lists) if any(0 <= i for i in x)]
                back = [b""] * len(lists)
                if some:
                    coder._table("ids_in", coder._rows([np.asarray(lists[k], dtype=np.int32) for k in some]))
                    for w, data in coder.duck.execute(_DECODE).fetchall():
                        back[some[w]] = data
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in passing), pa.array(back, pa.binary())], names=[*passing, "decoded"])

    return in_short_batches(rows).select(*dict.fromkeys([*passing, ids])).mapInArrow(decoded, fields)


def digests(encoded: DataFrame) -> list[Column]:
    """n_tokens, ids_sha256, decoded_sha256 of what ``tokenize`` returns."""
    return [
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("token_ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]
