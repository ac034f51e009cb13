"""A Merkle manifest of a dataset: digests of rows, joined in runs of eight up to a root for each group, and these to one root.

Leaves are numbered within their group by two-level ranks. Building is driven by events: a task reads numbered nodes and
adds each one's digest to its partial parent (the runs of a combineByKey); a parent that has as many children as its place
and the group's size say is finished at once and is itself the next event, so a task finishes all ancestors of what it
holds. What is left over, some nodes at the ends of each task's range, is the frontier: it is dealt anew by a higher
ancestor, where the partial parents meet, until each group has its root. Roots of groups are the leaves of one more tree.

A finished parent leaves a link to its children. Proofs go down these links, ``SPAN`` levels at a time: the links below one
node and the siblings on its own way to the root give the siblings of all nodes ``SPAN`` levels below it. No task holds more
than one such block, whatever a group's size.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import numbered
from .common import LOWER, UPPER, cut, partitions_for

#: Children of a node.
ARITY, BITS = 8, 3
#: Levels that one step of the proofs goes down.
SPAN = 3
#: Leaves that a task numbers and joins, about.
ROWS_EACH = 50_000


def digest(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def encoded(*columns: Column) -> Column:
    """Hex SHA-256 of the columns: each its number of bytes, a colon and its value; a dash for null."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(x).cast("string"), F.lit(":"), x), F.lit("-")) for x in texts]), 256)


def width(size: int, level: int) -> int:
    """Nodes of a level of a tree of ``size`` leaves."""
    return -(-size >> BITS * level) if size else 0


def climbed(nodes: Iterator[tuple[str, int, int, int, str]], top: int | None = None) -> Iterator[tuple]:
    """Events (key, size, level, place, digest) -> the same with children: parents as they are finished, then what is open.

    A partial parent keeps its children's digests by place until it has all that it will ever have. Nodes at level ``top``
    aren't joined further. A finished parent has its children's digests; an open node has none. Roots are open too.
    """
    partial: dict[tuple, dict[int, str]] = {}
    for key, size, level, place, own in nodes:
        while True:
            count = width(size, level)
            if count <= 1 or level == top:
                yield key, size, level, place, own, None
                break
            parent = place >> BITS
            run = partial.setdefault((key, size, level + 1, parent), {})
            run[place] = own
            if len(run) < min(ARITY, count - (parent << BITS)):
                break
            del partial[key, size, level + 1, parent]
            children = [run[k] for k in sorted(run)]
            level, place, own = level + 1, parent, digest(*children)
            yield key, size, level, place, own, children
    for (key, size, level, _), run in partial.items():
        for place, own in sorted(run.items()):
            yield key, size, level - 1, place, own, None


NODE = "key string, size long, level int, place long, digest string, children array<string>"
NODE_TYPE = pa.schema([("key", pa.string()), ("size", pa.int64()), ("level", pa.int32()), ("place", pa.int64()), ("digest", pa.string()), ("children", pa.list_(pa.string()))])


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 5000) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)


def build(leaves: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """(links, roots) of the trees over ``leaves`` (key, size, place, digest), which lie in about ``tasks`` runs of places.

    links: key, size, level, place, digest, children, one row for each node above the leaves. roots: key, size, digest.
    """
    c = F.col

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, n, 0, p, d) for b in batches for k, n, p, d in zip(*(b.column(x).to_pylist() for x in ("key", "size", "place", "digest")), strict=True))
        yield from _batches(climbed(rows), NODE_TYPE)

    def meeting(top: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for key, size, nodes in zip(*(b.column(x).to_pylist() for x in ("key", "size", "nodes")), strict=True):
                    rows = ((key, size, x["level"], x["place"], x["digest"]) for x in sorted(nodes, key=lambda x: (x["level"], x["place"])))
                    yield from _batches(climbed(rows, top), NODE_TYPE)

        return run

    most = leaves.groupBy("key").count().agg(F.max("count")).first()[0] or 0
    # The first height whose nodes cover some sixty-four runs, as a run leaves a few open nodes a level; then four levels a round.
    height = next(level for level in range(64) if tasks << BITS * level >= 64 * most)
    whole = c("size") <= F.expr(f"shiftleft(1L, {BITS} * level)")
    events = cut(leaves.select("key", "size", "place", "digest").sortWithinPartitions("key", "place").mapInArrow(first, NODE))
    links, open_ = events.where("children IS NOT NULL"), events.where("children IS NULL")
    roots, waiting = open_.where(whole), open_.where(~whole)
    while not waiting.isEmpty():
        ancestor = F.expr(f"shiftright(place, {BITS} * ({height} - level))")
        runs = waiting.where(c("level") <= height).groupBy("key", "size", ancestor.alias("_above")).agg(F.collect_list(F.struct("level", "place", "digest")).alias("nodes"))
        events = cut(runs.select("key", "size", "nodes").mapInArrow(meeting(height), NODE))
        open_ = events.where("children IS NULL")
        links, roots = links.unionByName(events.where("children IS NOT NULL")), roots.unionByName(open_.where(whole))
        waiting, height = waiting.where(c("level") > height).unionByName(open_.where(~whole)), height + 4
    return links, roots.select("key", "size", "digest")


def _below(links: list[dict], above: list[str], level: int) -> dict[int, list[str]]:
    """The ways of all nodes at ``level`` below one node, whose own way is ``above``: what stands left and right of each in
    its run, then of its parent, and so on."""
    ways: dict[tuple[int, int], list[str]] = {}
    for link in sorted(links, key=lambda x: -x["level"]):
        own = ways.get((link["level"], link["place"]), above)
        for k, _ in enumerate(link["children"]):
            ways[link["level"] - 1, (link["place"] << BITS) + k] = ["".join(link["children"][:k]), "".join(link["children"][k + 1 :]), *own]
    return {place: way for (at, place), way in ways.items() if at == level}


def _blocks(links: DataFrame, tier: int) -> DataFrame:
    """key, block, links: the links of the levels of a tier, by their ancestor at its upper end."""
    c, low, high = F.col, tier * SPAN, (tier + 1) * SPAN
    block = F.expr(f"shiftright(place, {BITS} * ({high} - level))")
    return links.where((c("level") > low) & (c("level") <= high)).groupBy("key", block.alias("block")).agg(F.collect_list(F.struct("level", "place", "children")).alias("links"))


def upper_ways(links: DataFrame, tops: DataFrame) -> DataFrame:
    """key, block, way, subroot: the way of every node ``SPAN`` levels above the leaves, or of a lower tree's root.

    ``tops``: key, size, way and subroot of each root. From the top down; each step's ways are written once.
    """
    c = F.col
    most = tops.agg(F.max("size")).first()[0] or 0
    depth = next(level for level in range(64) if width(most, level) <= 1)
    schema = "key string, block long, way array<string>, subroot string"

    def down(level: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = pa.schema([("key", pa.string()), ("block", pa.int64()), ("way", pa.list_(pa.string())), ("subroot", pa.string())])
            rows = ((key, place, way, subroot) for b in batches for key, own, above, subroot in zip(*(b.column(x).to_pylist() for x in ("key", "links", "way", "subroot")), strict=True) for place, way in _below(own, above, level).items())
            yield from _batches(rows, made, 1000)

        return run

    def roots_of(tier: int) -> DataFrame:
        low, high = 1 << BITS * SPAN * tier if tier else 0, 1 << BITS * SPAN * (tier + 1)
        return tops.where((c("size") > low) & (c("size") <= high)).select("key", F.lit(0).cast("long").alias("block"), "way", "subroot")

    tiers = max(1, -(-depth // SPAN))
    found = roots_of(tiers - 1)
    for tier in range(tiers - 1, 0, -1):
        found = cut(_blocks(links, tier).join(found, ["key", "block"]).mapInArrow(down(tier * SPAN), schema)).unionByName(roots_of(tier - 1))
    return found


def proven(leaves: DataFrame, links: DataFrame, tops: DataFrame, finish, schema: str, types: pa.Schema) -> DataFrame:
    """``finish``(leaf, way, subroot) of every leaf; ``leaves``: key, place and what ``finish`` needs of each."""
    own = [x for x in leaves.columns if x != "key"]
    dealt = leaves.groupBy("key", F.shiftright("place", BITS * SPAN).alias("block")).agg(F.collect_list(F.struct(*own)).alias("leaves"))
    joined = dealt.join(upper_ways(links, tops), ["key", "block"]).join(_blocks(links, 0), ["key", "block"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                for members, own_links, above, subroot in zip(*(b.column(x).to_pylist() for x in ("leaves", "links", "way", "subroot")), strict=True):
                    ways = _below(own_links or [], above, 0)
                    for leaf in members:
                        yield finish(leaf, ways.get(leaf["place"], above), subroot)

        yield from _batches(rows(), types)

    return joined.select("leaves", "links", "way", "subroot").mapInArrow(run, schema)


def folded(own: str, way: list[str]) -> str:
    """The root that ``own`` and its siblings give."""
    for k in range(0, len(way), 2):
        own = digest(way[k], own, way[k + 1])
    return own


def manifest(docs: DataFrame, group: str = "lang", columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified: every row's place in the manifest, and its proof.

    A leaf is the digest of ``columns``. Leaves of a ``group`` (null is one) stand in the order of doc_id, rows without one
    first, rows of one doc_id in the order of their leaves; equal rows are leaves of their own beside one another. A proof
    holds the siblings of a row, level by level; folding them with the row's leaf gives the root. Every third row, by the
    checksum of doc_id, is folded with the leaf of its text with A-Z lowered: it is verified only if that changes nothing.
    Rows without doc_id are never changed. Null columns count as a dash, so null and empty texts differ. One row for each
    row; no rows give none. Other columns are not read.
    """
    c, spark = F.col, docs.sparkSession
    text = {x: c(x) for x in columns}
    tampered = encoded(*(text | {"text": F.translate("text", UPPER, LOWER)}).values())
    changed = c("doc_id").isNotNull() & (F.crc32(c("doc_id").cast("string").cast("binary")) % 3 == 0)
    # Null comes first: its key is lower than any other.
    key = F.coalesce(F.concat(F.lit("x"), c(group).cast("string")), F.lit("-"))
    rows = cut(docs.select(key.alias("key"), c("doc_id").cast("long").alias("doc_id"), encoded(*text.values()).alias("digest"), F.when(changed, tampered).alias("tampered"), F.monotonically_increasing_id().alias("_row")))
    tasks = partitions_for(spark, rows.count(), ROWS_EACH)
    leaves = numbered(rows, ["key"], ["doc_id", "digest", "_row"], position="place", parts=tasks).drop("_row")
    links, roots = build(leaves, tasks)

    groups = numbered(roots.select(F.lit("").alias("_all"), c("key").alias("group"), "digest"), ["_all"], ["group"], position="place", parts=partitions_for(spark, roots.count(), ROWS_EACH))
    groups = cut(groups.withColumnRenamed("_all", "key"))
    top_links, top_roots = build(groups, tasks)
    last = top_roots.first()
    root = last["digest"] if last else ""
    above = top_roots.select("key", "size", F.array().cast("array<string>").alias("way"), F.lit(None).cast("string").alias("subroot"))
    ways = pa.schema([("key", pa.string()), ("subroot", pa.string()), ("way", pa.list_(pa.string()))])
    tops = cut(proven(groups.select("key", "place", "group", "digest"), top_links, above, lambda leaf, way, _: (leaf["group"], leaf["digest"], way), "key string, subroot string, way array<string>", ways))
    tops = tops.join(roots.select("key", "size"), "key")

    def finish(leaf: dict, way: list[str], subroot: str) -> tuple:
        again = folded(leaf["tampered"] or leaf["digest"], way)
        return leaf["doc_id"], leaf["digest"], subroot, root, digest(*way), again, again == root

    kinds = pa.schema([("doc_id", pa.int64()), *((x, pa.string()) for x in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), ("verified", pa.bool_())])
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return proven(leaves.select("key", "place", "doc_id", "digest", "tampered"), links, tops, finish, schema, kinds)


def oracle(levels: int = 8, top_levels: int = 3) -> str:
    """DuckDB SQL for ``manifest``, one level after the other, for groups of up to 8 ** ``levels`` rows.

    The checksum of doc_id is computed bit by bit.
    """
    part = lambda x: f"coalesce(octet_length(encode({x}))::VARCHAR || ':' || {x}, '-')"
    whole = lambda text: "sha256(" + " || ".join(part(x) for x in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN {x} % 2 = 1 THEN xor({x} // 2, 3988292384) ELSE {x} // 2 END"
    crc = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: ascii(substr(doc_id::VARCHAR, k::INT, 1))::UBIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), list_transform(range(8), lambda z: 0::UBIGINT)), lambda x, y: " + step.format(x="x") + ")), 4294967295::UBIGINT)"

    def tree(name: str, base: str, n: int) -> list[str]:
        """Tables name0 .. name{n}: g, i, h and what stands left and right of it in its run (null at the root)."""
        out = [f"{name}0_ AS ({base})"]
        for k in range(n + 1):
            w = "PARTITION BY g, i // 8 ORDER BY i ROWS BETWEEN"
            sides = f"string_agg(h, '') OVER ({w} UNBOUNDED PRECEDING AND 1 PRECEDING) AS l, string_agg(h, '') OVER ({w} 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r"
            out.append(f"{name}{k} AS MATERIALIZED (SELECT g, i, h, CASE WHEN n > 1 THEN coalesce(l, '') END AS l, CASE WHEN n > 1 THEN coalesce(r, '') END AS r, n FROM (SELECT g, i, h, {sides}, count(*) OVER (PARTITION BY g) AS n FROM {name}{k}_))")
            out.append(f"{name}{k + 1}_ AS MATERIALIZED (SELECT g, i // 8 AS i, sha256(string_agg(h, '' ORDER BY i)) AS h FROM {name}{k} WHERE n > 1 GROUP BY g, i // 8)")
        out.append(f"{name}_roots AS (" + " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE n = 1" for k in range(n + 1)) + ")")
        return out

    rows = f"rows AS MATERIALIZED (SELECT doc_id, coalesce('x' || lang, '-') AS g, {whole('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {whole(lowered)} ELSE {whole('text')} END AS told FROM documents)"
    placed = "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows)"
    parts = [rows, placed, *tree("a", "SELECT g, i, leaf AS h FROM leaves", levels)]
    parts += tree("b", "SELECT 'all' AS g, row_number() OVER (ORDER BY g) - 1 AS i, h FROM a_roots", top_levels)
    parts.append("subroots AS (SELECT g, h, row_number() OVER (ORDER BY g) - 1 AS i FROM a_roots)")
    steps = [f"a{k}" for k in range(levels)] + [f"b{k}" for k in range(top_levels)]
    joins = " ".join(f"LEFT JOIN a{k} ON a{k}.g = v.g AND a{k}.i = v.i // {8**k}" for k in range(levels)) + " JOIN subroots s ON s.g = v.g " + " ".join(f"LEFT JOIN b{k} ON b{k}.i = s.i // {8**k}" for k in range(top_levels)) + " CROSS JOIN b_roots"
    way = " || ".join(f"coalesce({x}.l, '') || coalesce({x}.r, '')" for x in steps)
    parts.append(f"f0 AS (SELECT doc_id, leaf, s.h AS subroot, b_roots.h AS root, sha256({way}) AS proof_sha256, told AS h, {', '.join(f'{x}.l AS {x}l, {x}.r AS {x}r' for x in steps)} FROM leaves v {joins})")
    parts += [f"f{k + 1} AS (SELECT * REPLACE (CASE WHEN {x}l IS NULL THEN h ELSE sha256({x}l || h || {x}r) END AS h) FROM f{k})" for k, x in enumerate(steps)]
    return "WITH " + ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, root, proof_sha256, h AS folded_root, h = root AS verified FROM f{len(steps)}"
