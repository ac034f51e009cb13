"""The manifest against a tree written anew, its events against every order of arrival."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from chronolake.llm import manifest

from .fixtures import SCHEMA, documents, empty, rows


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def part(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def runs(xs):
    return [xs[k : k + 8] for k in range(0, len(xs), 8)]


def tree(leaves):
    """(root, siblings left and right of each leaf, level by level)."""
    level, ways, at = list(leaves), [[] for _ in leaves], list(range(len(leaves)))
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            ways[k].append((run[: i % 8], run[i % 8 + 1 :]))
        at = [i // 8 for i in at]
        level = [H(*run) for run in runs(level)]
    return level[0], ways


def brute(data):
    """Sorted rows (doc_id, leaf, subroot, root, proof, folded, verified)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaf = lambda r, text: H(*map(part, (r[0], r[3], r[2], r[4], text)))
    groups = {}
    for r in data:
        told = r[1].translate(lower) if r[1] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 else r[1]
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, told), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in names}
    root, tops = tree([trees[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for (_, _, own, told, doc_id), way in zip(sorted(groups[g]), trees[g][1], strict=True):
            h = told
            for left, right in way + top:
                h = H(*left, h, *right)
            out.append((doc_id, own, trees[g][0], root, H(*[x for left, right in way + top for x in left + right]), h, h == root))
    return sorted(out, key=str)


def found(docs):
    return sorted(map(tuple, manifest.manifest(docs).collect()), key=str)


def test_awkward_rows_equal_a_tree_written_anew(spark):
    assert found(documents(spark)) == brute(rows())


def test_deep_trees_and_many_groups(spark):
    rng = random.Random(5)
    data = [(k, f"Text {rng.random()}", "en" if k % 3 else rng.choice([None, "é", "a b", "Z", ""]), None, 3, None, None, None, None, None) for k in range(1500)]
    data += [(7, "again", "en", "s", 1, None, None, None, None, None)] * 30
    data += [(5000 + k, "one of a group", f"g{k}", "s", 1, None, None, None, None, None) for k in range(70)]
    assert found(spark.createDataFrame(data, SCHEMA)) == brute(data)


def test_no_rows_and_one_row(spark):
    assert found(empty(spark)) == []
    one = documents(spark).where("doc_id = 5")
    ((doc_id, leaf, subroot, root, proof, _, _),) = found(one)
    assert leaf == subroot == root and proof == H() and doc_id == 5


@pytest.mark.parametrize("size", [1, 2, 8, 9, 64, 65, 700])
def test_events_in_any_order_give_the_same_root(size):
    leaves = [H(str(k)) for k in range(size)]
    events = [("k", size, 0, k, d) for k, d in enumerate(leaves)]
    random.Random(size).shuffle(events)
    half = len(events) // 2
    made = [*manifest.climbed(iter(events[:half])), *manifest.climbed(iter(events[half:]))]
    open_ = [e[:5] for e in made if e[5] is None]
    again = [e for e in manifest.climbed(iter(open_)) if e[5] is None]
    assert [e[4] for e in again] == [tree(leaves)[0]]
    links = [e for e in [*made, *manifest.climbed(iter(open_))] if e[5] is not None]
    assert len({e[2:4] for e in links}) == len(links) and all(e[4] == H(*e[5]) for e in links)


def test_few_tasks_hold_all_of_a_large_group(spark):
    """Every row of one group; ranges of ten rows make the frontier meet in several rounds."""
    leaves = spark.range(3000).select(F.lit("k").alias("key"), F.lit(3000).cast("long").alias("size"), F.col("id").alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    want, ways = tree([H(str(k)) for k in range(3000)])
    links, roots = manifest.build(leaves.repartitionByRange(300, "place"), 300)
    assert [r["digest"] for r in roots.collect()] == [want]
    assert links.count() == 375 + 47 + 6 + 1
    tops = roots.select("key", "size", F.array().cast("array<string>").alias("way"), F.lit("s").alias("subroot"))
    upper = {r["block"]: r["way"] for r in manifest.upper_ways(links, tops).collect()}
    assert {b: [x for x in w] for b, w in upper.items()} == {b: ["".join(x) for pair in ways[b * 512][3:] for x in pair] for b in range(6)}
