"""SimHash against brute force: fingerprints, links, components, and which documents stay."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import xxhash

from chronolake.llm import simhash

from .fixtures import SCHEMA, documents, empty


def brute_fingerprint(text, width=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps, radius):
    n, root = len(fps), list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i in range(n):
        if ids[i] is not None:
            least[find(i)].append(ids[i])
    return [min(least[find(i)], default=None) for i in range(n)]


def near_copies(spark, copies=300):
    rng = random.Random(5)
    base = [rng.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta"]) + str(rng.randrange(50)) for _ in range(400)]
    rows = []
    for k in range(copies):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(400)] = f"new{rng.randrange(1000)}"
        rows.append((1000 + k, " ".join(words), "en", "s", 1, 1, "x", "y", 1, 0.1))
    return spark.createDataFrame(rows, SCHEMA)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CELL_ROWS", 64)
    docs = documents(spark, n=300).unionByName(near_copies(spark))
    rows = docs.collect()
    fps = [brute_fingerprint(r["text"]) for r in rows]
    expected = Counter((r["doc_id"], f, c) for r, f, c in zip(rows, fps, brute_components([r["doc_id"] for r in rows], fps, 2), strict=True))
    got = Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == expected
    stay = simhash.keep_one(docs).collect()
    kept = [brute_fingerprint(r["text"]) for r in stay]
    assert len(stay) == len(set(brute_components(range(len(fps)), fps, 2)))
    assert {r["doc_id"] for r in stay} == {c for _, _, c in expected}
    assert len(set(brute_components(range(len(kept)), kept, 2))) == len(kept)


def test_links_within_any_radius():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = np.unique(np.concatenate([base ^ np.uint64(1 << int(b)) ^ np.uint64(1 << int(c)) for b, c in rng.integers(0, 64, (12, 2))] + [base]))
    for radius in (0, 1, 2, 3, 5):
        i, j = simhash.links_within(fps, radius, queries=64)
        near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == {(a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b}


def test_slices_of_a_batch(spark, monkeypatch):
    docs = documents(spark, n=300).coalesce(1)
    whole = simhash.fingerprints(docs).collect()
    monkeypatch.setattr(simhash, "SLICE_BYTES", 700)
    assert simhash.fingerprints(docs).collect() == whole


def test_nothing(spark):
    assert simhash.near_duplicates(empty(spark)).count() == 0
    assert simhash.keep_one(empty(spark)).count() == 0


def test_components_of_stars_chains_and_hubs(spark, monkeypatch):
    """Random links, with hubs that are the smallest and the largest node of theirs, on every way of joining hubs."""
    rng = random.Random(8)
    links = {(u, rng.randrange(u)) for u in rng.sample(range(1, 3000), 900)}
    links |= {(k, 3000) for k in range(3001, 3200)} | {(4000, k) for k in range(3300, 3400)} | {(k + 1, k) for k in range(5000, 5060)} | {(3150, 3333)[::-1]}
    root = {x: x for link in links for x in link}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in sorted(links):
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in root if find(x) != x}
    df = spark.createDataFrame(sorted(links), "u long, v long")
    for hub, rows in ((10_000, 100_000), (20, 100_000), (20, 1)):
        monkeypatch.setattr(simhash, "HUB", hub)
        monkeypatch.setattr(simhash, "BROADCAST_ROWS", rows)
        monkeypatch.setattr("chronolake.llm.common.BROADCAST_ROWS", rows)
        assert {tuple(r) for r in simhash.components(df).collect()} == want


def test_keep_one_with_any_names(spark):
    names = ["_id", "_many", "fp", "component", "row", "_stays", "a.b"]
    docs = spark.createDataFrame([(k, "one text of several words" if k % 2 else f"text {k}", *[k] * 7) for k in (1, 2, 3, 3, 5)] + [(None, "one text of several words", *[9] * 7)], "doc_id long, text string, " + ", ".join(f"`{c}` int" for c in names))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.collect()) == [1, 2]
