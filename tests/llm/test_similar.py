"""Near copies against brute force over sets of shingles."""

import random

import numpy as np
import pyarrow as pa

from chronolake.llm import similar
from chronolake.llm.simhash import fingerprints_of

from .fixtures import documents, empty


def shingles(text):
    w = text.lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(len(out)), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_near_copies_are_found_and_others_stay(spark):
    rng, rows, groups = random.Random(3), [], {}
    for g in range(60):
        words = [f"w{rng.randrange(20000)}" for _ in range(rng.randrange(80, 400))]
        for k in range(4):
            doc = 10 * g + k
            text = " ".join(words) if k < 2 else edited(rng, words, max(1, len(words) // 70)) if k == 2 else edited(rng, words, len(words) // 2)
            rows.append((doc, text))
            groups[doc] = 10 * g if k < 3 else doc
    found = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(jaccard(rows[k][1], rows[k + 2][1]) >= 0.8 for k in range(0, len(rows), 4))
    missed = [d for d in groups if d % 10 == 2 and found[d] != groups[d]]
    assert len(missed) <= 3 and all(found[d] == g for d, g in groups.items() if d not in missed)


def test_large_cells_lose_no_link(spark, monkeypatch):
    """One key for all: cells of every pair of parts meet."""
    monkeypatch.setattr(similar, "CELL_ROWS", 16)
    rng = random.Random(4)
    words = [f"w{k}" for k in range(300)]
    rows = [(k, edited(rng, words, 3)) for k in range(120)]
    assert {r["component_id"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}


def test_keep_one_on_awkward_rows(spark):
    docs = documents(spark)
    stay = similar.keep_one(docs).collect()
    assert similar.near_copies(docs).count() == docs.count()
    assert len(stay) == len({r["component"] for r in similar.near_copies(docs).collect()})
    assert similar.keep_one(empty(spark)).count() == 0


def test_links_are_exact(spark):
    """Pairs at 0.8 exactly are linked, short ones too; pairs just below are not."""
    rng, rows, near = random.Random(6), [], set()
    word = lambda: f"w{rng.randrange(10**9)}"
    for g in range(120):
        n = (9, 19, 29, 104)[g % 4]  # 5, 15, 25 or 100 shingles, and the text cut at the end to 0.8 of them
        words = [word() for _ in range(n)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[: 4 + (n - 4) * 4 // 5]))]
        near.add(g)
    for g in range(120, 200):  # long texts at 0.70 to 0.79
        words = [word() for _ in range(304)]
        rows += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(words[: 4 + 210 + g % 28]))]
    text = dict(rows)
    assert all((jaccard(text[10 * g], text[10 * g + 1]) >= 0.8) == (g in near) for g in range(200))
    found = {r["doc_id"]: r["component_id"] for r in similar.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {g for g in range(200) if found[10 * g + 1] == 10 * g} == near and all(found[10 * g] == 10 * g for g in range(200))


def test_linked_equals_brute_force():
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(60):
        base = rng.integers(0, 2**64, rng.integers(1, 40), dtype=np.uint64)
        sets += [np.unique(np.append(base[rng.random(len(base)) < 0.9], rng.integers(0, 2**64, 1, dtype=np.uint64))) for _ in range(5)]
    sets = [np.zeros(0, np.uint64)] + sets
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    got = similar.linked(np.concatenate(sets), owner, len(sets), 0.8)
    want = list(range(len(sets)))
    for j in range(len(sets)):
        for i in range(j):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            if 10 * len(a & b) >= 8 * len(a | b) > 0:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if w == old else w for w in want]
    assert got.tolist() == want and len(set(want)) < len(sets) - 20
