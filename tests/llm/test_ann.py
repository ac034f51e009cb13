"""Nearest neighbours against brute force, and the error bound."""

from collections import Counter

import numpy as np

from chronolake.llm import ann


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(first + k, v if v is None else [None if x is None else float(x) for x in v], 1) for k, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


def brute(rows, k, every):
    """Every row but the query's own; a repeated id is a row of its own, as candidate and as query."""
    good = [(i, np.array(v, dtype=np.float64)) for i, v in rows if v is not None and len(v) and not any(x is None or not np.isfinite(x) for x in v) and any(v)]
    out = Counter()
    for own, (q, vector) in enumerate(good):
        if q is not None and q % every == 0:
            near = sorted((-float(ann.exact(vector, v[None, :])[0]), i is None, i or 0) for row, (i, v) in enumerate(good) if row != own and len(v) == len(vector))[:k]
            out.update((q, r, None if none else i, round(-s, 9)) for r, (s, none, i) in enumerate(near, 1))
    return out


def found(df, **options):
    return Counter((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(df, **options).collect())


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "VECTOR_BYTES", 150 * 96)
    monkeypatch.setattr(ann, "QUERY_BYTES", 10 * 96)
    rng = np.random.default_rng(2)
    vectors = [list(v) for v in rng.standard_normal((400, 24)).astype(np.float32)]
    vectors[3], vectors[7], vectors[20], vectors[41] = None, [0.0] * 24, [None] + [1.0] * 23, [float("nan")] * 24
    vectors[60] = vectors[61] = vectors[62] = [5.0] * 24  # ties
    vectors[80] = [float("inf")] * 24
    df = frame(spark, vectors)
    df = df.unionByName(df.limit(5)).unionByName(frame(spark, [[float(x) for x in v] for v in rng.standard_normal((30, 7))], first=1000))
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    expected, got = brute(rows, 20, 20), found(df)
    assert (got & expected).total() >= 0.97 * expected.total()
    pairs, seen = Counter(x[::2] for x in expected.elements()), Counter(x[::2] for x in got.elements())
    assert (seen & pairs).total() >= 0.97 * pairs.total() and got.total() == expected.total()


def test_repeated_ids_and_rows_without_id(spark):
    rows = [(2, [3.0, 1.0]), (2, [9.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [4.0, 0.0]), (None, [4.0, 0.0]), (5, [4.0, 0.0]), (0, [1.0, 0.0]), (0, [2.0, 0.0]), (7, [8.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], "vec_id long, embedding array<double>, _row string, score int")
    got = found(df, k=4)
    assert got == brute(rows, 4, 20) and got[0, 1, 2, 9.0] == 1 and (0, 2, 5, 4.0) in got and (0, 3, None, 4.0) in got
    assert found(df) == brute(rows, 20, 20) and found(df, k=1) == brute(rows, 1, 20)


def test_few_and_none(spark):
    assert ann.nearest(frame(spark, [])).count() == 0
    assert ann.nearest(frame(spark, [None, [0.0, 0.0]])).count() == 0
    assert [tuple(r) for r in ann.nearest(frame(spark, [[1.0, 2.0], [3.0, 1.0]])).collect()] == [(0, 1, 1, 5.0)]


def test_bound_holds():
    rng = np.random.default_rng(3)
    vectors, centre = rng.standard_normal((3000, 64)) + 0.3, np.full(64, 0.3)
    block, missed = ann.Block(vectors, centre), 0
    for query in rng.standard_normal((20, 64)):
        guess, error = block.estimates(query)
        missed += (np.abs(guess - vectors @ query) > error).sum()
    assert missed < 0.005 * 60000


def test_more_neighbours_than_first_tries():
    rng = np.random.default_rng(5)
    vectors, ids = rng.standard_normal((300, 24)), np.arange(300)
    for k in (100, 250, 400):
        found = ann.best_of_block(ids[:3], vectors[:3], ids, np.ma.array(ids), vectors, vectors.mean(axis=0), k)
        for q in range(3):
            scores = ann.exact(vectors[q], vectors)
            want = [i for i in np.argsort(-scores) if i != q][:k]
            got = found[1][found[0] == q].tolist()
            assert len(got) == len(want) and len(set(got) & set(want)) >= 0.97 * len(want)
