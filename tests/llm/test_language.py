"""The network's slopes against differences, its labels against a plain loop, and languages of documents never seen."""

import numpy as np
import pytest

from chronolake.llm import language

from .fixtures import documents, empty, rows


def test_slopes_equal_differences():
    model = language.new_model(["a", "b", "c"], state=3, kind=np.float64)
    rng = np.random.default_rng(1)
    codes, length, label = rng.integers(97, 103, (6, 4)), np.array([6, 6, 3, 1]), np.array([0, 2, 1, 1])
    _, slopes = language.loss_and_slopes(model, codes, length, label)
    for w, slope in zip(model.weights(), slopes, strict=True):
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(6)] + [(0, 98)] * (w.shape[1] > 98):
            kept, sides = w[at], []
            for move in (1e-5, -1e-5):
                w[at] = kept + move
                sides.append(language.loss_and_slopes(model, codes, length, label)[0])
            w[at] = kept
            assert slope[at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-7)


def plain(model, window):
    """Probabilities at each byte, one byte after the other."""
    squash = lambda x: max(-1.0, min(1.0, x * (27 + x * x) / (27 + 9 * x * x))) if abs(x) < 3 else np.sign(x)
    k = model.forwards.own.shape[1]

    def states(direction, data):
        h, out = np.zeros(k), []
        for b in data:
            x, g = direction.inputs[:, b].astype(float), direction.own.astype(float) @ h
            update = np.array([(1 + squash((x[i] + g[i]) / 2)) / 2 for i in range(k)])
            reset = np.array([(1 + squash((x[k + i] + g[k + i]) / 2)) / 2 for i in range(k)])
            new = np.array([squash(x[2 * k + i] + reset[i] * g[2 * k + i]) for i in range(k)])
            h = h + update * (new - h)
            out.append(h)
        return out

    both = zip(states(model.forwards, window), states(model.backwards, window[::-1])[::-1], strict=True)
    scores = np.array([model.out @ np.concatenate(x) + model.bias[:, 0] for x in both])
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def test_every_position_of_every_window_is_labelled(spark):
    rng = np.random.default_rng(2)
    model = language.new_model(["a", "b", "c"])
    for w in model.weights():
        w += 0.5 * rng.standard_normal(w.shape).astype(np.float32)
    texts = ["short", "x" * 127, "né " * 100, "abc" * 128, "z"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    for r in language.predict(df, model, keep_spans=True).collect():
        data = texts[r["doc_id"]].encode()
        p = np.concatenate([plain(model, data[k : k + language.WINDOW]) for k in range(0, len(data), language.WINDOW)])
        pooled, labels = p.mean(axis=0), [model.labels[k] for k in p.argmax(axis=1)]
        assert r["lang_pred"] == model.labels[pooled.argmax()] and r["score"] == pytest.approx(pooled.max(), abs=1e-4)
        assert [s["lang"] for s in r["spans"] for _ in range(s["end"] - s["start"])] == labels
        assert r["n_positions"] == len(data) == r["spans"][-1]["end"]
        assert r["n_switches"] == sum(a != b for a, b in zip(labels, labels[1:], strict=False)) == len(r["spans"]) - 1


def test_languages_of_documents_not_trained_on(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    found = language.predict(docs, language.fit(docs, epochs=20), passing=("doc_id", "lang")).where(language.held_out()).collect()
    assert len(found) > 30 and sum(r["lang_pred"] == r["lang"] for r in found) >= 0.95 * len(found)


def test_held_out_labels_change_nothing(spark):
    from pyspark.sql import functions as F

    docs = documents(spark)
    other = docs.withColumn("lang", F.when(language.held_out(), "zz").otherwise(F.col("lang")))
    assert language.training_windows(docs) == language.training_windows(other)


def test_awkward_rows(spark):
    model = language.new_model(["en", "fr"])
    got = language.predict(documents(spark), model, passing=("doc_id", "size", "h", "score", "block")[:3]).collect()
    assert len(got) == len(rows())
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for k in (100, 101, 102):
        assert (by[k][0]["lang_pred"], by[k][0]["score"], by[k][0]["n_positions"]) == ("und", 0.0, 0)
    assert len(by[103]) == 2 and by[103][0]["score"] == by[103][1]["score"] and by[None][0]["lang_pred"] in ("en", "fr")
    assert by[104][0]["n_positions"] == 150_000
    assert language.predict(empty(spark), model).count() == 0
    nothing = language.fit(empty(spark))
    assert {r["lang_pred"] for r in language.predict(documents(spark), nothing).collect()} == {"und"}
    one = language.predict(documents(spark), language.fit(documents(spark).where("lang = 'en'"), epochs=1)).where("doc_id = 5").first()
    assert (one["lang_pred"], one["score"]) == ("en", 1.0)
