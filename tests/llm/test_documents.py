"""Licenses, lines, mixing, toxicity, quality and fingerprints on awkward documents, against brute force or known results."""

import hashlib
import math
import os
import random
import re
import textwrap
import time
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from chronolake.llm import common, features, licenses, lines, merkle, mixing, quality, toxicity

from .fixtures import SCHEMA, documents, empty


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_licenses(spark):
    extra = [(500, "a\nLicensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.\nb", "en", "s", 1, 1, "x", "y", 1, 0.1), (501, "the mit\n  LICENSE and CC BY, mit license-mit license; worK MİT license", "en", "s", 1, 1, "x", "y", 1, 0.1), (502, "apache licenses mit licence", "en", "s", 1, 1, "x", "y", 1, 0.1)]
    docs = documents(spark).unionByName(spark.createDataFrame(extra, SCHEMA))
    got = {(key(r["doc_id"]), r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_licenses(docs).collect()}
    expected = set()
    for r in docs.collect():
        words = re.findall(licenses.WORD + "+", (r["text"] or "").translate(str.maketrans(common.UPPER, common.LOWER)))
        hits = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in hits]
        expected.add((key(r["doc_id"]), len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))))
    assert got == expected
    labels = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(docs).where("doc_id >= 500").collect()}
    assert labels == {500: "apache,apache-2", 501: "cc-by,mit", 502: ""}
    assert licenses.scan_licenses(empty(spark)).count() == 0


def test_license_filters_lose_nothing(spark):
    sets = licenses.template_sets()
    texts = [" ".join(words[cut:] + ["noise"] * 5) for _, _, words in sets for cut in range(0, len(words), 2)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = docs.select("doc_id", F.lit(0).alias("key"), F.col("text").alias("_low"))
    for threshold in (0.5, 0.8, 1.0):
        shape = licenses.Templates.of(licenses.TEMPLATES, threshold)
        held = rows.select(F.array_intersect(shape.vocabulary, F.split("_low", licenses.GAP)).alias("have"))
        got = {(r["doc_id"], r["template"]) for r in licenses.template_matches(rows, shape.ordered(licenses.frequencies(held))).collect()}
        assert got == {(k, n) for k, t in enumerate(texts) for n, _, words in sets if len(words) > licenses.SHORT and len(set(t.split()) & set(words)) / len(words) >= threshold - 1e-12}


def test_wrapped_licenses(spark):
    """Every template as headers have it, wrapped at 72 columns; words that are spread over a text are no notice."""
    rows = [(k, "first line\n" + textwrap.fill(text, 72, initial_indent=" * ", subsequent_indent=" * ") + "\nlast line") for k, (_, text) in enumerate(licenses.TEMPLATES)]
    rows += [(100 + k, ("\n" + "noise " * 30).join(text.split())) for k, (_, text) in enumerate(licenses.TEMPLATES)]
    docs = spark.createDataFrame(rows + [(300, rows[0][1]), (300, rows[0][1]), (None, rows[3][1]), (301, None)], "doc_id long, text string").cache()
    got = {r["doc_id"]: r for r in licenses.scan_licenses(docs).collect()}
    duck = duckdb.connect()
    duck.register("documents", docs.toPandas().astype({"doc_id": "Int64"}))
    answer = duck.execute(licenses.oracle())
    at = [c[0] for c in answer.description]
    same = lambda rows: sorted((tuple((c, round(r[c], 9) if isinstance(r[c], float) else r[c]) for c in sorted(at)) for r in rows), key=str)
    assert same(licenses.scan_licenses(docs).collect()) == same([dict(zip(at, r)) for r in answer.fetchall()])
    for k, (label, _) in enumerate(licenses.TEMPLATES):
        assert label in got[k]["labels"].split(",") and got[k]["score"] == 1.0 and got[k]["n_blocks"] >= 1
        assert got[100 + k]["labels"] == "" and got[100 + k]["n_blocks"] == 0


def test_short_license_names(spark):
    """Names need all of their words, within a few words of one another, on one line or several."""
    texts = ["Licensed under CC BY-NC 4.0.", "Licensed under CC BY 4.0.", "CC\nBY-SA", "cc " + "x " * 9 + "by nc", "GNU General Public License, version 2", "the GNU General Public License (version 3)", "GNU General Public License", "gnu lesser general public license", "CC0 1.0", "Apache License, Version 2.0", "Apache License 1.0"]
    found = {r["doc_id"]: r["labels"] for r in licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [found[k] for k in range(len(texts))] == ["cc-by,cc-by-nc", "cc-by", "cc-by,cc-by-sa", "", "gpl,gpl-2", "gpl,gpl-3", "gpl", "lgpl", "cc0", "apache,apache-2", "apache"]


def test_lines(spark):
    docs = documents(spark)
    got = {(key(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(docs).collect()}
    rows, pages, held = docs.collect(), defaultdict(set), defaultdict(set)
    for r in rows:
        if r["text"] is not None:
            pages[r["source"]].add(r["text"])
            for line in r["text"].split("\n"):
                held[r["source"], line.strip(" ")].add(r["text"])
    expected = set()
    for r in rows:
        own = r["text"].split("\n") if r["text"] is not None else []
        stay = [x for x in own if not x.strip(" ") or not (len(held[r["source"], x.strip(" ")]) >= 3 and len(held[r["source"], x.strip(" ")]) / len(pages[r["source"]]) > 0.1)]
        expected.add((key(r["doc_id"]), "\n".join(stay) if r["text"] is not None else None, len(own), len(own) - len(stay)))
    assert got == expected and any(x[3] for x in got)
    assert lines.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert lines.dedup_lines(empty(spark)).count() == 0


def test_lines_salted_alike(spark, monkeypatch):
    docs = documents(spark)
    plain = lines.dedup_lines(docs).orderBy("doc_id", "n_lines").collect()
    monkeypatch.setattr(lines, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(lines, "SALT_PAGES", 3)
    assert lines.dedup_lines(docs).orderBy("doc_id", "n_lines").collect() == plain


def test_lines_with_any_names(spark):
    names = ["_host", "_lines", "_kept", "_boiler", "_salt", "row", "keys", "n_lines", "a.b"]
    docs = spark.createDataFrame([(k, f"own {k}\nshared", "s", *[k] * len(names)) for k in range(9)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    got = lines.dedup_lines(docs)
    assert got.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert all(r["text"] == f"own {r['doc_id']}" and r["_host"] == r["doc_id"] and r["n_lines"] == 2 for r in got.collect())


def brute_targets(sizes, most=3):
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    target, free, total = {}, set(names), sum(sizes.values())
    while free:
        level = (total - sum(target.values())) / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > most * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            free.discard(s)
    return target


def test_mixing(spark):
    docs = documents(spark)
    plan = mixing.plan_mix(docs, block_words=16).collect()
    again = mixing.plan_mix(docs.repartition(7), block_words=16).collect()
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in plan) == Counter((r["doc_id"], r["size"], r["taken"]) for r in again)
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len([w for w in re.split(r"[\x20\x09-\x0D]+", r["text"] or "") if w])
    targets = brute_targets(sizes)
    taken = Counter()
    for r in plan:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] <= 3 * r["size"] and r["taken"] == sum(s["words"] * s["times"] for s in r["spans"]) and r["size"] == sum(s["words"] for s in r["spans"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - t) <= max(0.1 * t, 64) for s, t in targets.items())
    mixed = mixing.mixed_documents(docs, block_words=16)
    assert mixed.columns == docs.columns
    assert mixed.select(F.sum(mixing.n_words(F.col("text")))).first()[0] == sum(taken.values())
    assert mixing.plan_mix(empty(spark)).count() == 0 and mixing.mixed_documents(empty(spark)).count() == 0


def test_tiny_source_beside_a_huge_one(spark):
    """7 shards whose remainders sum to 0.49 each: the draws of all shards add up, and the tiny source keeps its place."""
    huge = [(k, "w " * 2000, "a") for k in range(214)] + [(214, "w " * 1379, "a"), (215, "x " * 100, "b")]
    plan = mixing.plan_mix(spark.createDataFrame(huge, "doc_id long, text string, source string")).collect()
    assert {r["target"] for r in plan if r["source"] == "b"} == {300.0}
    assert [r["taken"] for r in plan if r["source"] == "b"] in ([200], [300])


@pytest.mark.parametrize("slots", [[3354.1, 2.7], [0.3, 0.2], [2000.4, 1000.3, 33.9], [512.0, 512.0]])
def test_draws_make_up_the_expected_slots(spark, slots):
    rows = spark.createDataFrame([(f"s{k}", x) for k, x in enumerate(slots)], "sk string, slots double")
    got, shards = mixing.slot_runs(rows, 512, 1).collect(), max(1, -(-sum(slots) // 512))
    assert sum(r["n"] for r in got) == np.ceil(sum(slots) - 1e-6)
    whole, numbered = Counter(), defaultdict(list)
    for r in got:
        whole[r["shard"]] += r["n"]
        numbered[r["sk"]] += range(r["first"], r["first"] + r["n"])
    assert len(whole) == shards and max(whole.values()) - min(whole.values()) <= 2
    assert all(sorted(x) == list(range(len(x))) for x in numbered.values())


def test_taken_from_slots_by_hand(spark):
    """What each document gets, redone from the slots by plain loops."""
    docs = documents(spark)
    plan = mixing.plan_mix(docs, block_words=16, shard_blocks=8).collect()
    size = {r["source"]: r["source_size"] for r in plan}
    target = {r["source"]: r["target"] for r in plan}
    blocks = {s: -(-n // 16) for s, n in size.items()}
    sk = {s: "" if s is None else "s" + s for s in size}
    sources = spark.createDataFrame([(sk[s], target[s] * blocks[s] / size[s]) for s in size if size[s]], "sk string, slots double")
    runs = mixing.slot_runs(sources, 8, 20240607).collect()
    slots = [(r["sk"], j) for r in runs for j in range(r["first"], r["first"] + r["n"])]
    count = {sk[s]: b for s, b in blocks.items()}
    slots = [(k, j, count[k]) for k, j in slots if j < 3 * count[k]]
    at = mixing.permuted(F.col("j") % F.col("n"), F.col("n"), F.lit(20240607), F.col("sk"), F.floor(F.col("j") / F.col("n")))
    times = Counter((r["sk"], r["b"]) for r in spark.createDataFrame(slots, "sk string, j long, n long").select("sk", at.alias("b")).collect())
    assert max(times.values()) <= 3
    for s in size:  # documents stand in the order of their bucket and hash; one bucket here
        begin = 0
        for r in sorted((r for r in plan if r["source"] == s and r["size"]), key=lambda r: (r["h"], (r["doc_id"] is not None, r["doc_id"]))):
            want = Counter((begin + k) // 16 for k in range(r["size"]))
            assert r["taken"] == sum(n * times[sk[s], b] for b, n in want.items())
            begin += r["size"]
        assert begin == size[s]


def test_mixed_documents_with_any_names(spark):
    names = ["_id", "_h", "_k", "_spans", "h", "spans", "row", "copy", "parts", "words", "n", "sk", "a.b"]
    docs = spark.createDataFrame([(k % 9, "some words " * (k + 1), f"s{k % 2}", *[k % 9] * len(names)) for k in range(20)], "doc_id long, text string, source string, " + ", ".join(f"`{c}` int" for c in names))
    mixed = mixing.mixed_documents(docs, block_words=4)
    assert mixed.columns == docs.columns and all(set(r[3:]) == {r[0]} for r in mixed.collect())


def test_permutation(spark):
    for n in (1, 2, 7, 64, 101):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(5), F.lit("a"))).collect()]
        assert sorted(got) == list(range(n))


def toxic_sample(spark, n=400):
    rng = np.random.default_rng(4)
    words = np.array([f"w{k}" for k in range(200)])
    rows, labels = [], []
    for k in range(n):
        text = [" ".join(rng.choice(words, 8)) for _ in range(12)]
        if k % 5 == 0:
            text[k % 12] += " vile"
        rows.append((k, ". ".join(text), "en", "s", 1, 1, "x", "y", 1, 0.1))
        labels.append((k, int(k % 3 > 0), int(k % 5 == 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_sample(spark)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model, keep_sentences=True).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in rows)
    assert all(r["worst_sentence"] == r["doc_id"] % 12 and [s["number"] for s in r["sentences"]] == [r["doc_id"] % 12] for r in rows if r["predicted"])
    odd = toxicity.score(documents(spark), model).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r["score"] <= 1 for r in odd)
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert toxicity.score(docs, none).where("predicted = 1").count() == 0
    assert toxicity.score(empty(spark), toxicity.fit(empty(spark), labels.limit(0))).count() == 0


def plain_sigmoid(x):
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def plain_features(word):
    plain = word.lower().strip(features.MARKS)
    return [(plain[:k] if k else plain, k) for k in (0, *features.STEMS) if len(plain) >= max(k, 1)]


def plain_code(part, k):
    return (int(pd.util.hash_array(np.array([part], dtype=object), categorize=False)[0]) + 7919 * k) % 2**64 % toxicity.DIMENSION


def test_noisy_or_equals_plain_loops(spark):
    """The score of a document, sentence by sentence and word by word."""
    rng = np.random.default_rng(9)
    model = toxicity.Model(-2.0, rng.standard_normal(toxicity.DIMENSION) / 3)
    docs = documents(spark, n=25).where("doc_id IS NULL OR doc_id <> 104")
    got = sorted((key(r["doc_id"]), round(r["score"], 9), r["n_sentences"], r["worst_sentence"], round(r["worst_score"], 9), r["predicted"]) for r in toxicity.score(docs, model).collect())
    want = []
    for r in docs.collect():
        p = []
        for sentence in re.split(r"[.!?\n]+", r["text"] or ""):
            p.append(plain_sigmoid(model.bias + sum(model.weights[plain_code(*f)] for word in sentence.split() for f in plain_features(word))))
        score = 1 - math.prod(1 - x for x in p)
        want.append((key(r["doc_id"]), round(score, 9), len(p), p.index(max(p)), round(max(p), 9), int(score >= 0.3)))
    assert got == sorted(want)


def test_slope_of_the_bags_likelihood():
    """Against differences of the likelihood, on random bags."""
    rng = np.random.default_rng(3)
    doc, y, score = np.repeat(np.arange(6), [1, 2, 3, 1, 4, 2]), np.array([1, 0, 1, 0, 1, 1]), rng.standard_normal(13)

    def loss(x):
        out = 0.0
        for d in range(6):
            none = math.prod(1 - plain_sigmoid(v) for v in x[doc == d])
            out -= math.log(1 - none) if y[d] else math.log(none)
        return out

    plain = [(loss(score + h) - loss(score - h)) / 2e-5 for h in np.eye(13) * 1e-5]
    p = features.sigmoid(score)
    assert np.allclose(toxicity.slope_of(p, toxicity.noisy_or(doc, p, 6), doc, y), plain, atol=1e-6)


def test_labels_held_out_are_not_learned(spark):
    docs, labels = toxic_sample(spark)
    lies = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, lies)
    assert a.bias == pytest.approx(b.bias) and np.allclose(a.weights, b.weights)


def test_quality(spark):
    docs, labels = toxic_sample(spark)
    host = F.col("source")
    good = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("junk ### junk "), "text")).otherwise(F.col("text")))
    rows = quality.classify(good, labels, host=host, path=host).collect()
    assert sum(r["keep"] == (r["doc_id"] % 3 > 0) for r in rows) >= 0.98 * len(rows)
    odd = quality.classify(documents(spark), labels.limit(0), host=host, path=host).collect()
    assert len(odd) == documents(spark).count() and all(0 <= r["quality"] <= 1 for r in odd)
    assert quality.classify(empty(spark), labels, host=host, path=host).count() == 0


def test_sparse_sites_shrink(spark):
    rows = [("d", f"big{k % 4}", "p", 3.0 if k % 4 < 2 else -3.0) for k in range(400)] + [("d", "tiny", "p", -3.0)]
    df = spark.createDataFrame(rows, "doc_id string, host string, path string, evidence double")
    got = {r["host"]: r["host_posterior"] for r in quality.posteriors(df, 0.5).collect()}
    assert got["big0"] > 0.9 and got["big3"] < 0.1 and 0.1 < got["tiny"] < 0.5


def test_posteriors_equal_plain_loops(spark):
    """Hosts and paths of addresses of different depth, sparse ones among them, by loops over the documents."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(300):
        host = [f"big{k % 3}.org", f"small{k % 40}.net", None][k % 7 % 3]
        path = [None, "a", "a/b", f"a/b/{k % 5}"][k % 4]
        rows.append((k, host, path, float(rng.normal(1 if host and host < "c" else -1, 2))))
    got = {r["doc_id"]: r for r in quality.posteriors(spark.createDataFrame(rows, "doc_id long, host string, path string, evidence double"), 0.3).collect()}
    good = {k: 1 / (1 + math.exp(-e)) for k, _, _, e in rows}
    overall = sum(good.values()) / len(rows)

    def prior_count(groups):  # (n, good, mean of the level above)
        n = sum(g[0] for g in groups)
        between = sum(g[0] * (g[1] / g[0] - g[2]) ** 2 for g in groups) / n
        within = sum(g[2] * (1 - g[2]) for g in groups) / n
        noise = sum(g[0] * g[2] * (1 - g[2]) for g in groups) / n
        spread = between - within
        return min(1e6, max(2.0, noise / spread - 1 if spread > 0 else 1e6))

    hosts, paths = defaultdict(list), defaultdict(list)
    for k, h, p, _ in rows:
        hosts[h].append(good[k])
        paths[h, p].append(good[k])
    k_host = prior_count([(len(x), sum(x), overall) for x in hosts.values()])
    of_host = {h: (sum(x) + k_host * overall) / (len(x) + k_host) for h, x in hosts.items()}
    k_path = prior_count([(len(x), sum(x), of_host[h]) for (h, _), x in paths.items()])
    for k, h, p, e in rows:
        x, up = paths[h, p], of_host[h]
        prior = (sum(x) - good[k] + k_path * up) / (len(x) - 1 + k_path)
        odds = e - math.log(0.3 / 0.7) + math.log(prior / (1 - prior))
        assert got[k]["host_posterior"] == pytest.approx(up) and got[k]["path_posterior"] == pytest.approx((sum(x) + k_path * up) / (len(x) + k_path))
        assert got[k]["quality"] == pytest.approx(1 / (1 + math.exp(-odds))) and got[k]["keep"] == (got[k]["quality"] >= 0.5)


def test_quality_of_pages_by_address(spark):
    """Hosts and paths taken from real addresses; every page gets a score, sparse hosts stay near the corpus."""
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("test tables are not here")
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    host = F.regexp_extract("url", "^[a-z]+://([^/]+)", 1)
    path = F.regexp_extract("url", "^[a-z]+://[^/]+/([^/?]*)", 1)
    docs = pages.select(F.monotonically_increasing_id().alias("doc_id"), F.col("url"), F.lit("some words of a page").alias("text"))
    got = quality.classify(docs, spark.createDataFrame([], "doc_id long, quality int"), host=host, path=path).collect()
    assert len(got) == pages.count() and len({r["host"] for r in got}) > 1 and all(0 < r["quality"] < 1 for r in got)


def plain_paragraphs(text):
    """Character by character: what ends a leaf is looked at after each."""
    out, now = [], ""
    for k, x in enumerate(text):
        now += x
        following = text[k + 1] if k + 1 < len(text) else ""
        if k < 32:
            done = k % 4 == 3
        else:
            tail = text[32 : k + 1]
            spaces = len(tail) - len(tail.rstrip(" \t"))
            done = x == "\n" or (spaces > 0 and text[k - spaces] in ".!?" and (not following or following not in " \t"))
        if done:
            out.append(now)
            now = ""
    out += [now] if now else []
    cut = []
    for piece in out:
        if len(piece) <= 160:
            cut.append(piece)
            continue
        part = ""
        for k, x in enumerate(piece):
            part += x
            word = piece[: k + 1].rstrip(" \t") if x in " \t" and piece[k + 1 : k + 2] not in (" ", "\t") else ""
            if len(part) == 160 or (word and ord(word[-1]) % 4 == 0):
                cut.append(part)
                part = ""
        cut += [part] if part else []
    return cut


def plain_root(text):
    h = lambda data: hashlib.blake2b(data, digest_size=16).digest()
    leaves = [h(b"p" + x.encode()) for x in plain_paragraphs(text)]
    ends = [k for k, x in enumerate(leaves) if x[0] % 8 == 0 or k == len(leaves) - 1]
    return h(b"r" + b"".join(h(b"s" + b"".join(leaves[a:b])) for a, b in zip([0] + [k + 1 for k in ends], [k + 1 for k in ends]))).hex()


def plain_likeness(a, b):
    x, y = Counter(plain_paragraphs(a)), Counter(plain_paragraphs(b))
    apart = sum(len(p) * n for p, n in ((x - y) + (y - x)).items())
    return 1 - apart / (len(a) + len(b)) if a or b else 1.0


@pytest.mark.parametrize("ranges", [3, 5, 4096])
def test_merkle(spark, monkeypatch, ranges):
    """Against a tree and a likeness written anew; two ids, and rows without any, fill several ranges."""
    monkeypatch.setattr(merkle, "RANGE_ROWS", ranges)
    more = [(i, f"Text {k}. It goes on.\nline {k % 3}", "en", "s", 1, 1, "x", "y", 1, 0.1) for i in (7, 103, None) for k in range(25)]
    docs = documents(spark).unionByName(spark.createDataFrame(more, SCHEMA))
    found = merkle.fingerprint_edits(docs).collect()
    got = sorted(((key(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9), r["n_paragraphs"]) for r in found), key=str)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, key(r[0]), xxhash.xxh64_intdigest(r[1].encode(), 42), r[1].encode()))
    expected = []
    for k, (doc_id, text) in enumerate(rows):
        other = rows[(k + 1) % len(rows)][1]
        edited = text[: len(text) - len(text) // 4] + other[: len(text) // 4]
        expected.append((key(doc_id), len(text), hashlib.sha256(edited.encode()).hexdigest(), plain_root(text), plain_root(edited), round(plain_likeness(text, edited), 9), round(plain_likeness(text, other), 9), len(plain_paragraphs(text))))
    assert got == sorted(expected, key=str)
    assert all((r["first_edit"] is None) == (r["fingerprint"] == r["edited_fingerprint"]) or r["near_edited"] == 1.0 for r in found)
    assert merkle.fingerprint_edits(empty(spark)).count() == 0


def test_what_stands_keeps_its_likeness():
    """A quarter of a text is replaced; whatever its form, the rest is found again, and other texts are not alike."""
    rng = random.Random(4)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(2, 9))) for _ in range(n))
    texts = [words(400), words(40), words(6), "This.", "abcd", "x" * 3000, "".join(rng.choice("abcdef") for _ in range(5000)), "\n".join(words(5) for _ in range(9)), words(15) + ". " + words(300)]
    for text in texts:
        edited = text[: len(text) - len(text) // 4] + "#" * (len(text) // 4)
        near = merkle.likeness(merkle.tree_of(text), merkle.tree_of(edited))
        assert (near == 0.0) if text == "abcd" else 0.4 < near < 0.9, (text[:20], near)
    assert merkle.likeness(merkle.tree_of(texts[0]), merkle.tree_of(words(400))) < 0.1
    middle = texts[0][:900] + "some more words here " + texts[0][900:]
    assert merkle.likeness(merkle.tree_of(texts[0]), merkle.tree_of(middle)) > 0.9


def test_hot_ids_are_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 10)
    docs = spark.createDataFrame([(5 if k % 3 else k, f"text {k}") for k in range(600)] + [(None, f"t {k}") for k in range(200)], "doc_id long, text string")
    sizes = [r["count"] for r in merkle.in_order(docs).groupBy("_range").count().collect()]
    assert max(sizes) <= 40 and sum(sizes) == 800 + len(sizes)


def test_paragraphs_of_long_runs_take_one_pass():
    for text in ("." * 10**6, " " * 10**6, "a" * 10**6 + ".", ".\t" * 1000):
        began = time.perf_counter()
        assert "".join(merkle.paragraphs(text)) == text and time.perf_counter() - began < 1


def test_merkle_finds_the_edit():
    text = "\n".join(f"paragraph {k} with words." for k in range(200))
    a, b = merkle.tree_of(text), merkle.tree_of(text.replace("paragraph 77 ", "Paragraph 77 "))
    mine, theirs = merkle.differing(a, b)
    assert [text[o : o + n] for _, n, o in mine] == ["paragraph 77 with words.\n"] and len(theirs) == 1
    assert a.root != b.root and merkle.likeness(a, a) == 1.0 and 0.98 < merkle.likeness(a, b) < 1
    assert list(merkle.paragraphs(text)) == plain_paragraphs(text) and merkle.likeness(merkle.tree_of(""), merkle.tree_of("")) == 1.0
