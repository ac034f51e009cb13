"""The pipeline's near-duplicate stage drops what SimHash links, though the sets of shingles have little in common."""

import random
from collections import Counter

import pyarrow as pa

import corpus_pipeline
from chronolake.llm import simhash

from .test_similar import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_links_of_fingerprints(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    refrain = "come all ye " * 200
    one, other, near = refrain + words(20), refrain + words(20), words(80)
    texts = {3: one, 7: other, 11: near, 12: near + " more", 20: words(60), 21: words(60), 30: None, 31: ""}
    a, b = simhash.fingerprints_of(*simhash.shingle_hashes(pa.array([one, other]), 3), 2).tolist()
    assert (a ^ b).bit_count() <= 2 and jaccard(one, other) < 0.2
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in texts.items()], SCHEMA)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([3, 11, 20, 21, 30])


def test_few_links_lie_in_few_parts(spark):
    """A round over few links writes as many files as these fill, not one for each of the session's shuffle partitions."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 97)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        roots = simhash.components(spark.createDataFrame([(k + 1, k) for k in range(40)], "u long, v long"))
        assert roots.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert {tuple(r) for r in roots.collect()} == {(k, 0) for k in range(1, 41)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
