"""The pipeline's stages, one after the other, against plain loops over planted and awkward rows."""

import random
from collections import Counter

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from chronolake.llm import bpe, mixing

from .fixtures import rows
from .test_similar import jaccard

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def planted():
    """Toxic documents, a line that a site repeats, copies, near copies; and the awkward rows."""
    rng = random.Random(11)
    made, labels = [], []
    for k in range(240):
        words = [f"w{rng.randrange(3000)}" for _ in range(60)]
        if k % 6 == 0:
            words[rng.randrange(60)] = "vile"
        made.append((1000 + k, " ".join(words[:30]) + ".\n" + " ".join(words[30:]) + (f"\nSubscribe to site {k % 3}" if k % 2 else ""), "en", f"site{k % 3}", 0))
        labels.append((1000 + k, 1, int(k % 6 == 0)))
    for k in range(0, 240, 8):  # copies and near copies of clean documents
        _, text, lang, source, n = made[k + 1]
        made += [(3000 + k, text, lang, source, n), (3001 + k, text + " more", lang, source, n)]
    made += [r[:5] for r in rows(n=12) if r[0] != 104]
    return made, labels


def stages(spark, folder, made, labels, more=()):
    docs = spark.createDataFrame([(*r, *[1] * len(more)) for r in made], DOCUMENTS + "".join(f", `{c}` int" for c in more))
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{folder}/labels.parquet")
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs.collect())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_stages(spark, tmp_path):
    made, labels = planted()
    start, clean, lines, kept, mixed, encoded = stages(spark, str(tmp_path), made, labels, more=("_id", "_h", "fp", "row", "score"))
    # Toxicity: the planted documents go, all others stay.
    assert Counter(tuple(r[:5]) for r in clean) == Counter(r for r in made if not ((r[0] or 0) in range(1000, 1240) and (r[0] - 1000) % 6 == 0))
    # Lines: the repeated line goes; documents stay.
    assert Counter(r["doc_id"] for r in lines) == Counter(r["doc_id"] for r in clean)
    assert not any("Subscribe to" in (r["text"] or "") for r in lines)
    # Near copies: one row of each component of pairs at 0.8 or more, that of the smallest id.
    own = sorted(lines, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    root = list(range(len(own)))
    for j in range(len(own)):
        for i in range(j):
            if jaccard(own[i]["text"] or "", own[j]["text"] or "") >= 0.8:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    assert Counter((r["doc_id"], r["text"]) for r in kept) == Counter((own[k]["doc_id"], own[k]["text"]) for k in set(root))
    # Mix: what each source gives is near its target, and comes from its own documents.
    words = lambda text: len((text or "").split())
    sizes, taken = Counter(), Counter()
    for r in kept:
        sizes[r["source"]] += words(r["text"])
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    targets = {r["source"]: r["target"] for r in mixing.plan_mix(spark.createDataFrame([tuple(r) for r in kept], DOCUMENTS)).collect()}
    assert all(taken[s] <= 3 * n and abs(taken[s] - targets[s]) <= 256 for s, n in sizes.items())
    texts = {r["doc_id"]: set((r["text"] or "").split()) for r in kept}
    assert all(set(r["text"].split()) <= texts[r["doc_id"]] for r in mixed)
    # Tokens: as the library encodes, and back.
    ranks = dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert Counter((r["doc_id"], tuple(r["token_ids"])) for r in encoded) == Counter((r["doc_id"], tuple(library.encode_ordinary(r["text"]))) for r in mixed)


@pytest.mark.parametrize("made", [[], [(1, None, None, None, None)], [(None, None, None, None, None), (None, "", "", "", 0)], [(5, "one two three", "en", "s", 13)] * 3])
def test_small_tables(spark, tmp_path, made):
    """Empty tables and tables of nulls pass through all stages; rows that repeat leave one."""
    out = stages(spark, str(tmp_path), made, [])
    texts = {r[1] for r in made if r[1]}
    assert len(out[1]) == len(out[2]) == len(made) and len(out[3]) == len({r[1] or "" for r in made})
    assert {r["doc_id"] for r in out[5]} == {r[0] for r in made if r[1]} and len(out[5]) == len(out[4]) and bool(out[5]) == bool(texts)


def test_run_is_all_stages(spark, tmp_path):
    made, labels = planted()
    last = stages(spark, str(tmp_path), made, labels)[-1]
    result = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r["ids_sha256"] for r in result.collect()) == Counter(r["ids_sha256"] for r in last)
