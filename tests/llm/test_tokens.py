"""BPE against the tiktoken library, language model scores against brute force."""

import hashlib
import math
import random
import re
from collections import Counter

import public_tokenizers
import tiktoken

from chronolake.llm import bpe, lm

from .fixtures import documents, empty

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(RANKS), special_tokens={})


def test_pieces_like_the_library():
    coder, rng = bpe.Coder(RANKS, public_tokenizers.PATTERN), random.Random(3)
    texts = ["", "a", " the", "erheeant wasanbleeand", "<|endoftext|>", "x\x1cy \x85z​﻿", "\x00\x00", "don't WE'LL they'd", "  \n\n  a  "]
    for _ in range(300):
        texts.append("".join(rng.choice(["a", "b", "e", "th", "er", "é", "ß", "漢", "🙂", " ", "  ", "\n", "1", "22", "'s", "===", "--", " ", "ing"]) for _ in range(rng.randrange(1, 120))))
    texts += ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(700)), "ab" * 900, "a" * 3001, "=" * 2000, "\n" * 300, "1" * 500]
    for text, (ids, back) in zip(texts, coder.encode(texts), strict=True):
        assert memoryview(ids).cast("i").tolist() == LIBRARY.encode_ordinary(text), text[:50]
        assert back == text.encode()


def test_both_forms_agree():
    coder, rng = bpe.Coder(RANKS, public_tokenizers.PATTERN), random.Random(4)
    pieces = ["".join(rng.choice("aeinrst") for _ in range(rng.randrange(2, 30))).encode() for _ in range(400)]
    assert coder.merge(pieces, bpe._ONE) == coder.merge(pieces, bpe._ALL)


def test_documents(spark):
    docs = documents(spark)
    encoded = bpe.tokenize(docs, RANKS, public_tokenizers.PATTERN)
    got = encoded.select("doc_id", *bpe.digests(encoded)).collect()
    expected = Counter()
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r["text"] or "")
        expected[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got)) == expected
    back = {(r["doc_id"], bytes(r["decoded"])) for r in bpe.decode(encoded, RANKS).collect()}
    assert back == {(r["doc_id"], (r["text"] or "").encode()) for r in docs.collect()}
    assert bpe.tokenize(empty(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def brute_scores(texts, order, backoff, least):
    lists = [[w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in texts]
    counts = Counter(tuple(ws[i : i + k]) for ws in lists for k in range(1, order + 1) for i in range(len(ws) - k + 1))
    counts[()] = sum(map(len, lists))
    out = []
    for ws in lists:
        total = backs = 0
        for i in range(len(ws)):
            for k in range(min(order, i + 1), 0, -1):
                gram = tuple(ws[i - k + 1 : i + 1])
                if counts[gram] >= (least if k > 1 else 1):
                    total += math.log(counts[gram] / counts[gram[:-1]]) + (order - k) * math.log(backoff)
                    backs += order - k
                    break
        out.append((len(ws), total, backs))
    return out


def test_scores(spark, monkeypatch):
    docs = documents(spark, n=200)
    rows = docs.collect()
    for order in (1, 2, 3):
        monkeypatch.setattr(lm, "BLOCK_BYTES", 20_000)
        got = sorted(((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], round(r["log_score"], 5), r["n_backoffs"]) for r in lm.score_documents(docs, order=order).collect()))
        expected = sorted((r["doc_id"] if r["doc_id"] is not None else -1, n, round(s, 5) + 0.0, b) for r, (n, s, b) in zip(rows, brute_scores([r["text"] for r in rows], order, 0.4, 2), strict=True))
        assert [x[:2] + x[3:] for x in got] == [x[:2] + x[3:] for x in expected]
        assert all(abs(a[2] - b[2]) < 1e-3 for a, b in zip(got, expected, strict=True))
    assert lm.score_documents(empty(spark)).count() == 0
    assert {r["score"] for r in lm.score_documents(docs).where("n_words = 0").collect()} == {None}
