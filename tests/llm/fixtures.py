"""Small documents with the awkward cases: nulls, empty and long texts, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, key string, block int, score double"


def rows(seed=1, n=60):
    rng = random.Random(seed)
    words = ["the", "a", "Stupid", "idiot,", "été", "naïve", "x1", "###", "MIT", "License", "kelvinK", "日本語", "under", "of", "and", "river."]
    out = []
    for k in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))
        if k % 3 == 0:
            text = text.replace(" of ", ".\n") + "\nShared line of the site\n"
        out.append((k, text, "en", f"s{k % 4}", len(text), k, "x", "y", 3, 0.5))
    out += [
        (100, None, None, None, None, None, None, None, None, None),
        (101, "", "en", "s0", 0, 1, "x", "y", 3, 0.5),
        (102, " \t\n ", "en", None, 4, 1, "x", "y", 3, 0.5),
        (103, out[0][1], "en", "s0", 5, 1, "x", "y", 3, 0.5),
        (103, out[0][1], "en", "s0", 5, 1, "x", "y", 3, 0.5),
        (None, "a text without id. The MIT License", None, "s1", 3, 1, "x", "y", 3, 0.5),
        (104, "word " * 30000, "en", "s2", 150000, 1, "x", "y", 3, 0.5),
        (105, "ab" * 5000 + " " + "=" * 3000 + " 　 \r\n  x", "en", "s2", 150000, 1, "x", "y", 3, 0.5),
    ]
    return out


def documents(spark, **options):
    return spark.createDataFrame(rows(**options), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
