"""License scans: an exact set-similarity join between license templates and the text blocks of documents.

Templates and text blocks are sets of words. A block matches a template when it holds at least ``threshold`` of the
template's words (containment). Words are ordered by how many texts of the corpus hold them, the rarest first, and
three filters leave few pairs to compare, losing none:

* prefix: a matching block shares one of the template's ``size - need + 1`` rarest words;
* length: it has at least ``need`` template words at all;
* position: what follows a shared word on both sides must still suffice for ``need`` words.

Blocks are lines, and windows of words across line ends for notices that are wrapped over several of them.

Everything runs as DataFrame operations. The corpus is read once: what is stored of each text are its counts, the template
words that it has, and, only where these suffice for a template, the text itself. The rest works on that. Only the
templates' own vocabulary, which the list below bounds, is collected and sent along.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, ascii_lower, cut, partitions_for

#: Phrases whose places count as the base, by label; words stand consecutively. Fixed values.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: (label, text): notices that the method looks for. Wordings of public licenses.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("mit", "Released under the terms of the MIT License; see the LICENSE file"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("cc-by-nc", "CC BY-NC"),
    ("cc-by-sa", "CC BY-SA"),
    ("cc-by-nd", "CC BY-ND"),
    ("cc0", "CC0 1.0"),
    ("gpl-2", "GNU General Public License, version 2"),
    ("gpl-3", "GNU General Public License, version 3"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("apache-2", "Apache License, Version 2.0"),
    ("mpl", "Mozilla Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
)

#: Templates of so few words are names: all of their words must stand within one window, a long line doesn't do.
SHORT = 6

#: Pairs of a text and a template that one task looks at: their windows cost more than their bytes tell.
PAIRS = 64

#: Characters between words, once A-Z are lowered.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"


def template_sets(templates=TEMPLATES) -> list[tuple[int, str, list[str]]]:
    """(number, label, sorted distinct words) of each template that has words."""
    sets = [(k, label, sorted(set(re.findall(f"{WORD}+", text.translate(str.maketrans(UPPER, LOWER)))))) for k, (label, text) in enumerate(templates)]
    return [x for x in sets if x[2]]


def need_of(size: int, threshold: float) -> int:
    return size if size <= SHORT else max(1, math.ceil(threshold * size - 1e-9))


def _n_words(pieces: Column) -> Column:
    """Words among what ``split`` at gaps gives: the first and the last piece may be empty."""
    n = F.size(pieces)
    return (n - F.when(F.element_at(pieces, 1) == "", 1).otherwise(0) - F.when((n > 1) & (F.element_at(pieces, -1) == ""), 1).otherwise(0)).cast("long")


def phrase_places(pieces: str = "_pieces", low: str = "_low") -> dict[str, Column]:
    """n_words, n_base, first_word, last_word, base (labels) of a lowered text ``low`` and its ``pieces`` between gaps.

    Only texts that contain all words of a phrase have their words looked at.
    """
    maybe = F.lit(False)
    for phrase, _ in PHRASES:
        all_words = F.lit(True)
        for word in phrase.split(" "):
            all_words = all_words & F.contains(F.col(low), F.lit(word))
        maybe = maybe | all_words
    words = F.when(maybe, F.filter(pieces, lambda w: w != ""))

    def at(i: Column, phrase: str) -> Column:
        found = F.lit(True)
        for k, word in enumerate(phrase.split(" ")):
            found = found & F.coalesce(F.get("_words", i + k) == word, F.lit(False))
        return found

    places = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: F.coalesce(*[F.when(at(i, phrase), True) for phrase, _ in PHRASES], F.lit(False)))
    labels = [F.when(F.exists(F.col("_places"), (lambda p: lambda i: at(i, p))(phrase)), F.lit(label)) for phrase, label in PHRASES]
    none = F.array().cast("array<string>")
    return {
        "_words": words,
        "_places": F.when(F.size("_words") > 0, places),
        "n_words": _n_words(F.col(pieces)),
        "n_base": F.coalesce(F.when(F.col("_places").isNotNull(), F.size("_places")), F.lit(0)).cast("long"),
        "first_word": F.array_min("_places").cast("long"),
        "last_word": F.array_max("_places").cast("long"),
        "base": F.coalesce(F.when(F.size("_places") > 0, F.array_compact(F.array(*labels))), none),
    }


@dataclass(frozen=True)
class Templates:
    """Sets of words with what the filters need, in an order of the words."""

    sets: list[tuple[int, str, list[str]]]
    threshold: float
    order: list[str]

    @classmethod
    def of(cls, templates, threshold: float) -> Templates:
        sets = template_sets(templates)
        return cls(sets, threshold, sorted({w for _, _, words in sets for w in words}))

    def ordered(self, frequency: dict[str, int]) -> Templates:
        """The rarest word first, ties by name."""
        return replace(self, order=sorted(self.order, key=lambda w: (frequency.get(w, 0), w)))

    @property
    def vocabulary(self) -> Column:
        return F.array(*[F.lit(w) for w in self.order])

    @property
    def least(self) -> int:
        return min((need_of(len(words), self.threshold) for _, _, words in self.sets), default=1)

    def suffices(self, have: str) -> Column:
        """Whether a set of template words holds enough of any template."""
        enough = [F.size(F.array_intersect(have, F.array(*[F.lit(w) for w in words]))) >= need_of(len(words), self.threshold) for _, _, words in self.sets]
        return F.coalesce((F.size(have) >= self.least) & reduce(Column.__or__, enough, F.lit(False)), F.lit(False))


def frequencies(held: DataFrame, have: str = "have") -> dict[str, int]:
    """How many rows of ``held`` have each template word: at most one row for each word of the templates comes back."""
    return {r["word"]: r["count"] for r in held.select(F.explode(have).alias("word")).groupBy("word").count().collect()}


def prefix_join(held: DataFrame, shape: Templates, keys: tuple[str, ...], have: str = "have") -> DataFrame:
    """keys, template, label, containment: every pair of a row of ``held`` and a template at the threshold or above.

    ``have`` is the row's set of template words.
    """
    spark, rank = held.sparkSession, {w: k for k, w in enumerate(shape.order)}
    prefix, members = [], []
    for number, label, words in shape.sets:
        need, ordered = need_of(len(words), shape.threshold), sorted(words, key=rank.__getitem__)
        members.append((number, label, ordered))
        prefix += [(w, number, i, len(words), need) for i, w in enumerate(ordered[: len(words) - need + 1])]
    index = spark.createDataFrame(prefix, "word string, template int, i int, size int, need int")
    whole = spark.createDataFrame(members, "template int, label string, members array<string>")
    starts = F.array(*[F.lit(w) for w in sorted({p[0] for p in prefix})])
    return (
        held.where(F.arrays_overlap(have, starts))
        .select(*keys, F.array_intersect(shape.vocabulary, have).alias("_have"))
        .select(*keys, "_have", F.size("_have").alias("_n"), F.posexplode("_have").alias("_j", "word"))
        .join(F.broadcast(index), "word")
        .where((F.col("_n") >= F.col("need")) & (1 + F.least(F.col("size") - F.col("i"), F.col("_n") - F.col("_j")) - 1 >= F.col("need")))
        .join(F.broadcast(whole), "template")
        .withColumn("_both", F.size(F.array_intersect("_have", "members")))
        .where(F.col("_both") >= F.col("need"))
        .withColumn("containment", F.col("_both") / F.col("size"))
        .select(*keys, "template", "label", "containment")
        .distinct()
    )


def template_matches(docs: DataFrame, shape: Templates, block: str = r"\n") -> DataFrame:
    """doc_id, key, block, template, label, containment: every pair of a text block and a template at the threshold or above.

    ``docs`` has doc_id, key and _low (the lowered text); blocks are what stands between matches of ``block``.
    """
    blocks = docs.select("doc_id", "key", F.posexplode(F.split("_low", block)).alias("block", "_text"))
    held = blocks.select("doc_id", "key", "block", F.array_intersect(shape.vocabulary, F.split("_text", GAP)).alias("have"))
    return prefix_join(held, replace(shape, sets=[x for x in shape.sets if len(x[2]) > SHORT]), ("doc_id", "key", "block"))


def wrapped_matches(docs: DataFrame, shape: Templates, templates=TEMPLATES) -> DataFrame:
    """doc_id, key, block (-1 less the template), template, label, containment: the best window of each text of several lines
    that holds ``threshold`` of a template's words, wherever its lines end. Windows have a quarter more words than the template.
    Templates of up to ``SHORT`` words are looked for in texts of one line too.

    ``docs`` has doc_id, key, _low and have (the text's set of template words), a text once.
    """
    texts = docs.withColumn("_several", F.contains("_low", F.lit("\n")))
    short = [k for k, _, words in shape.sets if len(words) <= SHORT]
    spans = [(k, span_of(templates[k][1]), words, need_of(len(words), shape.threshold)) for k, _, words in shape.sets]
    wide = docs.sparkSession.createDataFrame(spans, "template int, _span int, _members array<string>, _need int")
    pairs = prefix_join(texts, shape, ("doc_id", "key", "_several")).where(F.col("_several") | F.col("template").isin(short))
    likely = cut(pairs.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "template", "label"))
    likely_rows, likely = likely.count(), likely.join(F.broadcast(wide), "template")
    words = F.filter(F.split("_low", GAP), lambda w: w != "")
    hits = F.filter(F.transform(words, lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: F.array_contains("_members", x["w"]))
    within = lambda h, k: F.filter(F.slice("_hits", k + 1, F.col("_span")), lambda x: x["i"] < h["i"] + F.col("_span"))
    held = F.transform("_hits", lambda h, k: F.size(F.array_distinct(F.transform(within(h, k), lambda x: x["w"]))))
    return (
        texts.join(likely, (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")))
        .repartition(partitions_for(docs.sparkSession, likely_rows, PAIRS), "key", "template")
        .withColumn("_hits", hits)
        .withColumn("_best", F.array_max(held))
        .where(F.col("_best") >= F.col("_need"))
        .withColumn("containment", F.col("_best") / F.size("_members"))
        .select("doc_id", "key", (-1 - F.col("template")).alias("block"), "template", "label", "containment")
    )


def span_of(text: str) -> int:
    """Words of the windows in which a template is looked for."""
    return math.ceil(1.25 * len(re.findall(f"{WORD}+", text.translate(str.maketrans(UPPER, LOWER)))))


def scan_licenses(docs: DataFrame, threshold: float = 0.8, templates=TEMPLATES) -> DataFrame:
    """License labels of every whole text of ``docs`` (doc_id, text).

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks: one row for each row.
    A null text counts as empty: no words, no labels, score 0. Repeated rows and repeated ids each get their own row,
    null ids included. Templates are looked for across line ends too; n_blocks is the number of lines that match and of
    templates that match only so. The score is 1 where a phrase stands, else the best containment at the threshold or
    above, else 0. Other columns of ``docs`` are left out, so their names cannot clash.
    """
    text, shape = F.coalesce("text", F.lit("")), Templates.of(templates, threshold)
    rows = docs.select("doc_id", F.xxhash64(text).alias("key"), ascii_lower(text).alias("_low")).withColumn("_pieces", F.split("_low", GAP)).withColumn("have", F.array_intersect(shape.vocabulary, "_pieces"))
    for name, column in phrase_places().items():
        rows = rows.withColumn(name, column)
    enough = F.size("have") >= shape.least
    read = cut(rows.select("doc_id", "key", "n_words", "n_base", "first_word", "last_word", "base", F.when(enough, F.col("have")).alias("have"), F.when(shape.suffices("have"), F.col("_low")).alias("_low")))
    shape = shape.ordered(frequencies(read))
    texts = read.where(F.col("_low").isNotNull()).select("doc_id", "key", "have", "_low").dropDuplicates(["doc_id", "key"])
    by_line = template_matches(texts, shape)
    lines = by_line.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), F.col("template").alias("_template")).distinct()
    same = (F.col("key") == F.col("_key")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("template") == F.col("_template"))
    wrapped = wrapped_matches(texts, shape, templates).join(lines, same, "left").withColumn("block", F.when(F.col("_template").isNull(), F.col("block")))
    found = (
        by_line.unionByName(wrapped.select(*by_line.columns))
        .groupBy("doc_id", "key")
        .agg(F.max("containment").alias("best"), F.collect_set("label").alias("more"), F.countDistinct("block").alias("n_blocks"))
    )
    joined = read.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.key") == F.col("f.key")), "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "b.doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join(F.array_sort("base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base", F.coalesce("more", none)))), ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("best", F.lit(0.0))).alias("score"),
        F.coalesce("n_blocks", F.lit(0)).cast("long").alias("n_blocks"),
    )


def oracle(threshold: float = 0.8) -> str:
    """DuckDB SQL for the rows of ``scan_licenses``, by comparing every line and every window with every template."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = ", ".join(f"({number}, '{label}', {quoted(words)}, {span_of(TEMPLATES[number][1])})" for number, label, words in template_sets())
    pattern = f"{WORD}+"
    hits = " UNION ALL ".join(
        f"SELECT rid, i - 1 AS p, '{label}' AS label FROM pos WHERE " + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(" ")))
        for phrase, label in PHRASES
    )
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT rid, doc_id, contains(low, chr(10)) AS several, regexp_extract_all(low, '{pattern}') AS ws FROM d),
pos AS (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
hits AS ({hits}),
base AS (SELECT rid, count(*) AS n_base, min(p) AS first_word, max(p) AS last_word, list(DISTINCT label) AS base FROM hits GROUP BY rid),
lines AS (SELECT rid, unnest(string_split(low, chr(10))) AS line, unnest(range(len(string_split(low, chr(10))))) AS block FROM d),
sets AS (SELECT rid, block, regexp_extract_all(line, '{pattern}') AS ws FROM lines),
t(template, label, members, span) AS (VALUES {templates}),
m AS (SELECT rid, block, template, label, len(list_intersect(list_distinct(ws), members))::DOUBLE / len(members) AS c FROM sets, t WHERE len(ws) > 0),
ml AS (SELECT m.* FROM m JOIN t USING (template) WHERE len(members) > {SHORT} AND c >= {threshold} - 1e-12),
near AS (SELECT rid, ws, template, label, members, span FROM w, t WHERE (several OR len(members) <= {SHORT}) AND len(list_intersect(list_distinct(ws), members)) >= CASE WHEN len(members) <= {SHORT} THEN len(members) ELSE {threshold} * len(members) - 1e-9 END),
placed AS (SELECT rid, template, label, members, span, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM near),
own AS (SELECT * FROM placed WHERE list_contains(members, word)),
win AS (SELECT a.rid, a.template, any_value(a.label) AS label, count(DISTINCT b.word)::DOUBLE / any_value(len(a.members)) AS c, any_value(CASE WHEN len(a.members) <= {SHORT} THEN 1.0 ELSE {threshold} END) AS least FROM own a JOIN own b ON a.rid = b.rid AND a.template = b.template AND b.i >= a.i AND b.i < a.i + a.span GROUP BY a.rid, a.template, a.i),
mw AS (SELECT rid, CASE WHEN NOT EXISTS (SELECT 1 FROM ml WHERE ml.rid = win.rid AND ml.template = win.template) THEN -1 - template END AS block, template, any_value(label) AS label, max(c) AS c FROM win WHERE c >= least - 1e-12 GROUP BY ALL),
f AS (SELECT rid, max(c) AS best, list(DISTINCT label) AS more, count(DISTINCT block) AS n_blocks FROM (SELECT * FROM ml UNION ALL SELECT rid, block, template, label, c FROM mw) GROUP BY rid)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(base, more))), ','), '') AS labels,
  greatest(CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END, coalesce(best, 0.0::DOUBLE)) AS score, coalesce(n_blocks, 0) AS n_blocks
FROM w LEFT JOIN base USING (rid) LEFT JOIN f USING (rid)
"""
