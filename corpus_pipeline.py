"""A training corpus from raw documents: five stages, each one of the text operators over all that the stage before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written as Parquet and read again as the
next one's ``docs``. All but the last return the columns of ``documents``. Tables without rows pass through all stages.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import bpe, lines, mixing, similar, toxicity
from chronolake.llm.common import DOC_COLUMNS, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels of ``docs``, rejects go.

    Null and empty texts score the bias alone and stay; repeated rows share a score; without labels of both kinds all stay.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, passing=DOC_COLUMNS).where("predicted = 0").select(*DOC_COLUMNS)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines on more than a tenth of their source's documents go; documents stay.

    A null text stays null; null sources are one site; repeated texts count once on both sides of the share, and all stay.
    """
    return lines.dedup_lines(docs).select(*DOC_COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts whose SimHash fingerprints are linked as in ``op6``, or whose
    sets of five-word shingles have an exact similarity of 0.8; groups chain through links of both kinds.

    That of the smallest doc_id; of rows with one id, or none, the first by fingerprint, text and the other columns. Null and
    empty texts are one group. Rows that repeat one another leave one.
    """
    return similar.keep_one(docs.select(*DOC_COLUMNS), prints=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, a row for each time that it takes some of a document.

    Null and empty texts go, as they have no words to take. Repeated rows are different documents of their source.
    """
    return mixing.mixed_documents(docs.select(*DOC_COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row, and digests of the ids and of the bytes that they decode to; no ids for a null or empty text."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    encoded = bpe.tokenize(docs, ranks, public_tokenizers.PATTERN, passing=("doc_id", "lang", "source"))
    return encoded.select("doc_id", "lang", "source", *bpe.digests(encoded), "token_ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate),
    ("near_dedup", drop_near_duplicates),
    ("source_mix", mix_sources),
    ("byte_bpe", tokenize),
]

#: SQL can express neither the classifier nor the draws of the mix; the stages' operators are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to a folder of this run under the shared folder."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4()}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
