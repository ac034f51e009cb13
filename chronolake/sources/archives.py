"""Raw material -> documents: members of archives, ticker maps, press releases' tables, component lists, kept payloads.

Readers give the rows that the others take: ``key`` and ``payload``, or typed rows with ``problem``. Files are read by
Spark (``binaryFile``), so any store that Spark reads will do.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator, Mapping
from html.parser import HTMLParser
from types import MappingProxyType

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import zipped

#: Names of the members that hold a company's facts. Fixed value.
FACTS_MEMBER = r"(^|/)CIK\d{10}\.json$"
#: How an index's name stands in a table, without spaces and case; months as a release writes them. Fixed values.
INDEX, INDEX_FAMILY = "s&p500", "s&p"
RELEASE_DATE = r"^(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2}, \d{4}$"
TICKER = r"^[A-Z0-9.]+$"


def members(spark: SparkSession, path: str, pattern: str = FACTS_MEMBER, range_bytes: int = zipped.RANGE_BYTES) -> DataFrame:
    """archive, key (the member's name without folders), payload (text), problem: the members of ZIP files whose name fits.

    ``path`` is a file, a folder, or a pattern of file names. Ranges of ``range_bytes`` of an archive are tasks of their own,
    and a task holds one member at a time. A member that isn't UTF-8 or damaged, that is longer than a gigabyte, or that stands
    twice, and a file that is no archive, have a problem.
    """
    return zipped.read(spark, path, pattern, range_bytes)


#: Numbers of tickers that the provider's map gives to an issuer without facts. Fixed values.
ISSUERS_OF_TICKERS = {"XOM": 34088}


def ticker_map(documents: DataFrame, overrides: Mapping[str, int] = MappingProxyType(ISSUERS_OF_TICKERS)) -> DataFrame:
    """key, ticker, cik, title, problem of documents that map numbers to {cik_str, ticker, title}. A ticker stands once.

    The tickers of ``overrides`` get the number given there, whatever the document says.
    """
    shape = "map<string, struct<cik_str: bigint, ticker: string, title: string>>"
    rows = documents.select("key", F.explode(F.from_json("payload", shape)).alias("_n", "_r")).select("key", F.upper(F.trim("_r.ticker")).alias("ticker"), F.col("_r.cik_str").alias("cik"), F.trim("_r.title").alias("title"))
    for ticker, number in overrides.items():
        rows = rows.withColumn("cik", F.when(F.col("ticker") == ticker, number).otherwise(F.col("cik")))
    again = F.count(F.lit(1)).over(Window.partitionBy("key", "ticker")) > 1
    problem = F.when(F.coalesce(F.col("ticker"), F.lit("")) == "", "lacks a ticker").when(~F.coalesce(F.col("cik") > 0, F.lit(False)), "CIK is not positive").when(F.coalesce(F.col("title"), F.lit("")) == "", "lacks a title").when(again, "ticker stands twice")
    return rows.withColumn("problem", problem)


class _Tables(HTMLParser):
    """The cells of every table row of a page."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list[str]] = []
        self._row: list[str] | None = None
        self._cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._row = []
        elif tag in ("td", "th") and self._row is not None:
            self._cell = []

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self._cell is not None:
            self._row.append(" ".join("".join(self._cell).split()))
            self._cell = None
        elif tag == "tr" and self._row is not None:
            self.rows.append(self._row)
            self._row = None


def table_rows(documents: DataFrame) -> DataFrame:
    """key, position, cells of every row of every table of HTML documents. Pages are short; a task reads one at a time."""

    def parsed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, payload in zip(frame["key"], frame["payload"], strict=True):
                page = _Tables()
                page.feed(payload or "")
                page.close()
                out += [(key, k, cells) for k, cells in enumerate(page.rows)]
            yield pd.DataFrame(out, columns=["key", "position", "cells"])

    return documents.select("key", "payload").mapInPandas(parsed, "key string, position int, cells array<string>")


def constituent_changes(documents: DataFrame) -> DataFrame:
    """key, effective_date, action, company, ticker, problem of press releases: additions to and deletions from the index.

    A row of the table names the index once, then the action, the company and the ticker; one of its cells is the date.
    Rows of other indices are left out. Rows that don't say it clearly, a release whose additions and deletions don't
    balance, one that repeats an event, and one without any event have a problem.
    """
    c = F.col
    plain = F.transform("cells", lambda x: F.lower(F.replace(x, F.lit(" "), F.lit(""))))
    rows = table_rows(documents).withColumns({"_plain": plain, "_acts": F.transform("cells", lambda x: F.lower(x))})
    at = lambda column, test: F.filter(F.sequence(F.lit(0), F.size("cells") - 1), lambda i: test(F.get(column, i)))
    rows = rows.where(F.size("cells") > 0).withColumns({"_index": at(c("_plain"), lambda x: x == INDEX), "_family": at(c("_plain"), lambda x: x.startswith(INDEX_FAMILY)), "_action": at(c("_acts"), lambda x: x.isin("addition", "deletion")), "_dates": F.filter("cells", lambda x: x.rlike(RELEASE_DATE))})
    one = lambda name: F.size(name) == 1
    other = (F.size("_index") == 0) & one("_action") & one("_family") & (F.get("_family", F.lit(0)) + 1 == F.get("_action", F.lit(0)))
    named = rows.where((F.size("_index") > 0) | (F.size("_action") > 0)).where(~other)
    place = F.get("_action", F.lit(0))
    clear = one("_index") & one("_family") & one("_action") & (F.get("_index", F.lit(0)) + 1 == place)
    day = F.coalesce(*[F.try_to_date(F.get("_dates", F.lit(0)), f) for f in ("MMMM d, yyyy", "MMM d, yyyy")])
    said = named.select("key", day.alias("effective_date"), F.get("_acts", place).alias("action"), F.get("cells", place + 1).alias("company"), F.upper(F.get("cells", place + 2)).alias("ticker"), clear.alias("_clear"), one("_dates").alias("_dated"))
    whole = Window.partitionBy("key")
    problem = (
        F.when(~c("_clear"), "index and action are not clear")
        .when(c("ticker").isNull(), "row is not complete")
        .when(~c("_dated") | c("effective_date").isNull(), "no single date")
        .when(~c("ticker").rlike(TICKER), "ticker is not valid")
        .when(F.count(F.lit(1)).over(Window.partitionBy("key", "effective_date", "action", "ticker")) > 1, "event is repeated")
        .when(F.count_if(c("action") == "addition").over(whole) != F.count_if(c("action") == "deletion").over(whole), "additions and deletions do not balance")
    )
    found = said.withColumn("problem", problem).drop("_clear", "_dated")
    none = documents.select("key").join(found.select("key").distinct(), "key", "left_anti").withColumn("problem", F.lit("no change of the index"))
    return found.unionByName(none, allowMissingColumns=True)


def components(documents: DataFrame, least: int = 1, most: int = 1_000_000) -> DataFrame:
    """key, ticker, cik (ten digits), problem of CSV documents with the columns Symbol and CIK among others.

    A list of fewer than ``least`` or more than ``most`` rows is a problem of each of its rows.
    """
    c = F.col
    text = F.regexp_replace(F.coalesce("payload", F.lit("")), "^﻿", "")
    lines = documents.select("key", F.split(text, "\r?\n").alias("_l")).withColumn("_head", F.transform(F.split(F.get("_l", F.lit(0)), ","), lambda x: F.trim(F.replace(x, F.lit('"'), F.lit("")))))
    placed = lines.withColumns({"_s": F.array_position("_head", "Symbol").cast("int"), "_k": F.array_position("_head", "CIK").cast("int")})
    wrong = placed.where("_s = 0 OR _k = 0").select("key", F.lit("lacks Symbol or CIK").alias("problem"))
    # A cell is quoted text, in which two quotes are one, or runs up to the next comma.
    cells = placed.where("_s > 0 AND _k > 0").select("key", "_s", "_k", F.explode(F.slice("_l", 2, F.size("_l"))).alias("_line")).where(F.trim("_line") != "")
    cells = cells.withColumn("_r", F.regexp_extract_all("_line", F.lit(r'(?:^|,)(\s*"(?:[^"]|"")*"\s*|[^,]*)'), F.lit(1)))
    bare = lambda x: F.when(F.trim(x).startswith('"'), F.replace(F.regexp_replace(F.trim(x), '^"|"$', ""), F.lit('""'), F.lit('"'))).otherwise(x)
    at = lambda name: bare(F.get("_r", c(name) - 1))
    typed = cells.select("key", F.upper(F.trim(at("_s"))).alias("ticker"), F.trim(at("_k")).alias("_cik"))
    w = Window.partitionBy("key")
    number = F.expr("try_cast(_cik AS bigint)")
    problem = (
        F.when(~F.coalesce(c("ticker").rlike(TICKER), F.lit(False)), "ticker is not valid")
        .when(~F.coalesce(number.between(1, 9_999_999_999), F.lit(False)), "CIK is not valid")
        .when(F.count(F.lit(1)).over(Window.partitionBy("key", "ticker")) > 1, "ticker stands twice")
        .when(~F.count(F.lit(1)).over(w).between(least, most), "list is too short or too long")
    )
    return typed.withColumns({"cik": F.lpad(number.cast("string"), 10, "0"), "problem": problem}).drop("_cik").unionByName(wrong, allowMissingColumns=True)


def kept_payloads(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """snapshot_id, key, payload, problem: kept gzip files, read and held against what was written down of them.

    ``expected``: snapshot_id, file (the file's name), payload_sha256, original_bytes, stored_bytes. A file that isn't there,
    that has another size, or whose unpacked bytes have another digest or length, has a problem and no payload.
    """
    c = F.col

    def unpacked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, stored, content in zip(frame["file"], frame["length"], frame["content"], strict=True):
                try:
                    whole = gzip.decompress(content)
                except (OSError, EOFError, zlib.error):
                    whole = None
                yield pd.DataFrame([(name, stored, whole)], columns=["file", "length", "content"])

    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", "content").mapInPandas(unpacked, "file string, length long, content binary")
    met = expected.join(files, "file", "left")
    problem = (
        F.when(c("length").isNull(), "file is not there")
        .when(c("content").isNull(), "file can't be unpacked")
        .when(c("length") != c("stored_bytes"), "file has another size")
        .when(F.octet_length("content") != c("original_bytes"), "payload has another size")
        .when(F.sha2("content", 256) != c("payload_sha256"), "payload has another digest")
    )
    return met.withColumn("problem", problem).select("snapshot_id", c("file").alias("key"), F.when(c("problem").isNull(), F.decode("content", "UTF-8")).alias("payload"), "problem")
