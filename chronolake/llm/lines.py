"""Line de-duplication by site-relative frequency.

A line is boilerplate of a host when more than ``max_ratio`` of the host's pages hold it (and ``min_pages`` at least).
Pages with the same text count once, on both sides of the ratio: a page that was fetched a thousand times must not turn
its own body into boilerplate.

Pages travel as arrays of line hashes, never as text. At most ``mean lines of a page / max_ratio`` lines of a host can
pass the ratio, so each host's boilerplate is a short array, and the documents are joined to it by host. That table is
broadcast if it measures at most ``BROADCAST_BYTES``; beyond it, hosts are dealt out with one salt for every
``SALT_PAGES`` of their own pages, so no task gets more of a hot host than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

BROADCAST_BYTES = 32 << 20
SALT_PAGES = 50_000
#: Hosts with more pages than that, whose numbers of salts are broadcast: at 100 bytes each, 200 MB.
BROADCAST_ROWS = 2_000_000


def _key(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def _keys(text: Column) -> Column:
    """Distinct hashes of the lines that are not blank."""
    return F.array_distinct(F.transform(F.filter(F.split(text, "\n", -1), lambda x: F.trim(x) != ""), _key))


def boilerplate(pages: DataFrame, max_ratio: float, min_pages: int) -> DataFrame:
    """host, host_pages, keys (hashes of its boilerplate lines), of ``pages`` (_host, text)."""
    once = pages.groupBy("_host", F.xxhash64("text").alias("_page"), F.length("text").alias("_length")).agg(F.first(_keys(F.col("text"))).alias("_keys"))
    hosts = once.groupBy("_host").agg(F.count(F.lit(1)).alias("host_pages"))
    held = once.select("_host", F.explode("_keys").alias("key")).groupBy("_host", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    return (
        held.join(hosts, "_host")
        .where(F.col("n") / F.col("host_pages") > max_ratio)
        .groupBy("_host")
        .agg(F.collect_list("key").alias("keys"), F.first("host_pages").alias("host_pages"))
    )


def _with_boilerplate(named: DataFrame, found: DataFrame) -> DataFrame:
    """``named`` with _boiler, the boilerplate of its host, or null."""
    found = cut(found.select("_host", F.col("keys").alias("_boiler"), F.ceil(F.col("host_pages") / SALT_PAGES).alias("_salts")))
    measured = found.agg(F.sum(F.size("_boiler") * 8 + F.length("_host") + 64).alias("bytes")).first()["bytes"] or 0
    if measured <= BROADCAST_BYTES:
        return named.join(F.broadcast(found), "_host", "left").drop("_salts")
    # Each host is repeated for its own salts; those with several are few, one for every SALT_PAGES pages of the corpus at most.
    hot = found.where("_salts > 1").select("_host", "_salts")
    if hot.count() > BROADCAST_ROWS:
        raise ValueError(f"more than {BROADCAST_ROWS} hosts of over {SALT_PAGES} pages: raise SALT_PAGES")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1))).drop("_salts")
    dealt = named.join(F.broadcast(hot), "_host", "left").withColumn("_salt", F.pmod("_id", F.coalesce("_salts", F.lit(1).cast("long")))).drop("_salts")
    return dealt.join(salted, ["_host", "_salt"], "left").drop("_salt")


def dedup_lines(docs: DataFrame, host: str = "source", max_ratio: float = 0.1, min_pages: int = 3) -> DataFrame:
    """``docs`` without the lines that are boilerplate of their host, and n_lines, n_dropped.

    All columns stay; n_chars, if there, follows the new text; columns of ``docs`` with the two names give way. Lines are
    what stands between line feeds; they are compared without the spaces around them. Blank lines are neither counted nor
    dropped. A null text stays null with 0 lines; a text all of whose lines go becomes empty. Null hosts form one host.
    Repeated rows stay repeated. The columns of ``docs`` travel as one, so they may have any names.
    """
    named = docs.select(F.coalesce(F.concat(F.lit("h"), F.col(f"`{host}`")), F.lit("")).alias("_host"), "text", F.xxhash64("doc_id", "text").alias("_id"), F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    found = boilerplate(named.select("_host", "text").where(F.col("text").isNotNull()), max_ratio, min_pages)
    lines = F.split("text", "\n", -1)
    joined = _with_boilerplate(named, found)
    kept = F.filter("_lines", lambda x: (F.trim(x) == "") | ~F.array_contains("_boiler", _key(x)))
    result = (
        joined.withColumn("_lines", lines)
        .withColumn("_kept", F.when(F.col("_boiler").isNull(), F.col("_lines")).otherwise(kept))
        .withColumn("n_lines", F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines")), F.lit(0)).cast("long"))
        .withColumn("n_dropped", F.coalesce(F.when(F.col("text").isNotNull(), F.size("_lines") - F.size("_kept")), F.lit(0)).cast("long"))
        .withColumn("text", F.when(F.col("n_dropped") > 0, F.array_join("_kept", "\n")).otherwise(F.col("text")))
    )
    own = {c: F.col("row").getField(c) for c in docs.columns if c not in ("n_lines", "n_dropped")} | {"text": F.col("text")}
    if "n_chars" in own:
        own["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(own["n_chars"])
    return result.select(*[x.alias(c) for c, x in own.items()], "n_lines", "n_dropped")


def oracle(max_ratio: float = 0.1, min_pages: int = 3) -> str:
    """DuckDB SQL for ``op10``: doc_id, source, n_lines, n_dropped, text_sha256."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, text FROM documents),
once AS (SELECT DISTINCT source, text FROM d WHERE text IS NOT NULL),
pages AS (SELECT source, count(*) AS host_pages FROM once GROUP BY source),
held AS (SELECT source, line, count(*) AS n FROM (SELECT DISTINCT source, text, trim(line) AS line FROM (SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM once)) WHERE line <> '' GROUP BY source, line),
boiler AS (SELECT h.source, list(line) AS lines FROM held h JOIN pages p ON h.source IS NOT DISTINCT FROM p.source WHERE n >= {min_pages} AND n::DOUBLE / host_pages > {max_ratio} GROUP BY h.source),
k AS (SELECT d.doc_id, d.source, d.text, string_split(d.text, chr(10)) AS ls, coalesce(b.lines, []::VARCHAR[]) AS bl FROM d LEFT JOIN boiler b ON d.source IS NOT DISTINCT FROM b.source),
r AS (SELECT *, list_filter(ls, lambda x: trim(x) = '' OR NOT list_contains(bl, trim(x))) AS kept FROM k)
SELECT doc_id, source, coalesce(len(ls), 0) AS n_lines, coalesce(len(ls) - len(kept), 0) AS n_dropped,
  sha256(CASE WHEN len(ls) > len(kept) THEN coalesce(array_to_string(kept, chr(10)), '') ELSE text END) AS text_sha256
FROM r
"""
