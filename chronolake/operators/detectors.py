"""Detectors of anomalies: each gives findings of one shape, so that any of them can be united.

A finding: rule, subject_type, subject_id, severity, old_value, new_value. A detector that lacks its baseline finds
nothing; it never invents a change.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import covers, first_per, newest

SHAPE = ("rule", "subject_type", "subject_id", "severity", "old_value", "new_value")


def _finding(df: DataFrame, rule: str, subject_type: str, subject: Column, severity: Column, old: Column, new: Column) -> DataFrame:
    values = (F.lit(rule), F.lit(subject_type), subject.cast("string"), severity, old.cast("double"), new.cast("double"))
    return df.select(*[v.alias(n) for n, v in zip(SHAPE, values)])


def unite(*findings: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, findings)


def without_evidence(members: DataFrame, evidence: DataFrame, key: str, rule: str = "missing_evidence") -> DataFrame:
    """Members without any row of evidence. If no member has one, the source is gone: one finding for it all."""
    lacking = members.select(key).distinct().join(evidence.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    counts = lacking.agg(F.count(F.lit(1)).alias("_n"), F.count("_there").alias("_known"))
    whole = _finding(counts.where("_n > 0 AND _known = 0"), rule, "source", F.lit("all"), F.lit("high"), F.col("_n"), F.lit(0))
    single = lacking.where("_there IS NULL").join(F.broadcast(counts), F.col("_known") > 0)
    return unite(_finding(single, rule, key, F.col(key), F.lit("medium"), F.lit(1), F.lit(0)), whole)


def unexplained_moves(bars: DataFrame, day: Column, n: int = 30, least: float = 0.25, high: float = 0.5) -> DataFrame:
    """Closes among each security's last ``n`` bars up to ``day`` that moved by ``least`` or more on a day whose bar declares
    neither a split nor a dividend.

    ``bars``: security_id, date, close, split_ratio, dividends, actions_complete. A move counts only against the bar before
    it within the window. A security with a bar that can't be judged (actions not complete, split or dividend unknown, close
    not positive) has one finding for that instead: a scan never guesses.
    """
    c, w = F.col, Window.partitionBy("security_id")
    last = first_per(bars.where(c("date") <= day), ["security_id"], newest("date"), n).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1")
    judged = F.coalesce(c("actions_complete") & c("split_ratio").isNotNull() & c("dividends").isNotNull() & (c("close") > 0), F.lit(False))
    rows = last.withColumns({"_bad": F.count_if(~judged).over(w), "_before": F.lag("close").over(w.orderBy("date"))})
    move = c("close") / c("_before") - 1
    found = rows.where((c("_bad") == 0) & (F.abs(move) >= least) & (c("split_ratio") == 1) & (c("dividends") == 0))
    moved = _finding(found, "price_action_mismatch", "security_session", F.concat_ws("@", "security_id", "date"), F.when(F.abs(move) >= high, "high").otherwise("medium"), c("_before"), c("close"))
    unsure = rows.where("_bad > 0").groupBy("security_id").agg(F.max("_bad").alias("_bad"))
    return unite(moved, _finding(unsure, "price_action_mismatch", "security", c("security_id"), F.lit("withheld"), F.lit(0), c("_bad")))


def share_jumps(facts: DataFrame, day: Column, n: int = 8, least: float = 0.30) -> DataFrame:
    """Share counts of each issuer's last ``n`` filing dates up to ``day`` that aren't positive, or that jump by ``least`` or
    more: from one filing's newest period to the next filing's (of several values the least), or between periods of one filing.

    ``facts``: issuer_id, period_end, as_of_date, value.
    """
    c, by = F.col, Window.partitionBy("issuer_id")
    seen = facts.where((c("as_of_date") <= day) & (c("period_end") <= c("as_of_date")) & c("value").isNotNull()).select("issuer_id", "period_end", "as_of_date", "value").distinct()
    recent = seen.withColumn("_v", F.dense_rank().over(by.orderBy(F.desc("as_of_date")))).where(c("_v") <= n).withColumn("_n", F.count(F.lit(1)).over(by)).where("_n > 1")
    subject = F.concat(c("issuer_id").cast("string"), F.lit("@"), c("period_end").cast("string"), F.lit("#"), c("as_of_date").cast("string"))
    bad = _finding(recent.where("value <= 0"), "share_count_jump", "share_count", subject, F.lit("high"), F.lit(None), c("value"))
    good = recent.where("value > 0")
    newest_period = first_per(good, ["issuer_id", "as_of_date"], [c("period_end").desc(), c("value").asc()])

    def jumps(rows: DataFrame, keys: Sequence[str], order: Sequence[str], kind: str) -> DataFrame:
        before = F.lag("value").over(Window.partitionBy(*keys).orderBy(*order))
        found = rows.withColumn("_before", before).where(F.abs(c("value") / c("_before") - 1) >= least)
        return _finding(found, "share_count_jump", kind, subject, F.lit("high"), c("_before"), c("value"))

    return unite(bad, jumps(newest_period, ["issuer_id"], ["as_of_date"], "inter_vintage"), jumps(good, ["issuer_id", "as_of_date"], ["period_end", "value"], "intra_vintage"))


def conflicting_filings(facts: DataFrame, members: DataFrame, day: Column) -> DataFrame:
    """Keys of members (``members``: issuer_id) for which several values were known on one date, up to ``day``.

    ``facts``: issuer_id, metric, period_end, as_of_date, value.
    """
    c = F.col
    seen = facts.where((c("as_of_date") <= day) & (c("period_end") <= c("as_of_date")) & c("value").isNotNull()).join(members.select("issuer_id").distinct(), "issuer_id", "left_semi")
    keys = ("issuer_id", "metric", "period_end", "as_of_date")
    several = seen.groupBy(*keys).agg(F.countDistinct("value").alias("_n")).where("_n > 1")
    subject = F.concat(c("issuer_id").cast("string"), F.lit(":"), "metric", F.lit("@"), c("period_end").cast("string"), F.lit("#"), c("as_of_date").cast("string"))
    return _finding(several, "conflicting_filings", "issuer_metric_period", subject, F.lit("high"), F.lit(1), c("_n"))


def fundamentals_coverage(members: DataFrame, facts: DataFrame, accepted: DataFrame, day: Column) -> DataFrame:
    """Members (issuer_id, ticker) without facts known by ``day`` whose ingest was accepted (``accepted``: run_id).

    Several securities of one issuer are one member. If no member has any, the source is gone: one finding for it all. A
    member that has facts, but none of an accepted ingest, is said to be unverified.
    """
    c = F.col
    known = facts.where((c("as_of_date") <= day) & (c("period_end") <= c("as_of_date"))).select("issuer_id", "run_id")
    fine = known.join(accepted.select("run_id").distinct(), "run_id", "left_semi").select("issuer_id").distinct().withColumn("_fine", F.lit(True))
    any_ = known.select("issuer_id").distinct().withColumn("_any", F.lit(True))
    asked = members.groupBy("issuer_id").agg(F.min("ticker").alias("ticker")).join(fine, "issuer_id", "left").join(any_, "issuer_id", "left")
    counts = asked.agg(F.count(F.lit(1)).alias("_n"), F.count("_fine").alias("_known"))
    whole = _finding(counts.where("_n > 0 AND _known = 0"), "fundamentals_coverage", "source", F.lit("all"), F.lit("high"), c("_n"), F.lit(0))
    single = asked.where("_fine IS NULL").join(F.broadcast(counts), c("_known") > 0)
    return unite(_finding(single, "fundamentals_coverage", "issuer", c("issuer_id"), F.when(c("_any"), "unverified").otherwise("missing"), F.lit(1), F.lit(0)), whole)


def coverage_drop(baseline: DataFrame, current: DataFrame, metrics: Sequence[str], keys: Sequence[str], least: int = 1, high: int = 5) -> DataFrame:
    """Coverage counts of each scope that fell by ``least`` or more since the baseline; ``high`` or more is severe."""
    old, new = (df.unpivot(list(keys), list(metrics), "_metric", name) for df, name in ((baseline, "_old"), (current, "_new")))
    drop = F.col("_old") - F.col("_new")
    fell = old.join(new, [*keys, "_metric"]).where(drop >= least)
    return _finding(fell, "coverage_drop", "coverage_metric", F.concat_ws(":", *keys, "_metric"), F.when(drop >= high, "high").otherwise("medium"), F.col("_old"), F.col("_new"))


def mapping_drift(mappings: DataFrame, day: Column) -> DataFrame:
    """On ``day``: securities with several windows of one provider, and symbols that several securities claim.

    ``mappings``: provider, provider_symbol, security_id, start, end (open if null). Symbols are compared in upper case.
    """
    active = mappings.where(covers(F.col("start"), F.col("end"), day))
    windows = active.groupBy("security_id", "provider").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    claims = active.groupBy("provider", F.upper("provider_symbol").alias("_symbol")).agg(F.countDistinct("security_id").alias("_n")).where("_n > 1")
    return unite(
        _finding(windows, "mapping_drift", "security_provider", F.concat_ws(":", "security_id", "provider"), F.lit("high"), F.lit(1), F.col("_n")),
        _finding(claims, "mapping_drift", "provider_symbol", F.concat_ws(":", "provider", "_symbol"), F.lit("high"), F.lit(1), F.col("_n")),
    )


def percentile_jump(baseline: DataFrame, current: DataFrame, key: str, score: str, least: float = 40.0, high: float = 60.0) -> DataFrame:
    """Members of both snapshots whose score (0 to 100) moved by ``least`` points or more."""
    both = baseline.select(key, F.col(score).alias("_old")).join(current.select(key, F.col(score).alias("_new")), key)
    move = F.abs(F.col("_new") - F.col("_old"))
    return _finding(both.where(move >= least), "percentile_jump", "member_score", F.col(key), F.when(move >= high, "high").otherwise("medium"), F.col("_old"), F.col("_new"))
