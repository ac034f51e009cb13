"""Rules by which provider rows become stored rows: spans, contexts, keys, versions, memberships, histories.

Nothing is repaired silently: what breaks a rule carries its name in ``problem``, and ``refuse`` turns that into a failure.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import intervals
from .asof import covers, exactly_one, few, member_on
from .facts import upsert

#: Longest span of a reported period in days, widest repair of a bar in basis points, longest run of missing sessions,
#: least share of sessions present, days that a history may start late or end early. Fixed values.
LONGEST_SPAN, WIDEST_REPAIR, LONGEST_HOLE, LEAST_SHARE, EDGE = 400, 100.0, 5, 0.95, 7
#: Forms of yearly and of shorter reports. Fixed values.
ANNUAL_FORMS, INTERIM_FORMS = ("10-K", "10-K/A", "20-F", "20-F/A", "40-F", "40-F/A"), ("10-Q", "10-Q/A", "6-K", "6-K/A", "8-K", "8-K/A")


def refuse(rows: DataFrame, subject: str) -> DataFrame:
    """``rows`` without ``problem``, failing at run time at the first row that has one."""
    failed = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat_ws(" ", "problem", F.col(subject).cast("string"))).cast("boolean")).otherwise(F.lit(True))
    return rows.where(failed).drop("problem")


def _span() -> Column:
    return F.datediff("end", "start")


def single_period(rows: DataFrame, keys: Sequence[str], order: str = "position", complete: bool = False) -> DataFrame:
    """Adds period_value: of the rows of one filing and period end, the value with the shortest span, or the longest where
    any is of a full year. A lone row keeps its value; of several, those without a start have no say. Ties go by ``order``.

    ``rows``: keys (the filing among them), start, end, fp, val. Groups are one company's rows of one concept and filing.
    ``complete``: all of them have a val and an end, so groups are those of ``period_contexts`` and need no order of their own.
    """
    said = F.lit(True) if complete else F.col("val").isNotNull() & F.col("end").isNotNull()
    group = Window.partitionBy(*keys, "end") if complete else Window.partitionBy(*keys, "end", said)
    there = said & _span().isNotNull()
    row = F.struct(_span().alias("span"), F.col(order).alias("order"), F.col("val").alias("val"))
    longest, shortest = F.max(F.when(there, row)).over(group), F.min(F.when(there, row)).over(group)
    annual = F.coalesce(F.max(F.when(said, F.col("fp") == "FY")).over(group), F.lit(False))
    chosen = F.when(F.count(F.lit(1)).over(group) == 1, F.col("val")).when(annual, longest["val"]).otherwise(shortest["val"])
    return rows.withColumn("period_value", F.when(said, chosen))


def period_contexts(rows: DataFrame, keys: Sequence[str], unit: Column) -> DataFrame:
    """The rows of exactly ``unit`` that stand for their filing's period: all of the longest span of a full year, or of the
    shortest of a part of it. Filings whose rows of one end disagree on the fiscal period are left out whole, as are
    spans of no day or of more than ``LONGEST_SPAN``, and rows of forms that don't carry such a period.
    """
    c = F.col
    named = (F.trim("form") != "") & (F.trim("fp") != "") & c("fy").isNotNull() & c("filed").isNotNull()
    whole = rows.where((c("unit") == unit) & c("val").isNotNull() & named & _span().between(1, LONGEST_SPAN))
    group = Window.partitionBy(*keys, "end")
    context = F.struct(F.trim("fp"), "fy")
    same = F.min(context).over(group) == F.max(context).over(group)
    annual = F.trim("fp") == "FY"
    formed = F.when(annual, F.trim("form").isin(*ANNUAL_FORMS)).otherwise(F.trim("form").isin(*INTERIM_FORMS))
    span = F.when(formed, _span())  # rows of other forms have no say in it
    wanted = F.when(annual, F.max(span).over(group)).otherwise(F.min(span).over(group))
    return whole.withColumns({"_same": same, "_wanted": wanted}).where(c("_same") & formed & (_span() == c("_wanted"))).drop("_same", "_wanted")


def storage_rows(rows: DataFrame, keys: Sequence[str], economics: Sequence[str], order: str, keep_first: bool = True, priority: str | None = None) -> DataFrame:
    """keys, economics, conflict: one row for each storage key.

    Where rows of a key disagree on the economics the first by ``order`` wins (``keep_first``) or the key is withheld. With
    ``priority`` only the rows of the lowest priority of a key count. Aggregates only, so a hot key is combined map-side.
    """
    rank = [F.coalesce(F.col(priority), F.lit(0))] if priority else []
    first = F.min(F.struct(*[r.alias("_priority") for r in rank], F.col(order).alias("_order"), F.struct(*economics).alias("_e")))
    if priority:
        lowest = F.min(rank[0]).over(Window.partitionBy(*keys))
        rows = rows.withColumn("_lowest", lowest).where(rank[0] == F.col("_lowest"))
    said = F.struct(*economics)
    found = rows.groupBy(*keys).agg(first.alias("_first"), (F.to_json(F.min(said)) != F.to_json(F.max(said))).alias("conflict"))
    kept = found if keep_first else found.where("NOT conflict")
    return kept.select(*keys, "_first._e.*", "conflict")


def repair_envelope(bars: DataFrame) -> DataFrame:
    """Adds repaired: bars whose open or close lies outside high and low by less than ``WIDEST_REPAIR`` are widened; others stay."""
    c, four = F.col, ("open", "high", "low", "close")
    fine = F.lit(True)
    for name in four:
        fine = fine & F.coalesce((c(name) > 0) & (c(name) < float("inf")), F.lit(False))
    top, bottom = F.greatest(*four), F.least(*four)
    gap = F.greatest(top - c("high"), c("low") - bottom)
    small = F.when(fine, (gap > 0) & (gap / c("close") * 10_000 < WIDEST_REPAIR)).otherwise(False)
    return bars.withColumns({"repaired": small, "high": F.when(small, top).otherwise(c("high")), "low": F.when(small, bottom).otherwise(c("low"))})


def membership(baseline: DataFrame, events: DataFrame, key: str, first: Column, last: Column) -> DataFrame:
    """key, start, end, known, end_known, problem: members on ``first`` (``baseline``: key), changed by ``events`` (key, date,
    action, known, position) after ``first`` and up to ``last``; who is a member at the end leaves the day after ``last``.

    A deletion of who isn't a member and an addition of who is are problems; each has a row of its own.
    """
    c = F.col
    opened = baseline.select(key, first.alias("date"), F.lit("addition").alias("action"), first.alias("known"), F.lit(-1).cast("long").alias("position")).distinct()
    inside = events.where((c("date") > first) & (c("date") <= last)).select(key, "date", "action", "known", c("position").cast("long").alias("position"))
    w = Window.partitionBy(key).orderBy("date", "position")
    before = F.lag("action").over(w)
    problem = F.when((c("action") == "deletion") & F.coalesce(before != "addition", F.lit(True)), "deletion of an inactive member").when((c("action") == "addition") & (before == "addition"), "addition of an active member")
    rows = opened.unionByName(inside).withColumns({"problem": problem, "_next": F.lead("date").over(w), "_next_known": F.lead("known").over(w)})
    kept = rows.where((c("action") == "addition") | c("problem").isNotNull())
    return kept.select(key, c("date").alias("start"), F.coalesce("_next", F.date_add(last, 1)).alias("end"), "known", F.coalesce("_next_known", last).alias("end_known"), "problem")


def validated_histories(prices: DataFrame, windows: DataFrame, sessions: DataFrame, key: str) -> DataFrame:
    """key, n_rows, n_sessions, problem: does each window [start, end) of ``windows`` have the prices that a history needs?

    ``sessions`` (date) is an exchange's calendar, some 250 rows a year, and is broadcast; prices meet it by key and date.
    """
    c = F.col
    index = sessions.select("date").distinct().withColumn("_at", F.row_number().over(Window.orderBy("date")))
    expected = windows.select(key, "start", "end").join(few(index), (c("date") >= c("start")) & (c("date") < c("end"))).select(key, "date", "_at")
    actual = prices.groupBy(key, "date").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~F.coalesce(c("close") > 0, F.lit(False))).alias("_bad"))
    met = expected.join(actual, [key, "date"], "full_outer")
    missing = met.where("_n IS NULL").withColumn("_island", c("_at") - F.row_number().over(Window.partitionBy(key).orderBy("_at")))
    holes = missing.groupBy(key, "_island").agg(F.count(F.lit(1)).alias("_k")).groupBy(key).agg(F.max("_k").alias("_hole"))
    seen = met.groupBy(key).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("_at").alias("n_sessions"), F.max("_n").alias("_most"), F.sum("_bad").alias("_bad"), F.min(F.when(c("_n") > 0, c("date"))).alias("_first"), F.max(F.when(c("_n") > 0, c("date"))).alias("_last"), F.count_if(c("_at").isNull()).alias("_strange"))
    joined = windows.select(key, "start", "end").join(seen, key, "left").join(holes, key, "left")
    problem = (
        F.when(F.coalesce("n_rows", F.lit(0)) == 0, "no rows")
        .when(c("_most") > 1, "duplicate dates")
        .when((c("_first") < c("start")) | (c("_last") >= c("end")), "rows outside the window")
        .when(c("_bad") > 0, "missing or non-positive close")
        .when(c("n_sessions") == 0, "no sessions")
        .when(c("_strange") > 0, "not a session")
        .when(c("n_rows") < F.greatest(F.lit(1), F.floor(c("n_sessions") * LEAST_SHARE)), "incomplete")
        .when(c("_hole") > LONGEST_HOLE, "too many missing sessions in a row")
        .when(c("_first") > F.date_add("start", EDGE), "begins too late")
        .when(c("_last") < F.date_sub("end", EDGE), "ends too early")
    )
    return joined.select(key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_sessions", F.lit(0)).alias("n_sessions"), problem.alias("problem"))


def append_versions(stored: DataFrame, arrived: DataFrame, keys: Sequence[str], version: str = "version") -> DataFrame:
    """The rows to append: new keys as version 1, keys whose newest stored version differs as the next; equal ones none.

    Adds problem where a key arrives more than once.
    """
    rest = [c for c in arrived.columns if c not in keys]
    newest = stored.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("_old"), F.max(version).alias("_version"))
    once = arrived.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    joined = once.join(newest, list(keys), "left")
    same = F.lit(True)
    for c in rest:
        same = same & F.col(f"_old.{c}").eqNullSafe(F.col(c))
    fresh = joined.where(F.col("_version").isNull() | ~same | (F.col("_n") > 1))
    return fresh.select(*keys, *rest, (F.coalesce("_version", F.lit(0)) + 1).alias(version), F.when(F.col("_n") > 1, "key arrives more than once").alias("problem"))


def lost_keys(stored: DataFrame, arrived: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stored keys that a full refresh would drop, with problem: a refresh must not shrink a relation."""
    gone = stored.select(*keys).distinct().join(arrived.select(*keys).distinct(), list(keys), "left_anti")
    return gone.withColumn("problem", F.lit("refresh drops a stored key"))


def overlap_mismatches(fetched: DataFrame, stored: DataFrame, keys: Sequence[str], numbers: Sequence[str], flags: Sequence[str], relative: float = 1e-9) -> DataFrame:
    """keys, field: where rows of both sides disagree, on numbers beyond the tolerance and on flags null-safely."""
    a, b = fetched.alias("a"), stored.alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])

    def near(n: str) -> Column:
        x, y = F.col(f"a.{n}"), F.col(f"b.{n}")
        return F.coalesce(F.abs(x - y) <= relative * F.greatest(F.abs(x), F.abs(y)), x.isNull() & y.isNull())

    wrong = [F.when(~near(n), n) for n in numbers] + [F.when(~F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")), n) for n in flags]
    return joined.select(*[F.col(f"a.{k}").alias(k) for k in keys], F.explode(F.array_compact(F.array(*wrong))).alias("field"))


def carried_forward(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Adds mark (the last value known by then) and stale (whether it is an older row's)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({"mark": F.last(value, ignorenulls=True).over(w), "stale": F.col(value).isNull()})


#: Days by which an edge of a reference list may stray from the announced event. Fixed value.
EDGE_TOLERANCE = 3


def matched_edges(expected: DataFrame, actual: DataFrame, keys: Sequence[str], tolerance: int = EDGE_TOLERANCE) -> DataFrame:
    """keys, expected, actual, outcome of two sets of dated edges (keys, date): equal, moved, missing or unexpected.

    Equal edges match first. Then each expected one, in the order of dates, takes the nearest actual one that is left within
    the tolerance (of two as near the earlier). The edges of a key are few: the events of one label.
    """
    c = F.col
    dates = lambda df, name: df.select(*keys, "date").distinct().groupBy(*keys).agg(F.array_sort(F.collect_list("date")).alias(name))
    none = F.array().cast("array<date>")
    both = dates(expected, "_e").join(dates(actual, "_a"), list(keys), "full_outer").withColumns({"_e": F.coalesce("_e", none), "_a": F.coalesce("_a", none)})
    left = both.withColumns({"_same": F.array_intersect("_e", "_a"), "_we": F.array_except("_e", "_a"), "_wa": F.array_except("_a", "_e")})
    kind = "struct<rest: array<date>, found: array<struct<expected: date, actual: date>>>"
    pair = lambda e, a: F.struct(e.alias("expected"), a.alias("actual"))

    def take(state: Column, e: Column) -> Column:
        near = F.filter(state["rest"], lambda a: F.abs(F.datediff(a, e)) <= tolerance)
        best = F.array_min(F.transform(near, lambda a: F.struct(F.abs(F.datediff(a, e)).alias("d"), a.alias("a"))))["a"]
        rest = F.when(best.isNull(), state["rest"]).otherwise(F.array_except(state["rest"], F.array(best)))
        return F.struct(rest.alias("rest"), F.concat(state["found"], F.array(pair(e, best))).alias("found")).cast(kind)

    start = F.struct(c("_wa").alias("rest"), F.array().cast("array<struct<expected: date, actual: date>>").alias("found")).cast(kind)
    done = left.withColumn("_done", F.aggregate("_we", start, take))
    no = F.lit(None).cast("date")
    every = F.concat(F.transform("_same", lambda x: pair(x, x)), c("_done.found"), F.transform(c("_done.rest"), lambda x: pair(no, x)))
    rows = done.select(*keys, F.inline(every))
    outcome = F.when(c("actual").isNull(), "missing").when(c("expected").isNull(), "unexpected").when(c("expected") == c("actual"), "equal").otherwise("moved")
    return rows.withColumn("outcome", outcome)


def merged_batches(batches: DataFrame, keys: Sequence[str], batch: str = "batch") -> DataFrame:
    """All rows of several reviewed batches, with problem where a key stands in them more than once."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return batches.withColumn("problem", F.when(n > 1, "event stands in the batches more than once")).drop(batch)


def reference_gaps(assignments: DataFrame, owners: DataFrame, ciks: DataFrame, providers: DataFrame, first: str, last: str) -> DataFrame:
    """ticker, security_id, start, end, problem: what of each assignment, within [first, last), no owner with a CIK and no
    verified provider cover together.

    An assignment (ticker, security_id, start, end) with several gaps, and a ticker with gaps in several assignments, have a
    problem. ``owners``: security_id, issuer_id, start, end; ``ciks``: issuer_id, start, end; ``providers``: security_id,
    mapping_status, start, end.
    """
    c = F.col
    clip = lambda df: df.withColumns({"start": F.greatest("start", F.lit(first).cast("date")), "end": F.least(F.coalesce("end", F.lit(last).cast("date")), F.lit(last).cast("date"))}).where("start < end")
    asked = clip(assignments.select("ticker", "security_id", "start", "end")).withColumn("_from", c("start"))
    a, b = clip(owners).alias("a"), clip(ciks).alias("b")
    filed = a.join(b, (c("a.issuer_id") == c("b.issuer_id")) & (c("a.start") < c("b.end")) & (c("b.start") < c("a.end"))).select("a.security_id", F.greatest("a.start", "b.start").alias("start"), F.least("a.end", "b.end").alias("end"))
    both = intervals.intersect(intervals.merge(filed, ["security_id"]), intervals.merge(clip(providers.where("mapping_status = 'verified'")).select("security_id", "start", "end"), ["security_id"]), ["security_id"])
    keys = ["ticker", "security_id", "_from"]
    covered = asked.select(*keys).join(both, "security_id").select(*keys, "start", "end")
    gaps = intervals.subtract(asked.select(*keys, "start", "end"), covered, keys)
    several = F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1
    elsewhere = F.min("_from").over(Window.partitionBy("ticker")) != F.max("_from").over(Window.partitionBy("ticker"))
    return gaps.withColumn("problem", F.when(several, "several gaps in one assignment").when(elsewhere, "gaps in several assignments")).drop("_from")


#: A provider's factor for "no action", and how near two factors must be. Fixed values.
NO_ACTION, FACTOR_TOLERANCE = 1.0, 1e-12


def reviewed_actions(bars: DataFrame, reviews: DataFrame) -> DataFrame:
    """``bars`` (provider, provider_symbol, security_id, date, factor, ...) with split_ratio, actions_complete and review.

    A factor of one is no action. Any other needs a review of exactly this security, symbol, date and factor (``reviews``:
    those and legal_ratio, complete); without one, or with another factor, the bar stays but isn't complete.
    """
    c = F.col
    keys = ["provider", "provider_symbol", "security_id", "date"]
    joined = bars.join(reviews.select(*keys, c("factor").alias("_factor"), c("legal_ratio").alias("_ratio"), c("complete").alias("_complete")), keys, "left")
    near = lambda a, b: F.abs(a - b) <= FACTOR_TOLERANCE
    review = F.when(near(c("factor"), F.lit(NO_ACTION)), "none reported").when(c("_factor").isNull(), "not reviewed").when(~near(c("factor"), c("_factor")), "another factor").when(c("_complete"), "reviewed").otherwise("reviewed, incomplete")
    return joined.withColumn("review", review).withColumns({"split_ratio": F.when(c("review").startswith("reviewed"), c("_ratio")).otherwise(1.0), "actions_complete": c("review").isin("none reported", "reviewed")}).drop("_factor", "_ratio", "_complete")


def identity_assignments(memberships: DataFrame, transitions: DataFrame, prefix: str) -> DataFrame:
    """ticker, start, end, known, security_id, status, problem: memberships with the security that each stands for.

    A ticker that a transition (security_id, from_ticker, to_ticker, kind) names has its security; another ticker is a
    security of its own, named by ``prefix``. Tickers of contradicting transitions, and securities two of whose
    assignments overlap, have a problem.
    """
    c = F.col
    named = transitions.select(F.explode(F.array("from_ticker", "to_ticker")).alias("ticker"), "security_id", "kind").groupBy("ticker").agg(F.countDistinct("security_id").alias("_n"), F.countDistinct("kind").alias("_k"), F.min("security_id").alias("_s"), F.min("kind").alias("_kind"))
    joined = memberships.join(named, "ticker", "left").withColumns({"security_id": F.coalesce("_s", F.concat(F.lit(prefix), F.lower("ticker"))), "status": F.coalesce("_kind", F.lit("bounded ticker"))})
    w = Window.partitionBy("security_id").orderBy("start", "ticker")
    far = F.coalesce("end", F.lit("9999-12-31").cast("date"))
    before = F.max(far).over(w.rowsBetween(Window.unboundedPreceding, -1))
    problem = F.when(c("_n") > 1, "several securities").when(c("_k") > 1, "several kinds of transition").when(before > c("start"), "assignments overlap")
    return joined.withColumn("problem", problem).select("ticker", "start", "end", "known", "security_id", "status", "problem")


def bounded_vintages(rows: DataFrame, first: Column | None, last: Column | None, today: Column, keys: Sequence[str] = ("series_id",)) -> DataFrame:
    """keys, vintage: the distinct vintage dates within the bounds, none after ``today``."""
    upper = today if last is None else F.least(last, today)
    fits = F.col("vintage") <= upper
    return rows.where(fits if first is None else fits & (F.col("vintage") >= first)).select(*keys, "vintage").distinct()


def warmup_candidates(memberships: DataFrame, mappings: DataFrame, as_of: Column) -> DataFrame:
    """security_id, ticker, provider, provider_symbol, problem: the verified mapping of each member known on ``as_of``; a
    member with several has a problem, one without any no row."""
    c = F.col
    members = memberships.where(member_on(c("known"), c("start"), c("end"), c("end_known"), as_of, as_of)).select("security_id", "ticker")
    active = mappings.where((c("mapping_status") == "verified") & covers(c("start"), c("end"), as_of)).select("security_id", "provider", "provider_symbol")
    return exactly_one(members.join(active, "security_id"), ["security_id"], "verified mapping")


def owner_conflicts(stored: DataFrame, arrived: DataFrame, keys: Sequence[str], owner: str) -> DataFrame:
    """keys, problem: arriving keys that are stored under another owner."""
    a, b = stored.where(F.col(owner).isNotNull()).alias("a"), arrived.alias("b")
    met = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    return met.where(F.col(f"a.{owner}") != F.col(f"b.{owner}")).select(*[F.col(f"a.{k}").alias(k) for k in keys]).distinct().withColumn("problem", F.lit("key belongs to another owner"))


def membership_rows(arrived: DataFrame, stored: DataFrame, keys: Sequence[str] = ("universe_id", "ticker")) -> DataFrame:
    """The memberships as they would be stored, with problem: arriving rows by key and start replace stored ones.

    ``known`` may not follow the start, an end must follow it, and what is known of an end lies between the two; without a
    date of its own an end was known with the start. Intervals of a key may not overlap.
    """
    c = F.col
    ended = arrived.withColumn("end_known", F.coalesce("end_known", F.when(c("end").isNotNull(), c("known"))))
    merged = upsert(stored, ended.select(*stored.columns), [*keys, "start"], keep_if_null=["security_id"])
    w = Window.partitionBy(*keys).orderBy("start")
    before, first = F.lag("end").over(w), F.row_number().over(w) == 1
    problem = (
        F.when(c("known") > c("start"), "known after its start")
        .when(c("end") <= c("start"), "end does not follow the start")
        .when(c("end").isNull() & c("end_known").isNotNull(), "open, but its end is known")
        .when((c("end_known") < c("known")) | (c("end_known") > c("end")), "end known out of turn")
        .when(~first & (before.isNull() | (before > c("start"))), "overlaps the interval before")
    )
    return merged.withColumn("problem", problem)


def conversion_rows(arrived: DataFrame, stored: DataFrame, securities: DataFrame, today: Column) -> DataFrame:
    """Arriving conversions with problem: rules of a row, securities that aren't known, and stored ones that say otherwise."""
    c = F.col
    known = securities.select(c("security_id").alias("_k")).distinct()
    a = arrived.join(known.withColumnRenamed("_k", "_s"), c("source_security_id") == c("_s"), "left").join(known.withColumnRenamed("_k", "_t"), c("target_security_id") == c("_t"), "left")
    rest = [n for n in ("target_security_id", "effective_date", "known_date", "share_ratio", "basis_policy", "review_status", "source", "basis_source") if n in arrived.columns]
    old = stored.select(c("source_security_id").alias("_o"), F.struct(*rest).alias("_old"))
    joined = a.join(old, c("source_security_id") == c("_o"), "left")
    same = F.lit(True)
    for n in rest:
        same = same & c(f"_old.{n}").eqNullSafe(c(n))
    again = F.count(F.lit(1)).over(Window.partitionBy("source_security_id")) > 1
    problem = (
        F.when(c("source_security_id") == c("target_security_id"), "converts into itself")
        .when(again, "source converts more than once")
        .when(c("known_date") > c("effective_date"), "known after it is effective")
        .when(c("verified_date") > today, "verified in the future")
        .when(~F.coalesce((c("share_ratio") > 0) & (c("share_ratio") < float("inf")) & ~F.isnan("share_ratio"), F.lit(False)), "ratio is not positive")
        .when(c("basis_policy") != "carryover", "unknown basis policy")
        .when(c("review_status") != "verified", "not verified")
        .when(c("_s").isNull() | c("_t").isNull(), "unknown security")
        .when(c("_o").isNotNull() & ~same, "stored conversion says otherwise")
    )
    return joined.withColumn("problem", problem).select(*arrived.columns, "problem")


def quarantined(rows: DataFrame, bad: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows that go with ``quarantine_reason``); a null answer stays."""
    wrong = F.coalesce(bad, F.lit(False))
    return rows.where(~wrong), rows.where(wrong).withColumn("quarantine_reason", F.lit(reason))


def uncovered_legacy(rows: DataFrame, legacy: Column, keys: Sequence[str], replacement: Column) -> DataFrame:
    """Legacy rows whose key has no replacement: while there are any, legacy rows may not be deleted."""
    have = rows.where(replacement).select(*keys).distinct()
    return rows.where(legacy).join(have, list(keys), "left_anti")


def tombstones(rows: DataFrame, gone: Column) -> DataFrame:
    """What to append to a history where the rows that ``gone`` names are deleted: they, marked as deleted."""
    return rows.where(F.coalesce(gone, F.lit(False))).withColumn("is_deleted", F.lit(True))


#: What names the raw row that a fact came from: all of it, or nothing.
LINEAGE = ("run_id", "snapshot_id", "rowset_sha256", "row_sha256")
#: The key of a fact; what identifies its subject keeps an older value where a newer row has none.
FACT_KEY, FACT_SUBJECT = ("ticker", "period_end", "as_of_date", "metric"), ("issuer_id", "security_id")


def fact_problems(arrived: DataFrame, stored: DataFrame, retained: DataFrame) -> DataFrame:
    """``arrived`` facts with problem: what they lack, or what of ``stored`` and ``retained`` they go against.

    Facts have ``FACT_KEY``, ``LINEAGE`` and issuer_id. A fact is known on a date, its period has ended by then, and its key
    arrives once. Its lineage is whole or absent, names an issuer and digests of 64 hex digits, and a snapshot that is among
    ``retained`` (run_id, snapshot_id). Where a stored fact of the key has lineage, one without may not take its place.
    """
    c, key = F.col, list(FACT_KEY)
    text = {x: F.nullif(F.trim(c(x).cast("string")), F.lit("")) for x in LINEAGE}
    given = sum((x.isNotNull().cast("int") for x in text.values()), F.lit(0))
    traced = stored.where(reduce(Column.__or__, [c(x).isNotNull() for x in LINEAGE])).select(*key).distinct().withColumn("_traced", F.lit(True))
    kept = retained.select(c("run_id").cast("string").alias("_run"), c("snapshot_id").cast("string").alias("_snapshot")).distinct().withColumn("_kept", F.lit(True))
    rows = arrived.withColumns({"_given": given, "_n": F.count(F.lit(1)).over(Window.partitionBy(*key))})
    met = rows.join(traced, key, "left").join(kept, (text["run_id"] == c("_run")) & (text["snapshot_id"] == c("_snapshot")), "left")
    digest = lambda x: F.coalesce(F.lower(text[x]).rlike("^[0-9a-f]{64}$"), F.lit(True))
    problem = (
        F.when(c("as_of_date").isNull(), "lacks the date on which it was known")
        .when(c("period_end").isNull(), "lacks its period's end")
        .when(c("period_end") > c("as_of_date"), "period ends after it was known")
        .when(c("_n") > 1, "key arrives more than once")
        .when(c("_given").between(1, len(LINEAGE) - 1), "lineage is not whole")
        .when(~(digest("rowset_sha256") & digest("row_sha256")), "digest is not one")
        .when((c("_given") > 0) & F.coalesce(F.trim("issuer_id") == "", F.lit(True)), "lineage without an issuer")
        .when((c("_given") > 0) & c("_kept").isNull(), "raw evidence is not retained")
        .when((c("_given") == 0) & c("_traced"), "would replace a fact with lineage")
    )
    return met.withColumn("problem", problem).select(*arrived.columns, "problem")


def fact_versions(stored: DataFrame, arrived: DataFrame, version: str = "version") -> DataFrame:
    """What to append for facts without problems: the next version of each key, its subject kept where it isn't named again."""
    newest = stored.groupBy(*FACT_KEY).agg(F.max(version).alias("_v"), F.max_by(F.struct(*FACT_SUBJECT), version).alias("_old"))
    met = arrived.join(newest, list(FACT_KEY), "left")
    own = [F.coalesce(x, f"_old.{x}").alias(x) if x in FACT_SUBJECT else F.col(x) for x in arrived.columns]
    return met.select(*own, (F.coalesce("_v", F.lit(0)) + 1).cast("long").alias(version), F.lit(False).alias("is_deleted"))
