"""Point-in-time reads: what was known on a date, and never anything later.

"Latest" is always: filter to what is known, order by a total order, take the first per key. Spark turns
``row_number() = 1`` into a group limit before the shuffle, so each map task sends one row for each key.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge, spread_merge
from .ranking import running
from .stages import cut


def covers(start: Column, end: Column, day: Column) -> Column:
    """``day`` lies in [start, end); a null end is open."""
    return (start <= day) & (end.isNull() | (end > day))


def member_on(known: Column, start: Column, end: Column, end_known: Column, known_as_of: Column, effective_on: Column) -> Column:
    """A membership known by ``known_as_of`` and effective on ``effective_on``; an end announced later doesn't count."""
    return (known <= known_as_of) & (start <= effective_on) & (end.isNull() | (end > effective_on) | (end_known > known_as_of))


def first_per(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key under ``order`` (a total order, or the choice among equals is arbitrary)."""
    row = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_row", row).where(F.col("_row") <= n).drop("_row")


#: Rows of a calendar, or of another relation that is small by its nature: some centuries of sessions.
FEW = 200_000


def few(rows: DataFrame, most: int = FEW) -> DataFrame:
    """``rows``, broadcast; fails at run time where there are more than ``most``, so what is broadcast can't grow with the data."""
    n = F.count(F.lit(1)).over(Window.partitionBy(F.lit(1)))
    checked = F.when(n > most, F.raise_error(F.lit(f"more than {most} rows to broadcast")).cast("boolean")).otherwise(F.lit(True))
    return F.broadcast(rows.withColumn("_few", checked).where("_few").drop("_few"))


def newest(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def latest_known(facts: DataFrame, keys: Sequence[str], as_of: Column | date, ties: Sequence[str] = (), known: str = "as_of_date", valid: str = "period_end") -> DataFrame:
    """The newest vintage of each key known at ``as_of``. Facts that claim to be known before their period ends are refused."""
    seen = facts.where((F.col(known) <= as_of) & (F.col(valid) <= F.col(known)))
    return first_per(seen, keys, newest(known, *[c for c in (valid,) if c not in keys], *ties))


def routed(facts: DataFrame, routes: DataFrame, by: dict[str, str]) -> DataFrame:
    """Facts by dated identity: one equi-join for each kind of route, never one join with OR.

    ``routes`` has requested, kind, target; ``by`` names the fact column of each kind.
    """
    parts = [routes.where(F.col("kind") == kind).join(facts, routes["target"] == facts[column]).drop("target", "kind") for kind, column in by.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def capture(versions: DataFrame, sequence: str = "sequence") -> DataFrame:
    """generation: the highest sequence so far, one row (null where nothing is stored)."""
    return versions.agg(F.max(sequence).alias("generation"))


def snapshot(versions: DataFrame, keys: Sequence[str], generation: int | DataFrame, sequence: str = "sequence", deleted: str = "is_deleted") -> DataFrame:
    """The state at a generation (a number, or what ``capture`` gave) of an append-only table: the last version of each key,
    unless it is a tombstone."""
    if isinstance(generation, DataFrame):
        seen = versions.join(F.broadcast(generation), F.col(sequence) <= F.col("generation")).drop("generation")
    else:
        seen = versions.where(F.col(sequence) <= generation)
    return first_per(seen, keys, newest(sequence)).where(~F.coalesce(F.col(deleted), F.lit(False)))


def routes_of(keys: DataFrame, assignments: DataFrame, day: Column, key: str = "ticker", target: str = "security_id") -> DataFrame:
    """For each key the number of targets it has on ``day``, and the target if there is exactly one (else null): fail-closed."""
    active = assignments.where(covers(F.col("start"), F.col("end"), day)).select(key, target)
    found = active.groupBy(key).agg(F.countDistinct(target).alias("n_targets"), F.min(target).alias("_one"))
    return keys.join(found, key, "left").select(*keys.columns, F.coalesce("n_targets", F.lit(0)).alias("n_targets"), F.when(F.col("n_targets") == 1, F.col("_one")).alias(target))


def require_unambiguous(routes: DataFrame) -> DataFrame:
    """``routes``, failing at run time where a key has more than one target."""
    return routes.withColumn("n_targets", F.when(F.col("n_targets") > 1, F.raise_error(F.lit("ambiguous identity")).cast("long")).otherwise(F.col("n_targets")))


def frontier(edges: DataFrame, longest: int | None = None) -> DataFrame:
    """origin, target, ratio, depth: everything that ``edges`` (source, target, ratio) lead to, ratios multiplied on the way.

    Pointer doubling: after round k all ways of up to 2 ** k steps are known, and those of exactly so many are joined to all
    of them, so a chain of a thousand takes ten rounds. Each round's new ways are written once. Of several ways to a target
    the shortest counts, of these the one of the smallest ratio (ratios are positive); a circle ends where it comes back to its
    origin. The rounds go on until nothing is new: nothing is left out. With ``longest``, a longer way is an error.
    """
    c = F.col
    shortest = lambda ways: ways.groupBy("origin", "target").agg(F.min(F.struct("depth", "ratio")).alias("_w")).select("origin", "target", "_w.ratio", "_w.depth")
    steps = edges.where("source <> target").select(c("source").alias("origin"), "target", "ratio", F.lit(1).alias("depth"))
    new = cut(shortest(steps))
    whole, reach = new, 1
    while not (full := new.where(c("depth") == reach)).isEmpty():
        after = whole.select(c("origin").alias("_at"), c("target").alias("_to"), c("ratio").alias("_by"), c("depth").alias("_more"))
        longer = full.join(after, c("target") == c("_at")).where("origin <> _to")
        longer = longer.select("origin", c("_to").alias("target"), (c("ratio") * c("_by")).alias("ratio"), (c("depth") + c("_more")).alias("depth"))
        new = cut(shortest(longer).join(whole.select("origin", "target"), ["origin", "target"], "left_anti"))
        whole, reach = whole.unionByName(new), 2 * reach
        if longest is not None and reach > longest and not new.where(c("depth") > longest).isEmpty():
            raise ValueError(f"a chain has more than {longest} steps")
    return whole


def known_history(facts: DataFrame, keys: Sequence[str], as_of: Column | date, metrics: Sequence[str] | None = None, value: str = "value", known: str = "as_of_date", valid: str = "period_end", ties: Sequence[str] = ()) -> DataFrame:
    """Histories of several metrics: the newest vintage of each key, metric and period, and of these only what has a value.

    Nulls are dropped after the choice: a restatement without a value withdraws the period, it doesn't bring an older
    vintage back.
    """
    named = facts if metrics is None else facts.where(F.col("metric").isin(*metrics))
    seen = named.where((F.col(known) <= as_of) & (F.col(valid) <= F.col(known)))
    return first_per(seen, [*keys, "metric", valid], newest(known, *ties)).where(F.col(value).isNotNull())


#: Sources of macro observations, the preferred first; all others come last. Fixed values.
MACRO_SOURCES = ("fred", "treasury")


def macro_known(rows: DataFrame, as_of: Column | date, keys: Sequence[str] = ("series_id", "date")) -> DataFrame:
    """The newest vintage of each observation released by ``as_of``; of one day's, by source, then the last fetched.

    ``rows``: series_id, date, release_date, value, source, fetched_at. Rows without a release date never count.
    """
    rank = F.coalesce(*[F.when(F.col("source") == s, k) for k, s in enumerate(MACRO_SOURCES)], F.lit(len(MACRO_SOURCES)))
    seen = rows.where((F.col("release_date") <= as_of) & (F.col("date") <= as_of))
    return first_per(seen, list(keys), [F.col("release_date").desc(), rank.asc(), F.col("fetched_at").desc_nulls_last()])


def identity_paths(requests: DataFrame, assignments: DataFrame, claims: DataFrame, day: Column, claimed: str, key: str = "ticker") -> DataFrame:
    """requested, kind, target, n_targets: the way to the rows of each requested ticker on ``day``, or none (kind null).

    The ticker's security, if it has exactly one; where a claim on it (``claims``: security_id, ``claimed``, start, end) is
    active, its ``claimed`` (kind "claimed"); where it ever had one but none is active, nothing; else the ticker itself
    (kind "ticker"). Tickers, or securities, with more than one answer go nowhere and tell how many they had.
    """
    c = F.col
    owned = routes_of(requests.select(key).distinct(), assignments, day, key)
    active = claims.where(covers(c("start"), c("end"), day)).groupBy("security_id").agg(F.countDistinct(claimed).alias("_n"), F.min(claimed).cast("string").alias("_one"))
    ever = claims.select("security_id").distinct().withColumn("_ever", F.lit(True))
    joined = owned.join(active, "security_id", "left").join(ever, "security_id", "left")
    n = F.greatest(c("n_targets"), F.coalesce("_n", F.lit(0)))
    kind = F.when(n > 1, None).when(c("_one").isNotNull(), "claimed").when(c("_ever").isNull(), "ticker")
    return joined.select(c(key).alias("requested"), kind.alias("kind"), F.when(kind == "claimed", c("_one")).when(kind == "ticker", c(key)).alias("target"), n.alias("n_targets"))


def last_bars(bars: DataFrame, by: Sequence[str], as_of: Column | date, n: int, priority: str = "priority", fetched: str = "fetched_at") -> DataFrame:
    """The last ``n`` dates of each key up to ``as_of``; of several bars of one date that of the highest priority, then the last fetched."""
    one = first_per(bars.where(F.col("date") <= as_of), [*by, "date"], [F.col(priority).desc(), F.col(fetched).desc_nulls_last()])
    return first_per(one, by, newest("date"), n)


def newest_reviewed(bars: DataFrame, day: Column | date) -> DataFrame:
    """date: the newest one, up to ``day``, with complete actions, a known split basis and a positive close; null without any."""
    fine = F.col("actions_complete") & F.col("close_split_adjusted").isNotNull() & (F.col("close") > 0)
    return bars.where((F.col("date") <= day) & fine).agg(F.max("date").alias("date"))


def members_by_date(dates: DataFrame, memberships: DataFrame, key: str = "ticker", ahead: int = 0) -> DataFrame:
    """date, n_members: how many keys are members on each of ``dates``, known by the date and effective ``ahead`` days later.

    ``memberships``: ``key``, known, start, end, end_known. A sweep in place of a join of members and dates: a membership
    counts from the day on which it is known and near enough to the day on which its end is; what a key has of these is
    merged, and changes are summed up by day before anything is compared with the dates. Rows grow with memberships and days.
    Dates without members are left out.
    """
    c = F.col
    leaves = F.when(c("end").isNull(), None).otherwise(F.greatest(F.date_sub("end", ahead), c("end_known")))
    counted = memberships.where("known IS NOT NULL AND start IS NOT NULL").select(key, F.greatest("known", F.date_sub("start", ahead)).alias("start"), leaves.alias("end"))
    spans = merge(counted.where("`end` IS NULL OR start < `end`"), [key])
    changes = spans.select(F.explode(F.array(F.struct(c("start").alias("date"), F.lit(1).alias("n")), F.struct(c("end").alias("date"), F.lit(-1).alias("n")))).alias("_c")).select("_c.*")
    days = changes.groupBy("date").agg(F.sum("n").alias("n"), F.lit(0).alias("_asked"))
    days = days.unionByName(dates.select("date").distinct().select("date", F.lit(0).cast("long").alias("n"), F.lit(1).alias("_asked")))
    # One row for each day of a change and each date: a calendar.
    upto = Window.partitionBy(F.lit(1)).orderBy("date", "_asked").rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("n_members", F.sum("n").over(upto)).where("_asked = 1 AND n_members > 0").select("date", "n_members")


def newest_decision(dates: DataFrame, memberships: DataFrame, least: int, most: int, key: str = "ticker") -> DataFrame:
    """date: the newest of ``dates`` on which the universe has ``least`` to ``most`` members; see ``members_by_date``."""
    return members_by_date(dates, memberships, key).where(F.col("n_members").between(least, most)).agg(F.max("date").alias("date"))


def exactly_one(rows: DataFrame, keys: Sequence[str], subject: str) -> DataFrame:
    """``rows`` with problem where a key has several: the caller asked for the one."""
    return rows.withColumn("problem", F.when(F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1, f"more than one {subject}"))


def within(rows: DataFrame, start: str, end: str, first: Column | date | None = None, last: Column | date | None = None, **equal) -> DataFrame:
    """Rows whose [start, end) meets [first, last), each bound and each equality only where it is given."""
    out = rows
    for name, value in equal.items():
        if value is not None:
            out = out.where(F.col(name) == value)
    if last is not None:
        out = out.where(F.col(start) < last)
    if first is not None:
        out = out.where(F.col(end).isNull() | (F.col(end) > first))
    return out


def unverified_actions(bars: DataFrame, by: Sequence[str], first: Column | date, last: Column | date) -> DataFrame:
    """by, n: bars from ``first`` to ``last`` whose actions aren't known to be complete (false and null alike)."""
    unsure = ~F.coalesce("actions_complete", F.lit(False))
    return bars.where(F.col("date").between(first, last)).groupBy(*by).agg(F.count_if(unsure).alias("n"))


def conversions_between(conversions: DataFrame, first: Column | date, last: Column | date) -> DataFrame:
    """Verified conversions effective in (first, last], known by then."""
    return conversions.where((F.col("review_status") == "verified") & (F.col("effective_date") > first) & (F.col("effective_date") <= last) & (F.col("known_date") <= F.col("effective_date")))


def active_listings(listings: DataFrame, keys: Sequence[str], as_of: Column | date, known_as_of: Column | date) -> DataFrame:
    """The listing of each key that covers ``as_of`` and was known by ``known_as_of``, that which began last."""
    c = F.col
    return first_per(listings.where(covers(c("listed_start"), c("listed_end"), as_of) & (c("known_at") <= known_as_of)), keys, newest("listed_start"))


def relabelled(prices: DataFrame, mappings: DataFrame, assignments: DataFrame) -> DataFrame:
    """``prices`` (provider, provider_symbol, date, ...) with security_id, ticker and problem: the market's label of the date.

    No range join with the assignments: days of prices and of changes are one sequence, in which a running sum carries the label.
    Rows outside the verified windows of their mapping (``mappings``: provider, provider_symbol, security_id,
    mapping_status, start, end) go; of the others each must have exactly one ticker that day (``assignments``: security_id,
    ticker, start, end), or says so. The provider's own label is never trusted.
    """
    c = F.col
    verified = mappings.where("mapping_status = 'verified'").select("provider", "provider_symbol", "security_id", c("start").alias("_a"), c("end").alias("_b"))
    mapped = prices.join(verified, ["provider", "provider_symbol"]).where(covers(c("_a"), c("_b"), c("date"))).drop("_a", "_b")
    # A sweep over each security's days: how many tickers are active, and the sum of their numbers, which names a lone one.
    spans = spread_merge(assignments.select("security_id", F.upper("ticker").alias("_t"), "start", "end").where(c("_t").isNotNull()), ["security_id", "_t"])
    number = F.xxhash64("_t").cast("decimal(38,0)")
    step = lambda day, n: F.struct(c(day).alias("date"), F.lit(n).alias("n"), (n * number).alias("of"), F.lit(0).alias("asked"))
    changes = spans.select("security_id", F.explode(F.array(step("start", 1), step("end", -1))).alias("_s")).select("security_id", "_s.*")
    asked = mapped.select("security_id", "date", F.lit(0).alias("n"), F.lit(0).cast("decimal(38,0)").alias("of"), F.lit(1).alias("asked"))
    days = changes.unionByName(asked).groupBy("security_id", "date").agg(F.sum("n").alias("n"), F.sum("of").cast("decimal(38,0)").alias("of"), F.max("asked").alias("asked"))
    swept = running(days, ["security_id"], ["date"], {"_n": "n", "_of": "of"}).where("asked = 1")
    names = spans.select(c("security_id").alias("_s"), number.alias("_number"), "_t").distinct()
    found = swept.join(names, (c("_n") == 1) & (c("security_id") == c("_s")) & (c("_of") == c("_number")), "left")
    joined = mapped.join(found.select("security_id", "date", "_n", c("_t").alias("_one")), ["security_id", "date"])
    return joined.withColumns({"ticker": c("_one"), "problem": F.when(c("_n") != 1, "not exactly one ticker on the date")}).drop("_n", "_one")
