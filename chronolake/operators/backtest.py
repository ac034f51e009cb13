"""Holding periods with costs and taxes, and what a curve or a list of period returns says about a strategy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import few
from .facts import in_order, quotient, sharpe_and_t

#: Rebalances below which no return gap is read as anything. Fixed value.
LEAST_PERIODS = 20


@dataclass(frozen=True)
class Frictions:
    """Costs in basis points of a trade and for each trade, tax rates, and the days that make a gain long-term."""

    commission_bps: float = 5.0
    slippage_bps: float = 5.0
    fixed_fee: float = 0.0
    short_rate: float = 0.0
    long_rate: float = 0.0
    dividend_rate: float = 0.0
    long_term_days: int = 365


def hold(paths: DataFrame, capital: float, frictions: Frictions, by: Sequence[str] = ("book",), refuse_invalid: bool = True) -> DataFrame:
    """A row for each book that buys its securities in equal parts at ``entry`` and sells them at ``exit``.

    ``paths``: the columns ``by``, security_id, date, close, adj_close, split_ratio, dividends, actions_complete,
    close_split_adjusted, entry, exit; all rows from entry to exit count. Returns gross_return (adjusted closes),
    net_return, costs, taxes, turnover and missing: the sorted reasons for which the book has no result. Reasons are
    per security, so a book's holdings, not its days, meet in one group. Splits count only where closes aren't
    adjusted for them; losses offset gains of their own kind only. Without ``refuse_invalid`` prices are taken as they are: a
    zero one is no reason, and makes its book's results infinite or not a number.
    """
    c, one = F.col, [*by, "security_id"]
    inside = paths.where(c("date").between(c("entry"), c("exit")) & (c("entry") <= c("exit")))
    after = c("date") > c("entry")
    split = F.when(after & ~F.coalesce("close_split_adjusted", F.lit(False)) & (c("split_ratio") > 0), c("split_ratio")).otherwise(1.0)
    grown = F.product(split).over(in_order(one, "date").rowsBetween(Window.unboundedPreceding, 0))
    rows = inside.withColumn("_grown", grown)
    at_entry, at_exit = c("date") == c("entry"), c("date") == c("exit")
    held = rows.groupBy(*one).agg(
        F.count_if(at_entry).alias("n_entry"),
        F.count_if(at_exit).alias("n_exit"),
        F.max(F.when(at_entry, c("close"))).alias("bought"),
        F.max(F.when(at_exit, c("close"))).alias("sold"),
        F.max(F.when(at_entry, F.coalesce("adj_close", "close"))).alias("bought_adjusted"),
        F.max(F.when(at_exit, F.coalesce("adj_close", "close"))).alias("sold_adjusted"),
        F.max(F.when(at_exit, c("_grown"))).alias("grown"),
        F.sum(F.when(after & (c("dividends") > 0), c("_grown") * c("dividends")).otherwise(0.0)).alias("dividends"),
        F.count_if(~F.coalesce("actions_complete", F.lit(False))).alias("n_unverified"),
        F.count_if(c("close_split_adjusted").isNull()).alias("n_unknown_basis"),
        F.countDistinct("close_split_adjusted").alias("n_bases"),
    )
    everyone = paths.groupBy(*one).agg(F.max("entry").alias("entry"), F.max("exit").alias("exit"))
    joined = everyone.join(held, one, "left")
    fine = lambda name: F.coalesce((c(name) > 0) & ~F.isnan(name), F.lit(False))
    over = F.try_divide if refuse_invalid else quotient  # a refused price may be zero
    reason = (
        F.when(c("entry") > c("exit"), "empty holding window")
        .when(F.coalesce("n_entry", F.lit(0)) == 0, "no entry price")
        .when(F.coalesce("n_exit", F.lit(0)) == 0, "no exit price")
        .when(c("n_unverified") > 0, "unverified corporate actions")
        .when(c("n_unknown_basis") > 0, "split basis unknown")
        .when(c("n_bases") > 1, "mixed split basis")
        .when((c("n_entry") > 1) | (c("n_exit") > 1), "ambiguous price")
        .when(F.lit(refuse_invalid) & ~(fine("bought") & fine("sold")), "invalid execution price")
        .when(F.lit(refuse_invalid) & ~(fine("bought_adjusted") & fine("sold_adjusted")), "invalid return price")
    )
    size = joined.withColumn("_reason", reason).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by)))
    part = F.lit(float(capital)) / c("_n")
    sold = over(part, c("bought")) * c("grown") * c("sold")
    rate = (frictions.commission_bps + frictions.slippage_bps) / 1e4
    long_held = F.datediff("exit", "entry") >= frictions.long_term_days
    each = size.withColumns(
        {
            "_gross": over(part * c("sold_adjusted"), c("bought_adjusted")),
            "_costs": (part + sold) * rate + 2 * frictions.fixed_fee,
            "_turnover": (part + sold) / capital,
            "_income": over(part, c("bought")) * c("dividends"),
            "_short": F.when(~long_held, sold - part).otherwise(0.0),
            "_long": F.when(long_held, sold - part).otherwise(0.0),
        }
    )
    reason_known = c("_reason").isNotNull()
    totals = each.groupBy(*by).agg(*[F.sum(n).alias(n) for n in ("_gross", "_costs", "_turnover", "_income", "_short", "_long")], F.array_sort(F.collect_set(F.when(reason_known, F.concat_ws(": ", c("security_id").cast("string"), "_reason")))).alias("missing"), F.count("_reason").alias("_bad"))
    taxes = F.greatest("_short", F.lit(0.0)) * frictions.short_rate + F.greatest("_long", F.lit(0.0)) * frictions.long_rate + c("_income") * frictions.dividend_rate
    whole = lambda x: F.when(c("_bad") == 0, x)
    return totals.select(
        *by,
        whole(c("_gross") / capital - 1).alias("gross_return"),
        whole((c("_gross") - c("_costs") - taxes) / capital - 1).alias("net_return"),
        whole(c("_costs")).alias("costs"),
        whole(taxes).alias("taxes"),
        whole(c("_turnover")).alias("turnover"),
        "missing",
    )


def curve_metrics(curve: DataFrame, keys: Sequence[str], date: str = "date", equity: str = "equity") -> DataFrame:
    """For each curve: cumulative and annualised return (years of 365.25 days, one day at least), volatility by 252,
    deepest drawdown, share of days that rise, Sharpe ratio, t statistic and number of days. Curves start above zero."""
    w = in_order(keys, date)
    before = F.lag(equity).over(w)
    rows = curve.withColumns({"_ret": F.when(before > 0, F.col(equity) / before - 1), "_peak": F.max(equity).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    sharpe, t = sharpe_and_t(F.col("_ret"), 252)
    total = F.max_by(equity, date) / F.min_by(equity, date) - 1
    years = F.greatest(F.datediff(F.max(date), F.min(date)) / F.lit(365.25), F.lit(1 / 365.25))
    return rows.groupBy(*keys).agg(
        total.alias("cumulative_return"),
        (F.pow(1 + total, 1 / years) - 1).alias("annualized_return"),
        F.coalesce(F.stddev_samp("_ret") * F.sqrt(F.lit(252.0)), F.lit(0.0)).alias("annualized_volatility"),
        F.min(F.col(equity) / F.col("_peak") - 1).alias("max_drawdown"),
        F.avg(F.when(F.col("_ret").isNotNull(), (F.col("_ret") > 0).cast("double"))).alias("win_rate"),
        sharpe.alias("sharpe_ratio"),
        t.alias("return_t_stat"),
        F.count(F.lit(1)).alias("n_days"),
    )


def period_metrics(periods: DataFrame, keys: Sequence[str], periods_per_year: float = 4.0) -> DataFrame:
    """For each strategy the same from its periods (entry, exit, ret), which are few: they compound in order of entry."""
    w = in_order(keys, "entry").rowsBetween(Window.unboundedPreceding, 0)
    grown = periods.withColumn("_equity", F.product(1 + F.col("ret")).over(w))
    rows = grown.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_equity").over(w)))
    sharpe, t = sharpe_and_t(F.col("ret"), periods_per_year)
    total = F.max_by("_equity", "entry")
    years = F.greatest(F.datediff(F.max("exit"), F.min("entry")) / F.lit(365.25), F.lit(1 / 365.25))
    return rows.groupBy(*keys).agg(
        (total - 1).alias("cumulative_return"),
        (F.pow(total, 1 / years) - 1).alias("annualized_return"),
        F.coalesce(F.stddev_samp("ret") * F.sqrt(F.lit(float(periods_per_year))), F.lit(0.0)).alias("annualized_volatility"),
        F.least(F.lit(0.0), F.min(F.col("_equity") / F.col("_peak") - 1)).alias("max_drawdown"),
        F.avg((F.col("ret") > 0).cast("double")).alias("win_rate"),
        sharpe.alias("sharpe_ratio"),
        t.alias("return_t_stat"),
        F.count(F.lit(1)).alias("n_periods"),
    )


def verdict(t_stat: Column, periods: Column, pairs: Column) -> Column:
    """What a sample can support: none, not interpretable, noise or suggestive."""
    return F.when(t_stat.isNull() | (pairs < 2), "insufficient").when(periods < LEAST_PERIODS, "not interpretable").when(F.abs(t_stat) < 2, "noise").otherwise("suggestive")


def execution_dates(decisions: DataFrame, sessions: DataFrame) -> DataFrame:
    """decision, next_decision, entry, exit: the first session after each decision up to the next one, and the next decision's
    date if it is a session. Both relations are calendars: a row a quarter, a row a session."""
    c = F.col
    following = decisions.select("decision").distinct().withColumn("next_decision", F.lead("decision").over(Window.orderBy("decision"))).where("next_decision IS NOT NULL")
    days = sessions.select("date").distinct()
    met = following.join(few(days), (c("date") > c("decision")) & (c("date") <= c("next_decision")), "left")
    return met.groupBy("decision", "next_decision").agg(F.min("date").alias("entry"), F.max(F.when(c("date") == c("next_decision"), c("date"))).alias("exit"))


def periods(audit: DataFrame, dates: DataFrame, regimes: DataFrame, top_n: int, require_regime: bool = True) -> DataFrame:
    """decision, entry, exit, regime, n_eligible, members_digest, selected, status, missing: what each period can do.

    ``audit``: decision, ticker, eligible, score; ``dates``: decision, entry, exit; ``regimes``: decision, regime. The
    ``top_n`` eligible tickers by score, ties by ticker, are selected unless a date lacks, the regime isn't known where it is
    required, or fewer are eligible. A decision without any row in ``audit`` has no one eligible.
    """
    c = F.col
    best = F.row_number().over(Window.partitionBy("decision", "eligible").orderBy(c("score").desc_nulls_last(), "ticker"))
    ranked = audit.withColumn("_r", F.when(c("eligible"), best))
    sums = ranked.groupBy("decision").agg(
        F.count_if("eligible").alias("n_eligible"),
        F.sha2(F.array_join(F.array_sort(F.collect_set(F.upper("ticker"))), "\n"), 256).alias("members_digest"),
        F.array_sort(F.collect_list(F.when(c("_r") <= top_n, F.struct("_r", "ticker")))).alias("_best"),
    )
    known = dates.join(regimes, "decision", "left").join(sums, "decision", "left").withColumns({"regime": F.coalesce("regime", F.lit("unknown")), "n_eligible": F.coalesce("n_eligible", F.lit(0))})
    unscheduled = c("entry").isNull() | c("exit").isNull()
    status = F.when(unscheduled, "no execution date").when(F.lit(require_regime) & (c("regime") == "unknown"), "regime not known").when(c("n_eligible") < top_n, "too few eligible").otherwise("ready")
    missing = F.when(c("status") == "too few eligible", F.concat(F.lit("eligible:"), "n_eligible", F.lit(f"<{top_n}")))
    return known.withColumn("status", status).select("decision", "entry", "exit", "regime", "n_eligible", "members_digest", F.when(c("status") == "ready", F.transform("_best", lambda x: x["ticker"])).alias("selected"), "status", missing.alias("missing"))


def benchmark_returns(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """decision, entry, exit, ret, problem: a benchmark's total return by adjusted closes between entry and exit.

    ``bars``: date, close, adj_close of the benchmark, a row a session (broadcast); ``dates``: decision, entry, exit, where
    null its first and last date after the decision up to ``next_decision`` stand in. One join, one aggregate.
    """
    c = F.col
    price = F.coalesce("adj_close", "close")
    inside = (c("date") > c("decision")) & (c("date") <= c("next_decision"))
    met = dates.join(few(bars.select("date", price.alias("_p"))), inside | (c("date") == c("entry")) | (c("date") == c("exit")), "left")
    bar = F.when(inside, F.struct("date", "_p"))
    at = lambda name: F.max(F.when(c("date") == c(name), c("_p")))
    own = met.groupBy("decision", "next_decision").agg(F.max("entry").alias("_e"), F.max("exit").alias("_x"), F.min(bar).alias("_first"), F.max(bar).alias("_last"), at("entry").alias("_at_e"), at("exit").alias("_at_x"))
    given = lambda name, own, other: F.when(c(name).isNotNull(), own).otherwise(other)
    joined = own.select("decision", F.coalesce("_e", "_first.date").alias("entry"), F.coalesce("_x", "_last.date").alias("exit"), given("_e", c("_at_e"), c("_first._p")).alias("_entry"), given("_x", c("_at_x"), c("_last._p")).alias("_exit"))
    problem = F.when(c("entry").isNull() | c("exit").isNull(), "no benchmark price").when(c("_entry").isNull() | c("_exit").isNull() | ~(c("_entry") > 0), "benchmark price is not valid")
    return joined.withColumn("problem", problem).select("decision", "entry", "exit", F.when(c("problem").isNull(), c("_exit") / c("_entry") - 1).alias("ret"), "problem")
