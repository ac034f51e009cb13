"""Value and quality of companies from one wide row each, their cross-sectional scores and the blend by macro regime.

A wide row holds the newest known values (``debt_total``), trailing-year sums (``ttm_revenue``) and the same a year before
(``prior_debt_total``, ``prior_ttm_revenue``). A missing input makes what needs it null; nothing is filled in. Ranks are
windows over a section (a decision date, say), never over the whole table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .asof import few
from .facts import quotient
from .ranking import grade, mean_of, percentile

#: Tax rate assumed on operating income, and the growth of shares that doesn't count as dilution. Fixed values.
TAX_RATE = 0.21
DILUTION = 1.01
#: Weight of quality by regime; value has the rest. Other regimes weigh as "unknown". Fixed values.
QUALITY_WEIGHT = {"goldilocks": 0.60, "reflation": 0.45, "stagflation": 0.65, "deflationary": 0.55, "risk_off": 0.70, "unknown": 0.60}
#: Share of quality and value together, of momentum and of low volatility, where all four are blended. Fixed values.
CORE_WEIGHT, MOMENTUM_WEIGHT, CALM_WEIGHT = 0.60, 0.25, 0.15

MULTIPLES = ("pe", "ev_ebitda", "p_fcf", "ev_sales", "p_b")
INDUSTRIAL = ("roic", "fcf_margin", "gross_margin")
FINANCIAL = ("bank_roe", "bank_equity_ratio", "bank_net_margin")


def ratio(above: Column, below: Column) -> Column:
    """above / below; null for a null or zero divisor."""
    return F.when(below != 0, above / below)


def over_positive(above: Column, below: Column) -> Column:
    return F.when(below > 0, above / below)


def free_cash_flow() -> Column:
    return F.col("ttm_cfo") - F.abs("ttm_capex")


def value_multiples(wide: DataFrame) -> DataFrame:
    """Adds market_cap, enterprise_value and the five multiples. A company without positive earnings has no pe."""
    c = F.col
    sized = wide.withColumn("market_cap", c("price") * c("shares_out"))
    sized = sized.withColumn("enterprise_value", c("market_cap") + c("debt_total") - c("cash"))
    return sized.withColumns(
        {
            "pe": F.when(c("ttm_eps_diluted") > 0, c("price") / c("ttm_eps_diluted")),
            "ev_ebitda": ratio(c("enterprise_value"), c("ttm_operating_income") + F.abs("ttm_depreciation")),
            "p_fcf": ratio(c("market_cap"), free_cash_flow()),
            "ev_sales": ratio(c("enterprise_value"), c("ttm_revenue")),
            "p_b": ratio(c("market_cap"), c("stockholders_equity")),
        }
    )


def value_score(multiples: DataFrame, *section: str) -> DataFrame:
    """Adds a percentile of cheapness for each positive multiple, and value_score, 100 times their mean if two are there."""
    cheap = {f"{m}_pct": percentile(F.when(F.col(m) > 0, -F.col(m)), *section) for m in MULTIPLES}
    return multiples.withColumns(cheap).withColumn("value_score", 100 * mean_of(list(cheap)))


def quality_components(wide: DataFrame) -> DataFrame:
    """Adds the industrial components, or the financial ones where ``is_financial``; the other kind's are null.

    Invested capital is averaged with the year before's where that is known and not zero.
    """
    c = F.col
    now, before = c("debt_total") + c("stockholders_equity"), c("prior_debt_total") + c("prior_stockholders_equity")
    invested = F.when(before != 0, (now + before) / 2).otherwise(now)
    industrial = {
        "roic": over_positive(c("ttm_operating_income") * (1 - TAX_RATE), invested),
        "fcf_margin": over_positive(free_cash_flow(), c("ttm_revenue")),
        "gross_margin": F.when(c("ttm_gross_profit") != 0, over_positive(c("ttm_gross_profit"), c("ttm_revenue"))),
    }
    financial = {
        "bank_roe": over_positive(c("ttm_net_income"), c("stockholders_equity")),
        "bank_equity_ratio": over_positive(c("stockholders_equity"), c("total_assets")),
        "bank_net_margin": over_positive(c("ttm_net_income"), c("ttm_revenue")),
    }
    own = {n: F.when(~c("is_financial"), x) for n, x in industrial.items()} | {n: F.when(c("is_financial"), x) for n, x in financial.items()}
    return wide.withColumns(own)


def piotroski(wide: DataFrame) -> DataFrame:
    """Adds piotroski_f (criteria met) and piotroski_evaluated (criteria whose inputs are known); f is null if none is.

    Nine criteria: return on assets positive, cash flow positive, return rising, cash flow above income, leverage falling,
    current ratio rising, no dilution, gross margin rising, turnover rising. Without assets and income there is no score.
    Financial companies skip leverage, current ratio and gross margin.
    """
    c, financial = F.col, F.coalesce(F.col("is_financial"), F.lit(False))
    roa, prior_roa = over_positive(c("ttm_net_income"), c("total_assets")), over_positive(c("prior_ttm_net_income"), c("prior_total_assets"))

    def rises(above: str, below: str) -> Column:
        return over_positive(c(above), c(below)) > over_positive(c(f"prior_{above}"), c(f"prior_{below}"))

    leverage = over_positive(c("debt_total"), c("total_assets")) < over_positive(c("prior_debt_total"), c("prior_total_assets"))
    criteria = [
        roa > 0,
        c("ttm_cfo") > 0,
        roa > prior_roa,
        c("ttm_cfo") > c("ttm_net_income"),
        F.when(~financial, leverage),
        F.when(~financial, rises("current_assets", "current_liabilities")),
        F.when(c("prior_shares_out") > 0, c("shares_out") <= c("prior_shares_out") * DILUTION),
        F.when(~financial, rises("ttm_gross_profit", "ttm_revenue")),
        over_positive(c("ttm_revenue"), c("total_assets")) > over_positive(c("prior_ttm_revenue"), c("prior_total_assets")),
    ]
    met = sum((F.coalesce(x.cast("int"), F.lit(0)) for x in criteria), F.lit(0))
    known = sum((x.isNotNull().cast("int") for x in criteria), F.lit(0))
    return wide.withColumns({"piotroski_f": F.when(roa.isNotNull(), met), "piotroski_evaluated": F.when(roa.isNotNull(), known).otherwise(0)})


def quality_score(components: DataFrame, *section: str) -> DataFrame:
    """Adds quality_score: 100 times the mean percentile of the components that are there, the Piotroski share among them."""
    rows = components.withColumn("_piotroski", F.when(F.col("piotroski_evaluated") > 0, F.col("piotroski_f") / F.col("piotroski_evaluated")))
    names = [*INDUSTRIAL, *FINANCIAL, "_piotroski"]
    ranked = rows.withColumns({f"_pct_{n}": percentile(F.col(n), *section) for n in names})
    scored = ranked.withColumn("quality_score", 100 * mean_of([f"_pct_{n}" for n in names]))
    return scored.drop("_piotroski", *[f"_pct_{n}" for n in names])


def quality_weight(regime: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in QUALITY_WEIGHT.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.lower(regime)), F.lit(QUALITY_WEIGHT["unknown"]))


def blend(scores: DataFrame, *section: str, tie: str, regime: Column) -> DataFrame:
    """Adds qv_score, qv_grade, qv_rank and missing: quality and value by the regime's weights, only where both are there.

    ``missing`` lists the absent scores in order. Ranks go by score (rounded to ten places), then ``tie``; what has no
    score has no rank.
    """
    weight = quality_weight(regime)
    mixed = scores.withColumn("qv_score", weight * F.col("quality_score") + (1 - weight) * F.col("value_score"))
    return _graded(mixed, "qv", section, tie, ("quality_score", "value_score"))


def blend_all(scores: DataFrame, *section: str, tie: str, regime: Column) -> DataFrame:
    """The same as qvml_*, with momentum_score and low_volatility_score beside them; only where all four are there."""
    weight = quality_weight(regime)
    core = weight * F.col("quality_score") + (1 - weight) * F.col("value_score")
    mixed = scores.withColumn("qvml_score", CORE_WEIGHT * core + MOMENTUM_WEIGHT * F.col("momentum_score") + CALM_WEIGHT * F.col("low_volatility_score"))
    return _graded(mixed, "qvml", section, tie, ("quality_score", "value_score", "momentum_score", "low_volatility_score"))


def _graded(scored: DataFrame, name: str, section: Sequence[str], tie: str, needed: Sequence[str]) -> DataFrame:
    score = F.round(f"{name}_score", 10)
    place = F.row_number().over(Window.partitionBy(*section, score.isNull()).orderBy(score.desc(), F.col(tie)))
    absent = F.array_compact(F.array(*[F.when(F.col(n).isNull(), n) for n in needed]))
    return scored.withColumns({f"{name}_grade": grade(score), f"{name}_rank": F.when(score.isNotNull(), place), "missing": absent})


def market_scores(factors: DataFrame, *section: str) -> DataFrame:
    """Adds momentum_score and low_volatility_score (0 to 100) from momentum and volatility."""
    return factors.withColumns({"momentum_score": 100 * percentile(F.col("momentum"), *section), "low_volatility_score": 100 * percentile(-F.col("volatility"), *section)})


def classify_regime(evidence: DataFrame) -> DataFrame:
    """Adds growth, inflation_state, curve_state, stress and regime from gdp, inflation, curve, vix and credit.

    High stress outranks all else. Without growth, inflation or any sign of stress the regime is unknown; the curve is context.
    """
    c = F.col
    states = evidence.withColumns(
        {
            "growth": F.when(c("gdp").isNull(), "unknown").when(c("gdp") > 0, "expansion").otherwise("contraction"),
            "inflation_state": F.when(c("inflation").isNull(), "unknown").when(c("inflation") < 2, "low").when(c("inflation") < 3, "moderate").otherwise("high"),
            "curve_state": F.when(c("curve").isNull(), "unknown").when(c("curve") <= -0.25, "inverted").when(c("curve") < 0.25, "flat").otherwise("steep"),
            "stress": F.when(c("vix").isNull() & c("credit").isNull(), "unknown").when((c("vix") >= 30) | (c("credit") >= 3), "high").when((c("vix") >= 20) | (c("credit") >= 2), "elevated").otherwise("calm"),
        }
    )
    incomplete = (c("growth") == "unknown") | (c("inflation_state") == "unknown") | (c("stress") == "unknown")
    regime = (
        F.when(incomplete, "unknown")
        .when(c("stress") == "high", "risk_off")
        .when((c("growth") == "contraction") & c("inflation_state").isin("moderate", "high"), "stagflation")
        .when((c("growth") == "contraction") & (c("inflation_state") == "low"), "deflationary")
        .when((c("growth") == "expansion") & (c("inflation_state") == "high"), "reflation")
        .otherwise("goldilocks")
    )
    return states.withColumn("regime", regime)


def market_window(bars: DataFrame, sessions: DataFrame, key: str, decision: Column, n: int = 253, skip: int = 21, stale_days: int = 7, refuse_invalid: bool = True) -> DataFrame:
    """key, n_bars, momentum, volatility, problem from each key's last ``n`` bars up to ``decision``.

    The bars must be the exchange's sessions without a hole up to the decision, with complete actions and one split basis.
    Momentum leaves the latest ``skip`` sessions out; volatility is annualised by 252. ``bars``: key, date, close,
    split_ratio, dividends, actions_complete, close_split_adjusted, one row for each date; a missing ratio is 1 and a missing dividend 0.
    Without ``refuse_invalid`` prices and actions are taken as they are, and what is divided by a zero close is infinite or not a number.
    ``sessions`` (date), some 250 a year, are broadcast.
    """
    c = F.col
    calendar = sessions.where(c("date") <= decision).select("date").distinct().withColumn("_at", F.row_number().over(Window.orderBy(F.desc("date"))))
    newest = Window.partitionBy(key).orderBy(F.desc("date"))
    last = bars.where(c("date") <= decision).withColumn("_r", F.row_number().over(newest)).where(c("_r") <= n)
    placed = last.join(few(calendar), "date", "left")
    ratio = F.when(F.coalesce("close_split_adjusted", F.lit(False)), 1.0).otherwise(F.coalesce("split_ratio", F.lit(1.0)))
    before = F.lag("close").over(Window.partitionBy(key).orderBy("date"))
    oldest = c("_r") == F.count(F.lit(1)).over(Window.partitionBy(key))
    grown = ratio * (c("close") + F.coalesce("dividends", F.lit(0.0)))
    gross = F.when(before > 0, grown / before) if refuse_invalid else quotient(grown, before)
    fine = F.coalesce((c("close") > 0) & (F.coalesce("split_ratio", F.lit(1.0)) > 0) & (F.coalesce("dividends", F.lit(0.0)) >= 0) & ~F.isnan("close"), F.lit(False))
    rows = placed.withColumns({"_gross": gross, "_fine": F.when(oldest, F.coalesce(c("close") > 0, F.lit(False))).otherwise(fine)})
    found = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("n_bars"),
        F.count_if(~F.coalesce("actions_complete", F.lit(False))).alias("_open"),
        F.count_if(c("close_split_adjusted").isNull()).alias("_unknown"),
        F.countDistinct("close_split_adjusted").alias("_bases"),
        F.datediff(decision, F.max("date")).alias("_stale"),
        F.count_if(F.coalesce(c("_at") != c("_r"), F.lit(True))).alias("_off"),
        F.count_if(~c("_fine")).alias("_bad"),
        F.product(F.when(c("_r") > skip, c("_gross"))).alias("_grown"),
        F.stddev_samp(c("_gross") - 1).alias("_spread"),
    )
    problem = (
        F.when(c("n_bars") < n, "too few prices")
        .when(c("_open") > 0, "unverified corporate actions")
        .when(c("_unknown") > 0, "split basis unknown")
        .when(c("_bases") > 1, "mixed split basis")
        .when(c("_stale") > stale_days, "stale price")
        .when(c("_off") > 0, "missing sessions")
        .when(F.lit(refuse_invalid) & (c("_bad") > 0), "invalid price or action")
    )
    whole = lambda x: F.when(c("problem").isNull(), x)
    return found.withColumn("problem", problem).select(key, "n_bars", whole(c("_grown") - 1).alias("momentum"), whole(c("_spread") * F.sqrt(F.lit(252.0))).alias("volatility"), "problem")


def audit(members: DataFrame, coverage: DataFrame, key: str, excluded: Sequence[str] = ()) -> DataFrame:
    """Adds eligible and reasons: the sorted distinct reasons for which a member can't be held.

    ``members``: key and missing (array); ``coverage``: key, has_price_history, has_pit_fundamentals, one row a key.
    """
    joined = members.join(coverage.select(key, "has_price_history", "has_pit_fundamentals"), key, "left")
    no = F.lit(False)
    own = F.array(
        F.when(F.col(key).cast("string").isin(*excluded), "excluded") if excluded else F.lit(None).cast("string"),
        F.when(~F.coalesce("has_price_history", no), "no price history"),
        F.when(~F.coalesce("has_pit_fundamentals", no), "no point-in-time fundamentals"),
    )
    reasons = F.array_sort(F.array_distinct(F.concat(F.array_compact(own), F.coalesce("missing", F.array().cast("array<string>")))))
    return joined.withColumn("reasons", reasons).withColumn("eligible", F.size("reasons") == 0)


def contemporaneous_price() -> Column:
    """The close on the share basis of its own day: adjusted closes times their factor (null without a positive one), plain
    closes as they are, null where the basis isn't known."""
    factor = F.col("split_normalization_factor")
    positive = (factor > 0) & (factor < float("inf"))
    return F.when(F.col("close_split_adjusted"), F.when(positive, F.col("close") * factor)).when(~F.col("close_split_adjusted"), F.col("close"))


def metric_value(flow: Column) -> Column:
    """A flow's value of its single period, anything else's value as it is; never the one for the other."""
    return F.when(flow, F.col("quarter_value")).otherwise(F.col("value"))
