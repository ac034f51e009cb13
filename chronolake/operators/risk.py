"""Checks of proposed books and fixed-return scenarios over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .facts import finite

EPSILON = 1e-9


@dataclass(frozen=True)
class Limits:
    """What a long-only book may do."""

    least_positions: int = 10
    most_positions: int = 20
    position: float = 0.10
    sector: float = 0.25
    gross: float = 1.0
    turnover: float = 1.0
    drawdown: float = 0.15
    order_share: float = 0.05


@dataclass(frozen=True)
class Scenario:
    """Returns of the positions chosen and of the others; who is chosen (all, each sector in turn, the heaviest ``count``); and
    the share of average daily value that still trades, over how many sessions."""

    name: str
    chosen: float
    others: float = 0.0
    kind: str = "all"
    count: int = 0
    adv_share: float = 0.5
    sessions: int = 5


#: The reference scenarios. Fixed values.
SCENARIOS = (
    Scenario("broad_drawdown_2008_style", -0.37),
    Scenario("supervisory_severe_equity_decline", -0.58, sessions=10),
    Scenario("liquidity_shock_2020_style", -0.34, adv_share=0.25),
    Scenario("inflation_rate_shock_2022_style", -0.18, adv_share=0.6),
    Scenario("sector_specific_crash", -0.4, -0.1, kind="sector"),
    Scenario("top_five_down_20", -0.2, kind="heaviest", count=5, adv_share=0.75),
    Scenario("top_five_down_30", -0.3, kind="heaviest", count=5, adv_share=0.6),
    Scenario("top_five_down_40", -0.4, kind="heaviest", count=5),
)
#: Volatility and correlation scenario: multiple of volatility, one correlation, standard deviations, sessions. Fixed values.
VOLATILITY_MULTIPLE, CORRELATION, DEVIATIONS, HORIZON, SESSIONS_A_YEAR = 2.0, 0.85, 2.0, 20, 252
#: Share of the value traded a day that an exit may take. Fixed value.
EXIT_SHARE = 0.10

CHECKS = ("input_integrity", "long_only", "position_count", "gross_exposure", "position_concentration", "sector_concentration", "rebalance_turnover", "liquidity", "drawdown_halt")


def assess(books: DataFrame, targets: DataFrame, current: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """book, gross, cash, turnover, drawdown, the nine checks (true: passed) and approved, for each row of ``books``.

    ``books``: book, equity, peak; ``targets``: book, ticker, weight, sector, adv; ``current``: book, ticker, weight. Evidence
    that lacks or isn't finite fails its check. Targets are summed by ticker before any exposure is measured; a book's
    positions are combined by sums, so no book has to fit in one task.
    """
    c, no = F.col, F.lit(False)
    blank = F.coalesce(F.trim("ticker") == "", F.lit(True))
    wanted = targets.groupBy("book", F.upper(F.trim("ticker")).alias("ticker")).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.coalesce(finite(c("weight")), no)).alias("_invalid"),
        F.sum(F.when(finite(c("weight")), c("weight"))).alias("_target"),
        F.max_by("adv", F.coalesce("weight", F.lit(0.0))).alias("_adv"),
        F.count_if((c("weight") > EPSILON) & (F.coalesce(F.trim("sector"), F.lit("")) == "")).alias("_no_sector"),
    )
    held = current.groupBy("book", F.upper(F.trim("ticker")).alias("ticker")).agg(F.sum("weight").alias("_held"), F.count_if(~F.coalesce(finite(c("weight")) & (c("weight") >= 0), no)).alias("_invalid_held"))
    both = wanted.join(held, ["book", "ticker"], "full_outer").fillna(0, ["_n", "_invalid", "_target", "_no_sector", "_held", "_invalid_held"])
    moved = F.abs(c("_target") - c("_held"))
    equity = books.select("book", "equity", "peak")
    lines = both.join(equity, "book", "right")
    evident = F.coalesce(finite(c("_adv")) & (c("_adv") > 0), no)
    illiquid = (moved > EPSILON) & (~evident | (moved * c("equity") / c("_adv") > limits.order_share + EPSILON))
    sums = lines.groupBy("book").agg(
        F.max("equity").alias("equity"),
        F.max("peak").alias("peak"),
        F.count_if(((c("_n") > 1) | (c("_invalid") > 0) | (c("_invalid_held") > 0) | blank) & c("_n").isNotNull()).alias("_wrong"),
        F.count_if(c("_target") < -EPSILON).alias("_short"),
        F.count_if(c("_target") > EPSILON).alias("_count"),
        F.coalesce(F.sum(F.abs("_target")), F.lit(0.0)).alias("gross"),
        F.coalesce(F.sum(F.when(c("_target") > EPSILON, c("_target"))), F.lit(0.0)).alias("_long"),
        F.coalesce(F.max("_target"), F.lit(0.0)).alias("_largest"),
        F.coalesce(F.sum("_no_sector"), F.lit(0)).alias("_no_sector"),
        (0.5 * (F.coalesce(F.sum(moved), F.lit(0.0)) + F.abs(F.coalesce(F.sum("_held") - F.sum("_target"), F.lit(0.0))))).alias("turnover"),
        F.count_if(illiquid).alias("_illiquid"),
    )
    sectors = targets.where((c("weight") > EPSILON) & (F.trim("sector") != "")).groupBy("book", "sector").agg(F.sum("weight").alias("_w")).groupBy("book").agg(F.max("_w").alias("_sector"))
    valued = F.coalesce(finite(c("equity")) & (c("equity") > 0), no)
    capital = valued & F.coalesce(finite(c("peak")) & (c("peak") > 0) & (c("equity") <= c("peak") + EPSILON), no)
    drawn = sums.join(sectors, "book", "left").withColumn("drawdown", F.when(capital, c("equity") / c("peak") - 1).otherwise(-1.0))
    passed = (
        c("_wrong") == 0,
        c("_short") == 0,
        c("_count").between(limits.least_positions, limits.most_positions),
        c("gross") <= limits.gross + EPSILON,
        c("_largest") <= limits.position + EPSILON,
        (c("_no_sector") == 0) & (F.coalesce("_sector", F.lit(0.0)) <= limits.sector + EPSILON),
        c("turnover") <= limits.turnover + EPSILON,
        valued & (c("_illiquid") == 0),
        capital & (c("drawdown") >= -limits.drawdown - EPSILON),
    )
    judged = drawn.withColumns(dict(zip(CHECKS, passed))).withColumn("cash", F.greatest(F.lit(0.0), 1 - c("_long")))
    approved = F.lit(True)
    for name in CHECKS:
        approved = approved & c(name)
    return judged.select("book", "gross", "cash", "turnover", "drawdown", *CHECKS, approved.alias("approved"))


def shock_largest(positions: DataFrame, n: int, ret: float) -> DataFrame:
    """book, loss: what a book loses when the ``n`` heaviest positions of each book (ties by security_id) return ``ret``."""
    heavy = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("weight"), "security_id"))
    return positions.withColumn("_r", heavy).groupBy("book").agg(F.sum(F.when(F.col("_r") <= n, F.col("weight") * ret).otherwise(0.0)).alias("loss"))


def stressed_weights(positions: DataFrame, ret: str = "ret") -> DataFrame:
    """Adds stressed_weight: each position's share of its book's value (cash included) after its return ``ret``."""
    left = F.sum(F.col("weight") * F.col(ret)).over(Window.partitionBy("book"))
    return positions.withColumn("stressed_weight", F.when(1 + left > 0, F.col("weight") * (1 + F.col(ret)) / (1 + left)))


def exit_days(weight, equity: float, adv, share: float = 0.10):
    """Whole sessions to sell a position at ``share`` of its average daily value; null without that value."""
    return F.when(adv > 0, F.ceil(weight * equity / (adv * share)))


def evaluate(positions: DataFrame, equity: float, scenarios=SCENARIOS) -> DataFrame:
    """book, scenario, loss, worst_sector, n_exits_late, blockers: what each scenario does to each book.

    ``positions``: book, security_id, ticker, sector, weight, rank (of the factor), adv. A sector scenario is one scenario a
    sector of the book. The heaviest positions are those of the greatest weight, ties by rank, security and ticker. An exit
    is late if, at the share of value that still trades, it takes longer than the scenario's sessions. A position without
    sector or value traded blocks its book: the numbers are then null and the blockers named.

    Scenarios are a short list: positions are read once and each scenario is an aggregate, not a copy of them.
    """
    c = F.col
    heavy = F.row_number().over(Window.partitionBy("book").orderBy(F.desc("weight"), F.col("rank").asc_nulls_last(), "security_id", "ticker"))
    lacking = F.array_compact(F.array(F.when(F.coalesce(F.trim("sector"), F.lit("")) == "", F.concat("ticker", F.lit(":sector"))), F.when(~F.coalesce(c("adv") > 0, F.lit(False)), F.concat("ticker", F.lit(":liquidity")))))
    rows = positions.withColumns({"_heavy": heavy, "_lacking": lacking})
    blocked = rows.groupBy("book").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_lacking")))).alias("blockers"))
    parts = []
    for s in scenarios:
        late = c("weight") * (1 + F.lit(s.others)) * equity / (c("adv") * s.adv_share * EXIT_SHARE) > s.sessions
        if s.kind == "sector":
            own = rows.groupBy("book", "sector").agg(F.sum("weight").alias("_in"), F.count_if(late).alias("_late")).withColumns({"_all": F.sum("_in").over(Window.partitionBy("book")), "_lates": F.sum("_late").over(Window.partitionBy("book"))})
            parts.append(own.select("book", F.concat(F.lit(f"{s.name}:"), F.coalesce("sector", F.lit(""))).alias("scenario"), (c("_in") * s.chosen + (c("_all") - c("_in")) * s.others).alias("loss"), c("_lates").alias("n_exits_late")))
        else:
            ret = F.when(c("_heavy") <= s.count, s.chosen).otherwise(s.others) if s.kind == "heaviest" else F.lit(s.chosen)
            parts.append(rows.groupBy("book").agg(F.lit(s.name).alias("scenario"), F.sum(c("weight") * ret).alias("loss"), F.count_if(late).alias("n_exits_late")))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    free = F.size("blockers") == 0
    return whole.join(blocked, "book").select("book", "scenario", F.when(free, c("loss")).alias("loss"), F.when(free, c("n_exits_late")).alias("n_exits_late"), "blockers")


def volatility_loss(positions: DataFrame) -> DataFrame:
    """book, security_id, contribution: what each position adds to the loss if volatility multiplies and all returns move
    together; contributions of a book sum to its loss. ``positions``: book, security_id, weight, volatility (a year's)."""
    c = F.col
    x = positions.withColumn("_x", c("weight") * c("volatility") * VOLATILITY_MULTIPLE * F.sqrt(F.lit(HORIZON / SESSIONS_A_YEAR)))
    w = Window.partitionBy("book")
    sums = x.withColumns({"_flat": F.sum("_x").over(w), "_own": F.sum(c("_x") * c("_x")).over(w)})
    spread = F.sqrt(CORRELATION * c("_flat") * c("_flat") + (1 - CORRELATION) * c("_own"))
    return sums.select("book", "security_id", (-DEVIATIONS * c("_x") * (CORRELATION * c("_flat") + (1 - CORRELATION) * c("_x")) / spread).alias("contribution"))


def withheld(blockers: DataFrame, kinds: tuple[str, ...] = ("price", "revenue_fact")) -> DataFrame:
    """book, kind, status, live: for each kind of evidence whether it lacks now, so that results must be withheld, or is only
    shown as a policy. ``blockers``: book, blocker ("kind:what"). Nothing is recalculated and no number comes out."""
    c = F.col
    found = blockers.groupBy("book").agg(*[F.array_sort(F.collect_set(F.when(c("blocker").startswith(f"{k}:"), c("blocker")))).alias(k) for k in kinds])
    long = found.unpivot("book", list(kinds), "kind", "live")
    return long.select("book", "kind", F.when(F.size("live") > 0, "withholding required").otherwise("policy demonstration").alias("status"), "live")


def liquidity_evidence(bars: DataFrame, sessions: DataFrame, day, n: int = 20) -> DataFrame:
    """security_id, adv, problem: the mean value traded over exactly the last ``n`` sessions up to ``day``, or why not.

    ``bars``: security_id, date, close, volume; ``sessions``: date (a calendar, broadcast).
    """
    c = F.col
    wanted = sessions.where(c("date") <= day).select("date").distinct().orderBy(F.desc("date")).limit(n)
    last = bars.where(c("date") <= day).withColumn("_r", F.row_number().over(Window.partitionBy("security_id").orderBy(F.desc("date")))).where(c("_r") <= n)
    fine = F.coalesce(finite(c("close")) & (c("close") > 0) & finite(c("volume")) & (c("volume") > 0), F.lit(False))
    met = last.join(F.broadcast(wanted.withColumn("_in", F.lit(True))), "date", "left")
    sums = met.groupBy("security_id").agg(F.count(F.lit(1)).alias("_n"), F.count("_in").alias("_met"), F.countDistinct("date").alias("_dates"), F.count_if(~fine).alias("_bad"), F.avg(c("close") * c("volume")).alias("_adv"), F.max("date").alias("_last"))
    top = wanted.agg(F.max("date").alias("_day"))
    problem = (
        F.when(c("_n") < n, "too few bars")
        .when(c("_dates") < c("_n"), "duplicate dates")
        .when(c("_last") != c("_day"), "latest session is missing")
        .when(c("_met") < c("_n"), "sessions are missing")
        .when(c("_bad") > 0, "close or volume is not positive")
    )
    judged = sums.join(F.broadcast(top)).withColumn("problem", problem)
    return judged.select("security_id", F.when(c("problem").isNull(), c("_adv")).alias("adv"), "problem")
