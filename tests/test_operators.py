"""Operators on fixtures whose results are known."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from chronolake.operators import asof, facts, intervals, portfolio, ranking
from chronolake.operators.backtest import Frictions


def test_restated_fact(spark):
    rows = [("T", "revenue", date(2023, 12, 31), a, v) for a, v in ((date(2024, 2, 1), 100.0), (date(2024, 3, 1), 110.0), (date(2025, 1, 1), 120.0))]
    df = spark.createDataFrame(rows, "ticker string, metric string, period_end date, as_of_date date, value double")
    for day, value in ((date(2024, 2, 15), 100.0), (date(2024, 12, 31), 110.0)):
        assert [r["value"] for r in asof.latest_known(df, ["ticker", "metric"], day).collect()] == [value]


def test_membership_end_announced_late(spark):
    df = spark.createDataFrame([("A", date(2024, 1, 1), date(2024, 7, 1), date(2023, 12, 15), date(2024, 6, 20)), ("B", date(2024, 7, 1), None, date(2024, 6, 15), None)], "t string, s date, e date, k date, ek date")
    c = F.col
    on = lambda k, d: {r["t"] for r in df.where(asof.member_on(c("k"), c("s"), c("e"), c("ek"), F.lit(k), F.lit(d))).collect()}
    assert on(date(2024, 6, 30), date(2024, 6, 30)) == {"A"}
    assert on(date(2024, 6, 30), date(2024, 7, 1)) == {"B"}
    assert on(date(2024, 6, 16), date(2024, 7, 1)) == {"A", "B"}


def test_ambiguous_identity_raises(spark):
    a = spark.createDataFrame([("X", 1, date(2020, 1, 1), None), ("X", 2, date(2020, 1, 1), None)], "ticker string, security_id int, start date, end date")
    routes = asof.routes_of(a.select("ticker").distinct(), a, F.lit(date(2021, 1, 1)))
    assert routes.first()["security_id"] is None
    with pytest.raises(Exception, match="ambiguous"):
        asof.require_unambiguous(routes).collect()


def test_intervals(spark):
    df = spark.createDataFrame([("a", date(2020, 1, 1), date(2020, 2, 1)), ("a", date(2020, 2, 1), date(2020, 3, 1)), ("a", date(2020, 5, 1), None)], "k string, start date, end date")
    assert [(r["start"].month, r["end"].year) for r in intervals.merge(df, ["k"]).orderBy("start").collect()] == [(1, 2020), (5, 9999)]
    assert [(r["start"].month, r["end"].month) for r in intervals.gaps(df, ["k"]).collect()] == [(3, 5)]
    assert intervals.overlaps(df, ["k"]).count() == 0


def test_percentile_counts_strictly_below(spark):
    df = spark.createDataFrame([("s", 1.0), ("s", 1.0), ("s", 3.0), ("s", None)], "s string, v double")
    got = sorted((r["p"] for r in df.select(ranking.percentile(F.col("v"), "s").alias("p")).collect() if r["p"] is not None))
    assert got == [0.0, 0.0, pytest.approx(2 / 3)]


def test_capped_top_is_the_greedy_walk(spark):
    rows = [(k, "ab"[k % 3 == 0], float(100 - k)) for k in range(20)]
    got = [r["k"] for r in ranking.capped_top(spark.createDataFrame(rows, "k int, g string, s double"), "g", 2, 3, "s", "k").collect()]
    assert sorted(got) == [0, 1, 2]


def ttm_of(spark, *rows):
    """ttm of one history: (label, value) in the order of the period ends."""
    df = spark.createDataFrame([("k", date(2000, 1, 1) + timedelta(days=90 * k), label, float(v)) for k, (label, v) in enumerate(rows)], "k string, period_end date, fiscal_period string, value double")
    return facts.trailing_year(df, ["k"]).first()["ttm"]


def test_trailing_year(spark):
    year = ("Q1_2023", 10), ("Q2_2023", 20), ("Q3_2023", 30)
    full = (*year, ("FY2023", 100))
    assert ttm_of(spark, *full) == 100
    assert ttm_of(spark, *full, ("Q1_2024", 15)) == 105
    assert ttm_of(spark, *full, (" q1_2024 ", 15), ("Q2_2024", 25)) == 110
    assert ttm_of(spark, *full, ("Q2_2024", 25)) is None  # a hole
    assert ttm_of(spark, *full, ("Q1_2024", 15), ("Q1_2024", 15), ("Q3_2024", 1)) is None  # one quarter twice, one not at all
    assert ttm_of(spark, ("Q1_2023", 1), *full, ("Q1_2024", 15)) is None  # two counterparts
    assert ttm_of(spark, *full[1:], ("Q1_2024", 15)) is None  # none
    assert ttm_of(spark, *full, ("H1_2024", 15)) is None and ttm_of(spark, *year, ("FY", 100), ("Q1_2024", 15)) is None
    assert ttm_of(spark, *year, ("FY", 100)) == 100  # a full year alone needs no label
    assert ttm_of(spark, *full, ("Q1_2025", 15)) is None
    assert ttm_of(spark, *year) is None and ttm_of(spark, *year, ("Q4_2023", 40)) == 100
    assert ttm_of(spark, ("Q4_2022", 5), *year) == 65 and ttm_of(spark, ("Q4_2022", 5), *year, ("INST", 1)) is None
    assert ttm_of(spark, ("Q1_2023", 5), ("Q3_2023", 5), ("Q3_2023", 5), ("Q4_2023", 5)) is None  # duplicates span a year too


def test_later_product(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), ("a", 3, 5.0), ("b", 1, 7.0)], "k string, at int, x double")
    assert sorted(r[0] for r in df.select(facts.later_product(["k"], "at", "x")).collect()) == [1.0, 1.0, 5.0, 15.0]


def bar(close, split=1.0, dividend=0.0, adjusted=False, complete=True):
    return {"close": close, "split_ratio": split, "dividends": dividend, "actions_complete": complete, "close_split_adjusted": adjusted, "twice": False}


FREE = Frictions(commission_bps=0, slippage_bps=0)
DAY = [date(2023, 3, 31), date(2023, 4, 3), date(2023, 6, 30), date(2023, 7, 3), date(2023, 9, 29)]


def test_book_keeps_its_money():
    book = portfolio.Book(1000.0, FREE)
    first = {"A": bar(10.0), "B": bar(20.0)}
    book.session(DAY[0], first)
    book.rebalance(["A", "B"], DAY[0], first)
    assert book.equity() == pytest.approx(1000) and book.held("A") == pytest.approx(50)
    second = {"A": bar(5.0, split=2.0, dividend=0.5), "B": bar(20.0)}
    book.session(DAY[1], second)
    assert book.held("A") == pytest.approx(100) and book.cash == pytest.approx(50)
    book.rebalance(["B"], DAY[1], second)
    assert "A" not in book.lots and book.equity() == pytest.approx(1050)


def test_a_split_counts_only_where_closes_are_not_adjusted():
    book = portfolio.Book(1000.0, FREE)
    book.session(DAY[0], {"A": bar(10.0)})
    book.rebalance(["A"], DAY[0], {"A": bar(10.0)})
    book.session(DAY[1], {"A": bar(10.0, split=2.0, adjusted=True)})
    assert book.held("A") == pytest.approx(100) and book.equity() == pytest.approx(1000)


def test_taxes_and_costs():
    book = portfolio.Book(1000.0, Frictions(commission_bps=10.0, slippage_bps=0.0, short_rate=0.3, long_rate=0.15, dividend_rate=0.2))
    book.session(DAY[0], {"A": bar(10.0)})
    book.rebalance(["A"], DAY[0], {"A": bar(10.0)})
    paid = 1000 / 1.001
    assert book.cash == pytest.approx(0) and book.held("A") == pytest.approx(paid / 10) and book.costs == pytest.approx(paid * 0.001)
    book.session(DAY[1], {"A": bar(20.0)})
    book.sell("A", 1e9, DAY[1])
    gain = paid / 10 * (20 * 0.999 - 10.01)
    assert book.taxes == pytest.approx(0.3 * gain) and book.cash == pytest.approx(paid / 10 * 20 * 0.999 - 0.3 * gain)
    fees = portfolio.Book(100.0, Frictions(commission_bps=0, slippage_bps=0, fixed_fee=5.0))
    fees.session(DAY[0], {"A": bar(10.0), "B": bar(10.0)})
    fees.rebalance(["A", "B"], DAY[0], {"A": bar(10.0), "B": bar(10.0)})
    assert fees.costs == pytest.approx(10) and fees.equity() == pytest.approx(90)


def folded(periods, bars, conversions=()):
    """The rows of one book that is told of everything by date."""
    told = [(d, portfolio.BAR, (s, b)) for d, own in bars.items() for s, b in own.items()]
    told += [(d, portfolio.CONVERSION, {"source": s, "target": t, "date": d, "ratio": r}) for s, t, d, r in conversions]
    told += [(d, portfolio.DECISION, {"decision": d, "entry": e, "exit": x, "targets": t}) for d, e, x, t in periods] + [(x, portfolio.EXIT, d) for d, _, x, _ in periods]
    book, rows = portfolio.Stream(1000.0, FREE), []
    for day, kind, what in sorted(told, key=lambda x: x[:2]):
        if kind == portfolio.BAR:
            book.tell(day, *what)
        elif kind == portfolio.CONVERSION:
            book.convert(what)
        elif kind == portfolio.DECISION:
            book.decide(what)
        else:
            rows += list(book.exit(what))
    assert not book.bars and not book.open
    return [(r[0], round(r[2], 6), r[6], r[7], r[8]) for r in rows]


def test_a_holding_is_carried_over():
    bars = {d: {"A": bar(c)} for d, c in zip(DAY[1:], (100, 110, 110, 120))}
    rows = folded([(DAY[0], DAY[1], DAY[2], ["A"]), (DAY[2], DAY[3], DAY[4], ["A"])], bars)
    assert rows == [(DAY[1], 1000.0, 1, [], None), (DAY[2], 1100.0, 1, [], None), (DAY[3], 1100.0, 1, [], None), (DAY[4], 1200.0, 1, [], None)]


def test_conversion_keeps_lots_and_basis():
    book = portfolio.Book(0.0, FREE)
    book.lots["OLD"] = portfolio.deque([portfolio.Lot(10.0, 6.0, DAY[0]), portfolio.Lot(4.0, 9.0, DAY[1])])
    book.convert("OLD", "NEW", 1.5)
    assert [(x.quantity, x.basis, x.since) for x in book.lots["NEW"]] == [(15.0, 4.0, DAY[0]), (6.0, 6.0, DAY[1])] and "OLD" not in book.lots
    bars = {DAY[1]: {"OLD": bar(10)}, DAY[2]: {"OLD": bar(12)}, DAY[3]: {"NEW": bar(8)}, DAY[4]: {"NEW": bar(9)}}
    rows = folded([(DAY[0], DAY[1], DAY[4], ["OLD"])], bars, [("OLD", "NEW", DAY[3], 1.5)])
    assert [r[1] for r in rows] == [1000.0, 1200.0, 1200.0, 1350.0]


@pytest.mark.parametrize(
    "bars, conversions, problem",
    [
        ({DAY[1]: {"A": bar(None)}, DAY[2]: {"A": bar(5)}}, (), "A: no price at entry"),
        ({DAY[1]: {"A": bar(5)}, DAY[2]: {"B": bar(5)}}, (), "A: no price at exit"),
        ({DAY[1]: {"A": bar(5)}}, (), "A: no price at exit; exit is no session"),
        ({DAY[1]: {"A": bar(5, adjusted=None)}, DAY[2]: {"A": bar(5, adjusted=None)}}, (), "A: split basis unknown"),
        ({DAY[1]: {"A": bar(5)}, DAY[2]: {"A": bar(5, adjusted=True)}}, (), "A: mixed split basis"),
        ({DAY[1]: {"A": bar(5, complete=None)}, DAY[2]: {"A": bar(5)}}, (), "A: unverified corporate actions"),
        ({DAY[1]: {"A": bar(5)}, DAY[2]: {"A": bar(5), "B": bar(3)}}, (("A", "B", DAY[1], 2.0),), "A: converts by entry; B: no price at conversion; B: no price at entry"),
        ({DAY[1]: {"A": bar(5)}, DAY[2]: {"A": bar(5, split=-1.0)}}, (), "corporate action is not a number of 0 or more"),
    ],
)
def test_a_period_without_evidence_changes_nothing(bars, conversions, problem):
    assert folded([(DAY[0], DAY[1], DAY[2], ["A"])], bars, conversions) == [(DAY[0], 1000.0, 0, [], problem)]


def test_null_close_keeps_the_mark_and_says_so():
    bars = {DAY[1]: {"A": bar(10)}, DAY[2]: {"A": bar(None)}, DAY[3]: {"A": bar(float("nan"))}, DAY[4]: {"A": bar(11)}}
    assert folded([(DAY[0], DAY[1], DAY[4], ["A"])], bars) == [(DAY[1], 1000.0, 1, [], None), (DAY[2], 1000.0, 1, ["A"], None), (DAY[3], 1000.0, 1, ["A"], None), (DAY[4], 1100.0, 1, [], None)]


def test_only_few_rows_are_broadcast(spark):
    assert spark.range(100).join(asof.few(spark.range(5), 5), "id").count() == 5
    with pytest.raises(Exception, match="more than 4 rows"):
        spark.range(100).join(asof.few(spark.range(5), 4), "id").count()


def test_chains_are_whole_and_circles_end(spark):
    edges = [(k, k + 1, 2.0 if k % 100 == 0 else 1.0) for k in range(1000)] + [(5000, 5001, 2.0), (5001, 5002, 3.0), (5002, 5000, 5.0), (7000, 7000, 2.0)]
    found = {(r["origin"], r["target"]): (r["ratio"], r["depth"]) for r in asof.frontier(spark.createDataFrame(edges, "source long, target long, ratio double")).collect()}
    assert len(found) == 1000 * 1001 // 2 + 6
    assert found[0, 1000] == (2.0**10, 1000)
    assert found[5000, 5002] == (6.0, 2) and (5000, 5000) not in found and 7000 not in {a for a, _ in found}


def test_of_several_ways_the_shortest_counts(spark):
    edges = spark.createDataFrame([("a", "b", 2.0), ("b", "d", 2.0), ("a", "c", 3.0), ("c", "d", 1.0), ("c", "e", 1.0), ("e", "d", 0.1)], "source string, target string, ratio double")
    assert {(r["origin"], r["target"]): (r["ratio"], r["depth"]) for r in asof.frontier(edges).collect()}["a", "d"] == (3.0, 2)
    assert asof.frontier(edges.limit(0)).count() == 0
    with pytest.raises(ValueError, match="more than 1 steps"):
        asof.frontier(edges, longest=1)


@pytest.mark.parametrize("parts", [1, 9])
def test_spread_ranks_equal_those_of_one_task(spark, parts):
    rng = random.Random(parts)
    rows = [(k, rng.choice(["a", None, "b"]), rng.choice([1.0, 1.0, 1.0, None, rng.random()]), rng.randrange(4)) for k in range(900)]
    df = spark.createDataFrame(rows, "id long, s string, v double, u int")
    plain = df.withColumns({f"{x}_want": ranking.percentile(F.col(x), "s") for x in "vu"}).select("id", "v_want", "u_want")
    wrong = ranking.spread_percentiles(df, "id", ["s"], ["v", "u"], parts).join(plain, "id").where("NOT (v_pct <=> v_want) OR NOT (u_pct <=> u_want)")
    assert wrong.count() == 0
    want = {}
    for k, s, v, u in sorted(rows, key=lambda r: (r[3], r[0])):
        want.setdefault(s, []).append(k)
    got = {(r["id"], r["position"], r["size"]) for r in ranking.numbered(df, ["s"], ["u", "id"], parts=parts).collect()}
    assert got == {(k, at, len(ids)) for ids in want.values() for at, k in enumerate(ids)}


def test_a_long_book_streams_and_overlapping_periods_keep_their_order(spark):
    """Three years of sessions, a period each week; every other one ends after the next begins, one has no targets."""
    days = [date(2020, 1, 1) + timedelta(days=k) for k in range(1000)]
    bars = spark.createDataFrame([(s, d, 10.0 + (k * n) % 7, 1.0, 0.01, True, False) for k, d in enumerate(days) for n, s in enumerate("ABC", 2)], "security_id string, date date, close double, split_ratio double, dividends double, actions_complete boolean, close_split_adjusted boolean")
    periods = [(b, days[k], days[k + 1], days[k + (7 if k % 14 else 9)], [] if k == 700 else ["ABC"[k % 3], "B"]) for b in ("x", "y") for k in range(0, 980, 7)]
    rows = portfolio.fold(bars, spark.createDataFrame(periods, "book string, decision date, entry date, exit date, targets array<string>"), initial=1000.0, frictions=FREE).collect()
    x, y = ([tuple(r)[1:] for r in rows if r["book"] == b] for b in "xy")
    assert x == y and [r[-1] for r in x if r[-1]] == ["no targets"]
    plain = {d: {s: bar(10.0 + (k * n) % 7, dividend=0.01) for n, s in enumerate("ABC", 2)} for k, d in enumerate(days)}
    assert [(r[0], round(r[2], 6), r[6], list(r[7]), r[8]) for r in x] == folded([p[1:] for p in periods if p[0] == "x"], plain)


def test_selection_tells_why_rows_are_passed_over(spark):
    rows = [("a", "x", 9.0, 1), ("b", "x", 8.0, 1), ("c", "x", 7.0, 1), ("d", None, 6.0, 1), ("e", "y", 5.0, None), ("f", "y", 4.0, 1), ("g", "y", 3.0, 1), ("h", "z", None, 1)]
    df = spark.createDataFrame(rows, "t string, g string, s double, adv int")
    lacking = {"no sector": F.col("g").isNull(), "no volume": F.col("adv").isNull()}
    told = lambda n: [(r["t"], r["rank"], r["reason"]) for r in ranking.selection(df, lacking, "g", 2, n, "s", "t").orderBy("t").collect()]
    assert told(3) == [("a", 1, None), ("b", 2, None), ("c", None, "x limit reached"), ("d", None, "no sector"), ("e", None, "no volume"), ("f", 3, None)]
    assert told(9) == [*told(3), ("g", 4, None)]


def test_years_are_shifted_as_texts(spark):
    days = ["2024-02-29", "2024-1-5", "soon", None, "2024-01-01-01", "x-1-2"]
    df = spark.createDataFrame([(k, d) for k, d in enumerate(days)], "k int, d string")
    assert [r["b"] for r in df.orderBy("k").select(facts.shift_year(F.col("d")).alias("b")).collect()] == ["2023-02-29", "2023-1-5", "soon", None, "2024-01-01-01", "x-1-2"]
