"""A portfolio book carried through periods: first-in first-out lots, conversions, splits, dividends, costs and taxes.

The fold is sequential within a book, so Spark spreads the books. A book's rows (bars of the securities that it ever aims at
and of what these convert into, within its own periods) stream through its task in the order of their dates: the task holds
the lots and the bars since the earliest period that is not done, whatever the book's length. A period whose evidence lacks
anything leaves the book as it was and says why.
"""

from __future__ import annotations

import copy
import math
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .asof import frontier
from .backtest import Frictions

SCHEMA = "book string, date date, cash double, equity double, costs double, taxes double, n_positions int, n_lots int, stale array<string>, problem string"
SMALL = 1e-9


class Refused(Exception):
    """A period that lacks evidence: its reasons."""


@dataclass
class Lot:
    quantity: float
    basis: float  # paid for one share, costs included
    since: date


@dataclass
class Book:
    cash: float
    frictions: Frictions = field(default_factory=Frictions)
    lots: dict[str, deque] = field(default_factory=dict)
    marks: dict[str, tuple[float, date]] = field(default_factory=dict)
    gains: dict[str, float] = field(default_factory=lambda: {"short": 0.0, "long": 0.0})
    income: float = 0.0
    costs: float = 0.0
    taxes: float = 0.0

    def held(self, security: str) -> float:
        return sum(lot.quantity for lot in self.lots.get(security, ()))

    def value(self, security: str) -> float:
        if security not in self.marks:
            raise Refused(f"{security}: no mark")
        return self.held(security) * self.marks[security][0]

    def equity(self) -> float:
        return self.cash + sum(self.value(s) for s in self.lots)

    def _tax(self) -> None:
        """Losses offset gains of their own kind only; what is due beyond what was booked leaves the cash."""
        f = self.frictions
        due = max(0.0, self.gains["short"]) * f.short_rate + max(0.0, self.gains["long"]) * f.long_rate + self.income * f.dividend_rate
        self.cash, self.taxes = self.cash - (due - self.taxes), due

    def _cost(self, notional: float) -> float:
        f = self.frictions
        return notional * (f.commission_bps + f.slippage_bps) / 1e4 + f.fixed_fee

    def convert(self, source: str, target: str, ratio: float) -> None:
        """Lots keep their dates; quantities times the ratio, bases over it."""
        moved = [Lot(lot.quantity * ratio, lot.basis / ratio, lot.since) for lot in self.lots.pop(source, ())]
        self.marks.pop(source, None)
        if moved:
            self.lots.setdefault(target, deque()).extend(moved)

    def session(self, day: date, bars: dict[str, dict]) -> None:
        """Splits where closes aren't adjusted for them, dividends into cash, then marks. Without a usable close the mark stays."""
        for security in list(self.lots):
            bar = bars.get(security)
            if bar is None:
                continue
            split, dividend = event(bar["split_ratio"], 1.0), event(bar["dividends"], 0.0)
            if split != 1.0 and bar["close_split_adjusted"] is not True:
                for lot in self.lots[security]:
                    lot.quantity, lot.basis = lot.quantity * split, lot.basis / split
            if dividend:
                paid = self.held(security) * dividend
                self.cash, self.income = self.cash + paid, self.income + paid
                self._tax()
        for security, bar in bars.items():
            if usable(bar):
                self.marks[security] = (bar["close"], day)

    def sell(self, security: str, notional: float, day: date) -> None:
        """Oldest lots first; costs lower the price received."""
        price, held = self.marks[security][0], self.held(security)
        quantity = held if held - notional / price <= SMALL else notional / price
        cost = self._cost(quantity * price)
        if cost > quantity * price + SMALL:
            raise Refused(f"{security}: costs exceed the proceeds")
        net, left, lots = price - cost / quantity, quantity, self.lots[security]
        while lots and left > SMALL:
            lot = lots[0]
            part = min(lot.quantity, left)
            kind = "long" if (day - lot.since).days >= self.frictions.long_term_days else "short"
            self.gains[kind] += part * (net - lot.basis)
            lot.quantity, left = lot.quantity - part, left - part
            if lot.quantity <= SMALL:
                lots.popleft()
        self.cash, self.costs = self.cash + quantity * price - cost, self.costs + cost
        if not lots:
            del self.lots[security], self.marks[security]
        self._tax()

    def buy(self, security: str, notional: float, day: date) -> None:
        """Costs are part of the basis."""
        cost, quantity = self._cost(notional), notional / self.marks[security][0]
        if notional + cost > self.cash + SMALL or quantity <= 0:
            raise Refused(f"{security}: cash does not suffice")
        self.lots.setdefault(security, deque()).append(Lot(quantity, (notional + cost) / quantity, day))
        self.cash, self.costs = self.cash - notional - cost, self.costs + cost

    def rebalance(self, targets: list[str], day: date, bars: dict[str, dict]) -> None:
        """Equal values; sales before purchases; purchases share what the sales, costs and fees leave."""
        without = sorted(s for s in {*targets, *self.lots} if not usable(bars.get(s)))
        if without:
            raise Refused(*[f"{s}: no execution price" for s in without])
        equity = self.equity()
        if equity <= 0:
            raise Refused("equity is not positive")
        each, now = equity / len(targets), {s: self.value(s) for s in self.lots}
        gap = {s: (each if s in targets else 0.0) - now.get(s, 0.0) for s in {*targets, *now}}
        for s in sorted(s for s, x in gap.items() if x < -equity * 1e-12):
            self.sell(s, -gap[s], day)
        wanted = {s: gap[s] for s in sorted(gap) if gap[s] > equity * 1e-12}
        if wanted:
            f = self.frictions
            spare = (self.cash - len(wanted) * f.fixed_fee) / (1 + (f.commission_bps + f.slippage_bps) / 1e4)
            scale = min(1.0, max(0.0, spare) / sum(wanted.values()))
            if scale <= 0:
                raise Refused("cash does not suffice")
            for s, x in wanted.items():
                self.marks[s] = (bars[s]["close"], day)
                self.buy(s, x * scale, day)
        self.cash = 0.0 if abs(self.cash) <= SMALL else self.cash


def usable(bar: dict | None) -> bool:
    return bar is not None and bar["close"] is not None and math.isfinite(bar["close"]) and bar["close"] > 0


def event(x: float | None, none: float) -> float:
    """A split ratio or dividend; null is none, and so is a split ratio of 0."""
    if x is None or math.isnan(x):
        return none
    if not math.isfinite(x) or x < 0:
        raise Refused("corporate action is not a number of 0 or more")
    return none if none and not x else x


def converted(securities: set[str], conversions: list[dict], day: date) -> set[str]:
    """What ``securities`` are by ``day``."""
    out, by_source = set(securities), {c["source"]: c for c in conversions if c["date"] <= day}
    while out & by_source.keys():
        for s in sorted(out & by_source.keys()):
            out = (out - {s}) | {by_source[s]["target"]}
            del by_source[s]
    return out


def preflight(book: Book, targets: list[str], bars: dict[date, dict[str, dict]], entry: date, exit_: date, conversions: list[dict]) -> list[str]:
    """Sorted reasons for which a period can't be carried out: dates that are no sessions, prices that lack at entry or
    exit, conversions without a price or before entry, unknown or mixed split bases, unverified actions."""
    out = set()
    out |= {f"{name} is no session" for name, day in (("entry", entry), ("exit", exit_)) if day not in bars}
    price = lambda s, day: usable(bars.get(day, {}).get(s))
    concerned = {*targets, *book.lots}
    for c in conversions:
        if c["source"] in targets and c["date"] <= entry:
            out.add(f"{c['source']}: converts by entry")
        if c["date"] not in bars:
            out.add(f"{c['source']}: conversion on no session")
        if not price(c["target"], c["date"]):
            out.add(f"{c['target']}: no price at conversion")
        concerned.add(c["target"])
    out |= {f"{s}: no price at entry" for s in converted({*targets, *book.lots}, conversions, entry) if not price(s, entry)}
    out |= {f"{s}: no price at exit" for s in converted(set(targets), conversions, exit_) if not price(s, exit_)}
    for s in concerned:
        own = [day[s] for day in bars.values() if s in day]
        bases = {b["close_split_adjusted"] for b in own}
        if None in bases:
            out.add(f"{s}: split basis unknown")
        if len(bases) > 1:
            out.add(f"{s}: mixed split basis")
        if any(b["actions_complete"] is not True for b in own):
            out.add(f"{s}: unverified corporate actions")
        if any(b["twice"] for b in own):
            out.add(f"{s}: ambiguous price")
    return sorted(out)


def _plain(x):
    return None if x is None or (isinstance(x, float) and math.isnan(x)) or x is pd.NaT or x is pd.NA else x


def _period(book: Book, row: dict, bars: dict[date, dict[str, dict]], conversions: list[dict]) -> Iterator[tuple]:
    """The sessions after the decision, up to the exit."""
    chain, reached = [], {*row["targets"], *book.lots}
    for c in sorted(conversions, key=lambda c: (c["date"], c["source"])):
        if row["decision"] < c["date"] <= row["exit"] and c["source"] in reached:
            reached.add(c["target"])
            chain.append(c)
    within = {day: own for day, own in bars.items() if row["decision"] < day <= row["exit"]}
    if not row["targets"]:
        raise Refused("no targets")
    if not row["decision"] < row["entry"] <= row["exit"]:
        raise Refused("dates are out of order")
    reasons = preflight(book, row["targets"], within, row["entry"], row["exit"], chain)
    if reasons:
        raise Refused(*reasons)
    for day in sorted(within):
        for c in chain:
            if c["date"] == day and c["source"] in book.lots:
                book.convert(c["source"], c["target"], c["ratio"])
        book.session(day, within[day])
        if day == row["entry"]:
            book.rebalance(row["targets"], day, within[day])
        stale = sorted(s for s in book.lots if book.marks[s][1] != day)
        yield day, book.cash, book.equity(), book.costs, book.taxes, len(book.lots), sum(map(len, book.lots.values())), stale, None


class Stream:
    """A book that is told, in the order of dates, of bars, conversions and the beginnings and ends of its periods.

    A period is carried out once its exit is told and all that were decided before it are done; then the bars that no later
    period needs are let go.
    """

    def __init__(self, initial: float, frictions: Frictions) -> None:
        self.book = Book(initial, frictions)
        self.bars: dict[date, dict[str, dict]] = {}
        self.conversions: list[dict] = []
        self.open: list[dict] = []  # by decision; "done" once the exit is told

    def tell(self, day: date, security: str, bar: dict) -> None:
        if self.open:
            own = self.bars.setdefault(day, {})
            own[security] = bar | {"twice": security in own}

    def convert(self, event: dict) -> None:
        if self.open:
            self.conversions.append(event)

    def decide(self, row: dict) -> None:
        self.open.append({**row, "targets": sorted(set(row["targets"])), "done": False})

    def exit(self, decision: date) -> Iterator[tuple]:
        next(r for r in self.open if r["decision"] == decision and not r["done"])["done"] = True
        while self.open and self.open[0]["done"]:
            yield from self._carried(self.open.pop(0))
        first = self.open[0]["decision"] if self.open else date.max
        self.bars = {day: own for day, own in self.bars.items() if day > first}
        self.conversions = [c for c in self.conversions if c["date"] > first]

    def _carried(self, row: dict) -> Iterator[tuple]:
        """A refused period gives one row, on its decision date, with its reasons."""
        before = copy.deepcopy(self.book)
        try:
            yield from list(_period(self.book, row, self.bars, self.conversions))
        except Refused as refused:
            book = self.book = before
            yield row["decision"], book.cash, book.equity(), book.costs, book.taxes, len(book.lots), sum(map(len, book.lots.values())), [], "; ".join(map(str, refused.args))


#: What a row of a book's stream tells, in the order of one date: bars and conversions, an exit, a decision, and an exit that
#: isn't after its decision.
BAR, CONVERSION, EXIT, DECISION, EARLY_EXIT = range(5)
STREAM = "book string, at date, kind int, security_id string, close double, split_ratio double, dividends double, actions_complete boolean, close_split_adjusted boolean, target string, ratio double, decision date, entry date, exit date, targets array<string>"


def fold(prices: DataFrame, periods: DataFrame, conversions: DataFrame | None = None, initial: float = 1e6, frictions: Frictions = Frictions()) -> DataFrame:
    """Each book's curve: book, date, cash, equity, costs, taxes, n_positions, n_lots, stale (marks of an older day), problem.

    ``prices``: security_id, date, close, split_ratio, dividends, actions_complete, close_split_adjusted; every date with any
    row of the books' securities is a session. ``periods``: book, decision, entry, exit, targets (array). ``conversions``:
    source, target, date, ratio. A period's sessions follow its decision, up to its exit; entry rebalances to equal values
    after that day's marks. A period with a problem changes nothing and has one row that names it.
    """
    c, spark = F.col, prices.sparkSession
    known = conversions if conversions is not None else spark.createDataFrame([], "source string, target string, date date, ratio double")
    known = known.select(c("source").cast("string").alias("source"), c("target").cast("string").alias("target"), "date", c("ratio").cast("double").alias("ratio"))
    aimed = periods.select(c("book").cast("string").alias("book"), F.explode(c("targets").cast("array<string>")).alias("security_id")).distinct()
    reach = frontier(known.select("source", "target", F.lit(1.0).alias("ratio"))).select(c("origin").alias("security_id"), "target").distinct()
    wanted = aimed.unionByName(aimed.join(reach, "security_id").select("book", c("target").alias("security_id"))).distinct()
    spans = periods.groupBy(c("book").cast("string").alias("book")).agg(F.min("decision").alias("_from"), F.max("exit").alias("_to"))
    bar = ["close", "split_ratio", "dividends", "actions_complete", "close_split_adjusted"]
    named = prices.withColumn("security_id", c("security_id").cast("string"))
    rows = named.join(wanted.join(spans, "book"), "security_id").where((c("date") > c("_from")) & (c("date") <= c("_to"))).select("book", "security_id", "date", *bar)
    told = rows.select("book", c("date").alias("at"), F.lit(BAR).alias("kind"), "security_id", *bar)
    events = wanted.join(known, c("security_id") == c("source")).join(spans, "book").where((c("date") > c("_from")) & (c("date") <= c("_to")))
    events = events.select("book", c("date").alias("at"), F.lit(CONVERSION).alias("kind"), c("source").alias("security_id"), "target", "ratio").distinct()
    plans = periods.select(c("book").cast("string").alias("book"), "decision", "entry", "exit", c("targets").cast("array<string>").alias("targets"))
    late = F.coalesce(c("exit") > c("decision"), F.lit(False))
    begins = plans.select("*", c("decision").alias("at"), F.lit(DECISION).alias("kind"))
    ends = plans.select("book", "decision", F.when(late, c("exit")).otherwise(c("decision")).alias("at"), F.when(late, EXIT).otherwise(EARLY_EXIT).alias("kind"))
    stream = told
    for part in (events, begins, ends):
        stream = stream.unionByName(part, allowMissingColumns=True)
    names = [x.split()[0] for x in STREAM.split(", ")]
    ordered = stream.select(*names).repartition("book").sortWithinPartitions("book", "at", "kind", "decision", "security_id")
    columns, each = [x.split()[0] for x in SCHEMA.split(", ")], 10_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, own, out = None, None, []
        for frame in frames:
            for row in frame.itertuples(index=False):
                if own is None or row.book != name:
                    name, own = row.book, Stream(initial, frictions)
                if row.kind == BAR:
                    own.tell(row.at, row.security_id, {k: _plain(getattr(row, k)) for k in bar})
                elif row.kind == CONVERSION:
                    own.convert({"source": row.security_id, "target": row.target, "date": row.at, "ratio": row.ratio})
                elif row.kind == DECISION:
                    own.decide({"decision": row.decision, "entry": row.entry, "exit": row.exit, "targets": list(row.targets) if row.targets is not None else []})
                else:
                    out += [(name, *x) for x in own.exit(row.decision)]
                if len(out) >= each:
                    yield pd.DataFrame(out, columns=columns)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=columns)

    return ordered.mapInPandas(run, SCHEMA)
