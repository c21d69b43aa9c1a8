"""Path-dependent portfolios: a day-by-day fold over Spark's rows.

Entry, rank, gate and exit flags are columns. Parameter sets that differ only in what the account does share one copy of the rows; the
copies, each with at most ACCOUNTS sets, are groups that Spark deals out and sorts by day. A task sees one day of one group at a
time and holds that day's symbols and the open positions of its accounts, nothing of the past. One account's days follow each other, so
a single parameter set is one task's, as many rows as the market has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import indicators as I
from ..sources import panel as P
from . import rules as R
from .params import Params
from .signals import CHECKS, checks, gate, index_features, prepared

#: Parameter sets of a group.
ACCOUNTS = 16
#: What the signal columns depend on; the rest concerns the account.
SIGNAL = ("gate", "rsi_min", "rsi_max", "high_within_pct", "exit_below_sma50", "rank_by", "mom_lookback")
UNIT = 10000.0
FIRST = 252


@dataclass
class Day:
    """One day's symbols in the order of sym_ix; NaN is missing. exits holds a flag per exit rule."""

    t: int
    date: object
    gate: bool
    index: float
    ids: np.ndarray
    symbols: list[str]
    sectors: list[str]
    close: np.ndarray
    entry: np.ndarray
    rank: np.ndarray
    vol: np.ndarray
    sma: np.ndarray
    exits: list[np.ndarray]

    # Found once for all accounts of a group.
    @cached_property
    def place(self) -> dict[int, int]:
        return {i: k for k, i in enumerate(self.ids.tolist())}

    @cached_property
    def prices(self) -> list[float]:
        return self.close.tolist()

    @cached_property
    def ranked(self) -> list[int]:
        """Candidates, best first; ties in the order of sym_ix."""
        found = np.flatnonzero(self.entry & ~np.isnan(self.rank))
        return found[np.argsort(-self.rank[found], kind="stable")].tolist()

    def price(self, i: int) -> float | None:
        """The day's price of a symbol, if it has one."""
        k = self.place.get(i)
        return None if k is None or self.prices[k] != self.prices[k] else self.prices[k]


class Account:
    """Cash and positions of one simulation."""

    def __init__(self, p: Params, first: int, algo: dict | None = None):
        self.p, self.first, self.algo = p, first, algo
        self.cash = self.equity = float(p.capital)
        self.positions: dict[int, dict] = {}
        self.trades: list[tuple] = []
        self.orders: tuple[list, list] = ([], [])
        self.fee = p.fee_bps / 10000
        self.index: float | None = None

    def exit_reason(self, price: float, k: int, day: Day, pos: dict) -> str | None:
        p = self.p
        if self.algo is None:
            if price <= pos["peak"] * (1 - p.trail_pct / 100):
                return "trail"
            return "under_sma50" if p.exit_below_sma50 and price < day.sma[k] else None
        x = self.algo.get("exit", {})
        loss, gain, days = (x.get(n, 0) for n in ("stop_loss", "take_profit", "max_hold"))
        if loss > 0 and price <= pos["entry"] * (1 - loss / 100):
            return "loss_limit"
        if gain > 0 and price >= pos["entry"] * (1 + gain / 100):
            return "gain_limit"
        if days > 0 and day.t - pos["t0"] >= days:
            return "time_limit"
        return next((R.describe(r) for r, flag in zip(x.get("rules", []), day.exits) if flag[k]), None)

    def fill(self, day: Day) -> None:
        """Yesterday's orders at the last known prices: sells, then buys as far as the cash goes."""
        sells, buys = self.orders
        for i, pos in self.positions.items():
            price = day.price(i)
            if price is not None:
                pos["known"] = price
        for i, reason in sells:
            pos = self.positions.pop(i)
            got = pos["shares"] * pos["known"] * (1 - self.fee)
            self.cash += got
            self.trades.append((pos["symbol"], pos["sector"], pos["date"], pos["entry"], day.date, pos["known"], pos["shares"], got - pos["cost"], got / pos["cost"] - 1, day.t - pos["t0"], reason))
        for i, symbol, sector, price, shares in buys:
            now = day.price(i)
            price = price if now is None else now
            each = price * (1 + self.fee)
            short = max(0, int(np.ceil((shares * each - self.cash) / each / self.p.lot - 1e-12)))
            shares -= short * self.p.lot
            while shares > 0 and shares * each > self.cash:
                shares -= self.p.lot
            if shares > 0:
                self.cash -= shares * each
                self.positions[i] = {"symbol": symbol, "sector": sector, "shares": shares, "entry": price, "cost": shares * each, "t0": day.t, "date": day.date, "peak": price, "known": price}

    def mark(self) -> float:
        value = float(sum(p["shares"] * p["known"] for p in self.positions.values()))
        self.equity = self.cash + value
        return value

    def size(self, price: float, vol: float) -> int:
        p = self.p
        if p.sizing == "risk":
            distance = max(p.stop_vol_mult * (vol if vol > 0 else 0.02) * price, 0.02 * price)
            value = min(self.equity * p.risk_pct / 100 / distance * price, self.equity * p.max_pos_pct / 100)
        else:
            value = self.equity / p.slots
        return int(value / price // p.lot) * p.lot

    def decide(self, day: Day, force: bool = False) -> dict[int, str]:
        """Sets the orders at the day's close; why candidates were passed over."""
        p, sells = self.p, []
        for i, pos in self.positions.items():
            price = day.price(i)
            if price is not None:
                pos["peak"] = max(pos["peak"], price)
            why = "gate_closed" if p.gate_exit_all and not day.gate else None if price is None else self.exit_reason(price, day.place[i], day, pos)
            if why:
                sells.append((i, why))
        buys, passed = [], {}
        if force or (day.t - self.first) % p.rebalance_every == 0:
            going = {i for i, _ in sells}
            staying = [pos["sector"] for i, pos in self.positions.items() if i not in going]
            used, per_sector = len(staying), {s: staying.count(s) for s in set(staying)}
            for k in day.ranked:
                i, s = int(day.ids[k]), day.sectors[k]
                if i in self.positions:
                    continue
                full = "gate_closed" if not day.gate else "slots_taken" if used >= (max(p.slots, 1) if p.sizing == "risk" else p.slots) else "sector_full" if per_sector.get(s, 0) >= p.sector_cap else None
                shares = 0 if full else self.size(float(day.close[k]), float(day.vol[k]))
                if full or shares <= 0:
                    passed[i] = full or "under_one_lot"
                    continue
                buys.append((i, day.symbols[k], s, float(day.close[k]), shares))
                used, per_sector[s] = used + 1, per_sector.get(s, 0) + 1
        self.orders = (sells, buys)
        return passed

    def step(self, day: Day, last: bool = False) -> tuple:
        """(t, date, equity, invested, bench) of a day; orders of its close fill at the next one."""
        self.fill(day)
        value = self.mark()
        self.index = day.index if self.index is None else self.index
        if not last:
            self.decide(day)
        return day.t, day.date, self.equity, value / self.equity, day.index / self.index * self.p.capital


def simulate(days: Iterable[Day], p: Params, algo: dict | None = None, first: int = FIRST, last: int | None = None) -> tuple[Account, list[tuple]]:
    """The account at the end, and its steps."""
    account, first = Account(p, max(first, FIRST), algo), max(first, FIRST)
    return account, [account.step(day, day.t == last) for day in days if first <= day.t and (last is None or day.t <= last)]


EQUITY = "combo int, t int, date date, equity double, invested double, bench double"
TRADES = "combo int, symbol string, sector string, entry_date date, entry double, exit_date date, exit double, shares bigint, pnl double, ret double, days int, reason string"
STATE = "combo int, symbol string, held boolean, selling boolean, buying boolean, reason string, position_shares bigint, position_entry double, entry_date date, peak double"


@dataclass
class Market:
    """rows(symbol, sym_ix, sector, t, close in ten-thousandths, sma50, vol20, exit0, ...) and signals(params) -> (entry, rank) over
    their columns; days(t, date, idx) with a flag gate_... for each gate."""

    rows: DataFrame
    days: DataFrame
    signals: Callable[[Params], tuple[Column, Column]]
    algo: dict | None = None


def market(rows: DataFrame, index: DataFrame, signals: Callable[[Params], tuple[Column, Column]], algo: dict | None = None) -> Market:
    kinds = {k: gate(Params(gate=k)) for k in ("off", "sma200", "sma50_200")}
    return Market(rows, index_features(index).select("t", "date", "idx", *[g.alias(f"gate_{k}") for k, g in kinds.items()]), signals, algo)


def grouped(sets: list[Params]) -> list[list[tuple[int, Params]]]:
    """Parameter sets with their numbers, together where the signal columns are the same, at most ACCOUNTS in a group."""
    alike: dict[tuple, list] = {}
    for k, p in enumerate(sets):
        alike.setdefault(tuple(getattr(p, n) for n in SIGNAL), []).append((k, p))
    return [found[k : k + ACCOUNTS] for found in alike.values() for k in range(0, len(found), ACCOUNTS)]


def over_sets(m: Market, sets: list[Params], schema: str, end: Callable[[int, Account, list[tuple], Day], list[tuple]], first: int | None = None, last: int | None = None, forced: bool = False) -> DataFrame:
    """The rows that end(combo, account, steps since the last call, day) gives for every parameter set: on the last day, and before it
    whenever `steps` has grown to a few hundred rows. With `forced` the last day ends with a decision too."""
    groups, algo = grouped(sets), m.algo
    first = max(first or FIRST, FIRST)
    last = m.days.agg(F.max("t")).first()[0] if last is None else last
    exits = [c for c in m.rows.columns if c.startswith("exit") and c[4:].isdigit()]
    number = lambda c: F.col(c).cast("double").alias(c)
    base = m.rows.where(F.col("t").between(first, last)).drop("date", "idx").join(F.broadcast(m.days), "t")  # a row for each day
    sent = []
    for g, found in enumerate(groups):
        entry, rank = m.signals(found[0][1])
        sent.append(F.struct(F.lit(g).alias("g"), F.coalesce(entry, F.lit(False)).alias("entry"), rank.cast("double").alias("rank"), F.coalesce(F.col(f"gate_{found[0][1].gate}"), F.lit(False)).alias("gate")))
    sma = (F.col("sma50") / UNIT if "sma50" in m.rows.columns else F.lit(None)).cast("double").alias("sma")
    rows = base.select("t", "date", "idx", "sym_ix", "symbol", "sector", (F.col("close") / UNIT).cast("double").alias("close"), number("vol20"), sma, *[F.coalesce(F.col(c).cast("int") == 1, F.lit(False)).alias(c) for c in exits], F.explode(F.array(*sent)).alias("s"))
    rows = rows.select("s.*", *[c for c in rows.columns if c != "s"])
    rows = rows.repartition(len(groups), "g").sortWithinPartitions("g", "t", "sym_ix")
    names = [f.split()[0] for f in schema.split(", ")]
    kinds = pa.schema([(n, {"int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "date": pa.date32(), "string": pa.string(), "boolean": pa.bool_()}[k]) for n, k in (f.split() for f in schema.split(", "))])

    def fold(days: Iterator[tuple[int, Day]]) -> Iterator[list[tuple]]:
        now, accounts = None, []
        for g, day in days:
            if g != now:
                now, accounts = g, [(k, Account(p, first, algo), []) for k, p in groups[g]]
            for k, account, steps in accounts:
                steps.append(account.step(day, day.t == last and not forced))
                if day.t == last or len(steps) >= 500:
                    yield end(k, account, steps, day)
                    steps.clear()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in fold(by_day(batches, exits)):
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), kinds.types)], names)

    return rows.mapInArrow(run, schema)


def by_day(batches: Iterator[pa.RecordBatch], exits: list[str]) -> Iterator[tuple[int, Day]]:
    """(group, day) of rows sorted by group, t and symbol, whole days across batches."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
        g, t = table["g"].to_numpy(), table["t"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (t[1:] != t[:-1]))))
        yield from _days(table.slice(0, int(starts[-1])), exits)
        held = table.slice(int(starts[-1]))
    if held is not None:
        yield from _days(held, exits)


def _days(table: pa.Table, exits: list[str]) -> Iterator[tuple[int, Day]]:
    if not table.num_rows:
        return
    c = {n: table[n].to_numpy() for n in ("g", "t", "sym_ix", "idx", "close", "rank", "vol20", "sma", "entry", "gate", *exits)}
    symbols, sectors, dates = (table[n].to_pylist() for n in ("symbol", "sector", "date"))
    starts = np.flatnonzero(np.concatenate(([True], (c["g"][1:] != c["g"][:-1]) | (c["t"][1:] != c["t"][:-1])))).tolist()
    for lo, hi in zip(starts, [*starts[1:], table.num_rows]):
        x = slice(lo, hi)
        yield int(c["g"][lo]), Day(int(c["t"][lo]), dates[lo], bool(c["gate"][lo]), float(c["idx"][lo]), c["sym_ix"][x], symbols[x], sectors[x], c["close"][x], c["entry"][x].astype(bool), c["rank"][x].astype(float), c["vol20"][x].astype(float), c["sma"][x].astype(float), [c[e][x] for e in exits])


def built_in(rows: DataFrame, index: DataFrame, lookbacks: Iterable[int] = (126,)) -> Market:
    """The strategy's own signals over rows with its indicators: all five checks, ranked by momentum, or by the column ml_rank."""
    back = {f"_mom{n}": I.change(F.col("close"), n) for n in lookbacks}

    def signals(p: Params) -> tuple[Column, Column]:
        every = F.lit(True)
        for c, _ in zip(checks(p), CHECKS):
            every = every & c
        return every, F.col("ml_rank") if p.rank_by == "ml" else F.col(f"_mom{p.mom_lookback}")

    return market(I.windows(rows, max(lookbacks), back), index, signals)


def built_in_market(spark: SparkSession, sf_dir: str) -> Market:
    return built_in(prepared(spark, sf_dir), P.index_bars(spark, sf_dir))


def ruled(rows: DataFrame, index: DataFrame, algo: dict) -> Market:
    """Signals from rows with the columns entry, rank and exit0, exit1, ... of an algorithm."""
    return market(rows, index, lambda p: (F.col("entry") == 1, F.col("rank")), algo)


def algo_market(spark: SparkSession, sf_dir: str, algo: dict) -> Market:
    """An algorithm's rules as columns."""
    rows = R.with_operands(prepared(spark, sf_dir), P.index_bars(spark, sf_dir), algo)
    exits = {f"exit{k}": R.holds(r).cast("int") for k, r in enumerate(algo.get("exit", {}).get("rules", []))}
    rows = rows.withColumns({"_met": R.met(algo["entry"]["rules"]), **exits})
    rows = rows.withColumns({"entry": R.enters(algo, F.col("_met")).cast("int"), "rank": R.rank_value(algo)})
    return ruled(rows, P.index_bars(spark, sf_dir), algo)


def equity_curves(m: Market, sets: list[Params], first: int | None = None, last: int | None = None) -> DataFrame:
    return over_sets(m, sets, EQUITY, lambda k, account, steps, day: [(k, *s) for s in steps], first, last)


def trades(m: Market, sets: list[Params], first: int | None = None, last: int | None = None) -> DataFrame:
    def closed(k: int, account: Account, steps: list[tuple], day: Day) -> list[tuple]:
        out = [(k, *x) for x in account.trades]
        account.trades.clear()
        return out

    return over_sets(m, sets, TRADES, closed, first, last)


def final_state(m: Market, sets: list[Params], first: int, last: int) -> DataFrame:
    """Every symbol of the last day after a forced decision: what is held, sold and bought, and why not."""

    def state(k: int, account: Account, steps: list[tuple], day: Day) -> list[tuple]:
        if day.t != last:
            return []
        passed = account.decide(day, force=True)
        why, sizes, out = dict(account.orders[0]), {b[0] for b in account.orders[1]}, []
        for i, symbol in zip(day.ids.tolist(), day.symbols):
            pos = account.positions.get(i)
            out.append((k, symbol, pos is not None, i in why, i in sizes, why.get(i) or passed.get(i), *((pos["shares"], pos["entry"], pos["date"], pos["peak"] * UNIT) if pos else (None,) * 4)))
        return out

    return over_sets(m, sets, STATE, state, first, last)
