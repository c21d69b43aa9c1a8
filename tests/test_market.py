"""Invariants of the market part on small panels of our own."""

import math
import random
from dataclasses import dataclass

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsight.functions import scalars as S
from barsight.operators import indicators as I
from barsight.operators import stats
from barsight.plans import learning as L
from barsight.plans import portfolio as B
from barsight.plans import rules as R
from barsight.plans.params import PRESETS, Params, combinations
from barsight.sources import panel as P


def bars_of(spark, series):
    rows = [(name, k, t, x) for k, (name, xs) in enumerate(series.items()) for t, x in enumerate(xs)]
    return spark.createDataFrame(rows, "symbol string, sym_ix int, t int, close double")


def column(df, name):
    return [r[0] for r in df.orderBy("symbol", "t").select(name).collect()]


def test_windows(spark):
    df = bars_of(spark, {"a": [1.0, 2.0, None, 4.0, 5.0, 6.0]})
    df = I.windows(df, 3, {"sma": I.sma(F.col("close"), 2)}, I.extremes(max=("max", "close", 3)))
    assert column(df, "sma") == [None, 1.5, None, None, 4.5, 5.5]
    assert column(df, "max") == [1.0, 2.0, None, 4.0, 5.0, 6.0]


def test_recurrences():
    assert I.rsi_values([float(x) for x in range(1, 20)], 14)[-1] == 100.0
    assert I.ema_values([1.0, None, 3.0], 2) == [None, None, pytest.approx(1 + 2 / 3 * 2)]
    assert all(x is None for x in I.macd_values([1.0] * 33)) and I.macd_values([1.0] * 34)[-1] == 0


def test_crossing_holds_on_its_day_only(spark):
    rule = {"a": {"ind": "close"}, "op": "xup", "b": {"ind": "num", "v": 2}}
    df = bars_of(spark, {"a": [1.0, 3.0, 3.0, 1.0, 2.0, 2.5]}).withColumn("up", R.holds(rule))
    assert column(df, "up") == [False, True, False, False, False, True]
    with pytest.raises(ValueError):
        R.operands({"entry": {"rules": [{"a": {"ind": "no"}, "op": ">", "b": {"ind": "num", "v": 1}}]}})


def samples_of(spark, scores, labels, decisions=None):
    return spark.createDataFrame([("one", float(s), int(y), bool(d), float(y) - 0.5) for s, y, d in zip(scores, labels, decisions or labels)], "key string, score double, label int, decision boolean, fwd double")


@pytest.mark.parametrize("scores,labels,auc", [([1, 2, 3, 4], [0, 0, 1, 1], 1.0), ([4, 3, 2, 1], [0, 0, 1, 1], 0.0), ([1, 1, 1, 1], [0, 1, 0, 1], 0.5), ([1, 2, 3, 4], [0, 1, 0, 1], 0.75)])
def test_auc(spark, scores, labels, auc):
    row = stats.auc(samples_of(spark, scores, labels), ["key"]).first()
    assert row["auc"] == auc
    points = stats.roc_points(samples_of(spark, scores, labels), ["key"]).orderBy("k").collect()
    assert (points[0]["fpr"], points[0]["tpr"], points[-1]["fpr"], points[-1]["tpr"]) == (0, 0, 1, 1)


def test_confusion_and_deciles_add_up(spark):
    r = random.Random(1)
    n = 203
    rows = samples_of(spark, [r.random() for _ in range(n)], [r.randint(0, 1) for _ in range(n)], [r.randint(0, 1) for _ in range(n)])
    m = stats.confusion(rows, ["key"]).first()
    assert m["tp"] + m["fp"] + m["tn"] + m["fn"] == n and m["accuracy"] == pytest.approx((m["tp"] + m["tn"]) / n)
    d = stats.deciles(rows, ["key"], ["label"]).orderBy("bucket").collect()
    assert [x["n"] for x in d] == [math.floor((b + 1) * n / 10) - math.floor(b * n / 10) for b in range(10)]


@dataclass
class Matrices:
    """A market as [day, symbol] matrices; NaN is missing."""

    symbols: list
    sectors: list
    dates: list
    index: np.ndarray
    gates: dict
    close: np.ndarray
    columns: dict

    def days(self, p):
        """The days as the fold gets them, with the strategy's own signals."""
        c, close = self.columns, self.close * B.UNIT
        with np.errstate(invalid="ignore"):
            entry = (close > c["sma200"]) & ((close > c["sma50"]) | (not p.exit_below_sma50)) & (c["sma50"] > c["sma200"]) & (c["ema12"] > c["ema26"]) & (c["rsi14"] >= p.rsi_min) & (c["rsi14"] <= p.rsi_max) & (close >= c["hi252"] * (1 - p.high_within_pct / 100))
        rank = np.full_like(close, np.nan)
        rank[p.mom_lookback :] = close[p.mom_lookback :] / close[: -p.mom_lookback] - 1
        ids = np.arange(len(self.symbols))
        return [B.Day(t, d, bool(self.gates[p.gate][t]), self.index[t], ids, self.symbols, self.sectors, self.close[t], entry[t], rank[t], c["vol20"][t], c["sma50"][t] / B.UNIT, []) for t, d in enumerate(self.dates)]

    def market(self, spark):
        """The same as Spark rows."""
        value = lambda x: None if np.isnan(x) else float(x)
        rows = [(s, i, self.sectors[i], t, value(self.close[t, i] * B.UNIT), *(value(x[t, i]) for x in self.columns.values())) for i, s in enumerate(self.symbols) for t in range(len(self.dates))]
        frame = spark.createDataFrame(rows, "symbol string, sym_ix int, sector string, t int, close double, " + ", ".join(f"{k} double" for k in self.columns))
        return B.built_in(frame, spark.createDataFrame([(t, d, float(self.index[t])) for t, d in enumerate(self.dates)], "t int, date date, idx double"))


def simulate(m, p, first=252, last=None):
    """(account, equity by day, invested share by day)."""
    account, steps = B.simulate(m.days(p), p, None, first, last)
    return account, [s[2] for s in steps], [s[3] for s in steps]


def random_market(n=40, days=600, seed=3):
    r = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(r.normal(0.0005, 0.02, (days, n)), axis=0))
    for i in range(n):
        close[: (i % 5) * 30, i] = np.nan
    index = 1000 * np.exp(np.cumsum(r.normal(0.0005, 0.01, days)))
    series = [[None if np.isnan(x) else x * B.UNIT for x in close[:, i]] for i in range(n)]

    def mean(x, k):
        out = np.full(len(x), np.nan)
        for t in range(k - 1, len(x)):
            w = x[t - k + 1 : t + 1]
            out[t] = np.nan if np.isnan(w).any() else w.mean()
        return out

    num = lambda xs: np.array([[np.nan if v is None else v for v in x] for x in xs]).T
    scaled = close * B.UNIT
    with np.errstate(invalid="ignore"):
        hi = np.array([np.nanmax(np.where(np.isnan(scaled[max(0, t - 251) : t + 1]), -np.inf, scaled[max(0, t - 251) : t + 1]), axis=0) for t in range(days)])
    columns = {"sma50": np.column_stack([mean(scaled[:, i], 50) for i in range(n)]), "sma200": np.column_stack([mean(scaled[:, i], 200) for i in range(n)]), "ema12": num([I.ema_values(x, 12) for x in series]), "ema26": num([I.ema_values(x, 26) for x in series]), "rsi14": num([I.rsi_values(x, 14) for x in series]), "hi252": hi, "vol20": np.full((days, n), 0.02)}
    on = index > mean(index, 200)
    import datetime

    dates = [datetime.date(2020, 1, 1) + datetime.timedelta(days=k) for k in range(days)]
    return Matrices([f"s{i}" for i in range(n)], [f"sec{i % 4}" for i in range(n)], dates, index, {"off": np.ones(days, bool), "sma200": on, "sma50_200": on}, close, columns)


@pytest.fixture(scope="module")
def market():
    return random_market()


def test_no_look_ahead(market):
    p, cut = Params(gate="off", slots=5), 450
    _, before, _ = simulate(market, p)
    later = random_market()
    for x in (later.close, *later.columns.values()):
        x[cut:] *= 1.7
    _, after, _ = simulate(later, p)
    assert before[: cut - 252] == after[: cut - 252] and before != after


def test_limits_and_books(market):
    p = Params(gate="off", slots=5, sector_cap=2, lot=100, capital=1_000_000)
    account, equity, _ = simulate(market, p)
    held = [x["sector"] for x in account.positions.values()]
    assert len(held) <= 5 and all(held.count(s) <= 2 for s in held)
    assert all(t[6] % 100 == 0 for t in account.trades) and account.trades
    value = sum(x["shares"] * x["known"] for x in account.positions.values())
    assert account.cash + value == pytest.approx(equity[-1])
    closed = sum(t[7] for t in account.trades)
    open_ = sum(x["shares"] * x["known"] - x["cost"] for x in account.positions.values())
    assert p.capital + closed + open_ == pytest.approx(equity[-1])


def plain_simulation(m, p):
    """The same plan once more, bar by bar with plain Python: (equity by day, trades)."""
    n, close = len(m.symbols), m.close.tolist()
    col = {k: v.tolist() for k, v in m.columns.items()}
    known, cash, held, trades, equity, orders = [math.nan] * n, p.capital, {}, [], [], ([], [])
    fee, last = p.fee_bps / 1e4, len(close) - 1
    for t in range(252, last + 1):
        for i in range(n):
            if not math.isnan(close[t][i]):
                known[i] = close[t][i]
        for i in orders[0]:
            h = held.pop(i)
            got = h["shares"] * known[i] * (1 - fee)
            cash += got
            trades.append((m.symbols[i], h["day"], t, h["shares"], got - h["paid"]))
        for i, shares in orders[1]:
            if math.isnan(known[i]):
                continue
            each = known[i] * (1 + fee)
            while shares > 0 and shares * each > cash:
                shares -= p.lot
            if shares > 0:
                cash -= shares * each
                held[i] = {"shares": shares, "paid": shares * each, "day": t, "top": known[i]}
        total = cash + sum(h["shares"] * known[i] for i, h in held.items())
        equity.append(total)
        sells = []
        for i, h in held.items():
            x = close[t][i]
            if math.isnan(x):
                continue
            h["top"] = max(h["top"], x)
            if x <= h["top"] * (1 - p.trail_pct / 100) or (p.exit_below_sma50 and x < col["sma50"][t][i] / B.UNIT):
                sells.append(i)
        buys = []
        if (t - 252) % p.rebalance_every == 0 and m.gates[p.gate][t]:
            stay = [i for i in held if i not in sells]
            sectors = [m.sectors[i] for i in stay]
            ranked = []
            for i in range(n):
                x, back = close[t][i], close[t - p.mom_lookback][i]
                c = {k: v[t][i] for k, v in col.items()}
                y = x * B.UNIT
                if c["sma50"] > c["sma200"] and y > c["sma200"] and (y > c["sma50"] or not p.exit_below_sma50) and c["ema12"] > c["ema26"] and p.rsi_min <= c["rsi14"] <= p.rsi_max and y >= c["hi252"] * (1 - p.high_within_pct / 100) and not math.isnan(x / back):
                    ranked.append((-(x / back - 1), i))
            for _, i in sorted(ranked):
                if i in held or len(sectors) >= p.slots or sectors.count(m.sectors[i]) >= p.sector_cap:
                    continue
                shares = int(total / p.slots / close[t][i] // p.lot) * p.lot
                if shares > 0:
                    buys.append((i, shares))
                    sectors.append(m.sectors[i])
        orders = (sells, buys) if t < last else ([], [])
    return equity, trades


@pytest.mark.parametrize("changes", [{"gate": "off", "slots": 5}, {"slots": 8, "sector_cap": 2, "trail_pct": 8, "rebalance_every": 3}, {"gate": "sma50_200", "slots": 3, "lot": 100, "capital": 1_000_000, "exit_below_sma50": False, "rsi_min": 30, "high_within_pct": 40}])
def test_simulation_against_a_plain_one(market, changes):
    p = Params(**changes)
    account, equity, _ = simulate(market, p)
    want, trades = plain_simulation(market, p)
    assert equity == pytest.approx(want, rel=1e-9)
    days = {d: k for k, d in enumerate(market.dates)}
    assert [(x[0], days[x[2]], days[x[4]], x[6]) for x in account.trades] == [x[:4] for x in trades]
    assert [x[7] for x in account.trades] == pytest.approx([x[4] for x in trades], abs=1e-6) and len(trades) > 5


def test_spark_folds_are_the_same_simulation(spark, market, monkeypatch):
    """Sets of several groups, with two accounts a group, and days that cross batches."""
    monkeypatch.setattr(B, "ACCOUNTS", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    sets = [Params(gate="off", slots=5), Params(gate="off", slots=8, trail_pct=8), Params(gate="off", slots=3, sector_cap=1), Params(gate="off", slots=5, rsi_min=30), Params(slots=5, high_within_pct=40, exit_below_sma50=False)]
    m = market.market(spark)
    curves, trades = B.equity_curves(m, sets).collect(), B.trades(m, sets).collect()
    state = B.final_state(m, sets, 252, len(market.dates) - 1).collect()
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k, p in enumerate(sets):
        account, equity, _ = simulate(market, p)
        assert [r["equity"] for r in sorted(curves, key=lambda r: r["t"]) if r["combo"] == k] == pytest.approx(equity, rel=1e-9)
        assert sorted((r["symbol"], r["entry_date"], r["exit_date"], r["shares"]) for r in trades if r["combo"] == k) == sorted((x[0], x[2], x[4], x[6]) for x in account.trades)
        assert {r["symbol"]: r["position_shares"] for r in state if r["combo"] == k and r["held"]} == {x["symbol"]: x["shares"] for x in account.positions.values()}
        assert sum(r["combo"] == k for r in state) == len(market.symbols)


def test_grid_and_spread_runs_are_the_same_simulation(spark, market):
    from barsight.plans.model_queries import grid_search

    base = Params(gate="off", slots=5)
    out = {r["combo"]: r for r in grid_search(spark, market.market(spark), base, {"slots": (3, 5), "trail_pct": (10, 20)}, top=2).collect()}
    assert {k: r["kind"] for k, r in out.items()} == {0: "combination", 1: "combination", 2: "combination", 3: "combination", 4: "baseline", 5: "index"}
    assert sum(r["oos_sharpe"] is not None for r in out.values()) == 4 and out[3]["sharpe"] == out[4]["sharpe"]
    last = len(market.dates) - 1
    split = int(252 + (last - 252) * 0.7 + 0.5)
    for k, (slots, trail) in enumerate([(3, 10), (3, 20), (5, 10), (5, 20)]):
        _, equity, invested = simulate(market, base.with_(slots=slots, trail_pct=trail), 252, split)
        r = np.diff(equity) / np.array(equity[:-1])
        assert out[k]["total"] == pytest.approx(equity[-1] / equity[0] - 1) and out[k]["exposure"] == pytest.approx(np.mean(invested))
        assert out[k]["sharpe"] == pytest.approx(r.mean() / r.std(ddof=1) * 252**0.5)
    assert out[5]["oos_cagr"] is not None and out[5]["sharpe"] is None


def test_boosting_keeps_its_log_odds(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST_HESSIAN", 5.0)
    r = np.random.default_rng(2)
    x = r.normal(size=(1500, L.NF))
    y = (r.random(1500) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1]))).astype(int)
    rows = spark.createDataFrame([(k, 0, [float(v) for v in a], int(b)) for k, (a, b) in enumerate(zip(x, y))], "t int, sym_ix int, x array<double>, label int")
    edges = L.bin_edges(rows)
    monkeypatch.setattr(L, "RENEWED", 1000)
    plain = L.fit_trees(rows, "true", None, edges, rounds=7)
    monkeypatch.setattr(L, "RENEWED", 2)
    kept = L.fit_trees(rows, "true", None, edges, rounds=7)
    z = plain.bins(x)
    assert kept.score(z) == pytest.approx(plain.score(z), abs=1e-9) and len(kept.trees) == 7
    assert np.mean((kept.score(z) > 0) == y) > 0.6


def test_stored_models_are_taken_by_version_and_days(spark):
    from barsight.plans.model_queries import restored

    stored = spark.createDataFrame([(252, 1, 5), (315, 1, 5)], "retrain_t int, version int, n int")
    assert restored(stored, [315, 252], 1).columns == ["retrain_t", "n"]
    assert restored(stored, [252, 315], 2) is None and restored(stored, [252], 1) is None


def test_risk_size(market):
    account = B.Account(Params(sizing="risk", capital=1_000_000, max_pos_pct=100), 252)
    price = market.close[300, 0]
    assert account.size(price, 0.02) * max(3 * 0.02 * price, 0.02 * price) == pytest.approx(10_000, rel=0.01)


def test_grid():
    assert len(combinations()) == 108


def test_logistic_agrees_with_plain_gradient():
    r = np.random.default_rng(5)
    x = r.normal(size=(400, 3))
    y = (r.random(400) < 1 / (1 + np.exp(-(x @ [1.0, -2.0, 0.0])))).astype(float)
    m = L.fit_local(x, y, 1.0)
    z = L.standardised(x, m.mean, m.sd)
    gradient = z.T @ (1 / (1 + np.exp(-(z @ m.w))) - y) + np.array([0, 1, 1, 1]) * m.w
    assert np.abs(gradient).max() < 1e-6


def test_significant_digits(spark):
    xs = [13171.25, 11876.85, 0.000123456789, 1234567.5, -2.5e-9, 0.0]
    got = [r[0] for r in spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").orderBy("k").select(S.significant(F.col("x"))).collect()]
    assert got == [float(f"{x:.6g}") for x in xs]


def test_published_layouts(spark):
    df = spark.createDataFrame([("2024-01-01", [0, 1, 3], [1.0, 2.0, None])], "d0 string, dt array<int>, c array<double>").withColumn("d0", F.to_date("d0"))
    for name in ("o", "h", "l"):
        df = df.withColumn(name, F.col("c"))
    out = P.decode_ohlc(df.withColumn("v", F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), F.lit(3).cast("bigint")))).orderBy("t").collect()
    assert [str(r["date"]) for r in out] == ["2024-01-01", "2024-01-02", "2024-01-05"] and out[2]["close"] is None


def test_equal_weight_index(spark):
    rows = [("a", 0, "2024-01-01", 100.0), ("a", 1, "2024-01-02", 110.0), ("b", 0, "2024-01-01", 50.0), ("b", 1, "2024-01-02", 45.0)]
    df = spark.createDataFrame(rows, "symbol string, t int, date string, close double").withColumn("date", F.to_date("date"))
    assert [r["idx"] for r in P.chained(P.index_returns(df)).orderBy("t").collect()] == [1000.0, pytest.approx(1000.0)]


def test_entry_and_a_query_without_the_optional_part(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(E.oracle_sql()) <= set(E.queries())
