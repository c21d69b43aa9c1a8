"""The rule language: algorithms of nested dicts compiled to columns.

Operands: close, sma, ema, rsi, ret, vol, dhigh, dlow, macd, idx, idxsma (with n) and num (with v). Operators: > < >= <= xup
xdown. Catalyst sees plain column expressions; only ema, rsi and macd need the per-symbol fold, all of them in one pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cross_section as X
from ..operators import indicators as I

WORDS = {">": "over", "<": "under", ">=": "no less than", "<=": "no more than", "xup": "passes upward through", "xdown": "passes downward through"}
FOLDED = ("ema", "rsi", "macd")
EXTREME = {"dhigh": "max", "dlow": "min"}
#: Columns over the last places, from the close, its one-place change _r, and the extreme _x.
WINDOWED = {
    "sma": lambda n: I.sma(F.col("close"), n),
    "ret": lambda n: I.change(F.col("close"), n) * 100,
    "vol": lambda n: I.volatility(F.col("_r"), n) * F.sqrt(F.lit(252.0)) * 100,
    "dhigh": lambda n: I.off(F.col("close"), F.col(f"_max{n}")),
    "dlow": lambda n: I.off(F.col("close"), F.col(f"_min{n}")),
}


def windowed(panel: DataFrame, need: dict[str, dict]) -> DataFrame:
    """panel with a column for each windowed operand {name: {ind, n}}."""
    if not need:
        return panel
    ends = {f"_{EXTREME[o['ind']]}{o['n']}": (EXTREME[o["ind"]], "close", o["n"]) for o in need.values() if o["ind"] in EXTREME}
    steps = [I.extremes(**ends)] if ends else []
    steps += [{"_r": I.change(F.col("close"))}] if any(o["ind"] == "vol" for o in need.values()) else []
    out = I.windows(panel, 1 + max(o["n"] for o in need.values()), *steps, {k: WINDOWED[o["ind"]](o["n"]) for k, o in need.items()})
    return out.drop("_r", *ends)


def operand_name(o: dict) -> str:
    return o["ind"] + str(o.get("n") or "")


def describe(rule: dict) -> str:
    side = lambda o: str(o["v"]) if o["ind"] == "num" else o["ind"].upper() + (f"({o['n']})" if o.get("n") else "")
    return f"{side(rule['a'])} {WORDS[rule['op']]} {side(rule['b'])}"


def operands(algo: dict) -> dict[str, dict]:
    rules = [*algo["entry"]["rules"], *algo.get("exit", {}).get("rules", [])]
    found = [o for r in rules for o in (r["a"], r["b"])] + ([algo["rank"]] if algo.get("rank") else [])
    for o in found:
        if o["ind"] not in (*FOLDED, *WINDOWED, "close", "idx", "idxsma", "num"):
            raise ValueError(f"no indicator is called {o['ind']}")
    return {operand_name(o): o for o in found if o["ind"] != "num"}


def with_operands(panel: DataFrame, index: DataFrame, algo: dict) -> DataFrame:
    """panel with a column for every operand of the algorithm."""
    need = operands(algo)
    out = panel
    folds = [(k, o["ind"], o.get("n")) for k, o in need.items() if o["ind"] in FOLDED and k not in out.columns]
    if folds:
        out = I.with_recurrences(out, folds)
    out = windowed(out, {k: o for k, o in need.items() if o["ind"] in WINDOWED and k not in out.columns})
    series = {k: o for k, o in need.items() if o["ind"] in ("idx", "idxsma")}
    if series:
        w = W.orderBy("t")
        sma = lambda n: F.when(F.count("idx").over(w.rowsBetween(1 - n, 0)) == n, F.avg("idx").over(w.rowsBetween(1 - n, 0)))
        days = index.select("t", *[(F.col("idx") if o["ind"] == "idx" else sma(o["n"])).alias(k) for k, o in series.items()])
        out = out.join(F.broadcast(days), "t")  # a row for each day
    return out


def holds(rule: dict) -> Column:
    """False where an operand is missing, and for crosses on the first day or after a missing one."""
    a, b = (F.lit(float(o["v"])) if o["ind"] == "num" else F.col(operand_name(o)) for o in (rule["a"], rule["b"]))
    before = lambda o, c: c if o["ind"] == "num" else F.lag(c).over(I.by())
    op = rule["op"]
    if op in ("xup", "xdown"):
        a0, b0 = before(rule["a"], a), before(rule["b"], b)
        found = (a0 <= b0) & (a > b) if op == "xup" else (a0 >= b0) & (a < b)
        found = found & (F.col("t") > 0)
    else:
        found = {">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}.get(op, F.lit(False))
    return F.coalesce(found, F.lit(False))


def met(rules: list[dict]) -> Column:
    return reduce(lambda x, y: x + y, (holds(r).cast("int") for r in rules), F.lit(0))


def enters(algo: dict, count: Column) -> Column:
    n = len(algo["entry"]["rules"])
    if not n:
        return F.lit(False)
    return count > 0 if algo["entry"]["join"] == "any" else count == n


def rank_value(algo: dict) -> Column:
    r = algo.get("rank") or {"ind": "ret", "n": 126, "dir": "high"}
    c = F.col(operand_name(r)).cast("double")
    return -c if r.get("dir") == "low" else c


def samples(panel: DataFrame, index: DataFrame, algo: dict, start: int = 252) -> DataFrame:
    """(t, sym_ix, symbol, decision, score, fwd, label, part) of the days start, start + step, ... whose outcome is known.

    Score: share of entry rules met and a hundredth of the ranking's percentile among the day's rows. Label: forward change
    above 0, or above the index's. The first 70 % of the span of days is part 'in'.
    """
    ev = algo["eval"]
    h = ev["horizon"]
    rows = with_operands(panel, index, algo)
    rules = algo["entry"]["rules"]
    rows = rows.withColumn("_met", met(rules)).withColumn("fwd", I.forward_change(F.col("close"), h)).withColumn("_rank", rank_value(algo))
    days = index.select(F.col("t").alias("_t"), (F.lead("idx", h).over(W.orderBy("t")) / F.col("idx") - 1).alias("_ifwd"), F.max("t").over(W.partitionBy()).alias("_last"))
    rows = rows.join(F.broadcast(days), F.col("t") == F.col("_t"))
    first = max(start, 1)
    rows = rows.where((F.col("t") >= first) & (F.col("t") <= F.col("_last") - h) & ((F.col("t") - first) % ev["step"] == 0) & F.col("fwd").isNotNull())
    share = F.col("_met") / len(rules) if rules else F.lit(0.0)
    label = F.col("fwd") > (F.lit(0.0) if ev["label"] == "up" else F.col("_ifwd"))
    split = F.floor(first + (F.col("_last") - h - first) * 0.7 + 0.5)
    return rows.select("t", "sym_ix", "symbol", "sector", enters(algo, F.col("_met")).alias("decision"), (share + 0.01 * X.share_below(F.col("_rank"))).alias("score"), "fwd", label.cast("int").alias("label"), F.when(F.col("t") < split, "in").otherwise("out").alias("part"), split.cast("int").alias("split"))
