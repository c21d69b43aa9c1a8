"""Signals of the built-in strategy: indicator columns, macro gate, the five entry checks, price plan, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import size_shares
from ..operators import indicators as I
from ..sources import panel as P
from .params import Params

CHECKS = ("above_smas", "sma50_over_sma200", "ema12_over_ema26", "rsi_in_band", "near_high")


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel with the strategy's indicators, written once for one application and input."""

    def make() -> DataFrame:
        c = F.col("close")
        rows = I.with_recurrences(P.bars(spark, sf_dir), [("ema12", "ema", 12), ("ema26", "ema", 26), ("rsi14", "rsi", 14), ("macd", "macd", None)])
        step = {"sma50": I.sma(c, 50), "sma200": I.sma(c, 200), "mom126": I.change(c, 126), "vol20": I.volatility(F.col("r"), 20)}
        return I.windows(rows, 252, {"r": I.change(c)}, step, I.extremes(hi252=("max", "close", 252)))

    return P.kept(spark, sf_dir, "prepared", make)


def index_features(index: DataFrame) -> DataFrame:
    """Index averages over a window of days; the index is one series, as many rows as days."""
    w = W.orderBy("t")
    n = lambda k: w.rowsBetween(1 - k, 0)
    full = lambda k: F.when(F.count("idx").over(n(k)) == k, F.avg("idx").over(n(k)))
    return index.select("t", "date", "idx", full(50).alias("idx_sma50"), full(200).alias("idx_sma200"))


def gate(p: Params) -> Column:
    on = F.col("idx") > F.col("idx_sma200")
    if p.gate == "off":
        return F.lit(True)
    return F.coalesce(on & (F.col("idx_sma50") > F.col("idx_sma200")) if p.gate == "sma50_200" else on, F.lit(False))


def checks(p: Params) -> list[Column]:
    c, s50, s200 = F.col("close"), F.col("sma50"), F.col("sma200")
    known = c.isNotNull() & s200.isNotNull()
    above = (c > s200) & (c > s50) if p.exit_below_sma50 else c > s200
    each = (above, s50 > s200, F.col("ema12") > F.col("ema26"), F.col("rsi14").between(p.rsi_min, p.rsi_max), c >= F.col("hi252") * (1 - p.high_within_pct / 100))
    return [F.coalesce(known & x, F.lit(False)).alias(name) for x, name in zip(each, CHECKS)]


def with_checks(rows: DataFrame, p: Params) -> DataFrame:
    """rows with the five checks and how many hold."""
    out = rows.select("*", *checks(p))
    return out.withColumn("passes", sum((F.col(n).cast("int") for n in CHECKS), F.lit(0)))


def stop_level(peak: Column, p: Params) -> Column:
    trailing = peak * (1 - p.trail_pct / 100)
    return F.greatest(trailing, F.col("sma50").cast("double")) if p.exit_below_sma50 else trailing


def price_plan(rows: DataFrame, p: Params) -> DataFrame:
    """Entry, buy zone, stop, targets at two and three times the risk, and the size for the account, in the panel's unit."""
    c = F.col("close").cast("double")
    out = rows.withColumn("entry", c).withColumn("stop", stop_level(c, p)).withColumn("zone_low", F.least(c, F.col("ema12")))
    risk = F.col("entry") - F.col("stop")
    shares = size_shares(c / 10000, F.col("vol20"), F.lit(float(p.capital)), p)
    return out.withColumns({"risk_pct": risk / F.col("entry"), "target1": F.col("entry") + 2 * risk, "target2": F.col("entry") + 3 * risk, "shares": shares}).withColumns({"value": F.col("shares") * F.col("entry") / 10000, "max_loss": F.col("shares") * risk / 10000})


def status(held: Column, selling: Column, buying: Column, passes: Column) -> Column:
    return F.when(held & selling, "EXIT").when(held, "HOLD").when(buying, "BUY").when(passes == 5, "WAIT").when(passes >= 3, "WATCH").otherwise("AVOID")


def last_day(rows: DataFrame) -> DataFrame:
    newest = rows.agg(F.max("t").alias("_newest"))
    return rows.join(F.broadcast(newest), F.col("t") == F.col("_newest")).drop("_newest")


def ranked_signals(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """The newest day's table: every symbol with its checks, status as if nothing were held, rank and price plan."""
    rows = price_plan(with_checks(last_day(prepared(spark, sf_dir)), p), p)
    days = index_features(P.index_bars(spark, sf_dir))
    rows = rows.join(F.broadcast(days.drop("date")), "t").withColumn("gate_on", gate(p))
    order = F.row_number().over(W.partitionBy("t").orderBy(F.desc("passes"), F.col("mom126").desc_nulls_last(), "sym_ix"))
    state = status(F.lit(False), F.lit(False), F.lit(False), F.col("passes"))
    return rows.select("symbol", "sector", "date", "close", "passes", *CHECKS, "gate_on", state.alias("status"), order.alias("place"), F.round("mom126", 8).alias("momentum"), F.round("rsi14", 6).alias("rsi"), F.round("stop", 4).alias("stop"), F.round("risk_pct", 8).alias("risk_pct"), F.round("target1", 4).alias("target1"), F.round("target2", 4).alias("target2"), "shares")
