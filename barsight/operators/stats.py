"""Statistics of decisions, scores and equity curves.

Scores are first summed per distinct value, so running sums go over values, not rows, and over ranges of them (ordered.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import ordered


def score_groups(samples: DataFrame, key: list[str], score: str = "score", label: str = "label") -> DataFrame:
    return samples.groupBy(*key, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("p"), F.sum(1 - F.col(label).cast("bigint")).alias("n"))


def roc_points(samples: DataFrame, key: list[str], most: int = 400) -> DataFrame:
    """(key, k, fpr, tpr): cumulative rates by falling score, ties together, from (0, 0); more than `most` points are thinned to
    most + 1 by place."""
    g = score_groups(samples, key)
    c = ordered.with_before(g, key, [F.desc("score")], {"k": F.lit(1), "tp": F.col("p"), "fp": F.col("n")})
    c = c.select(*key, (F.col("k") + 1).cast("int").alias("k"), (F.col("tp") + F.col("p")).alias("tp"), (F.col("fp") + F.col("n")).alias("fp"))
    total = g.groupBy(*key).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), (F.count("*") + 1).alias("points")).where("pos > 0 and neg > 0")
    zero = total.select(*key, F.lit(0).alias("k"), F.lit(0).cast("bigint").alias("tp"), F.lit(0).cast("bigint").alias("fp"))
    all_points = c.unionByName(zero).join(total, key)
    every = F.col("points") / most
    # Place k stays if some j < most has floor(j * points / most) = k, or if it is the last.
    j = F.ceil(F.col("k") / every)
    chosen = (F.col("points") <= most) | (F.floor(j * every) == F.col("k")) & (j < most) | (F.col("k") == F.col("points") - 1)
    return all_points.where(chosen).select(*key, "k", (F.col("fp") / F.col("neg")).alias("fpr"), (F.col("tp") / F.col("pos")).alias("tpr"))


def wins(groups: DataFrame, key: list[str]) -> DataFrame:
    """(key, pos, neg, u) of (key, score, p, n): u counts pairs whose positive scores higher, ties half. Each range counts within
    itself; against the ranges before it only their sums count."""
    rows = ordered.ranged(groups, key, [F.desc("score")])
    above = F.coalesce(F.sum("p").over(ordered.inner(key, [F.desc("score")])), F.lit(0))
    parts = rows.select(*key, ordered.RANGE, "p", "n", (F.col("n") * (above + F.col("p") / 2)).alias("u")).groupBy(*key, ordered.RANGE).agg(F.sum("p").alias("p"), F.sum("n").alias("n"), F.sum("u").alias("u"))
    higher = F.coalesce(F.sum("p").over(W.partitionBy(*key).orderBy(ordered.RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(*key, "p", "n", (F.col("u") + F.col("n") * higher).alias("u"))
    return parts.groupBy(*key).agg(F.sum("p").alias("pos"), F.sum("n").alias("neg"), F.sum("u").alias("u"))


def auc(samples: DataFrame, key: list[str], score: str = "score", label: str = "label") -> DataFrame:
    """(key, pos, neg, auc, se, lo, hi): Mann-Whitney with ties half, missing without both labels, and the interval of Hanley and
    McNeil (1982)."""
    sums = wins(score_groups(samples, key, score, label), key)
    a = F.try_divide(F.col("u"), F.col("pos") * F.col("neg"))
    out = sums.select(*key, "pos", "neg", a.alias("auc"))
    x = F.col("auc")
    q1, q2 = x / (2 - x), 2 * x * x / (1 + x)
    se = F.sqrt((x * (1 - x) + (F.col("pos") - 1) * (q1 - x * x) + (F.col("neg") - 1) * (q2 - x * x)) / (F.col("pos") * F.col("neg")))
    out = out.withColumn("se", se)
    return out.withColumn("lo", x - 1.96 * F.col("se")).withColumn("hi", x + 1.96 * F.col("se"))


def confusion(samples: DataFrame, key: list[str]) -> DataFrame:
    """Cells and rates of decision against label, and the mean forward change by decision; undefined rates are null."""
    d, y = F.col("decision"), F.col("label") == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    g = samples.groupBy(*key).agg(n(d & y).alias("tp"), n(d & ~y).alias("fp"), n(~d & ~y).alias("tn"), n(~d & y).alias("fn"), F.sum(F.when(d, F.col("fwd"))).alias("f1s"), F.sum(F.when(~d, F.col("fwd"))).alias("f0s"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    total = tp + fp + tn + fn
    g = g.withColumns({"n": total, "signals": tp + fp, "base": (tp + fn) / total, "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "specificity": F.try_divide(tn, tn + fp), "accuracy": (tp + tn) / total})
    p, r, s = F.col("precision"), F.col("recall"), F.col("specificity")
    mcc = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return g.select(*key, "tp", "fp", "tn", "fn", "n", "signals", "base", "precision", "recall", "specificity", "accuracy", F.try_divide(2 * p * r, p + r).alias("f1"), F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, mcc).alias("mcc"), F.try_divide(p, F.col("base")).alias("lift"), ((r + s) / 2).alias("decision_auc"), F.try_divide(F.col("f1s"), tp + fp).alias("avg_fwd_signal"), F.try_divide(F.col("f0s"), tn + fn).alias("avg_fwd_other"))


def deciles(samples: DataFrame, key: list[str], order: list[str], buckets: int = 10) -> DataFrame:
    """Buckets of equal counts with floor borders by score, ties in the given order: n, score range, hit rate, mean change."""
    rows = ordered.numbered(samples.select(*dict.fromkeys([*key, "score", *order, "label", "fwd"])), key, [F.col(c) for c in ("score", *order)], "rn")
    rows = rows.join(samples.groupBy(*key).agg(F.count("*").alias("all")), key)
    bucket = F.floor(((F.col("rn") + 1) * buckets + F.col("all") - 1) / F.col("all"))
    return rows.groupBy(*key, bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.min("score").alias("score_lo"), F.max("score").alias("score_hi"), F.avg("label").alias("hit"), F.avg("fwd").alias("avg_fwd"))


def mean_ranks(samples: DataFrame, key: list[str], x: str, name: str) -> DataFrame:
    """(key, x, name): the 1-based rank of each distinct value, ties at their mean."""
    values = samples.groupBy(*key, x).agg(F.count("*").alias("_ties"))
    below = ordered.with_before(values, key, [F.col(x)], {"_below": F.col("_ties")})
    return below.select(*key, x, (F.col("_below") + 1 + (F.col("_ties") - 1) / 2).alias(name))


def spearman(samples: DataFrame, key: list[str], x: str = "score", y: str = "fwd") -> DataFrame:
    rows = samples.select(*key, x, y).join(mean_ranks(samples, key, x, "rx"), [*key, x]).join(mean_ranks(samples, key, y, "ry"), [*key, y])
    return rows.groupBy(*key).agg(F.corr("rx", "ry").alias("ic"))


def curve_metrics(curve: DataFrame, key: list[str]) -> DataFrame:
    """Total, yearly growth, volatility, Sharpe ratio and worst drawdown of (key, t, date, equity), and with the column invested
    the exposure, its mean; curves of one point are left out."""
    w = W.partitionBy(*key).orderBy("t")
    exposure = ["exposure"] if "invested" in curve.columns else []
    steps = curve.select(*key, "t", "date", "equity", *[F.col("invested").alias(c) for c in exposure], (F.col("equity") / F.lag("equity").over(w) - 1).alias("r"), F.max("equity").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("peak"))
    g = steps.groupBy(*key).agg(F.count("*").alias("n"), (F.max_by("equity", "t") / F.min_by("equity", "t")).alias("growth"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("years"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("sd"), F.min(F.col("equity") / F.col("peak") - 1).alias("max_dd"), *[F.avg(c).alias(c) for c in exposure]).where("n >= 2")
    sd = F.col("sd")
    return g.select(*key, "n", (F.col("growth") - 1).alias("total"), F.when(F.col("years") > 0, F.pow("growth", 1 / F.col("years")) - 1).otherwise(0.0).alias("cagr"), (sd * F.sqrt(F.lit(252.0))).alias("vol"), F.when(sd > 0, F.col("mean") / sd * F.sqrt(F.lit(252.0))).otherwise(0.0).alias("sharpe"), "max_dd", *exposure)


def trade_metrics(trades: DataFrame, key: list[str]) -> DataFrame:
    """Counts and means over closed trades (key, pnl, ret, days)."""
    win = F.col("pnl") > 0
    g = trades.groupBy(*key).agg(F.count("*").alias("trades"), F.avg(win.cast("int")).alias("win_rate"), F.avg(F.when(win, F.col("ret"))).alias("avg_win"), F.avg(F.when(~win, F.col("ret"))).alias("avg_loss"), F.sum(F.when(win, F.col("pnl")).otherwise(0)).alias("gw"), (-F.sum(F.when(win, 0).otherwise(F.col("pnl")))).alias("gl"), F.avg("days").alias("avg_days"))
    return g.select(*key, "trades", "win_rate", "avg_win", "avg_loss", F.when(F.col("gl") != 0, F.col("gw") / F.col("gl")).alias("profit_factor"), "avg_days")


def yearly_returns(curve: DataFrame, key: list[str]) -> DataFrame:
    """Per calendar year the last equity over the last of the year before; the first year starts at the first equity."""
    y = curve.groupBy(*key, F.year("date").alias("year")).agg(F.max_by("equity", "t").alias("end"), F.min_by("equity", "t").alias("start"))
    before = F.coalesce(F.lag("end").over(W.partitionBy(*key).orderBy("year")), F.col("start"))
    return y.select(*key, "year", (F.col("end") / before - 1).alias("ret"))
