"""Registered queries that run simulations or fit models: rows only, but for what SQL can state."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import cross_section as X
from ..operators import indicators as I
from ..operators import stats
from ..sources import panel as P
from . import learning as L
from . import portfolio as B
from . import rules as R
from . import signals as G
from .params import GRID, PRESETS, Params, combinations
from .queries import IND, LARGE, SAMPLES, _samples, _xs, market_features, query, retrain_days

# --- portfolio ---


@query("backtest_equity")
def backtest_equity(spark, d):
    return B.equity_curves(B.built_in_market(spark, d), [LARGE])


@query("backtest_trades")
def backtest_trades(spark, d):
    return B.trades(B.built_in_market(spark, d), [LARGE])


@query("recent_trades")
def recent_trades(spark, d):
    """The newest 400 trades, newest first."""
    return backtest_trades(spark, d).orderBy(F.desc("exit_date"), "symbol").limit(400)


@query("exit_reasons")
def exit_reasons(spark, d):
    return backtest_trades(spark, d).groupBy("reason").agg(F.count("*").alias("n"), F.sum("pnl").alias("pnl"))


@query("backtest_metrics")
def backtest_metrics(spark, d):
    m = B.built_in_market(spark, d)
    sets = [LARGE, LARGE.with_(sizing="risk"), LARGE.with_(gate="off")]
    curves = stats.curve_metrics(B.equity_curves(m, sets), ["combo"])
    return curves.join(stats.trade_metrics(B.trades(m, sets), ["combo"]), "combo", "left")


@query("algo_backtest")
def algo_backtest(spark, d):
    """Equity of each preset algorithm."""
    out = None
    for name, algo in PRESETS.items():
        one = B.equity_curves(B.algo_market(spark, d, algo), [LARGE]).withColumn("algorithm", F.lit(name))
        out = one if out is None else out.union(one)
    return out


def grid_search(spark: SparkSession, m: B.Market, base: Params, grid: dict = GRID, share: float = 0.7, top: int = 8) -> DataFrame:
    """Every combination in sample and the best `top` by Sharpe ratio again out of sample; the unchanged parameters ('baseline')
    in and out of sample; the index ('index') out of sample."""
    found = combinations(grid)
    sets = [base.with_(**c) for c in found] + [base]
    last, baseline = m.days.agg(F.max("t")).first()[0], len(found)
    split = int(B.FIRST + (last - B.FIRST) * share + 0.5)
    inside = stats.curve_metrics(B.equity_curves(m, sets, first=B.FIRST, last=split), ["combo"])
    inside = P.cut(inside)
    best = [r["combo"] for r in inside.where(F.col("combo") < baseline).orderBy(F.desc("sharpe"), "combo").limit(top).collect()] + [baseline]
    curves = B.equity_curves(m, [sets[k] for k in best], first=split + 1)
    curves = curves.withColumn("combo", F.element_at(F.array(*[F.lit(k) for k in best]), F.col("combo") + 1))
    index = curves.where(F.col("combo") == baseline).select(F.lit(baseline + 1).alias("combo"), "t", "date", F.col("bench").alias("equity"), F.lit(1.0).alias("invested"))
    outside = stats.curve_metrics(curves.drop("bench").unionByName(index), ["combo"]).select("combo", F.col("sharpe").alias("oos_sharpe"), F.col("cagr").alias("oos_cagr"), F.col("max_dd").alias("oos_max_dd"), F.col("exposure").alias("oos_exposure"))
    values = [(k, "combination", *map(float, c.values())) for k, c in enumerate(found)]
    values += [(baseline, "baseline", *(float(getattr(base, k)) for k in grid)), (baseline + 1, "index", *[None] * len(grid))]
    values = spark.createDataFrame(values, "combo int, kind string, " + ", ".join(f"{k} double" for k in grid))
    return values.join(inside, "combo", "left").join(outside, "combo", "left")


@query("grid_search")
def q_grid_search(spark, d):
    return grid_search(spark, B.built_in_market(spark, d), LARGE)


@query("grid_top")
def grid_top(spark, d):
    return q_grid_search(spark, d).where("kind = 'combination' and oos_sharpe is not null").orderBy(F.desc("sharpe"), "combo").limit(8)


@query("live_signals")
def live_signals(spark, d):
    """Three years of simulation to the newest bar, a forced decision there, and every symbol's status, position and plan."""
    m = B.built_in_market(spark, d)
    last = m.days.agg(F.max("t")).first()[0]
    state = B.final_state(m, [LARGE], max(B.FIRST, last - 3 * 252), last).drop("combo")
    signals = I.with_streak_start(G.with_checks(G.prepared(spark, d), LARGE), F.col("passes") == 5, "fired")
    signals = G.price_plan(G.last_day(signals), LARGE).join(state, "symbol")
    status = G.status(F.col("held"), F.col("selling"), F.col("buying"), F.col("passes"))
    return signals.select("symbol", "name", "sector", "date", "passes", status.alias("status"), "fired", "reason", "entry", "stop", "shares", "position_shares", "entry_date", (F.col("close") / B.UNIT / F.col("position_entry") - 1).alias("pnl_pct"), G.stop_level(F.col("peak"), LARGE).alias("position_stop"))


# --- features and splits ---
FEATURE_SQL = {"ret5": "ret5", "ret21": "ret21", "ret63": "ret63", "ret126": "mom126 * 100", "ret252": "ret252", "mom": "mom", "vol20": "vol20", "vol63": "vol63", "rsi5": "rsi5", "rsi14": "rsi14", "gap20": "(close / sma20 - 1) * 100", "gap50": "(close / sma50 - 1) * 100", "gap200": "(close / sma200 - 1) * 100", "trend": "sma50 / sma200 - 1", "dhigh20": "(close / hi20 - 1) * 100", "dhigh252": "(close / hi252 - 1) * 100", "dlow252": "(close / lo252 - 1) * 100", "macd": "macd"}
_W = "OVER (PARTITION BY symbol ORDER BY t)"
FEATS = ",\nfa AS (SELECT i.*, " + ", ".join(f"(CAST(close AS DOUBLE) / lag(close, {n}) {_W} - 1) * 100 AS ret{n}" for n in (5, 21, 63, 252)) + f", CAST(lag(close, 21) {_W} AS DOUBLE) / lag(close, 252) {_W} - 1 AS mom FROM i),\nfb AS (SELECT symbol, sym_ix, t, close, " + ", ".join(f"{v} AS f_{k}" for k, v in FEATURE_SQL.items()) + " FROM fa WHERE close IS NOT NULL AND t >= 252 AND (t - 252) % 5 = 0)"


def _features(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        index = P.index_bars(spark, d)
        return L.features(G.prepared(spark, d), index, market_features(index), PRESETS["pullback"], (F.col("t") >= 252) & ((F.col("t") - 252) % 5 == 0))

    return P.kept(spark, d, "features", make)


@query("features", "SELECT t, sym_ix, " + ", ".join(f"{_xs('f_' + k)} AS {k}" for k in FEATURE_SQL) + " FROM fb", IND + FEATS)
def features(spark, d):
    return _features(spark, d).select("t", "sym_ix", *L.STOCK)


BINS_SQL = ", x AS MATERIALIZED (SELECT t, sym_ix, " + ", ".join(f"{_xs('f_' + k)} AS {k}" for k in FEATURE_SQL) + """ FROM fb), lx AS (UNPIVOT x ON COLUMNS(* EXCLUDE (t, sym_ix)) INTO NAME feature VALUE v),
q AS (SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM lx),
ed AS MATERIALIZED (SELECT DISTINCT feature, v FROM q WHERE k IN (SELECT floor(j * n / 32) FROM range(1, 32) z(j))),
le AS (SELECT feature, list(v) AS edges FROM ed GROUP BY feature)"""


@query("bins", "SELECT t, sym_ix, feature, CAST(len(list_filter(edges, lambda e: e < v)) AS INTEGER) AS bin FROM lx JOIN le USING (feature)", IND + FEATS + BINS_SQL)
def bins(spark, d):
    """Bin of every ranked feature: how many of its at most 31 edges lie strictly below."""
    rows = _features(spark, d)
    edges = L.bin_edges(rows.select(F.array(*[F.col(k).cast("double") for k in L.STOCK]).alias("x")), names=L.STOCK)
    below = lambda c, e: F.size(F.filter(F.array(*[F.lit(float(v)) for v in e]), lambda v: v < c)).cast("int")
    each = F.array(*[F.struct(F.lit(k).alias("feature"), below(F.col(k).cast("double"), edges[n]).alias("bin")) for n, k in enumerate(L.STOCK)])
    return rows.select("t", "sym_ix", F.explode(each).alias("b")).select("t", "sym_ix", "b.*")


def _training(spark: SparkSession, d: str) -> DataFrame:
    """Samples with features and roles, written once."""

    def make() -> DataFrame:
        rows = _samples(spark, d).join(_features(spark, d).select("t", "sym_ix", L.vector()), ["t", "sym_ix"])
        # A fit runs many jobs over these rows: partitions of about 50,000.
        out = L.purged(rows, PRESETS["pullback"]["eval"]["horizon"]).select("t", "sym_ix", "symbol", "decision", "score", "fwd", "label", "x", "role")
        return out.repartition(max(1, _samples(spark, d).count() // 50_000))

    return P.kept(spark, d, "training", make)


@query("purged_split", """SELECT t, sym_ix, CASE WHEN t >= split THEN 'test' WHEN t < split - 21 AND t >= vs THEN 'val' WHEN t < split - 21 AND t < vs - 21 THEN 'fit' WHEN t < split - 21 THEN 'gap' END AS role FROM (
  SELECT *, (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT t FROM sq WHERE t < split - 21)) WHERE k = floor(n * 0.8::DOUBLE)) AS vs FROM sq)""", IND + SAMPLES + ", sq AS (SELECT *, floor(252 + ((SELECT max(t) FROM ix) - 21 - 252) * 0.7::DOUBLE + 0.5::DOUBLE) AS split FROM sm)")
def purged_split(spark, d):
    return _training(spark, d).select("t", "sym_ix", "role")


# --- models ---
_fits: dict[tuple, dict] = {}


def trained(spark: SparkSession, d: str) -> dict:
    """Both models, their validation AUCs and which is better (ties: the logistic), fitted once per application and input."""
    key = (spark.sparkContext.applicationId, d, P.stamp(spark, d))
    if key not in _fits:
        rows = _training(spark, d)
        counts = {r["role"]: r["count"] for r in rows.groupBy("role").count().collect()}
        if counts.get("fit", 0) < 2000 or counts.get("val", 0) < 500 or counts.get("test", 0) < 500:
            raise ValueError("not enough samples: take a longer period or sample more often")
        logistic, val_logistic = L.choose_penalty(rows)
        trees = L.fit_trees(rows, "role = 'fit'", "role = 'val'", L.bin_edges(rows.where("role in ('fit', 'gap', 'val')")))
        val_trees = L.auc_of(L.scored_by_trees(rows.where("role = 'val'"), trees), F.col("z"))
        _fits[key] = {"logistic": logistic, "trees": trees, "val": (val_logistic, val_trees), "best": "logistic" if val_logistic >= val_trees else "trees"}
    return _fits[key]


@query("logit_model")
def logit_model(spark, d):
    m = trained(spark, d)["logistic"]
    total = abs(m.w[1:]).sum() or 1.0
    rows = [(k, float(m.mean[i]), float(m.sd[i]), float(m.w[i + 1]), float(abs(m.w[i + 1]) / total)) for i, k in enumerate(L.FEATURES)]
    return spark.createDataFrame([("intercept", None, None, float(m.w[0]), None), *rows], "feature string, mean double, sd double, weight double, importance double")


@query("gbm_model")
def gbm_model(spark, d):
    m = trained(spark, d)["trees"]
    rows = [(k, n, *((x[0], x[1], x[2], x[3], None) if len(x) == 4 else (None, None, None, None, float(x[0])))) for k, tree in enumerate(m.trees) for n, x in enumerate(tree)]
    return spark.createDataFrame(rows, "tree int, node int, feature int, bin int, left int, right int, value double")


@query("feature_importance")
def feature_importance(spark, d):
    fit = trained(spark, d)
    w = abs(fit["logistic"].w[1:])
    g = fit["trees"].gains
    return spark.createDataFrame([(k, float(w[i] / (w.sum() or 1)), float(g[i] / (g.sum() or 1))) for i, k in enumerate(L.FEATURES)], "feature string, logistic double, trees double").orderBy(F.desc("logistic")).limit(10)


def _scored(spark: SparkSession, d: str, where: str = "role = 'test'") -> DataFrame:
    fit = trained(spark, d)
    rows = L.scored_by_trees(_training(spark, d).where(where), fit["trees"])
    return rows.withColumnRenamed("z", "trees").withColumn("logistic", fit["logistic"].column())


def _by_model(rows: DataFrame) -> DataFrame:
    """A row for each model: its score beside the row's outcome."""
    return rows.select("t", "sym_ix", "fwd", "label", F.explode(F.map_from_arrays(F.array(F.lit("rules"), F.lit("logistic"), F.lit("trees")), F.array("score", "logistic", "trees"))).alias("model", "score"))


@query("ml_report")
def ml_report(spark, d):
    """Test AUC, interval, rank correlation and top-share confusion of the rules' score and of both models."""
    rows = _scored(spark, d)
    long = _by_model(rows)
    w = W.partitionBy("model", "t")
    top = F.row_number().over(w.orderBy(F.desc("score"), "sym_ix")) <= X.take(F.count("*").over(w), 20.0)
    long = long.withColumn("decision", top)
    out = stats.auc(long, ["model"]).join(stats.spearman(long, ["model"]), "model").join(stats.confusion(long, ["model"]), "model")
    val = trained(spark, d)["val"]
    pool = _by_model(_scored(spark, d, "role in ('fit', 'gap', 'val')"))
    train = stats.auc(pool, ["model"]).select("model", F.col("auc").alias("train_auc"))
    known = spark.createDataFrame([("logistic", float(val[0])), ("trees", float(val[1]))], "model string, val_auc double")
    return out.join(F.broadcast(known), "model", "left").join(train, "model", "left")


@query("ml_roc")
def ml_roc(spark, d):
    """ROC points of the rules' score and of both models on the test rows."""
    return stats.roc_points(_by_model(_scored(spark, d)), ["model"])


@query("ml_deciles")
def ml_deciles(spark, d):
    return stats.deciles(_by_model(_scored(spark, d)), ["model"], ["t", "sym_ix"])


@query("auc_bootstrap")
def auc_bootstrap(spark, d):
    return L.bootstrap_summary(L.bootstrap(_scored(spark, d), trained(spark, d)["best"], "score"))


@query("ml_verdict")
def ml_verdict(spark, d):
    best = trained(spark, d)["best"]
    report = ml_report(spark, d).where(F.col("model") == best).select("model", "auc", "val_auc")
    return report.crossJoin(auc_bootstrap(spark, d)).select("model", S.model_verdict(F.col("auc"), F.col("val_auc"), F.col("lo")).alias("verdict"))


@query("ml_backtest")
def ml_backtest(spark, d):
    """The test period bought by the better model's top share, by that share where the rules hold too ('filter'), and by the
    same algorithm's rules."""
    algo = PRESETS["pullback"]
    index = P.index_bars(spark, d)
    split = _training(spark, d).where("role = 'test'").agg(F.min("t")).first()[0]
    fit = trained(spark, d)
    rows = L.features(G.prepared(spark, d), index, market_features(index), algo, F.col("t") >= split).select("t", "sym_ix", L.vector())
    scored = L.scored_by_trees(rows, fit["trees"]) if fit["best"] == "trees" else rows.withColumn("z", fit["logistic"].column())
    scored = scored.withColumn("chosen", X.at_threshold(F.col("z"), 20.0).cast("int")).select("t", "sym_ix", "z", "chosen")
    base = R.with_operands(G.prepared(spark, d), index, algo)
    exits = {f"exit{k}": R.holds(r).cast("int") for k, r in enumerate(algo["exit"]["rules"])}
    base = base.withColumns({"_met": R.met(algo["entry"]["rules"]), **exits})
    base = base.withColumn("held", R.enters(algo, F.col("_met")).cast("int")).join(scored, ["t", "sym_ix"], "left").withColumn("rank", F.col("z"))
    learned = None
    for source, entry in (("model", F.col("chosen")), ("filter", F.col("chosen") * F.col("held"))):
        m = B.ruled(base.withColumn("entry", F.coalesce(entry, F.lit(0))), index, algo)
        one = B.equity_curves(m, [LARGE], first=split).withColumn("source", F.lit(source))
        learned = one if learned is None else learned.union(one)
    rules = B.equity_curves(B.algo_market(spark, d, algo), [LARGE], first=split).withColumn("source", F.lit("rules"))
    return learned.union(rules)


@query("today_picks")
def today_picks(spark, d):
    """The newest day ranked by the better model refitted on all labelled rows; reasons by the logistic model."""
    fit, rows = trained(spark, d), _training(spark, d)
    logistic = L.fit_logistic(rows, fit["logistic"].penalty)[0]
    index = P.index_bars(spark, d)
    newest = index.agg(F.max("t")).first()[0]
    day = L.features(G.prepared(spark, d), index, market_features(index), PRESETS["pullback"], F.col("t") == newest).select("sym_ix", "symbol", "sector", L.vector())
    if fit["best"] == "trees":
        refit = L.fit_trees(rows, "true", None, L.bin_edges(rows), rounds=len(fit["trees"].trees))
        day, z = L.scored_by_trees(day, refit).withColumnRenamed("z", "tz"), F.col("tz")
    else:
        z = logistic.column()
    return L.picks(day, z, logistic, off=L.MARKET)


@query("top_reasons")
def top_reasons(spark, d):
    return today_picks(spark, d).select("symbol", F.posexplode("reasons").alias("k", "r")).select("symbol", "k", "r.*")


@query("today_rank")
def today_rank(spark, d):
    return today_picks(spark, d).select("symbol", "place", "pctl")


def _ranking(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        index = P.index_bars(spark, d)
        none = {"entry": {"join": "all", "rules": []}, "exit": {}, "eval": {"label": "beat"}}
        return L.features(G.prepared(spark, d), index, market_features(index), none, F.col("t") >= 252)

    return P.kept(spark, d, "ranking", make)


def walk_forward_models(spark: SparkSession, d: str) -> DataFrame:
    def make() -> DataFrame:
        index = P.index_bars(spark, d)
        ahead = index.select("t", (F.lead("idx", L.HORIZON).over(W.orderBy("t")) / F.col("idx") - 1).alias("ifwd"))
        fwd = P.bars(spark, d).select("t", "sym_ix", I.forward_change(F.col("close"), L.HORIZON).alias("fwd")).where("fwd is not null").join(F.broadcast(ahead), "t")
        fwd = fwd.select("t", "sym_ix", (F.col("fwd") > F.col("ifwd")).cast("int").alias("label"))
        return L.walk_forward(_ranking(spark, d), fwd, retrain_days(index))

    return P.kept(spark, d, "wf_models", make)


def restored(stored: DataFrame, days: list[int], version: int) -> DataFrame | None:
    """Stored models if their version and retrain days are those wanted, else null: they are then fitted anew."""
    found = stored.agg(F.min("version"), F.max("version"), F.sort_array(F.collect_list("retrain_t"))).first()
    return stored.drop("version") if (found[0], found[1], found[2]) == (version, version, sorted(days)) else None


@query("wf_restored")
def wf_restored(spark, d):
    """Scores by models that were stored as files and read again."""
    models = walk_forward_models(spark, d)
    path = f"{P.own_folder(spark)}/models-{uuid.uuid4().hex}"
    models.withColumn("version", F.lit(L.VERSION)).write.parquet(path)
    days = [r[0] for r in models.select("retrain_t").collect()]
    found = restored(spark.read.parquet(path), days, L.VERSION)
    return L.walk_forward_scores(_ranking(spark, d), models if found is None else found).select("t", "symbol", "retrain_t", "score")


@query("wf_models")
def wf_models(spark, d):
    """The models table, keyed by retrain day, from which stored models are taken again."""
    return walk_forward_models(spark, d)


@query("wf_scores")
def wf_scores(spark, d):
    return L.walk_forward_scores(_ranking(spark, d), walk_forward_models(spark, d)).select("t", "symbol", "retrain_t", "score")


@query("ranking_comparison")
def ranking_comparison(spark, d):
    """The same plan ranked by momentum and by the walk-forward model."""
    scores = L.walk_forward_scores(_ranking(spark, d), walk_forward_models(spark, d)).select("t", "sym_ix", F.col("score").alias("ml_rank"))
    rows = G.prepared(spark, d).join(scores, ["t", "sym_ix"], "left")
    m = B.built_in(rows, P.index_bars(spark, d))
    curves = B.equity_curves(m, [LARGE, LARGE.with_(rank_by="ml")])
    return stats.curve_metrics(curves, ["combo"]).withColumn("ranked_by", F.when(F.col("combo") == 0, "momentum").otherwise("ml"))
