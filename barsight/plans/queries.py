"""Registered queries of the market-signal part: name -> (Spark query, SQL or None)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import random32
from ..functions import scalars as S
from ..operators import cross_section as X
from ..operators import indicators as I
from ..operators import ordered, stats
from ..sources import frames as FR
from ..sources import panel as P
from ..sources import publish as PB
from . import rules as R
from . import signals as G
from .params import PRESETS, Params

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# --- SQL blocks behind the panel prefix ---
REC = """,
v AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k FROM b WHERE close IS NOT NULL),
rc(symbol, k, t, c, e12, e26, s9, g, l, g5, l5) AS (
  SELECT symbol, k, t, CAST(close AS DOUBLE), CAST(close AS DOUBLE), CAST(close AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE) FROM v WHERE k = 1
  UNION ALL
  SELECT symbol, k, t, c, e12, e26, CASE WHEN k < 26 THEN NULL WHEN k = 26 THEN e12 - e26 ELSE s9 + (2.0::DOUBLE / 10) * ((e12 - e26) - s9) END, CASE WHEN k = 2 THEN up ELSE g + (up - g) / 14 END, CASE WHEN k = 2 THEN dn ELSE l + (dn - l) / 14 END, CASE WHEN k = 2 THEN up ELSE g5 + (up - g5) / 5 END, CASE WHEN k = 2 THEN dn ELSE l5 + (dn - l5) / 5 END
  FROM (SELECT v.symbol, v.k, v.t, CAST(v.close AS DOUBLE) AS c, e12 + (2.0::DOUBLE / 13) * (v.close - e12) AS e12, e26 + (2.0::DOUBLE / 27) * (v.close - e26) AS e26, s9, g, l, g5, l5, greatest(v.close - c, 0.0::DOUBLE) AS up, greatest(c - v.close, 0.0::DOUBLE) AS dn
        FROM rc JOIN v ON v.symbol = rc.symbol AND v.k = rc.k + 1)),
re AS MATERIALIZED (SELECT symbol, t, CASE WHEN k >= 12 THEN e12 END AS ema12, CASE WHEN k >= 26 THEN e26 END AS ema26, CASE WHEN k >= 15 THEN CASE WHEN l = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + g / l) END END AS rsi14, CASE WHEN k >= 6 THEN CASE WHEN l5 = 0 THEN 100.0::DOUBLE ELSE 100 - 100 / (1 + g5 / l5) END END AS rsi5, CASE WHEN k >= 34 THEN (e12 - e26 - s9) / c * 100 END AS macd FROM rc)"""


def _sma(n: int, x: str = "close", by: str = "PARTITION BY symbol ") -> str:
    w = f"OVER ({by}ORDER BY t ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {w} = {n} THEN CAST(sum({x}) {w} AS DOUBLE) / {n} END"


def _lag(n: int, x: str = "close") -> str:
    return f"CAST({x} AS DOUBLE) / nullif(lag({x}, {n}) OVER (PARTITION BY symbol ORDER BY t), 0) - 1"


def _high(n: int) -> str:
    return f"CASE WHEN close IS NOT NULL THEN CAST(max(close) OVER (PARTITION BY symbol ORDER BY t ROWS {n - 1} PRECEDING) AS DOUBLE) END"


def _low(n: int) -> str:
    return _high(n).replace("max(", "min(")


def _vol(n: int, r: str = "r", by: str = "PARTITION BY symbol ") -> str:
    w = f"OVER ({by}ORDER BY t ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN t >= {n} AND count({r}) {w} >= {n - 2} THEN stddev_samp({r}) {w} END"


IND = f"""{REC},
i1 AS (SELECT b.*, ema12, ema26, rsi14, rsi5, macd, {_lag(1)} AS r, {_sma(20)} AS sma20, {_sma(50)} AS sma50, {_sma(200)} AS sma200, {_high(20)} AS hi20, {_high(55)} AS hi55, {_high(252)} AS hi252, {_low(252)} AS lo252, {_lag(126)} AS mom126 FROM b LEFT JOIN re USING (symbol, t)),
i AS MATERIALIZED (SELECT *, {_vol(20)} AS vol20, {_vol(63)} AS vol63 FROM i1),
ixf AS MATERIALIZED (SELECT *, {_sma(50, 'idx', '')} AS idx_sma50, {_sma(200, 'idx', '')} AS idx_sma200 FROM ix)"""
CHECK = """,
ck AS MATERIALIZED (SELECT *, CAST(above_smas AS INTEGER) + CAST(sma50_over_sma200 AS INTEGER) + CAST(ema12_over_ema26 AS INTEGER) + CAST(rsi_in_band AS INTEGER) + CAST(near_high AS INTEGER) AS passes FROM (
  SELECT *, coalesce(sma200 IS NOT NULL AND close > sma200 AND close > sma50, false) AS above_smas, coalesce(close IS NOT NULL AND sma50 > sma200, false) AS sma50_over_sma200, coalesce(sma200 IS NOT NULL AND close IS NOT NULL AND ema12 > ema26, false) AS ema12_over_ema26,
    coalesce(sma200 IS NOT NULL AND close IS NOT NULL AND rsi14 BETWEEN 50 AND 80, false) AS rsi_in_band, coalesce(sma200 IS NOT NULL AND close >= hi252 * (1 - 15::DOUBLE / 100), false) AS near_high FROM i))"""


def query(name: str, sql: str | None = None, blocks: str = ""):
    """Registers a query; sql is what follows the panel prefix and the blocks, or the whole text if it starts with WITH or SELECT
    of a driver table."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql if blocks is None else P.SQL + blocks + " " + sql
        return f

    return add


# --- 2.1 sources and sinks ---


@query("src_stocks", "SELECT * FROM stk")
def src_stocks(spark, d):
    return P.stocks(spark, d)


@query("src_prices", "SELECT symbol, date, price, volume FROM pr")
def src_prices(spark, d):
    return P.prices(spark, d)


@query("src_frames", "SELECT symbol, date, price / 10000.0::DOUBLE AS open, price / 10000.0::DOUBLE AS high, price / 10000.0::DOUBLE AS low, price / 10000.0::DOUBLE AS close, CAST(volume AS BIGINT) AS volume FROM pr WHERE date >= DATE '1994-01-01'")
def src_frames(spark, d):
    """Bars from downloaded frames of ten tickers each, from 1994 on; the date's bound is pushed into the read."""

    def make() -> DataFrame:
        rows, path = _plain_bars(spark, d), f"{P.own_folder(spark)}/frames-{uuid.uuid4().hex}"
        FR.write_frames(rows, path, [r[0] for r in P.stocks(spark, d).select("symbol").orderBy("symbol").collect()])
        return spark.createDataFrame([(path,)], "path string")

    path = P.kept(spark, d, "frames", make).first()[0]
    return FR.read_frames(spark, path).where("date >= date'1994-01-01'")


def _plain_bars(spark: SparkSession, d: str) -> DataFrame:
    """Prices as bars that open, peak, bottom and close alike."""
    return P.prices(spark, d).select("symbol", "date", *[(F.col("price") / 10000).alias(x) for x in ("open", "high", "low", "close")], F.col("volume").cast("bigint").alias("volume"))


def _encoded_ohlc(spark: SparkSession, d: str) -> DataFrame:
    return P.encode_ohlc(_plain_bars(spark, d))


TAIL = "tl AS (SELECT symbol, date, price / 10000.0::DOUBLE AS close, CAST(volume AS BIGINT) AS volume, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM pr)"


@query("decode_ohlc", "SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS t, date, close AS open, close AS high, close AS low, close, volume FROM tl WHERE rn <= 400", "," + TAIL)
def decode_ohlc(spark, d):
    """Round trip: the last 400 bars of a symbol to the published layout and back."""
    return P.decode_ohlc(_encoded_ohlc(spark, d), "symbol")


@query("ohlc_tail", "SELECT symbol, min(date) AS d0, count(*) AS bars, max(volume) AS most FROM tl WHERE rn <= 400 GROUP BY symbol", "," + TAIL)
def ohlc_tail(spark, d):
    return _encoded_ohlc(spark, d).select("symbol", "d0", F.size("c").cast("bigint").alias("bars"), F.array_max("v").alias("most"))


@query("decode_panel", "SELECT symbol, sym_ix, t, date, CAST(close AS DOUBLE) AS close, CASE WHEN sym_ix % 2 = 0 THEN name ELSE symbol END AS name, CASE WHEN sym_ix % 2 = 0 THEN sector ELSE 'Other' END AS sector FROM b")
def decode_panel(spark, d):
    """Round trip through the published layout; every other symbol has no dim row."""
    encoded = P.encode_panel(P.bars(spark, d), P.index_bars(spark, d), "equal weight")
    dims = P.stocks(spark, d).where("sym_ix % 2 = 0").select(F.col("symbol").alias("s"), F.col("name").alias("n"), F.col("sector").alias("sec"))
    long, _ = P.decode_panel(encoded, dims)
    return long


@query("panel_writer")
def panel_writer(spark, d):
    """The panel files, one JSON text per market, as written and read again."""
    out = None
    for m in ("A", "B"):
        one = P.encode_panel(P.bars(spark, d).where(F.col("market") == m), P.index_bars(spark, d), f"market {m}")
        one = one.select(F.lit(m).alias("market"), F.to_json(F.struct("*")).alias("json"))
        out = one if out is None else out.union(one)
    return P.filed(out, "market", "json")


@query("stale_outputs", "SELECT replace(replace(symbol, '.', '_'), '^', '') || '.json' AS file FROM (SELECT symbol, count(*) AS n FROM pr GROUP BY symbol) WHERE n < (SELECT count(*) / count(DISTINCT symbol) FROM pr)")
def stale_outputs(spark, d):
    """Files of all symbols but those with as many bars as the mean or more."""
    counts = P.prices(spark, d).groupBy("symbol").count()
    counts = counts.join(F.broadcast(counts.agg(F.avg("count").alias("mean"))))
    files = counts.select(S.file_name(F.col("symbol")).alias("file"))
    current = counts.where("count >= mean").select(S.file_name(F.col("symbol")).alias("file"))
    return files.join(current, "file", "left_anti")


@query("published_files", "SELECT replace(replace(symbol, '.', '_'), '^', '') || '.json' AS file, CAST(least(count(*), 400) AS BIGINT) AS bars, max(date) AS newest FROM pr GROUP BY symbol HAVING count(*) >= (SELECT count(*) / count(DISTINCT symbol) FROM pr)")
def published_files(spark, d):
    """A file per symbol is published, then those of symbols with as many bars as the mean or more; what readers find after that."""

    def make() -> DataFrame:
        folder = f"{P.own_folder(spark)}/site-{uuid.uuid4().hex}"
        ohlc = P.cut(_encoded_ohlc(spark, d))
        counts = P.prices(spark, d).groupBy("symbol").count()
        for bound in ("true", "count >= mean"):
            some = counts.join(F.broadcast(counts.agg(F.avg("count").alias("mean")))).where(bound)
            files = ohlc.join(some.select("symbol"), "symbol", "left_semi").select(S.file_name(F.col("symbol")).alias("file"), F.to_json(F.struct(*[c for c in ohlc.columns if c != "symbol"])).alias("text"))
            PB.publish(files, folder)
        return PB.published(spark, folder)

    rows = P.kept(spark, d, "published", make).select("file", F.from_json("text", P.OHLC_SCHEMA).alias("x")).select("file", "x.*")
    return P.decode_ohlc(rows, "file").groupBy("file").agg(F.count("*").alias("bars"), F.max("date").alias("newest"))


@query("meta_file", """SELECT m.market, 'Market ' || m.market AS name, CASE WHEN m.market = 'A' THEN 1 ELSE 100 END AS lot, n AS stocks, coalesce(missing, 0) AS missing, true AS built_now FROM (SELECT market, count(*) AS n FROM stk JOIN (SELECT symbol FROM pr GROUP BY symbol HAVING count(*) >= 60) USING (symbol) GROUP BY market) m
  LEFT JOIN (SELECT market, count(*) AS missing FROM stk WHERE symbol NOT IN (SELECT symbol FROM pr GROUP BY symbol HAVING count(*) >= 60) GROUP BY market) x ON x.market = m.market""")
def meta_file(spark, d):
    """The meta record as published and read again, with its build time."""

    def make() -> DataFrame:
        folder = f"{P.own_folder(spark)}/meta-{uuid.uuid4().hex}"
        have = P.prices(spark, d).groupBy("symbol").count().where("count >= 60")
        PB.publish(P.meta_record(P.stocks(spark, d), have, {"A": ("Market A", "USD", 1, "equal weight"), "B": ("Market B", "THB", 100, "equal weight")}).select(F.lit("meta.json").alias("file"), F.to_json(F.struct("*")).alias("text")), folder)
        return PB.published(spark, folder)

    meta = P.kept(spark, d, "meta", make).select(F.from_json("text", P.META_SCHEMA).alias("m")).select("m.*")
    rows = meta.select("generated", "stocks", "missing", F.explode("markets").alias("market", "about"))
    of = lambda c: F.size(F.filter(c, lambda x: x["m"] == F.col("market"))).cast("bigint")
    return rows.select("market", "about.name", "about.lot", of("stocks").alias("stocks"), of("missing").alias("missing"), F.col("generated").between(F.current_timestamp() - F.expr("interval 1 day"), F.current_timestamp()).alias("built_now"))


@query("meta_summary", "SELECT stk.market, count(DISTINCT stk.symbol) AS stocks, string_agg(DISTINCT stk.sector, ',' ORDER BY stk.sector) AS sectors, max(date) AS newest FROM stk JOIN pr USING (symbol) GROUP BY stk.market")
def meta_summary(spark, d):
    joined = P.prices(spark, d).join(P.stocks(spark, d), "symbol")
    return joined.groupBy("market").agg(F.countDistinct("symbol").alias("stocks"), F.array_join(F.array_sort(F.collect_set("sector")), ",").alias("sectors"), F.max("date").alias("newest"))


@query("meta_missing", "SELECT market, string_agg(symbol, ',' ORDER BY symbol) AS missing FROM stk WHERE symbol NOT IN (SELECT symbol FROM pr GROUP BY symbol HAVING count(*) >= (SELECT count(*) / count(DISTINCT symbol) FROM pr)) GROUP BY market")
def meta_missing(spark, d):
    """The missing list of each market's meta record."""
    found = missing_symbols(spark, d).join(P.stocks(spark, d), "symbol")
    return found.groupBy("market").agg(F.array_join(F.array_sort(F.collect_list("symbol")), ",").alias("missing"))


@query("fn_filename", "SELECT c_name, replace(replace('^' || c_name || '.BK', '.', '_'), '^', '') || '.json' AS file FROM customer", None)
def fn_filename(spark, d):
    return P.table(spark, d, "customer").select("c_name", S.file_name(F.concat(F.lit("^"), "c_name", F.lit(".BK"))).alias("file"))


@query("stored_settings", "SELECT symbol, CASE WHEN sym_ix % 5 = 0 THEN 60 ELSE n END AS bars, CASE WHEN sym_ix % 5 = 0 THEN 'none' ELSE sector END AS sector FROM stk JOIN (SELECT symbol, count(*) AS n FROM pr GROUP BY symbol) USING (symbol)")
def stored_settings(spark, d):
    """Each symbol's settings stored as JSON files by key and read again; every fifth text is broken and takes the defaults."""
    have = P.prices(spark, d).groupBy("symbol").agg(F.count("*").alias("bars")).join(P.stocks(spark, d), "symbol")
    text = F.when(F.col("sym_ix") % 5 == 0, "{").otherwise(F.to_json(F.struct("bars", "sector")))
    stored = P.filed(have.select("symbol", text.alias("json")), "symbol", "json")
    read = stored.select("symbol", F.from_json("json", "bars bigint, sector string").alias("s"))
    return read.select("symbol", F.coalesce("s.bars", F.lit(60).cast("bigint")).alias("bars"), F.coalesce("s.sector", F.lit("none")).alias("sector"))


# --- 2.2 projections, filters, predicates ---


@query("guard", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0 THEN l_tax / l_discount END AS x FROM lineitem", None)
def guard(spark, d):
    t = P.table(spark, d, "lineitem")
    ratio = F.when(F.col("l_discount") > 0, F.col("l_tax") / F.col("l_discount")).otherwise(F.lit(float("nan")))
    return t.select("l_orderkey", "l_linenumber", S.guard(ratio).alias("x"))


@query("min_history", "SELECT symbol, count(*) AS bars FROM pr GROUP BY symbol HAVING count(*) >= 60")
def min_history(spark, d):
    return P.prices(spark, d).groupBy("symbol").agg(F.count("*").alias("bars")).where("bars >= 60")


@query("market_split", "SELECT symbol, t, close FROM b WHERE market = 'A'")
def market_split(spark, d):
    return P.bars(spark, d).where("market = 'A'").select("symbol", "t", "close")


@query("fn_sigdigits", "SELECT l_orderkey, l_linenumber, CAST(printf('%.5e', l_extendedprice / 7) AS DOUBLE) AS x FROM lineitem", None)
def fn_sigdigits(spark, d):
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.significant(F.col("l_extendedprice") / 7).alias("x"))


@query("macro_gate", "SELECT t, coalesce(idx > idx_sma200, false) AS sma200, coalesce(idx > idx_sma200 AND idx_sma50 > idx_sma200, false) AS sma50_200, true AS \"off\" FROM ixf", IND)
def macro_gate(spark, d):
    return G.index_features(P.index_bars(spark, d)).select("t", *[G.gate(Params(gate=k)).alias(k) for k in ("sma200", "sma50_200", "off")])


@query("bull_checks", "SELECT symbol, t, above_smas, sma50_over_sma200, ema12_over_ema26, rsi_in_band, near_high, passes FROM ck", IND + CHECK.replace("coalesce(close IS NOT NULL AND sma50", "coalesce(sma200 IS NOT NULL AND close IS NOT NULL AND sma50"))
def bull_checks(spark, d):
    return G.with_checks(G.prepared(spark, d), Params()).select("symbol", "t", *G.CHECKS, "passes")


def _algo_rows(spark: SparkSession, d: str, name: str) -> DataFrame:
    return R.with_operands(G.prepared(spark, d), P.index_bars(spark, d), PRESETS[name])


@query("rule_filter", "SELECT symbol, t FROM i JOIN ixf USING (t) WHERE close > sma200 AND rsi14 < 40 AND idx > idx_sma200", IND)
def rule_filter(spark, d):
    rows = _algo_rows(spark, d, "pullback")
    for r in PRESETS["pullback"]["entry"]["rules"]:
        rows = rows.withColumn("_h", R.holds(r)).where("_h").drop("_h")
    return rows.select("symbol", "t")


CROSS = """,
cr AS (SELECT *, coalesce(lag(ema12) OVER w <= lag(ema26) OVER w AND ema12 > ema26, false) AS up, coalesce(lag(ema12) OVER w >= lag(ema26) OVER w AND ema12 < ema26, false) AS down FROM i WINDOW w AS (PARTITION BY symbol ORDER BY t))"""


@query("rule_cross", "SELECT symbol, t, up, down FROM cr WHERE up OR down", IND + CROSS)
def rule_cross(spark, d):
    algo = PRESETS["golden_cross"]
    rows = _algo_rows(spark, d, "golden_cross")
    rows = rows.select("symbol", "t", R.holds(algo["entry"]["rules"][0]).alias("up"), R.holds(algo["exit"]["rules"][0]).alias("down"))
    return rows.where("up or down")


@query("rule_join", "SELECT symbol, t, up AND coalesce(sma50 > sma200, false) AS every, up OR coalesce(sma50 > sma200, false) AS some, false AS none FROM cr", IND + CROSS)
def rule_join(spark, d):
    algo = PRESETS["golden_cross"]
    rows = _algo_rows(spark, d, "golden_cross").withColumn("_met", R.met(algo["entry"]["rules"]))
    n = F.col("_met")
    some = {"entry": {**algo["entry"], "join": "any"}}
    return rows.select("symbol", "t", R.enters(algo, n).alias("every"), R.enters(some, n).alias("some"), R.enters({"entry": {"join": "all", "rules": []}}, n).alias("none"))


@query("rules_met", "SELECT symbol, t, CAST(up AS INTEGER) + CAST(coalesce(sma50 > sma200, false) AS INTEGER) AS met FROM cr", IND + CROSS)
def rules_met(spark, d):
    rows = _algo_rows(spark, d, "golden_cross").withColumn("met", R.met(PRESETS["golden_cross"]["entry"]["rules"]))
    return rows.select("symbol", "t", "met")


CHECK_ALL = CHECK.replace("coalesce(close IS NOT NULL AND sma50", "coalesce(sma200 IS NOT NULL AND close IS NOT NULL AND sma50")
STATUS = """,
st AS (SELECT *, CASE WHEN sym_ix % 7 = 0 AND coalesce(close < sma50, false) THEN 'EXIT' WHEN sym_ix % 7 = 0 THEN 'HOLD' WHEN passes = 5 AND sym_ix % 2 = 0 THEN 'BUY' WHEN passes = 5 THEN 'WAIT' WHEN passes >= 3 THEN 'WATCH' ELSE 'AVOID' END AS status FROM ck)"""


def _status_rows(spark: SparkSession, d: str) -> DataFrame:
    """Status if every seventh symbol were held, sold below SMA50, and symbols of even number bought."""
    rows = G.with_checks(G.prepared(spark, d), Params())
    held, buying = F.col("sym_ix") % 7 == 0, (F.col("passes") == 5) & (F.col("sym_ix") % 2 == 0)
    return rows.withColumn("status", G.status(held, F.coalesce(F.col("close") < F.col("sma50"), F.lit(False)), buying, F.col("passes")))


@query("status_class", "SELECT symbol, t, status FROM st", IND + CHECK_ALL + STATUS)
def status_class(spark, d):
    return _status_rows(spark, d).select("symbol", "t", "status")


@query("status_counts", "SELECT t, status, count(*) AS n FROM st GROUP BY t, status", IND + CHECK_ALL + STATUS)
def status_counts(spark, d):
    return _status_rows(spark, d).groupBy("t", "status").agg(F.count("*").alias("n"))


@query("list_filter", "SELECT symbol, name, sector, status FROM st WHERE t = (SELECT max(t) FROM st) AND contains(lower(symbol || ' ' || name || ' ' || sector), 'asia')", IND + CHECK_ALL + STATUS)
def list_filter(spark, d):
    return G.last_day(_status_rows(spark, d)).where(S.contains_folded("Asia", "symbol", "name", "sector")).select("symbol", "name", "sector", "status")


@query("list_sort", "SELECT symbol, t, mom126, row_number() OVER (PARTITION BY t ORDER BY mom126 DESC NULLS LAST, sym_ix) AS place FROM st", IND + CHECK_ALL + STATUS)
def list_sort(spark, d):
    """Every day's list, missing values last."""
    order = W.partitionBy("t").orderBy(F.col("mom126").desc_nulls_last(), "sym_ix")
    return _status_rows(spark, d).select("symbol", "t", "mom126", F.row_number().over(order).cast("bigint").alias("place"))


@query("reason_text", "SELECT symbol, t, CASE WHEN p >= 0.67 THEN 'high' WHEN p <= 0.33 THEN 'low' ELSE 'middle' END AS words FROM (SELECT symbol, t, (rank() OVER (PARTITION BY t ORDER BY close) - 1)::DOUBLE / count(*) OVER (PARTITION BY t) AS p FROM b WHERE close IS NOT NULL)")
def reason_text(spark, d):
    rows = P.bars(spark, d).where("close is not null")
    return rows.select("symbol", "t", S.rank_words(X.share_below(F.col("close"))).alias("words"))


@query("rule_descriptions")
def rule_descriptions(spark, d):
    """Every rule in words, and on how many bars it holds."""
    out = None
    for name, algo in PRESETS.items():
        rules = [(part, n, r) for part in ("entry", "exit") for n, r in enumerate(algo[part]["rules"])]
        said = F.array(*[F.struct(F.lit(name).alias("algorithm"), F.lit(part).alias("part"), F.lit(n).alias("n"), F.lit(R.describe(r)).alias("text"), R.holds(r).cast("bigint").alias("held")) for part, n, r in rules])
        rows = _algo_rows(spark, d, name).select(said.alias("said")).select(F.explode("said").alias("x")).select("x.*")
        one = rows.groupBy("algorithm", "part", "n", "text").agg(F.sum("held").alias("held"))
        out = one if out is None else out.union(one)
    return out


# --- 2.3 joins and alignment ---


@query("align_grid", "SELECT symbol, t, date, price FROM b")
def align_grid(spark, d):
    return P.bars(spark, d).select("symbol", "t", "date", "price")


ODD = "odd AS (SELECT date, idx AS v FROM ix WHERE t % 3 <> 0 AND t > 40), cu AS (SELECT DISTINCT symbol, date FROM (SELECT symbol, date FROM b WHERE price IS NOT NULL UNION ALL SELECT symbol, odd.date FROM odd, stk))"


def _odd(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """An index known on some days only, and for each symbol the union of those days with its own."""
    odd = P.index_bars(spark, d).where("t % 3 <> 0 and t > 40").select("date", F.col("idx").alias("v"))
    days = P.densify(odd, P.stocks(spark, d).select("symbol"), odd.select("date", F.lit(0).alias("t")), ["date"]).select("symbol", "date")
    return odd, P.bars(spark, d).where("price is not null").select("symbol", "date").union(days).distinct()


@query("calendar_union", "SELECT symbol, date, v FROM cu LEFT JOIN odd USING (date)", "," + ODD)
def calendar_union(spark, d):
    odd, days = _odd(spark, d)
    return days.join(F.broadcast(odd), "date", "left").select("symbol", "date", "v")


@query("index_ffill", "SELECT symbol, date, v FROM (SELECT symbol, date, last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) AS v FROM cu LEFT JOIN odd USING (date)) WHERE v IS NOT NULL", "," + ODD)
def index_ffill(spark, d):
    filled = I.running(calendar_union(spark, d).withColumnRenamed("v", "known"), {"v": ("last", F.col("known"))}, ["symbol"], ["date"], F.floor(F.unix_date("date") / I.LENGTH))
    return filled.select("symbol", "date", "v").where("v is not null")


@query("dim_lookup", "SELECT b.symbol, t, coalesce(s.name, b.symbol) AS name, coalesce(s.sector, 'Other') AS sector FROM b LEFT JOIN (SELECT * FROM stk WHERE sym_ix % 3 = 0) s ON s.symbol = b.symbol")
def dim_lookup(spark, d):
    dims = P.stocks(spark, d).where("sym_ix % 3 = 0").select("symbol", "name", "sector")
    return P.with_dims(P.bars(spark, d).select("symbol", "t"), dims)


@query("asof_price", "SELECT symbol, t, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS known FROM b WHERE t >= 252")
def asof_price(spark, d):
    return I.with_last_known(P.bars(spark, d).where("t >= 252").select("symbol", "t", "price"), "price", "known").drop("price")


@query(
    "asof_sparse",
    """SELECT o_orderkey, k.symbol, k.date, price, volume FROM (SELECT o_orderkey, symbol, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey JOIN stk ON c_nationkey = sym_ix) k
  ASOF LEFT JOIN (SELECT symbol, date AS since, price, volume FROM pr) p ON p.symbol = k.symbol AND p.since <= k.date""",
)
def asof_sparse(spark, d):
    """Every order with its nation's latest price up to its day, on bars as they come, without a grid."""
    return _asof(spark, d, None)


@query(
    "asof_near",
    """SELECT o_orderkey, k.symbol, k.date, CASE WHEN k.date - since <= 1 THEN price END AS price, CASE WHEN k.date - since <= 1 THEN volume END AS volume FROM (SELECT o_orderkey, symbol, CAST(o_orderdate AS DATE) AS date FROM orders JOIN customer ON o_custkey = c_custkey JOIN stk ON c_nationkey = sym_ix) k
  ASOF LEFT JOIN (SELECT symbol, date AS since, price, volume FROM pr) p ON p.symbol = k.symbol AND p.since <= k.date""",
)
def asof_near(spark, d):
    """The same with prices of the day or the day before only."""
    return _asof(spark, d, 1)


def _asof(spark: SparkSession, d: str, tolerance: int | None) -> DataFrame:
    order, customer = P.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), P.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    asked = order.join(customer, order["o_custkey"] == customer["c_custkey"]).join(P.stocks(spark, d).select("symbol", "sym_ix"), F.col("c_nationkey") == F.col("sym_ix"))
    return I.asof_join(asked.select("o_orderkey", "symbol", F.to_date("o_orderdate").alias("date")), P.prices(spark, d), ["symbol"], "date", ["price", "volume"], tolerance=tolerance)


@query("forward_return", "SELECT symbol, t, CAST(lead(close, 21) OVER (PARTITION BY symbol ORDER BY t) AS DOUBLE) / close - 1 AS fwd FROM b")
def forward_return(spark, d):
    return P.bars(spark, d).select("symbol", "t", I.forward_change(F.col("close"), 21).alias("fwd"))


RETRAIN = "rt AS (SELECT unnest(range(525, (SELECT max(t) FROM b), 63)) AS r UNION ALL SELECT max(t) FROM b)"


def retrain_days(index: DataFrame, first: int = 525, every: int = 63) -> DataFrame:
    """(r): first, first + every, ... before the last day, and the last day."""
    last = index.agg(F.max("t").alias("last"))
    steps = F.when(F.col("last") > first, F.sequence(F.lit(first), F.col("last") - 1, F.lit(every))).otherwise(F.array().cast("array<int>"))
    return last.select(F.explode(F.concat(steps, F.array("last"))).alias("r"))


@query("retrain_days", "SELECT CAST(r AS INTEGER) AS r FROM rt", "," + RETRAIN)
def q_retrain_days(spark, d):
    return retrain_days(P.index_bars(spark, d))


@query("model_asof", "SELECT t, CAST((SELECT max(r) FROM rt WHERE r <= t) AS INTEGER) AS r FROM ix", "," + RETRAIN)
def model_asof(spark, d):
    """The latest retrain day up to each day: one ordered pass over days and retrain days together."""
    index = P.index_bars(spark, d)
    both = index.select("t", F.lit(None).cast("int").alias("r")).union(retrain_days(index).select(F.col("r").alias("t"), "r"))
    latest = F.max("r").over(W.orderBy("t").rangeBetween(W.unboundedPreceding, 0))
    return both.select("t", latest.alias("m"), "r").where("r is null").select("t", F.col("m").alias("r"))


@query("missing_symbols", "SELECT symbol FROM stk WHERE symbol NOT IN (SELECT symbol FROM pr GROUP BY symbol HAVING count(*) >= (SELECT count(*) / count(DISTINCT symbol) FROM pr))")
def missing_symbols(spark, d):
    counts = P.prices(spark, d).groupBy("symbol").count()
    kept = counts.join(F.broadcast(counts.agg(F.avg("count").alias("mean")))).where("count >= mean")
    return P.stocks(spark, d).select("symbol").join(kept, "symbol", "left_anti")


# --- 2.4 aggregations ---


@query("equal_weight_index", "SELECT t, date, idx FROM ix")
def equal_weight_index(spark, d):
    return P.index_bars(spark, d)


@query("breadth", "SELECT t, CAST(count(*) FILTER (WHERE close > sma200) AS DOUBLE) / greatest(count(*), 1) AS breadth FROM i WHERE close IS NOT NULL AND sma200 IS NOT NULL GROUP BY t", IND)
def breadth(spark, d):
    rows = G.prepared(spark, d).where("close is not null and sma200 is not null")
    return rows.groupBy("t").agg((F.sum((F.col("close") > F.col("sma200")).cast("int")) / F.count("*")).alias("breadth"))


@query("sector_counts", "SELECT t, sector, count(*) AS n FROM ck WHERE passes = 5 GROUP BY t, sector", IND + CHECK_ALL)
def sector_counts(spark, d):
    return G.with_checks(G.prepared(spark, d), Params()).where("passes = 5").groupBy("t", "sector").agg(F.count("*").alias("n"))


def _bench(spark: SparkSession, d: str) -> DataFrame:
    """The index scaled to an account from day 252, and every symbol's price as a curve of its own."""
    index = P.index_bars(spark, d).where("t >= 252").select(F.lit("index").alias("symbol"), "t", "date", F.col("idx").alias("equity"))
    own = P.bars(spark, d).where("t >= 252 and close is not null").select("symbol", "t", "date", F.col("close").cast("double").alias("equity"))
    return index.union(own)


CURVE = ", cv AS (SELECT 'index' AS symbol, t, date, idx AS equity FROM ix WHERE t >= 252 UNION ALL SELECT symbol, t, date, CAST(close AS DOUBLE) FROM b WHERE t >= 252 AND close IS NOT NULL)"


@query("metrics", """SELECT symbol, n, round(total, 8) AS total, round(CASE WHEN years > 0 THEN pow(total + 1, 1 / years) - 1 ELSE 0 END, 8) AS cagr, round(sd * sqrt(252.0::DOUBLE), 8) AS vol, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(252.0::DOUBLE) ELSE 0 END, 8) AS sharpe, round(max_dd, 8) AS max_dd FROM (
  SELECT symbol, count(*) AS n, arg_max(equity, t) / arg_min(equity, t) - 1 AS total, (max(date) - min(date)) / 365.25::DOUBLE AS years, avg(r) AS mean, stddev_samp(r) AS sd, min(equity / peak - 1) AS max_dd FROM (
    SELECT *, equity / lag(equity) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r, max(equity) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS peak FROM cv) GROUP BY symbol) WHERE n >= 2""", CURVE)
def metrics(spark, d):
    m = stats.curve_metrics(_bench(spark, d), ["symbol"])
    return m.select("symbol", "n", *[F.round(x, 8).alias(x) for x in ("total", "cagr", "vol", "sharpe", "max_dd")])


@query("yearly_returns", """SELECT symbol, CAST(y AS INTEGER) AS year, round(e / coalesce(lag(e) OVER (PARTITION BY symbol ORDER BY y), s) - 1, 10) AS ret FROM (SELECT symbol, year(date) AS y, arg_max(equity, t) AS e, arg_min(equity, t) AS s FROM cv GROUP BY ALL)""", CURVE)
def yearly_returns(spark, d):
    return stats.yearly_returns(_bench(spark, d), ["symbol"]).select("symbol", "year", F.round("ret", 10).alias("ret"))


@query("bench_curve", "SELECT t, date, round(idx / (SELECT idx FROM ix WHERE t = 252) * 100000, 4) AS bench FROM ix WHERE t >= 252")
def bench_curve(spark, d):
    index = P.index_bars(spark, d).where("t >= 252")
    return index.select("t", "date", F.round(F.col("idx") / F.first("idx").over(W.orderBy("t")) * 100000, 4).alias("bench"))


@query("drawdown", "SELECT symbol, t, CAST(max(close) OVER w AS BIGINT) AS peak, close / CAST(max(close) OVER w AS DOUBLE) - 1 AS dd FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING)")
def drawdown(spark, d):
    return I.with_peak(P.bars(spark, d).select("symbol", "t", "close"), "close").select("symbol", "t", "peak", (F.col("close") / F.col("peak") - 1).alias("dd"))


@query("distinct_dates", "SELECT DISTINCT date, sector FROM b WHERE close IS NOT NULL")
def distinct_dates(spark, d):
    return P.bars(spark, d).where("close is not null").select("date", "sector").distinct()


# samples of the decision test, and their statistics
SAMPLES = """,
sd AS (SELECT i.*, ixf.idx, CAST(lead(close, 21) OVER (PARTITION BY symbol ORDER BY t) AS DOUBLE) / close - 1 AS fwd, CAST(close > sma200 AS INTEGER) AS k1, CAST(rsi14 < 40 AS INTEGER) AS k2, CAST(idx > idx_sma200 AS INTEGER) AS k3 FROM i JOIN ixf USING (t)),
ifw AS (SELECT t, lead(idx, 21) OVER (ORDER BY t) / idx - 1 AS ifwd FROM ix),
el AS (SELECT sd.*, ifwd, coalesce(k1, 0) + coalesce(k2, 0) + coalesce(k3, 0) AS met, (SELECT max(t) FROM ix) AS last FROM sd JOIN ifw USING (t) WHERE fwd IS NOT NULL AND t >= 252 AND t <= (SELECT max(t) FROM ix) - 21 AND (t - 252) % 5 = 0),
sm AS MATERIALIZED (SELECT t, sym_ix, symbol, sector, met = 3 AS decision, met / 3.0::DOUBLE + 0.01::DOUBLE * CASE WHEN mom126 IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY t ORDER BY mom126 * 100 NULLS LAST) - 1)::DOUBLE / count(mom126) OVER (PARTITION BY t) END AS score,
  fwd, CAST(fwd > ifwd AS INTEGER) AS label, CASE WHEN t < floor(252 + (last - 21 - 252) * 0.7::DOUBLE + 0.5::DOUBLE) THEN 'in' ELSE 'out' END AS part FROM el),
sp AS (SELECT 'all' AS sample, * FROM sm UNION ALL SELECT part AS sample, * FROM sm)"""


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return P.kept(spark, d, "samples", lambda: R.samples(G.prepared(spark, d), P.index_bars(spark, d), PRESETS["pullback"]))


@query(
    "seeded_draws",
    """SELECT t, sym_ix, xor(z, z >> 14) / 4294967296.0::DOUBLE AS draw, xor(z, z >> 14) / 4294967296.0::DOUBLE < 0.5 AS in_half FROM (SELECT *, xor(CAST((y + xor(y, y >> 7)::HUGEINT * (y | 61)) % 4294967296 AS BIGINT), y) AS z FROM (
  SELECT *, CAST((xor(s, s >> 15)::HUGEINT * (s | 1)) % 4294967296 AS BIGINT) AS y FROM (SELECT t, sym_ix, CAST((row_number() OVER (ORDER BY t, sym_ix)::HUGEINT * 1831565813 + 42) % 4294967296 AS BIGINT) AS s FROM sm)))""",
    IND + SAMPLES,
)
def seeded_draws(spark, d):
    """The first tree's draws over all samples in order: every row computes its own from its place."""
    rows = ordered.numbered(_samples(spark, d).select("t", "sym_ix"), [], [F.col("t"), F.col("sym_ix")], "place")
    draw = random32.draw(42, F.col("place"))
    return rows.select("t", "sym_ix", draw.alias("draw"), (draw < 0.5).alias("in_half"))


def split_parts(samples: DataFrame) -> DataFrame:
    """Every row for 'all' and for its own part."""
    return samples.withColumn("sample", F.explode(F.array(F.lit("all"), F.col("part"))))


@query("samples", "SELECT t, sym_ix, decision, score, fwd, label, part FROM sm", IND + SAMPLES)
def samples(spark, d):
    return _samples(spark, d).select("t", "sym_ix", "decision", "score", "fwd", "label", "part")


@query("split_stats", "SELECT sample, count(*) AS n, round(avg(label), 10) AS base_rate, round(avg(fwd), 10) AS mean_fwd FROM sp GROUP BY sample", IND + SAMPLES)
def split_stats(spark, d):
    return split_parts(_samples(spark, d)).groupBy("sample").agg(F.count("*").alias("n"), F.round(F.avg("label"), 10).alias("base_rate"), F.round(F.avg("fwd"), 10).alias("mean_fwd"))


CONFUSION = """SELECT sample, tp, fp, tn, fn, n, signals, round(base, 10) AS base, round(p, 10) AS precision, round(r, 10) AS recall, round(s, 10) AS specificity, round((tp + tn) / n::DOUBLE, 10) AS accuracy, round(2 * p * r / nullif(p + r, 0), 10) AS f1,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 10) AS mcc, round(p / nullif(base, 0), 10) AS lift, round((r + s) / 2, 10) AS decision_auc, round(f1s / nullif(signals, 0), 10) AS avg_fwd_signal, round(f0s / nullif(n - signals, 0), 10) AS avg_fwd_other FROM (
  SELECT *, tp + fp AS signals, tp + fp + tn + fn AS n, (tp + fn) / (tp + fp + tn + fn)::DOUBLE AS base, tp / nullif(tp + fp, 0)::DOUBLE AS p, tp / nullif(tp + fn, 0)::DOUBLE AS r, tn / nullif(tn + fp, 0)::DOUBLE AS s FROM (
    SELECT sample, count(*) FILTER (decision AND label = 1) AS tp, count(*) FILTER (decision AND label = 0) AS fp, count(*) FILTER (NOT decision AND label = 0) AS tn, count(*) FILTER (NOT decision AND label = 1) AS fn, sum(fwd) FILTER (decision) AS f1s, sum(fwd) FILTER (NOT decision) AS f0s FROM sp GROUP BY sample))"""


@query("confusion", CONFUSION, IND + SAMPLES)
def confusion(spark, d):
    m = stats.confusion(split_parts(_samples(spark, d)), ["sample"])
    counts = ["sample", "tp", "fp", "tn", "fn", "n", "signals"]
    return m.select(*counts, *[F.round(x, 10).alias(x) for x in m.columns if x not in counts])


ROC = """,
sg AS (SELECT score, sum(label) AS p, sum(1 - label) AS n FROM sm GROUP BY score),
rp AS (SELECT 0 AS k, 0 AS tp, 0 AS fp UNION ALL SELECT row_number() OVER (ORDER BY score DESC), sum(p) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING), sum(n) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) FROM sg),
rt AS (SELECT count(*) AS points, max(tp) AS pos, max(fp) AS neg FROM rp)"""


@query("roc_points", "SELECT CAST(k AS INTEGER) AS k, CAST(fp AS DOUBLE) / neg AS fpr, CAST(tp AS DOUBLE) / pos AS tpr FROM rp, rt WHERE points <= 400 OR k = points - 1 OR k IN (SELECT CAST(floor(j * (points / 400.0::DOUBLE)) AS BIGINT) FROM range(400) x(j), rt)", IND + SAMPLES + ROC)
def roc_points(spark, d):
    return stats.roc_points(_samples(spark, d).withColumn("one", F.lit(1)), ["one"]).select("k", "fpr", "tpr")


AUC = """,
au AS (SELECT sample, score, sum(label) AS p, sum(1 - label) AS n FROM sp GROUP BY sample, score),
a1 AS (SELECT sample, CAST(sum(p) AS BIGINT) AS pos, CAST(sum(n) AS BIGINT) AS neg, sum(n * (above + p / 2.0::DOUBLE)) / nullif(CAST(sum(p) * sum(n) AS DOUBLE), 0) AS x FROM (SELECT *, coalesce(sum(p) OVER (PARTITION BY sample ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above FROM au) GROUP BY sample),
a2 AS (SELECT *, sqrt((x * (1 - x) + (pos - 1) * (x / (2 - x) - x * x) + (neg - 1) * (2 * x * x / (1 + x) - x * x)) / (pos * neg)) AS se FROM a1)"""


@query("auc", "SELECT sample, pos, neg, round(x, 12) AS auc FROM a2", IND + SAMPLES + AUC)
def auc(spark, d):
    return stats.auc(split_parts(_samples(spark, d)), ["sample"]).select("sample", "pos", "neg", F.round("auc", 12).alias("auc"))


@query("auc_ci", "SELECT sample, round(se, 10) AS se, round(x - 1.96::DOUBLE * se, 10) AS lo, round(x + 1.96::DOUBLE * se, 10) AS hi FROM a2", IND + SAMPLES + AUC)
def auc_ci(spark, d):
    return stats.auc(split_parts(_samples(spark, d)), ["sample"]).select("sample", *[F.round(x, 10).alias(x) for x in ("se", "lo", "hi")])


@query("auc_verdict", "SELECT sample, CASE WHEN x >= 0.6 THEN 'strong' WHEN x >= 0.55 THEN 'useful' WHEN x > 0.52 THEN 'weak' WHEN x >= 0.48 THEN 'none' ELSE 'inverted' END AS verdict FROM a2", IND + SAMPLES + AUC)
def auc_verdict(spark, d):
    return stats.auc(split_parts(_samples(spark, d)), ["sample"]).select("sample", S.auc_verdict(F.col("auc")).alias("verdict"))


@query("deciles", "SELECT sample, CAST(bucket AS INTEGER) AS bucket, count(*) AS n, min(score) AS score_lo, max(score) AS score_hi, round(avg(label), 10) AS hit, round(avg(fwd), 10) AS avg_fwd FROM (SELECT *, (row_number() OVER (PARTITION BY sample ORDER BY score, t, sym_ix) * 10 + count(*) OVER (PARTITION BY sample) - 1) // count(*) OVER (PARTITION BY sample) AS bucket FROM sp) GROUP BY sample, bucket", IND + SAMPLES)
def deciles(spark, d):
    m = stats.deciles(split_parts(_samples(spark, d)), ["sample"], ["t", "sym_ix"])
    return m.select("sample", "bucket", "n", "score_lo", "score_hi", F.round("hit", 10).alias("hit"), F.round("avg_fwd", 10).alias("avg_fwd"))


@query("spearman_ic", "SELECT sample, round(corr(rx, ry), 10) AS ic FROM (SELECT sample, rank() OVER (PARTITION BY sample ORDER BY score) + (count(*) OVER (PARTITION BY sample, score) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY sample ORDER BY fwd) + (count(*) OVER (PARTITION BY sample, fwd) - 1) / 2.0::DOUBLE AS ry FROM sp) GROUP BY sample", IND + SAMPLES)
def spearman_ic(spark, d):
    return stats.spearman(split_parts(_samples(spark, d)), ["sample"]).select("sample", F.round("ic", 10).alias("ic"))


# --- 2.5 windows and time series ---


@query("sma", "SELECT symbol, t, sma50, sma200 FROM i", IND)
def sma(spark, d):
    return G.prepared(spark, d).select("symbol", "t", "sma50", "sma200")


@query("ema", "SELECT symbol, t, ema12, ema26 FROM i", IND)
def ema(spark, d):
    return I.with_recurrences(P.bars(spark, d).select("symbol", "t", "close"), [("ema12", "ema", 12), ("ema26", "ema", 26)]).drop("close")


@query("rsi", "SELECT symbol, t, rsi14 FROM i", IND)
def rsi(spark, d):
    return I.with_recurrences(P.bars(spark, d).select("symbol", "t", "close"), [("rsi14", "rsi", 14)]).drop("close")


@query("macd_hist", "SELECT symbol, t, macd FROM i", IND)
def macd_hist(spark, d):
    return G.prepared(spark, d).select("symbol", "t", "macd")


def _windows(spark: SparkSession, d: str, back: int, *steps: I.Step) -> DataFrame:
    return I.windows(P.bars(spark, d).select("symbol", "t", "close"), back, *steps)


@query("rolling_max", "SELECT symbol, t, hi20, hi252 FROM i", IND)
def rolling_max(spark, d):
    return _windows(spark, d, 252, I.extremes(hi20=("max", "close", 20), hi252=("max", "close", 252))).select("symbol", "t", F.col("hi20").cast("double").alias("hi20"), F.col("hi252").cast("double").alias("hi252"))


@query("rolling_min", "SELECT symbol, t, lo252 FROM i", IND)
def rolling_min(spark, d):
    return _windows(spark, d, 252, I.extremes(lo252=("min", "close", 252))).select("symbol", "t", F.col("lo252").cast("double").alias("lo252"))


@query("volatility", "SELECT symbol, t, round(vol20, 8) AS vol20, round(vol63, 8) AS vol63 FROM i", IND)
def volatility(spark, d):
    rows = _windows(spark, d, 64, {"r": I.change(F.col("close"))}, {"vol20": I.volatility(F.col("r"), 20), "vol63": I.volatility(F.col("r"), 63)})
    return rows.select("symbol", "t", F.round("vol20", 8).alias("vol20"), F.round("vol63", 8).alias("vol63"))


@query("vol_annual", "SELECT symbol, t, round(vol20 * sqrt(252.0::DOUBLE) * 100, 6) AS vol FROM i", IND)
def vol_annual(spark, d):
    rows = R.windowed(P.bars(spark, d).select("symbol", "t", "close"), {"vol": {"ind": "vol", "n": 20}})
    return rows.select("symbol", "t", F.round("vol", 6).alias("vol"))


@query("momentum", "SELECT symbol, t, mom126 FROM i", IND)
def momentum(spark, d):
    return _windows(spark, d, 126, {"mom126": I.change(F.col("close"), 126)}).drop("close")


@query("ret_n", f"SELECT symbol, t, ({_lag(5)}) * 100 AS ret5, ({_lag(252)}) * 100 AS ret252 FROM b")
def ret_n(spark, d):
    return _windows(spark, d, 252, {"ret5": I.change(F.col("close"), 5) * 100, "ret252": I.change(F.col("close"), 252) * 100}).drop("close")


@query("dhigh", "SELECT symbol, t, (close / hi252 - 1) * 100 AS dhigh FROM i", IND)
def dhigh(spark, d):
    return _windows(spark, d, 252, I.extremes(x=("max", "close", 252))).select("symbol", "t", I.off(F.col("close"), F.col("x")).alias("dhigh"))


@query("dlow", "SELECT symbol, t, (close / lo252 - 1) * 100 AS dlow FROM i", IND)
def dlow(spark, d):
    return _windows(spark, d, 252, I.extremes(x=("min", "close", 252))).select("symbol", "t", I.off(F.col("close"), F.col("x")).alias("dlow"))


@query("index_features", "SELECT symbol, t, round(idx / idx_sma200 - 1, 8) AS gap FROM b JOIN ixf USING (t)", IND)
def index_features(spark, d):
    days = G.index_features(P.index_bars(spark, d)).select("t", F.round(F.col("idx") / F.col("idx_sma200") - 1, 8).alias("gap"))
    return P.bars(spark, d).select("symbol", "t").join(F.broadcast(days), "t")


@query("gap_sma", "SELECT symbol, t, (close / sma20 - 1) * 100 AS gap20, (close / sma200 - 1) * 100 AS gap200 FROM i", IND)
def gap_sma(spark, d):
    return _windows(spark, d, 200, {"gap20": I.gap_to_sma(F.col("close"), 20), "gap200": I.gap_to_sma(F.col("close"), 200)}).drop("close")


@query("trend", "SELECT symbol, t, sma50 / sma200 - 1 AS trend FROM i", IND)
def trend(spark, d):
    return _windows(spark, d, 200, {"trend": I.trend(F.col("close"))}).drop("close")


@query("mom_12_1", "SELECT symbol, t, CAST(lag(close, 21) OVER w AS DOUBLE) / lag(close, 252) OVER w - 1 AS mom FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t)")
def mom_12_1(spark, d):
    return _windows(spark, d, 252, {"mom": I.momentum_12_1(F.col("close"))}).drop("close")


MARKET = f""",
ir1 AS (SELECT t, idx, idx_sma200, idx / lag(idx) OVER (ORDER BY t) - 1 AS r FROM ixf),
mf AS MATERIALIZED (SELECT t, idx / lag(idx, 21) OVER (ORDER BY t) - 1 AS iret21, idx / lag(idx, 63) OVER (ORDER BY t) - 1 AS iret63, idx / idx_sma200 - 1 AS igap200, {_vol(20, 'r', '')} AS ivol20 FROM ir1)"""


def market_features(index: DataFrame) -> DataFrame:
    """(t, iret21, iret63, igap200, ivol20) as fractions."""
    one = G.index_features(index).withColumn("symbol", F.lit("index"))
    step = {"iret21": I.change(F.col("idx"), 21), "iret63": I.change(F.col("idx"), 63), "ivol20": I.volatility(F.col("r"), 20)}
    one = I.windows(one, 64, {"r": I.change(F.col("idx"))}, step)
    return one.select("t", "iret21", "iret63", (F.col("idx") / F.col("idx_sma200") - 1).alias("igap200"), "ivol20")


@query("market_features", "SELECT t, round(iret21, 8) AS iret21, round(iret63, 8) AS iret63, round(igap200, 8) AS igap200, round(ivol20, 8) AS ivol20 FROM mf", IND + MARKET)
def q_market_features(spark, d):
    m = market_features(P.index_bars(spark, d))
    return m.select("t", *[F.round(x, 8).alias(x) for x in m.columns[1:]])


@query("streak_start", "SELECT symbol, t, CASE WHEN passes = 5 THEN coalesce(max(CASE WHEN passes < 5 THEN t END) OVER (PARTITION BY symbol ORDER BY t) + 1, 0) END AS fired FROM ck", IND + CHECK_ALL)
def streak_start(spark, d):
    rows = G.with_checks(G.prepared(spark, d), Params())
    return I.with_streak_start(rows, F.col("passes") == 5, "fired").select("symbol", "t", "fired")


@query("returns", "SELECT symbol, t, r FROM i", IND)
def returns(spark, d):
    return _windows(spark, d, 1, {"r": I.change(F.col("close"))}).drop("close")


@query("xs_percentile", "SELECT symbol, t, CASE WHEN mom126 IS NULL THEN 0.5 ELSE (rank() OVER (PARTITION BY t ORDER BY mom126 NULLS LAST) - 1)::DOUBLE / count(mom126) OVER (PARTITION BY t) END AS pctl FROM i WHERE close IS NOT NULL", IND)
def xs_percentile(spark, d):
    return G.prepared(spark, d).where("close is not null").select("symbol", "t", X.share_below(F.col("mom126")).alias("pctl"))


def _xs(x: str) -> str:
    return f"CAST(CASE WHEN {x} IS NULL OR count({x}) OVER (PARTITION BY t) <= 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY t ORDER BY {x} NULLS LAST) - 1 + (count({x}) OVER (PARTITION BY t, {x}) - 1) / 2.0::DOUBLE) / nullif(count({x}) OVER (PARTITION BY t) - 1, 0) END AS FLOAT)"


@query("xs_rank", f"SELECT symbol, t, {_xs('mom126')} AS r126, {_xs('rsi14')} AS r_rsi FROM i WHERE close IS NOT NULL", IND)
def xs_rank(spark, d):
    rows = G.prepared(spark, d).where("close is not null").select("symbol", "t", F.col("mom126").alias("r126"), F.col("rsi14").alias("r_rsi"))
    return X.average_ranks(rows, ["r126", "r_rsi"])


@query("score_percentile", "SELECT symbol, t, CASE WHEN mom126 IS NOT NULL THEN (rank() OVER (PARTITION BY t ORDER BY mom126 NULLS LAST) - 1)::DOUBLE / greatest(count(mom126) OVER (PARTITION BY t) - 1, 1) END AS pctl FROM i", IND)
def score_percentile(spark, d):
    return G.prepared(spark, d).select("symbol", "t", X.score_percentile(F.col("mom126")).alias("pctl"))


# --- 2.6 sorts, limits, top-k ---


@query("rank_candidates", "SELECT symbol, t, CAST(row_number() OVER (PARTITION BY t ORDER BY mom126 DESC, sym_ix) AS INTEGER) AS place FROM ck WHERE passes = 5 AND mom126 IS NOT NULL", IND + CHECK_ALL)
def rank_candidates(spark, d):
    rows = G.with_checks(G.prepared(spark, d), Params()).where("passes = 5 and mom126 is not null")
    return rows.select("symbol", "t", X.place(F.col("mom126")).alias("place"))


@query("greedy_caps", """SELECT symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY place) AS overall FROM (SELECT *, row_number() OVER (PARTITION BY t, sector ORDER BY place) AS own FROM (
  SELECT *, row_number() OVER (PARTITION BY t ORDER BY mom126 DESC, sym_ix) AS place FROM ck WHERE passes = 5 AND mom126 IS NOT NULL)) WHERE own <= 2) WHERE overall <= 5""", IND + CHECK_ALL)
def greedy_caps(spark, d):
    """Each day's picks with five free slots and two per sector, as if nothing were held and every size sufficed."""
    rows = G.with_checks(G.prepared(spark, d), Params()).where("passes = 5 and mom126 is not null").withColumn("place", X.place(F.col("mom126")))
    _, fits = X.greedy_caps(F.col("place"), "sector", 2, 5)
    rows = rows.withColumn("fits", fits).where("fits")
    return rows.withColumn("overall", F.row_number().over(W.partitionBy("t").orderBy("place"))).where("overall <= 5").select("symbol", "t")


@query("top_decisions", "SELECT symbol, t FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY score DESC, sym_ix) AS k, count(*) OVER (PARTITION BY t) AS n FROM sm) WHERE k <= greatest(1, floor(n * 20.0::DOUBLE / 100 + 0.5::DOUBLE))", IND + SAMPLES)
def top_decisions(spark, d):
    return _samples(spark, d).withColumn("top", X.top_share(F.col("score"), 20.0)).where("top").select("symbol", "t")


@query("score_threshold", "SELECT symbol, t FROM (SELECT *, rank() OVER (PARTITION BY t ORDER BY score DESC) AS k, count(*) OVER (PARTITION BY t) AS n FROM sm) WHERE k <= greatest(1, floor(n * 20.0::DOUBLE / 100 + 0.5::DOUBLE))", IND + SAMPLES)
def score_threshold(spark, d):
    return _samples(spark, d).withColumn("top", X.at_threshold(F.col("score"), 20.0)).where("top").select("symbol", "t")


# --- 2.9 portfolio pieces that SQL can state ---
LARGE = Params(capital=10_000_000)


@query("stop_level", "SELECT symbol, t, greatest(p * (1 - 20::DOUBLE / 100), coalesce(sma50, 0)) AS stop FROM (SELECT *, max(close) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS p FROM i WHERE close IS NOT NULL)", IND)
def stop_level(spark, d):
    """The stop of a position that has been held from the first day."""
    rows = I.with_peak(G.prepared(spark, d).where("close is not null"), "close", "p")
    return rows.select("symbol", "t", G.stop_level(F.col("p"), Params()).cast("double").alias("stop"))


@query("size_shares", """SELECT symbol, t, CAST(floor(10000000.0::DOUBLE / 20 / (close / 10000.0::DOUBLE) / 1) AS BIGINT) AS slots,
  CAST(floor(least(10000000.0::DOUBLE * 1 / 100 / greatest(3 * v * (close / 10000.0::DOUBLE), close / 10000.0::DOUBLE * 0.02::DOUBLE) * (close / 10000.0::DOUBLE), 10000000.0::DOUBLE * 15 / 100) / (close / 10000.0::DOUBLE) / 100) * 100 AS BIGINT) AS risk
  FROM (SELECT *, CASE WHEN vol20 > 0 THEN round(vol20, 8) ELSE 0.02 END AS v FROM i WHERE close IS NOT NULL)""", IND)
def size_shares(spark, d):
    rows = G.prepared(spark, d).where("close is not null")
    price, equity = F.col("close") / 10000.0, F.lit(1e7)
    return rows.select("symbol", "t", S.size_shares(price, F.col("vol20"), equity, LARGE).alias("slots"), S.size_shares(price, F.round("vol20", 8), equity, LARGE.with_(sizing="risk", lot=100)).alias("risk"))


PLAN = """SELECT symbol, t, entry, stop, least(entry, ema12) AS zone_low, (entry - stop) / entry AS risk_pct, entry + 2 * (entry - stop) AS target1, entry + 3 * (entry - stop) AS target2, shares, shares * entry / 10000 AS value, shares * (entry - stop) / 10000 AS max_loss FROM (
  SELECT symbol, t, ema12, CAST(close AS DOUBLE) AS entry, greatest(CAST(close AS DOUBLE) * (1 - 20::DOUBLE / 100), coalesce(sma50, 0)) AS stop, CAST(floor(10000000.0::DOUBLE / 20 / (close / 10000.0::DOUBLE) / 1) AS BIGINT) AS shares FROM i WHERE close IS NOT NULL AND ema12 IS NOT NULL)"""


@query("price_plan", PLAN, IND)
def price_plan(spark, d):
    rows = G.prepared(spark, d).where("close is not null and ema12 is not null")
    return G.price_plan(rows, LARGE).select("symbol", "t", "entry", "stop", "zone_low", "risk_pct", "target1", "target2", "shares", "value", "max_loss")


CHART = f""",{TAIL}, ch AS MATERIALIZED (SELECT symbol, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS INTEGER) AS t, date, CAST(round(close * 10000) AS BIGINT) AS close FROM tl WHERE rn <= 400)""" + REC.replace("FROM b WHERE", "FROM ch WHERE") + f""",
cs AS (SELECT ch.*, ema12, ema26, rsi14, {_sma(50)} AS sma50, {_sma(200)} AS sma200, max(t) OVER (PARTITION BY symbol) AS last FROM ch LEFT JOIN re USING (symbol, t)),
pl AS (SELECT symbol, stop, CAST(close AS DOUBLE) + 2 * (close - stop) AS target1, CAST(close AS DOUBLE) + 3 * (close - stop) AS target2 FROM (SELECT *, greatest(CAST(close AS DOUBLE) * (1 - 20::DOUBLE / 100), coalesce(sma50, 0)) AS stop FROM cs WHERE t = last))"""


@query("chart_series", "SELECT symbol, t, date, close, ema12, ema26, sma50, sma200, rsi14, stop, target1, target2 FROM cs JOIN pl USING (symbol) WHERE t > last - 260", CHART)
def chart_series(spark, d):
    """All lines of a symbol's chart, computed over its published last 400 bars, of which the last 260 are shown, with the levels of
    the newest bar's plan."""
    rows = P.decode_ohlc(_encoded_ohlc(spark, d), "symbol").withColumn("close", F.round(F.col("close") * 10000).cast("bigint"))
    rows = I.with_recurrences(rows, [("ema12", "ema", 12), ("ema26", "ema", 26), ("rsi14", "rsi", 14)])
    rows = I.windows(rows, 200, {"sma50": I.sma(F.col("close"), 50), "sma200": I.sma(F.col("close"), 200)})
    lines = ["symbol", "t", "date", "close", "ema12", "ema26", "sma50", "sma200", "rsi14"]
    last = rows.groupBy("symbol").agg(F.max_by(F.struct("t", "close", "sma50"), "t").alias("x")).select("symbol", F.col("x.t").alias("last"), F.col("x.close").cast("double").alias("c"), F.col("x.sma50").alias("sma50"))
    plan = last.withColumn("stop", G.stop_level(F.col("c"), Params())).select("symbol", "last", "stop", *[(F.col("c") + k * (F.col("c") - F.col("stop"))).alias(f"target{k - 1}") for k in (2, 3)])
    return rows.join(plan, "symbol").where("t > last - 260").select(*lines, "stop", "target1", "target2")
