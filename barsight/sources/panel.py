"""Price panels: from driver tables, and from the published JSON layouts.

A panel is long: bars(symbol, sym_ix, sector, t, date, px, close, volume) on a dense grid of symbols and calendar places t, with
null for a missing price, and index_bars(t, date, idx). Prices are whole ten-thousandths, so sums over windows are exact and do
not depend on their order.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SMOOTH, BASE = 60, 1000.0
INPUTS = ("lineitem", "orders", "customer", "nation", "region")
_memo: dict[tuple, DataFrame] = {}
_own_dir: dict[str, str] = {}
_folders: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineage; one of its own only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir.setdefault(spark.sparkContext.applicationId, "") or tempfile.mkdtemp(prefix="barsight-")
        _own_dir[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; its file system deletes it when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _folders:
        _folders[app] = f"{shared_dir(spark)}/market/{app}"
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folders[app])
        store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(place)
        store.deleteOnExit(place)
    return _folders[app]


def stamp(spark: SparkSession, sf_dir: str) -> tuple:
    """Sizes and times of the input files, so that a changed input is read again."""
    files, conf = [], spark.sparkContext._jsc.hadoopConfiguration()
    for name in INPUTS:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files += [(f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in path.getFileSystem(conf).listStatus(path)]
    return tuple(files)


def kept(spark: SparkSession, sf_dir: str, name: str, make) -> DataFrame:
    """A table of one application and state of the input, made once and written: later queries plan a scan instead of its whole
    lineage, and it outlives any executor. The files go when the driver ends."""
    key = (spark.sparkContext.applicationId, sf_dir, stamp(spark, sf_dir), name)
    if key not in _memo:
        df, path = make(), f"{own_folder(spark)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        _memo[key] = spark.read.schema(df.schema).parquet(path)
    return _memo[key]


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that what follows does not compute it anew."""
    path = f"{own_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(text, key) stored as text files, a folder for each key, and read again."""
    path = f"{own_folder(df.sparkSession)}/files-{uuid.uuid4().hex}"
    df.select(key, text).write.partitionBy(key).text(path)
    return df.sparkSession.read.schema(f"value string, `{key}` string").text(path).select(F.col("value").alias(text), key)


def stocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, sym_ix, name, sector, market): nations as symbols, regions as sectors; the first two regions are market A."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = nation.join(region, nation["n_regionkey"] == region["r_regionkey"])
    return joined.select(F.col("n_name").alias("symbol"), F.col("n_nationkey").cast("int").alias("sym_ix"), F.concat(F.lit("Nation "), F.col("n_name")).alias("name"), F.col("r_name").alias("sector"), F.when(F.col("r_regionkey") < 2, "A").otherwise("B").alias("market"))


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, date, price, volume): exact volume-weighted unit price of a day in ten-thousandths."""

    def make() -> DataFrame:
        money = "decimal(18,2)"
        line = table(spark, sf_dir, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("date"), F.col("l_extendedprice").cast(money).alias("value"), F.col("l_quantity").cast(money).alias("quantity")).where("date is not null")
        order = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
        customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
        # An order's nation first, so that lineitem moves once, in decimals that fit a long. An order's lines mostly have dates of
        # their own: sums per order would hold nearly all rows before the shuffle, in wider decimals.
        nation = order.join(customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
        day = line.join(nation, F.col("l_orderkey") == F.col("o_orderkey"))
        day = day.groupBy("c_nationkey", "date").agg(F.sum("value").alias("value"), F.sum("quantity").alias("quantity")).where("quantity <> 0")
        value, quantity = F.col("value").cast(money).cast("double"), F.col("quantity").cast(money).cast("double")
        names = stocks(spark, sf_dir).select("symbol", "sym_ix")
        return day.join(names, day["c_nationkey"] == names["sym_ix"]).select("symbol", "date", F.round(value / quantity * 10000).cast("bigint").alias("price"), quantity.alias("volume"))

    # At most a row a symbol and day; whoever needs it twice, as the calendar does, would join lineitem twice.
    return kept(spark, sf_dir, "prices", make)


def calendar(dates: DataFrame) -> DataFrame:
    """(date, t) of distinct dates; as many rows as days, so one task may number them."""
    return dates.select("date").distinct().select("date", (F.row_number().over(W.orderBy("date")) - 1).cast("int").alias("t"))


def densify(bars: DataFrame, symbols: DataFrame, days: DataFrame, on: Sequence[str] = ("symbol", "date")) -> DataFrame:
    """Every symbol on every day, with nulls where it has no bar. The days of the calendar go to each symbol as an array."""
    days = days.agg(F.array_sort(F.collect_list(F.struct("t", "date"))).alias("days"))
    grid = symbols.join(F.broadcast(days)).select(*symbols.columns, F.explode("days").alias("day")).select(*symbols.columns, "day.t", "day.date")
    return grid.join(bars, list(on), "left")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    def make() -> DataFrame:
        raw = prices(spark, sf_dir)
        grid = densify(raw, stocks(spark, sf_dir), calendar(raw))
        by = W.partitionBy("symbol").orderBy("t")
        filled = grid.withColumn("px", F.last("price", ignorenulls=True).over(by.rowsBetween(W.unboundedPreceding, 0)))
        w = by.rowsBetween(1 - SMOOTH, 0)
        close = F.when(F.col("px").isNotNull(), F.round(F.sum("px").over(w).cast("double") / F.count("px").over(w)).cast("bigint"))
        return filled.select("symbol", "sym_ix", "name", "sector", "market", "t", "date", "price", "px", close.alias("close"), "volume")

    return kept(spark, sf_dir, "bars", make)


def index_returns(panel: DataFrame, close: str = "close") -> DataFrame:
    """(t, date, r): mean over symbols of the day's change, each clipped to [-0.5, 1], 0 on the first day and without any; in 1e-10."""
    change = F.col(close) / F.lag(close).over(W.partitionBy("symbol").orderBy("t")) - 1
    clipped = panel.select("t", "date", F.when(change.isNotNull(), F.greatest(F.lit(-0.5), F.least(F.lit(1.0), change))).alias("x"))
    mean = clipped.groupBy("t", "date").agg(F.avg("x").alias("x"))
    return mean.select("t", "date", F.round(F.when(F.col("t") == 0, 0.0).otherwise(F.coalesce("x", F.lit(0.0))) * 1e10).cast("bigint").alias("r"))


def chained(returns: DataFrame, base: float = BASE) -> DataFrame:
    """(t, date, idx): the running product in the order of days. One series with a row a day, so one task may carry it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = base
        for b in batches:
            if b.num_rows:
                x = np.cumprod(np.concatenate(([v], 1 + b.column(2).to_numpy() / 1e10)))[1:]
                v = x[-1]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x)], ["t", "date", "idx"])

    return returns.select("t", "date", "r").repartition(1).sortWithinPartitions("t").mapInArrow(run, "t int, date date, idx double")


def index_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "index", lambda: chained(index_returns(bars(spark, sf_dir))))


#: The same panel in SQL: px (prices), cal, stk, g (grid), b (bars), ir, ix (index); a prefix of every oracle.
SQL = """WITH RECURSIVE stk AS (SELECT n_name AS symbol, CAST(n_nationkey AS INTEGER) AS sym_ix, 'Nation ' || n_name AS name, r_name AS sector, CASE WHEN r_regionkey < 2 THEN 'A' ELSE 'B' END AS market FROM nation JOIN region ON n_regionkey = r_regionkey),
pr AS (SELECT symbol, date, CAST(round(CAST(v AS DOUBLE) / CAST(q AS DOUBLE) * 10000) AS BIGINT) AS price, CAST(q AS DOUBLE) AS volume FROM (
  SELECT c_nationkey, CAST(l_shipdate AS DATE) AS date, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS v, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS q
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL) JOIN stk ON c_nationkey = sym_ix WHERE q <> 0),
cal AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 1 AS INTEGER) AS t FROM (SELECT DISTINCT date FROM pr)),
g AS (SELECT stk.*, t, cal.date, price, volume FROM stk CROSS JOIN cal LEFT JOIN pr ON pr.symbol = stk.symbol AND pr.date = cal.date),
f AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS px FROM g),
b AS MATERIALIZED (SELECT symbol, sym_ix, name, sector, market, t, date, price, px, CASE WHEN px IS NOT NULL THEN CAST(round(CAST(sum(px) OVER w AS DOUBLE) / count(px) OVER w) AS BIGINT) END AS close, volume
  FROM f WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS 59 PRECEDING)),
ir AS MATERIALIZED (SELECT t, date, CAST(round((CASE WHEN t = 0 THEN 0 ELSE coalesce(avg(CASE WHEN x IS NOT NULL THEN least(1.0::DOUBLE, greatest(-0.5::DOUBLE, x)) END), 0) END) * 1e10) AS BIGINT) AS r
  FROM (SELECT t, date, CAST(close AS DOUBLE) / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS x FROM b) GROUP BY t, date),
ip(t, idx) AS (SELECT 0, CAST(1000.0 AS DOUBLE) * (1 + (SELECT r FROM ir WHERE t = 0) / 1e10::DOUBLE) UNION ALL SELECT ir.t, ip.idx * (1 + ir.r / 1e10::DOUBLE) FROM ip JOIN ir ON ir.t = ip.t + 1),
ix AS MATERIALIZED (SELECT ip.t, cal.date, idx FROM ip JOIN cal USING (t))"""


# --- published JSON layouts ---

STOCK_SCHEMA = "s string, n string, sec string, m string"
PANEL_SCHEMA = "d0 date, dt array<int>, index struct<name: string, c: array<double>>, s array<string>, c array<array<double>>"
OHLC_SCHEMA = "d0 date, dt array<int>, o array<double>, h array<double>, l array<double>, c array<double>, v array<bigint>"


def read_stocks(spark: SparkSession, path: str) -> DataFrame:
    """The stock list: a JSON array of {s, n, sec, m}."""
    return spark.read.schema(STOCK_SCHEMA).json(path, multiLine=True)


def _dates(first: Column, gaps: Column) -> Column:
    """Array of dates from the first and the day gaps."""
    sums = F.aggregate(gaps, F.array().cast("array<int>"), lambda acc, g: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + g)))
    return F.transform(F.when(F.size(gaps) > 0, sums).otherwise(F.array().cast("array<int>")), lambda n: F.date_add(first, n))


def decode_ohlc(df: DataFrame, *keep: str) -> DataFrame:
    """One row per bar of columns in OHLC_SCHEMA, with the columns of keep; t counts from 0."""
    z = F.arrays_zip(_dates(F.col("d0"), F.col("dt")).alias("date"), F.col("o").alias("open"), F.col("h").alias("high"), F.col("l").alias("low"), F.col("c").alias("close"), F.col("v").alias("volume"))
    return df.select(*keep, F.posexplode(z).alias("t", "x")).select(*keep, "t", "x.*")


def decode_panel(df: DataFrame, dims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bars, index bars) of panel rows; a symbol without a dim row is its own name, in sector 'Other'."""
    dated = df.withColumn("dates", _dates(F.col("d0"), F.col("dt")))
    index = dated.select(F.col("index.name").alias("name"), F.posexplode(F.arrays_zip(F.col("dates").alias("date"), F.col("index.c").alias("idx"))).alias("t", "x")).select("name", "t", "x.*")
    series = dated.select("dates", F.posexplode(F.arrays_zip(F.col("s").alias("symbol"), F.col("c").alias("close"))).alias("sym_ix", "x"))
    long = series.select("sym_ix", F.col("x.symbol").alias("symbol"), F.posexplode(F.arrays_zip(F.col("dates").alias("date"), F.col("x.close").alias("close"))).alias("t", "y")).select("symbol", "sym_ix", "t", "y.*")
    long = long.withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    return with_dims(long, dims.select(F.col("s").alias("symbol"), F.col("n").alias("name"), F.col("sec").alias("sector"))), index


def with_dims(long: DataFrame, dims: DataFrame) -> DataFrame:
    """long with name and sector; defaults where the symbol is unknown."""
    joined = long.join(dims, "symbol", "left")
    return joined.withColumn("name", F.coalesce("name", "symbol")).withColumn("sector", F.coalesce("sector", F.lit("Other")))


def gaps(dates: Column) -> Column:
    """Day gaps of an array of dates, 0 first."""
    return F.transform(dates, lambda d, i: F.when(i == 0, 0).otherwise(F.datediff(d, F.element_at(dates, F.greatest(i, F.lit(1)).cast("int")))))


def encode_ohlc(rows: DataFrame, bars: int = 400) -> DataFrame:
    """The last `bars` bars of each symbol in OHLC_SCHEMA, from (symbol, date, open, high, low, close, volume)."""
    latest = rows.withColumn("rn", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))).where(F.col("rn") <= bars)
    one = latest.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("date", "open", "high", "low", "close", "volume"))).alias("x"))
    return one.select("symbol", F.col("x")[0]["date"].alias("d0"), gaps(F.col("x.date")).alias("dt"), F.col("x.open").alias("o"), F.col("x.high").alias("h"), F.col("x.low").alias("l"), F.col("x.close").alias("c"), F.transform("x.volume", lambda v: F.coalesce(v, F.lit(0)).cast("bigint")).alias("v"))


def encode_panel(long: DataFrame, index: DataFrame, name: str) -> DataFrame:
    """One row in PANEL_SCHEMA from dense (symbol, sym_ix, t, close) and (t, date, idx); the calendar is bounded by days."""
    series = long.groupBy("sym_ix", "symbol").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "close"))), lambda x: x["close"].cast("double")).alias("c"))
    columns = series.agg(F.array_sort(F.collect_list(F.struct("sym_ix", "symbol", "c"))).alias("s"))
    days = index.agg(F.array_sort(F.collect_list(F.struct("t", "date", "idx"))).alias("d"))
    return columns.join(F.broadcast(days)).select(F.col("d")[0]["date"].alias("d0"), gaps(F.col("d.date")).alias("dt"), F.struct(F.lit(name).alias("name"), F.col("d.idx").alias("c")).alias("index"), F.col("s.symbol").alias("s"), F.col("s.c").alias("c"))


META_SCHEMA = f"generated timestamp, markets map<string, struct<name: string, currency: string, lot: int, index: string>>, stocks array<struct<{STOCK_SCHEMA.replace(' string', ': string')}>>, missing array<struct<s: string, m: string>>"


def meta_record(stocks: DataFrame, have: DataFrame, markets: dict[str, tuple[str, str, int, str]]) -> DataFrame:
    """One row in META_SCHEMA: build time, markets, the stocks that have enough bars, and those that do not. The stock list is a row a
    symbol; the layout wants it in one record."""
    listed = stocks.join(have.select("symbol", F.lit(True).alias("_have")), "symbol", "left").withColumn("_have", F.coalesce("_have", F.lit(False)))
    entry = F.struct(F.col("symbol").alias("s"), F.col("name").alias("n"), F.col("sector").alias("sec"), F.col("market").alias("m"))
    gone = F.struct(F.col("symbol").alias("s"), F.col("market").alias("m"))
    both = listed.agg(F.array_sort(F.collect_list(F.when(F.col("_have"), entry))).alias("stocks"), F.array_sort(F.collect_list(F.when(~F.col("_have"), gone))).alias("missing"))
    about = [x for k, (name, currency, lot, index) in markets.items() for x in (F.lit(k), F.struct(F.lit(name).alias("name"), F.lit(currency).alias("currency"), F.lit(lot).alias("lot"), F.lit(index).alias("index")))]
    return both.select(F.current_timestamp().alias("generated"), F.create_map(*about).alias("markets"), "stocks", "missing")
