"""Windows in blocks, as-of joins, downloaded frames and published files."""

import datetime
import random
import re
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F

from barsight.operators import indicators as I
from barsight.sources import frames as FR
from barsight.sources import panel as P
from barsight.sources import publish as PB


def walk(spark, symbols=3, days=90, seed=1):
    r = random.Random(seed)
    series = {f"s{k}": [r.choice([None, r.randint(1, 99), r.randint(1, 99)]) for _ in range(days)] for k in range(symbols)}
    rows = [(s, t, x) for s, xs in series.items() for t, x in enumerate(xs)]
    return series, spark.createDataFrame(rows, "symbol string, t int, close int").repartition(5)


@pytest.mark.parametrize("length", [1, 7, 32, 1024])
@pytest.mark.parametrize("n", [1, 2, 13, 40])
def test_blocks_change_no_window(spark, length, n):
    series, df = walk(spark)
    c = F.col("close")
    steps = [{"r": I.change(c)}, {"sma": I.sma(c, n), "ret": I.change(c, n), "r_n": F.count("r").over(I.last_n(n))}, I.extremes(hi=("max", "close", n), lo=("min", "close", n))]
    got = {(x["symbol"], x["t"]): x for x in I.windows(df, n + 1, *steps, length=length).collect()}
    assert len(got) == df.count()
    for s, xs in series.items():
        for t, x in enumerate(xs):
            last = [v for v in xs[max(0, t + 1 - n) : t + 1] if v is not None]
            g = got[s, t]
            assert g["hi"] == (None if x is None else max(last)) and g["lo"] == (None if x is None else min(last))
            assert g["sma"] == (sum(last) / n if len(last) == n else None)
            assert g["ret"] == (x / xs[t - n] - 1 if t >= n and x is not None and xs[t - n] is not None else None)
            steps_ = [k for k in range(max(1, t + 1 - n), t + 1) if xs[k] is not None and xs[k - 1] is not None]
            assert g["r_n"] == len(steps_)


def test_extremes_have_no_sliding_frame(spark):
    _, df = walk(spark)
    plan = I.windows(df, 2000, I.extremes(hi=("max", "close", 2000)))._jdf.queryExecution().optimizedPlan().toString()
    assert "unboundedpreceding" in plan and not re.search(r"RowFrame, -\d+, currentrow", plan)


def test_tasks_grow_with_days(spark):
    _, df = walk(spark, 1, 400)
    blocks = I.windows(df, 5, {"b": F.col(I.BLOCK)}, length=50).select("b").distinct().count()
    assert blocks == 8


def test_running_values_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(I, "LENGTH", 8)
    series, df = walk(spark)
    out = I.running(df, {"peak": ("max", F.col("close")), "low": ("min", F.col("close")), "known": ("last", F.col("close"))})
    out = I.with_streak_start(out, F.coalesce(F.col("close") > 20, F.lit(False)), "since")
    got = {(x["symbol"], x["t"]): x for x in out.collect()}
    for s, xs in series.items():
        since = None
        for t, x in enumerate(xs):
            seen = [v for v in xs[: t + 1] if v is not None]
            since = None if not (x or 0) > 20 else t if since is None else since
            assert tuple(got[s, t][k] for k in ("peak", "low", "known", "since")) == ((max(seen), min(seen), seen[-1]) if seen else (None,) * 3) + (since,)


@pytest.mark.parametrize("span,tolerance", [(3, None), (3, 2), (10_000, 2)])
def test_asof_join(spark, span, tolerance):
    r = random.Random(9)
    day = lambda k: datetime.date(2024, 1, 1) + datetime.timedelta(days=k)
    prices = {(s, k): r.randint(1, 9) for s in "ab" for k in r.sample(range(60), 15)} | {("a", 59): None}
    asked = [(n, r.choice(["a", "b", "c", None]), r.choice([None, *range(-3, 70)])) for n in range(200)]
    right = spark.createDataFrame([(s, day(k), v) for (s, k), v in prices.items()], "symbol string, date date, price int")
    left = spark.createDataFrame([(n, s, None if k is None else day(k)) for n, s, k in asked], "n int, symbol string, date date")
    got = {x["n"]: x["price"] for x in I.asof_join(left, right, ["symbol"], "date", ["price"], span, tolerance).collect()}
    for n, s, k in asked:
        before = [d for (p, d) in prices if p == s and k is not None and d <= k and (tolerance is None or k - d <= tolerance)]
        latest = [d for (p, d) in prices if p == s and k is not None and d <= k]
        assert got[n] == (prices[s, max(latest)] if before else None)
    assert len(got) == len(asked)


def test_downloaded_frames(spark, tmp_path):
    days = pd.to_datetime(["2024-01-02 23:00", "2024-01-03 23:00", "2024-01-04 23:00", "2024-01-04 23:30"]).tz_localize("America/New_York")
    frame = {"when": days}
    for ticker, close in {"AA": [1.0, None, 3.0, 4.0], "B|C": [5.0, 6.0, float("nan"), None], "NONE": [None] * 4}.items():
        frame |= {f"{ticker}|{f}": close for f in ("Open", "High", "Low", "Close")} | {f"{ticker}|Volume": [7.0, 8.0, None, 9.5]}
    frame["PART|Close"] = [1.0] * 4
    pd.DataFrame(frame).to_parquet(tmp_path / "a.parquet")
    pd.DataFrame({"when": ["2024-01-05 00:00:00+07:00"], **{f"D|{f}": [2] for f in FR.FIELDS}}).to_parquet(tmp_path / "b.parquet")
    pd.DataFrame({"when": [datetime.date(2024, 1, 5)], **{f"E|{f}": [3.0] for f in FR.FIELDS}}).to_parquet(tmp_path / "c.parquet")
    found = FR.read_frames(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 3
    want = {("AA", "2024-01-02", 1.0, 7), ("AA", "2024-01-04", 4.0, 9), ("B|C", "2024-01-02", 5.0, 7), ("B|C", "2024-01-03", 6.0, 8), ("D", "2024-01-05", 2.0, 2), ("E", "2024-01-05", 3.0, 3)}
    rows = lambda df: {(r["symbol"], str(r["date"]), r["close"], r["volume"]) for r in df.collect()}
    assert rows(found) == want
    later = found.where("date >= date'2024-01-03' and date < date'2024-01-05' and close > 4.5")
    assert rows(later) == {("B|C", "2024-01-03", 6.0, 8)}
    # Both bounds on the date went into the read; the one on the close stayed.
    plan = later._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Filter .*date", plan) and re.search(r"Filter .*close", plan)


def folder_of(spark):
    return f"{P.own_folder(spark)}/pub-{uuid.uuid4().hex}"


def files(spark, texts):
    return spark.createDataFrame(list(texts.items()), "file string, text string")


def seen(spark, folder):
    return {r["file"]: r["text"] for r in PB.published(spark, folder).collect()}


def test_publishing_replaces_all_or_nothing(spark, tmp_path):
    folder = str(tmp_path)
    with pytest.raises(ValueError):
        PB.published(spark, folder)
    first = PB.publish(files(spark, {"a.json": "{1}", "b.json": "{2}"}), folder)
    assert seen(spark, folder) == {"a.json": "{1}", "b.json": "{2}"} and PB.manifest(spark, folder) == first and first["files"] == 2
    assert abs((datetime.datetime.now(datetime.timezone.utc) - datetime.datetime.fromisoformat(first["generated"])).total_seconds()) < 120
    # A write that fails in its tasks, and one that stops before its manifest.
    broken = files(spark, {"a.json": "{9}", "c.json": "{9}"}).withColumn("text", F.when(F.col("file") == "c.json", F.raise_error(F.lit("no"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="no"):
        PB.publish(broken, folder)
    staged = PB.stage(files(spark, {"z.json": "{8}"}), folder)
    assert seen(spark, folder) == {"a.json": "{1}", "b.json": "{2}"} and PB.manifest(spark, folder) == first
    # Staged files that were changed are refused.
    spoiled = next((tmp_path / staged / "files").rglob("part-*"))
    (tmp_path / staged / "files" / "file=y.json").mkdir()
    spoiled.rename(tmp_path / staged / "files" / "file=y.json" / spoiled.name)
    with pytest.raises(ValueError):
        PB.commit(spark, folder, staged)
    assert seen(spark, folder) == {"a.json": "{1}", "b.json": "{2}"}
    second = PB.publish(files(spark, {"b.json": "{3}"}), folder)
    assert seen(spark, folder) == {"b.json": "{3}"}
    # What the manifest does not name is gone: the stale file, the failed and the staged state.
    assert [p.name for p in tmp_path.iterdir() if p.name.startswith("state-")] == [second["state"]]


def test_lineitem_is_read_once(spark, tmp_path, monkeypatch):
    import duckdb

    con, n = duckdb.connect(), 3000
    con.execute("CREATE TABLE region AS SELECT i AS r_regionkey, 'R' || i AS r_name FROM range(3) t(i)")
    con.execute("CREATE TABLE nation AS SELECT i::INTEGER AS n_nationkey, 'N' || i AS n_name, i % 3 AS n_regionkey FROM range(6) t(i)")
    con.execute("CREATE TABLE customer AS SELECT i AS c_custkey, CASE WHEN i % 9 < 6 THEN i % 9 END::INTEGER AS c_nationkey FROM range(50) t(i)")
    con.execute("CREATE TABLE orders AS SELECT i % 390 AS o_orderkey, CASE WHEN i % 11 <> 0 THEN i % 60 END AS o_custkey FROM range(400) t(i)")
    con.execute(f"CREATE TABLE lineitem AS SELECT CASE WHEN i % 17 <> 0 THEN i % 420 END AS l_orderkey, (CASE WHEN i % 13 <> 0 THEN i % 5 END)::DOUBLE AS l_quantity, (CASE WHEN i % 19 <> 0 THEN i * 1.37 END)::DOUBLE AS l_extendedprice, (CASE WHEN i % 23 <> 0 THEN DATE '2020-01-01' + (i % 40)::INTEGER END)::TIMESTAMP AS l_shipdate FROM range({n}) t(i)")
    for name in P.INPUTS:
        con.execute(f"COPY {name} TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    read, table = spark.sparkContext.accumulator(0), P.table

    def counted(spark, sf_dir, name):
        def run(batches):
            for batch in batches:
                read.add(batch.num_rows)
                yield batch

        df = table(spark, sf_dir, name)
        return df.mapInArrow(run, df.schema) if name == "lineitem" else df

    monkeypatch.setattr(P, "table", counted)
    bars = P.bars(spark, str(tmp_path))
    assert bars.where("px is not null").count() > 100 and read.value == n
    got = P.prices(spark, str(tmp_path)).select("symbol", "date", "price", "volume").collect()
    want = con.execute(P.SQL + " SELECT symbol, date, price, volume FROM pr WHERE date IS NOT NULL").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and read.value == n
