"""Time-series indicators of a dense panel, by windows over blocks of (symbol, t); recurrences by one fold per symbol.

Every lookback counts grid places, not rows with prices. A missing price is null, and each indicator says what a gap does.

A symbol's places are cut into blocks of LENGTH, so work spreads over days as well as symbols. Lookbacks reach into the block before by
copies of its last rows (windows); running values over all of the past come from a row per block (running). Columns of the first kind
are written over blocked() and go through windows().
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK, LENGTH = "_block", 1024


def by():
    """A symbol's places: for single steps back or ahead only."""
    return W.partitionBy("symbol").orderBy("t")


def blocked():
    return W.partitionBy("symbol", BLOCK).orderBy("t")


def last_n(n: int):
    return blocked().rowsBetween(1 - n, 0)


Step = dict[str, Column] | Callable[[DataFrame], DataFrame]


def windows(df: DataFrame, back: int, *steps: Step, length: int = LENGTH) -> DataFrame:
    """df with the columns of each step, which look back over at most `back` places in all, and may read those of the steps before.

    A row is copied into every block whose first lookback reaches it: once, for lookbacks below a block's length.
    """
    own = F.floor(F.col("t") / length)
    out = df.withColumn(BLOCK, F.explode(F.sequence(own, F.floor((F.col("t") + back) / length))))
    for step in steps:
        out = step(out) if callable(step) else out.withColumns(step)
    return out.where(F.col(BLOCK) == own).drop(BLOCK)


def extremes(**wanted: tuple[str, str, int]) -> Step:
    """name = (min or max, column, n): the extreme of the last n places, gaps aside, where the place itself has a value.

    In linear work whatever n is: places are cut every n; n places up to t are the end of one cut and the start of the next, so
    two running extremes, one from each side, hold the answer. Looks back over n - 1 places.
    """

    def add(df: DataFrame) -> DataFrame:
        names = df.columns
        for name, (kind, x, n) in wanted.items():
            cut = W.partitionBy("symbol", BLOCK, F.floor(F.col("t") / n)).orderBy("t")
            of = {"max": F.max, "min": F.min}[kind]
            df = df.withColumns({f"_{name}_to": of(x).over(cut.rowsBetween(W.unboundedPreceding, 0)), f"_{name}_from": of(x).over(cut.rowsBetween(0, W.unboundedFollowing))})
        both = {"max": F.greatest, "min": F.least}
        found = {name: F.when(F.col(x).isNotNull(), both[kind](F.lag(f"_{name}_from", n - 1).over(blocked()), F.col(f"_{name}_to"))).alias(name) for name, (kind, x, n) in wanted.items()}
        return df.select(*names, *found.values())

    return add


def sma(x: Column, n: int) -> Column:
    """Mean of n consecutive values; a gap makes the next n - 1 places missing."""
    w = last_n(n)
    return F.when(F.count(x).over(w) == n, F.sum(x).over(w) / n)


def change(x: Column, n: int = 1) -> Column:
    """x / x n places before - 1, both present."""
    return F.try_divide(x, F.lag(x, n).over(blocked())) - 1


def momentum_12_1(x: Column) -> Column:
    return F.try_divide(F.lag(x, 21).over(blocked()), F.lag(x, 252).over(blocked())) - 1


def volatility(change_1: Column, n: int) -> Column:
    """Sample deviation of one-place changes over n places, from place n on, with n - 2 changes at least."""
    w = last_n(n)
    return F.when((F.col("t") >= n) & (F.count(change_1).over(w) >= n - 2), F.stddev_samp(change_1).over(w))


def off(x: Column, extreme: Column) -> Column:
    """Percent by which x is above an extreme, below 0 for a high."""
    return (x / extreme - 1) * 100


def gap_to_sma(x: Column, n: int) -> Column:
    return (x / sma(x, n) - 1) * 100


def trend(x: Column) -> Column:
    return sma(x, 50) / sma(x, 200) - 1


def forward_change(x: Column, n: int) -> Column:
    return F.lead(x, n).over(by()) / x - 1


# --- running values over all of the past ---

RUNNING = {"max": F.max, "min": F.min, "last": partial(F.last, ignorenulls=True)}


def running(df: DataFrame, wanted: dict[str, tuple[str, Column]], key: Sequence[str] = ("symbol",), order: Sequence[str] = ("t",), block: Column | None = None) -> DataFrame:
    """df with name = (max, min or last, column) over the key's rows up to each row, nulls aside.

    Each block finds its own; a row per block and key carries what came before. `block` must not fall with the order; by default it is
    t's block.
    """
    values = {f"_{n}": c for n, (_, c) in wanted.items()}
    rows = df.withColumns({BLOCK: F.floor(F.col("t") / LENGTH) if block is None else block, **values})
    w = W.partitionBy(*key, BLOCK).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    inside = rows.withColumns({f"_{n}": RUNNING[kind](f"_{n}").over(w) for n, (kind, _) in wanted.items()})
    place = F.struct(*order)
    ends = {"max": lambda c: F.max(c), "min": lambda c: F.min(c), "last": lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), place))}
    parts = rows.groupBy(*key, BLOCK).agg(*[ends[kind](f"_{n}").alias(f"+{n}") for n, (kind, _) in wanted.items()])
    before = W.partitionBy(*key).orderBy(BLOCK).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select(*key, BLOCK, *[RUNNING[kind](f"+{n}").over(before).alias(f"+{n}") for n, (kind, _) in wanted.items()])
    both = {"max": F.greatest, "min": F.least, "last": F.coalesce}
    return inside.join(parts, [*key, BLOCK]).select(*df.columns, *[both[kind](F.col(f"_{n}"), F.col(f"+{n}")).alias(n) for n, (kind, _) in wanted.items()])


def with_peak(df: DataFrame, x: str, name: str = "peak") -> DataFrame:
    return running(df, {name: ("max", F.col(x))})


def with_last_known(df: DataFrame, x: str, name: str) -> DataFrame:
    return running(df, {name: ("last", F.col(x))})


def with_streak_start(df: DataFrame, passes: Column, name: str) -> DataFrame:
    """df with the first place of the unbroken run of passes that a place is in; null where it does not pass."""
    out = running(df, {"_fail": ("max", F.when(~passes, F.col("t"))), "_first": ("min", F.col("t"))})
    return out.withColumn(name, F.when(passes, F.coalesce(F.col("_fail") + 1, F.col("_first")))).drop("_fail", "_first")


def asof_join(left: DataFrame, right: DataFrame, key: Sequence[str], time: str, values: Sequence[str], span: int = 1024, tolerance: int | None = None) -> DataFrame:
    """left with the values of right's latest row of the key whose date is not after left's, null where there is none, or none within
    `tolerance` days. One ordered pass over both sides together, cut every `span` days, so a key's rows need not share a task; right has
    one row for a key and date. Rows without key or date find nothing."""
    side, found = "_side", "_found"
    rows = left.withColumns({side: F.lit(1), found: F.lit(None).cast(T.StructType([right.schema[c] for c in (time, *values)]))})
    known = right.select(*key, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in (*key, time)], F.lit(0).alias(side), F.struct(time, *values).alias(found))
    both = rows.unionByName(known.select(rows.columns)).withColumn("_day", F.unix_date(time))
    keyed = F.col("_day").isNotNull()
    for k in key:
        keyed = keyed & F.col(k).isNotNull()
    out = running(both.where(keyed), {"_last": ("last", F.col(found))}, key, (time, side), F.floor(F.col("_day") / span))
    near = F.lit(True) if tolerance is None else F.col("_day") - F.unix_date(F.col("_last")[time]) <= tolerance
    out = out.where(F.col(side) == 1).select(*left.columns, *[F.when(near, F.col("_last")[v]).alias(v) for v in values])
    loose = both.where((F.col(side) == 1) & ~keyed).select(*left.columns, *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    return out.unionByName(loose)


# --- recurrences: no window form, so a fold over one symbol's places in order ---


def ema_values(xs: Sequence[float | None], n: int) -> list[float | None]:
    """Weight 2 / (n + 1), from the first value; gaps are skipped and stay missing; given from the n-th value on."""
    out, weight, level, seen = [], 2 / (n + 1), None, 0
    for x in xs:
        if x is not None:
            level, seen = x if level is None else level + weight * (x - level), seen + 1
        out.append(level if x is not None and seen >= n else None)
    return out


def rsi_values(xs: Sequence[float | None], n: int) -> list[float | None]:
    """Wilder averages of rises and falls between successive values, from the first change; 100 without falls."""
    out, before, rise, fall, seen = [], None, 0.0, 0.0, 0
    for x in xs:
        value = None
        if x is not None:
            if before is not None:
                up, down = max(x - before, 0.0), max(before - x, 0.0)
                rise, fall = (rise + (up - rise) / n, fall + (down - fall) / n) if seen else (up, down)
                seen += 1
                if seen >= n:
                    value = 100.0 if fall == 0 else 100 - 100 / (1 + rise / fall)
            before = x
        out.append(value)
    return out


def macd_values(xs: Sequence[float | None]) -> list[float | None]:
    """Percent of price by which EMA12 - EMA26 exceeds its own EMA9."""
    line = [a - b if a is not None and b is not None else None for a, b in zip(ema_values(xs, 12), ema_values(xs, 26))]
    return [(a - s) / x * 100 if s is not None and x is not None else None for a, s, x in zip(line, ema_values(line, 9), xs)]


def recurrence(xs: Sequence[float | None], kind: str, n: int | None) -> list[float | None]:
    return {"ema": lambda: ema_values(xs, n), "rsi": lambda: rsi_values(xs, n), "macd": lambda: macd_values(xs)}[kind]()


def with_recurrences(df: DataFrame, specs: Sequence[tuple[str, str, int | None]], x: str = "close") -> DataFrame:
    """df with a double column for each (name, kind, n), all in one pass over a symbol's places; a symbol's history is one
    task's, as many rows as days."""

    def fold(table: pa.Table) -> pa.Table:
        table = table.sort_by("t")
        xs = [None if v is None else float(v) for v in table[x].to_pylist()]
        for name, kind, n in specs:
            table = table.append_column(name, pa.array(recurrence(xs, kind, n), pa.float64()))
        return table

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + "".join(f", `{name}` double" for name, _, _ in specs)
    return df.groupBy("symbol").applyInArrow(fold, schema)
