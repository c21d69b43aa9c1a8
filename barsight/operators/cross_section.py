"""Ranks and choices across the symbols of one day."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import half_up

def day():
    return W.partitionBy("t")


def share_below(x: Column, eligible: Column | None = None) -> Column:
    """Share of the day's values strictly below; 0.5 where missing. Nulls sort last, so they never count."""
    x = x if eligible is None else F.when(eligible, x)
    return F.when(x.isNull(), 0.5).otherwise((F.rank().over(day().orderBy(x.asc_nulls_last())) - 1) / F.count(x).over(day()))


def mean_place(day: np.ndarray, x: np.ndarray) -> np.ndarray:
    """0 for the day's least, 1 for its largest, ties sharing their mean; 0.5 where x is NaN or alone."""
    order = np.lexsort((x, day))  # NaN last
    d, v = day[order], x[order]
    at, known = np.arange(len(x)), ~np.isnan(v)
    new_day = np.concatenate(([True], d[1:] != d[:-1]))
    new_tie = new_day | np.concatenate(([True], v[1:] != v[:-1]))
    tie, whole = np.cumsum(new_tie) - 1, np.cumsum(new_day) - 1
    ties, n = np.bincount(tie), np.bincount(whole, known)[whole]
    mean = at[new_tie][tie] - at[new_day][whole] + (ties[tie] - 1) / 2
    out = np.empty(len(x))
    out[order] = np.where(known & (n > 1), mean / np.maximum(n - 1, 1), 0.5)
    return out


def average_ranks(rows: DataFrame, names: list[str], batch: int = 50_000) -> DataFrame:
    """rows with each named column replaced by its rank within its t (mean_place), as 32 bits: one exchange by t and one sort for all of
    them. A task takes whole days, about `batch` rows at a time; a day's symbols are the least it must hold."""
    kinds = ", ".join(f"`{f.name}` {'float' if f.name in names else f.dataType.simpleString()}" for f in rows.schema.fields)

    def ranked(table: pa.Table) -> Iterator[pa.RecordBatch]:
        day = table["t"].to_numpy()
        for name in names:
            x = table[name].cast(pa.float64()).to_numpy(zero_copy_only=False)
            table = table.set_column(table.column_names.index(name), name, pa.array(mean_place(day, x).astype(np.float32)))
        return table.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if b.num_rows:
                held.append(b)
            if sum(h.num_rows for h in held) < batch:
                continue
            table = pa.Table.from_batches(held)
            day = table["t"].to_numpy()
            whole = int(np.searchsorted(day, day[-1]))  # the last day may go on
            if whole:
                yield from ranked(table.slice(0, whole))
                held = table.slice(whole).to_batches()
        if held:
            yield from ranked(pa.Table.from_batches(held))

    return rows.repartition("t").sortWithinPartitions("t").mapInArrow(run, kinds)


def score_percentile(x: Column) -> Column:
    """Share of the other values of the day strictly below; null where missing."""
    below = F.rank().over(day().orderBy(x.asc_nulls_last())) - 1
    return F.when(x.isNotNull(), below / F.greatest(F.count(x).over(day()) - 1, F.lit(1)))


def place(x: Column, ties: str = "sym_ix") -> Column:
    """1 for the day's largest; ties keep the order of `ties`."""
    return F.row_number().over(day().orderBy(x.desc_nulls_last(), F.col(ties)))


def take(n: Column, percent: float) -> Column:
    """How many of n make the top share: one at least, halves rounded up."""
    return F.greatest(F.lit(1), half_up(n * percent / 100))


def top_share(x: Column, percent: float, ties: str = "sym_ix") -> Column:
    """Whether a row is in the day's top share, exactly so many rows."""
    return place(x, ties) <= take(F.count(x).over(day()), percent)


def at_threshold(x: Column, percent: float) -> Column:
    """Whether a row reaches the day's threshold score; all that tie with it do."""
    return x.isNotNull() & (F.rank().over(day().orderBy(x.desc_nulls_last())) <= take(F.count(x).over(day()), percent))


def greedy_caps(rank: Column, sector: str, sector_room: int, slots: int):
    """(rank in sector, whether within its room): with capacities that only count, the first `slots` of the rows within their
    sector's room are those that a walk down the ranking takes."""
    in_sector = F.row_number().over(W.partitionBy("t", sector).orderBy(rank))
    return in_sector, in_sector <= sector_room
