"""Order statistics over keys of any size, by range-partitioned running sums.

Rows are dealt by sampled splitters of (key, order), so ranges are of like size whatever the keys. Each range sums its own rows; a small
table with a row per range and key tells every range what lies before it. No window is wider than one range, or than that table.
Rows that tie in the order share a range, so callers whose ties may be many add them up first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.panel import cut

RANGE = "_range"


def ranged(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """df in ranges of (key, order), each row with its range's number; numbers rise with key and order."""
    return df.repartitionByRange(*[F.col(k) for k in key], *order).withColumn(RANGE, F.spark_partition_id())


def carried(parts: DataFrame, key: list[str], sums: list[str]) -> DataFrame:
    """(key, range, sums): what the key's earlier ranges hold together, from what each holds."""
    w = W.partitionBy(*key).orderBy(RANGE).rowsBetween(W.unboundedPreceding, -1)
    return parts.select(*key, RANGE, *[F.coalesce(F.sum(s).over(w), F.lit(0)).cast(parts.schema[s].dataType).alias(s) for s in sums])


def inner(key: list[str], order: list[Column]):
    """The rows of a range before a row."""
    return W.partitionBy(*key, RANGE).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)


def with_before(df: DataFrame, key: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """df with, under each name, the column's sum over the key's rows that stand before in the order."""
    # Written, since the ranges are read twice and must stay the same.
    rows = cut(ranged(df.withColumns({f"_{n}": c for n, c in sums.items()}), key, order))
    parts = rows.groupBy(*key, RANGE).agg(*[F.sum(f"_{n}").alias(f"+{n}") for n in sums])
    offsets = carried(parts, key, [f"+{n}" for n in sums])
    out = rows.join(offsets, [*key, RANGE])
    return out.select(*df.columns, *[(F.coalesce(F.sum(f"_{n}").over(inner(key, order)), F.lit(0)) + F.col(f"+{n}")).alias(n) for n in sums])


def numbered(df: DataFrame, key: list[str], order: list[Column], name: str) -> DataFrame:
    """df with the row's place in its key, from 0."""
    return with_before(df, key, order, {name: F.lit(1).cast("bigint")})
