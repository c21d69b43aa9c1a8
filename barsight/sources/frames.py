"""Downloaded price frames as a Spark data source: spark.read.format("price_frames").load(folder).

A downloader leaves one Parquet file per batch of tickers, wide as it comes: a column `when` (a date, or a time with its zone) and for each
ticker the columns TICKER|Open, |High, |Low, |Close, |Volume. A file is a partition. Rows come out long: (symbol, date, open, high, low,
close, volume). Rows without a close are dropped, and so are tickers without any, or whose columns are not all there; zones are
dropped and times cut to their local midnight; a ticker's date that comes twice in a file keeps its last row. Comparisons with the date are
pushed into the read, and a file's tickers are read one at a time.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual

FIELDS = ("Open", "High", "Low", "Close", "Volume")
SCHEMA = "symbol string, date date, open double, high double, low double, close double, volume bigint"
_COMPARE = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}


@dataclass
class Batch(InputPartition):
    path: str


def midnight(when: pa.Array) -> pa.Array:
    """Local dates of dates, times, or ISO texts with a zone."""
    if pa.types.is_string(when.type) or pa.types.is_large_string(when.type):
        return pc.utf8_slice_codeunits(when, 0, 10).cast(pa.date32())
    if pa.types.is_timestamp(when.type) and when.type.tz:
        when = pc.local_timestamp(when)
    return when.cast(pa.timestamp("us")).cast(pa.date32(), safe=False) if pa.types.is_timestamp(when.type) else when.cast(pa.date32())


class Frames(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path, self.wanted = path, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes comparisons with the date; the others stay with Spark."""
        for f in filters:
            if type(f) in _COMPARE and f.attribute == ("date",):
                self.wanted.append((_COMPARE[type(f)], f.value))
            elif not (isinstance(f, IsNotNull) and f.attribute == ("date",)):  # dates are never missing
                yield f

    def partitions(self) -> list[Batch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return [Batch(f.path) for f in sorted(found, key=lambda f: f.path) if f.is_file and f.path.endswith(".parquet")] or [Batch("")]

    def read(self, partition: Batch) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyarrow import parquet as pq

        if not partition.path:
            return
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path or self.path.startswith("file:") else fs.LocalFileSystem()
        file = pq.ParquetFile(store.open_input_file(partition.path))
        names = file.schema_arrow.names
        date = midnight(file.read(["when"])["when"].combine_chunks())
        for ticker in dict.fromkeys(n.rsplit("|", 1)[0] for n in names if "|" in n):
            columns = [f"{ticker}|{f}" for f in FIELDS]
            if not set(columns) <= set(names):
                continue
            rows = file.read(columns)
            close = rows[columns[3]].cast(pa.float64())
            here = pc.and_(pc.and_(pc.is_valid(close), pc.invert(pc.fill_null(pc.is_nan(close), True))), pa.chunked_array([pc.is_valid(date)]))
            for compare, value in self.wanted:
                here = pc.and_(here, pc.fill_null(compare(date, pa.scalar(value, pa.date32())), False))
            table = pa.table([date, *(rows[c].cast(pa.float64()) for c in columns)], ["date", *FIELDS]).filter(here)
            last = {d: k for k, d in enumerate(table["date"].to_pylist())}
            if len(last) < table.num_rows:
                table = table.take(pa.array(sorted(last.values())))
            volume = pc.fill_null(pc.if_else(pc.is_nan(table["Volume"]), None, table["Volume"]), 0).cast(pa.int64(), safe=False)
            for b in pa.table([pa.array([ticker] * table.num_rows, pa.string()), table["date"], *(table[f] for f in FIELDS[:4]), volume], ["symbol", "date", "open", "high", "low", "close", "volume"]).to_batches():
                yield b


class PriceFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "price_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Frames:
        return Frames(self.options["path"])


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PriceFrames)
    return spark.read.format("price_frames").load(path)


def write_frames(prices: DataFrame, path: str, symbols: list[str], each: int = 10, zone: str = "-05:00") -> None:
    """(symbol, date, open, high, low, close, volume) as a downloader would leave it: a frame for each `each` of the given symbols, days as
    texts with a zone."""
    for k in range(0, len(symbols), each):
        some = symbols[k : k + each]
        values = [F.first(c.lower()).alias(c) for c in FIELDS]
        wide = prices.where(F.col("symbol").isin(some)).groupBy("date").pivot("symbol", some).agg(*values)
        names = [F.col(f"`{s}_{c}`").cast("double").alias(f"{s}|{c}") for s in some for c in FIELDS]
        wide.select(F.concat(F.date_format("date", "yyyy-MM-dd"), F.lit(f" 00:00:00{zone}")).alias("when"), *names).coalesce(1).write.mode("append").parquet(path)
