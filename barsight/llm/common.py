"""Helpers that the operators share: row keys, word patterns, shared-storage cuts and links-to-components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A word is a run of ASCII digits, ASCII lower-case letters and anything beyond ASCII.
WORD_CHARS = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
_WORD_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """The words of a whole text, A-Z lower-cased (bytes.lower touches ASCII only); null has none."""
    return _WORD_BYTES.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def ascii_lower(col: Column) -> Column:
    return F.translate(col, UPPER, LOWER)


def text_key(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their text; equal rows stay equal."""
    return F.xxhash64(F.coalesce(text, F.lit("")), text.isNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_field(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of df and one field more (StructType.add would change the one df keeps)."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"`{name}` {kind}").fields])


def fresh(base: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    while base.lower() in taken:
        base += "_"
    return base


_scratch: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares for cut lineage; one of its own only in local mode, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="barsight-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir() or found
    return found.rstrip("/")


def scratch_dir(spark: SparkSession) -> str:
    """This application's own folder in the shared one; its file system deletes it when the driver ends."""
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        _scratch[app] = f"{shared_dir(spark)}/barsight/{app}"
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch[app])
        store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        store.mkdirs(path)
        store.deleteOnExit(path)
    return _scratch[app]


_noted: list[list[str]] = []


@contextmanager
def noted_cuts() -> Iterator[list[str]]:
    """The folders of the cuts made inside, for the caller to delete once nothing reads them."""
    _noted.append([])
    try:
        yield _noted[-1]
    finally:
        _noted.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends here and outlives any executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    for paths in _noted:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key that holds over 1 / HOT_SHARE of all rows is hot, so there are fewer than HOT_SHARE such keys; each is dealt to SALTS.
HOT_SHARE, SALTS = 512, 64


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str, total: int, spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right on keys, inner or left; right has unique keys, and `rows` says how many rows of left hold each.

    Rows of hot keys are dealt to SALTS parts by a hash of the columns of spread, and the hot rows of right go to each part.
    Only the hot keys, fewer than HOT_SHARE, are broadcast.
    """
    hot = F.col(rows) > max(total // HOT_SHARE, 1000)
    salt, mark = fresh("_salt", left, right), fresh("_hot", left, right)
    few = right.where(hot).select(*keys, F.lit(True).alias(mark))
    left = left.join(F.broadcast(few), keys, "left")
    left = left.withColumn(salt, F.when(F.col(mark), F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop(mark)
    right = right.withColumn(salt, F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [*keys, salt], how).drop(salt)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) with component the smallest node that links reach; nodes without an edge to another node are absent.

    Alternates large-star and small-star steps (Kiveris et al., 2014) over a deduplicated edge table, each written to
    shared storage. A step sends a row for each edge, so a hub's neighbours are never gathered in one task: the least
    neighbour comes from a partial aggregate and goes back by a join that may split a hot key.
    """

    def with_least(pairs: DataFrame, total: int) -> DataFrame:
        """pairs with m, the least neighbour of u."""
        m = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree"))
        return hot_join(pairs, m, ["u"], "degree", total, ["v"]).drop("degree")

    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut(e)
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * state[0]).withColumn("m", F.least("u", "m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # A node's least neighbour is among its rows, so its own link to it comes from the row where v = m.
        small = with_least(large, state[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v")
        e = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
