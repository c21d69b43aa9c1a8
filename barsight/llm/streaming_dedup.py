"""Exact deduplication by a stateful stream.

The documents are read as a stream of files. Each row becomes a digest of its text, its doc_id and a content locator (file and
row number there), and a streaming aggregate keeps, for each digest, the row with the largest doc_id and the number of rows. The
state lies in RocksDB on the executors' disks, is committed to the shared checkpoint with every micro-batch and never expires: there
is no watermark. Started again on the same checkpoint, the stream takes only files it has not seen and adds to what it retains.
Tasks aggregate before the shuffle, so a text with a third of all rows sends a row per task.

The state is then read as a table. A digest with more than one row is a hit, and every hit is checked on its full bytes: the text at
the keeper's locator is fetched and compared with the text of every other row of that digest. Rows that differ share a digest only,
and the rows of such a digest are grouped anew by whole text. Texts whose digest is unique never leave their scan: a bitmap of
the hits' digests (at most BITS bits, so 4 MB) tells most of them apart, and a false alarm costs no more than its shuffle.

Cases: a null text counts as empty; a null doc_id ranks below every other; rows that share text and largest doc_id tie, and the one with
the greatest locator stays; an empty table gives no rows; other columns are never read, so their names do not matter. Long texts pass
through the scan, and only those of hits through a join.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, hot_join, scratch_dir

#: The state's settings. Without the second each store, however small, sets 4 MB of disk aside for its manifest.
STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
#: Of the bitmap of hits, and input bytes of a micro-batch.
BITS, BATCH = 1 << 25, 256 << 30
Digest = Callable[[Column], Column]


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _fields(spark: SparkSession, path: str) -> T.StructType:
    found = {f.name: f for f in spark.read.parquet(path).schema.fields}
    return T.StructType([found["doc_id"], found["text"]])


def _located(docs: DataFrame, digest: Digest) -> DataFrame:
    """doc_id, text, digest and locator of every row of a scan."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), digest(text).alias("digest"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))


def retain(spark: SparkSession, path: str, checkpoint: str, digest: Digest = sha256, batch: int = BATCH) -> bool:
    """Runs the stream over the files of path that the checkpoint has not seen; false if it never held a batch."""
    # A pattern for the last letter, as a stream reads single files only by a pattern.
    files = f"{path[:-1]}[{path[-1]}]"
    stream = spark.readStream.schema(_fields(spark, path)).option("maxFileAge", "36500d").option("maxBytesPerTrigger", batch).parquet(files)
    state = _located(stream, digest).groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    before = {key: spark.conf.get(key, None) for key in STATE}
    for key, value in STATE.items():
        spark.conf.set(key, value)
    try:
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    query.awaitTermination()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{checkpoint}/commits/0")
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def retained(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(digest, keep_id, keep_file, keep_row, n): the state that the last committed batch left."""
    state = spark.read.format("statestore").load(checkpoint)
    keep = F.col("value.max")
    return state.select("key.digest", keep["doc_id"].alias("keep_id"), keep["file"].alias("keep_file"), keep["row"].alias("keep_row"), F.col("value.count").alias("n"))


def _bit(digest: str) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(BITS)) + 1


def _with_hits(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """rows with `held`: the text where the digest's bit is set, else null."""
    bits = hits.select(_bit("digest").alias("b")).groupBy(F.bitmap_bucket_number("b").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    at = F.bitmap_bit_position(_bit("digest"))
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    on = F.expr("shiftright(_byte, _shift) & 1 = 1")
    joined = rows.withColumn("bucket", F.bitmap_bucket_number(_bit("digest"))).join(F.broadcast(bits), "bucket", "left")
    joined = joined.withColumn("_byte", F.coalesce(byte, F.lit(0))).withColumn("_shift", (at % 8).cast("int"))
    return joined.withColumn("held", F.when(on, F.col("text")))


def resolve(spark: SparkSession, path: str, checkpoint: str, digest: Digest = sha256) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256, file, row) of every row of path, by what the stream retained."""
    state = cut(retained(spark, checkpoint))
    hits = state.where("n > 1")
    rows = _located(spark.read.schema(_fields(spark, path)).parquet(path), digest)
    marked = _with_hits(rows, hits).select("doc_id", "digest", "file", "row", F.sha2("text", 256).alias("text_sha256"), "held")
    marked = cut(marked)
    maybe = marked.where("held is not null")
    # The keeper's text from its locator; locators are unique, so no key is hot.
    contents = maybe.select("digest", F.col("file").alias("keep_file"), F.col("row").alias("keep_row"), F.col("held").alias("content"))
    keepers = hits.join(contents, ["digest", "keep_file", "keep_row"])
    total = state.agg(F.sum("n")).first()[0] or 0
    checked = hot_join(maybe, keepers, ["digest"], "n", total, ["file", "row"], "left")
    checked = checked.select("doc_id", "digest", "file", "row", "text_sha256", F.coalesce("keep_id", "doc_id").alias("keep_id"), F.coalesce("n", F.lit(1)).cast("bigint").alias("group_size"), (F.col("n").isNull() | (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))).alias("kept"), (F.col("n").isNull() | (F.col("held") == F.col("content"))).alias("same"))
    checked = cut(checked)
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256", "file", "row"]
    single = marked.where("held is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", "file", "row")
    clash = checked.where("not same").select("digest").distinct()
    if clash.isEmpty():
        return single.unionByName(checked.select(*out))
    # Different texts with one digest: its rows are grouped by whole text.
    chain = maybe.join(clash, "digest", "left_semi")
    groups = chain.groupBy("digest", "held").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("group_size"))
    chain = chain.join(groups, ["digest", "held"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.struct("file", "row") == F.struct("keep.file", "keep.row")).alias("kept"), "text_sha256", "file", "row")
    return single.unionByName(checked.join(clash, "digest", "left_anti").select(*out)).unionByName(chain)


def deduplicate(spark: SparkSession, path: str, checkpoint: str | None = None, digest: Digest = sha256, batch: int = BATCH) -> DataFrame:
    """Every row of the Parquet files at path with the row of its text that stays. A checkpoint of one's own lets later calls go on
    from the retained state; else the state goes when the driver ends."""
    checkpoint = checkpoint or f"{scratch_dir(spark)}/dedup-{uuid.uuid4().hex}"
    if not retain(spark, path, checkpoint, digest, batch):
        kind = _fields(spark, path)["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, keep_id {kind}, group_size bigint, kept boolean, text_sha256 string, file string, row bigint")
    return resolve(spark, path, checkpoint, digest)


def op11(spark: SparkSession, path: str) -> DataFrame:
    return deduplicate(spark, path).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, row_number() OVER (w ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
