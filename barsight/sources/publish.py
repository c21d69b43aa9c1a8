"""Published files with a manifest: all of a new state is seen, or none of it.

A state is staged in a folder of its own: the files (a folder named by the file, as Spark writes texts by a key) and their entries
(file, bytes, sha256), both written by tasks. Then one rename puts a manifest in place that names the folder, the build time, the
number of files and a checksum over all entries. Readers start from the manifest, so a write that fails in between changes nothing
for them. Last, every state folder that the manifest does not name is deleted, which takes away stale files and what failed writes left.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .panel import cut

MANIFEST = "manifest.json"
ENTRIES = "file string, bytes bigint, sha256 string"


def _store(spark: SparkSession, folder: str):
    """(file system, Path class) of a folder."""
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return of(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), of


def _checksum(entries: DataFrame) -> tuple[int, str]:
    """How many entries there are, and a sum over them that does not depend on their order."""
    n, total = entries.agg(F.count("*"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("\n", "file", F.col("bytes").cast("string"), "sha256"), 256), 1, 15), 16, 10).cast("decimal(38,0)"))).first()
    return n, str(total or 0)


def manifest(spark: SparkSession, folder: str) -> dict | None:
    """What the folder's readers see now; null before the first state."""
    store, path = _store(spark, folder)
    if not store.exists(path(f"{folder}/{MANIFEST}")):
        return None
    return json.loads(spark.read.text(f"{folder}/{MANIFEST}", wholetext=True).first()[0])


def stage(files: DataFrame, folder: str) -> str:
    """Writes (file, text) and their entries into a state folder that no manifest names yet."""
    state = f"state-{uuid.uuid4().hex}"
    files = cut(files.select("file", "text"))  # computed once: a build time must not differ between file and entry
    files.select("file", "text").write.partitionBy("file").text(f"{folder}/{state}/files")
    entries = files.select("file", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    entries.write.json(f"{folder}/{state}/entries")
    return state


def commit(spark: SparkSession, folder: str, state: str, built: datetime | None = None) -> dict:
    """Checks a staged state against its entries, names it in the manifest by one rename, and deletes every other."""
    files = _files(spark, folder, state).select("file", F.octet_length("text").cast("bigint").alias("bytes"), F.sha2("text", 256).alias("sha256"))
    count, checksum = _checksum(spark.read.schema(ENTRIES).json(f"{folder}/{state}/entries"))
    if _checksum(files) != (count, checksum):
        raise ValueError("staged files differ from their entries")
    found = {"generated": (built or datetime.now(timezone.utc)).isoformat(timespec="seconds"), "state": state, "files": count, "checksum": checksum}
    store, path = _store(spark, folder)
    fresh = path(f"{folder}/.{uuid.uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    rename = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fresh.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    over = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    rename.rename(store.makeQualified(fresh), store.makeQualified(path(f"{folder}/{MANIFEST}")), over)
    for f in store.listStatus(path(folder)):
        name = f.getPath().getName()
        if name.startswith("state-") and name != state:
            store.delete(f.getPath(), True)
    return found


def publish(files: DataFrame, folder: str, built: datetime | None = None) -> dict:
    """Puts (file, text), each file once, in place of what the folder published before."""
    return commit(files.sparkSession, folder, stage(files, folder), built)


def _files(spark: SparkSession, folder: str, state: str) -> DataFrame:
    # Layout files hold one line each.
    return spark.read.schema("value string, file string").text(f"{folder}/{state}/files").select("file", F.col("value").alias("text"))


def published(spark: SparkSession, folder: str) -> DataFrame:
    """(file, text) of the state that the manifest names."""
    found = manifest(spark, folder)
    if found is None:
        raise ValueError("nothing is published here")
    return _files(spark, folder, found["state"])
