"""Line dedup by winnowing over line hashes (after Schleimer, Wilkerson and Aiken, 2003).

1. Select. Of every `min_lines` consecutive line hashes the least (the rightmost of ties) is a fingerprint, so equal runs select
   fingerprints at equal offsets; only distinct selected places become rows. A line of at least `min_words` words is a run of
   its own and selects itself.
2. Join. Fingerprints that occur once in the corpus drop out; the others' places meet by fingerprint.
3. Extend. A matching place is extended to both sides over the windows that selected it, compared by 128-bit digests of their
   lines; a window matches if an earlier place has it. Matches of neighbouring fingerprints meet in maximal runs.
4. Delete. The lines of later repeated runs go; the first place of each stays.

A run of `min_lines` lines has no least length, as in the SQL: repeated pairs of blank lines go too.

Order of places: doc_id (null first), a hash of the text, line number. Rows that repeat with equal doc_id and text are one
place, so neither deletes the other. Fingerprints and windows that hold many places are salted before their joins.

Cases: a null text stays null with no lines; an empty text is one empty line; empty tables give no rows; extra columns of any
name are kept by line_dedup().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, hot_join, text_key

MIN_LINES, MIN_WORDS = 2, 50


def _places(docs: DataFrame, min_lines: int, min_words: int) -> DataFrame:
    """(_id, _key, at, fp, runs) of every selected place; runs: how far before `at` each window that selects it begins, its
    number of lines and its digest."""
    n = min_lines

    def selected(i: Column) -> Column:
        part = F.slice("hashes", i + 1, n)
        return (i + n - F.array_position(F.reverse(part), F.array_min(part))).cast("int")

    def digest(i: Column) -> Column:
        return F.unhex(F.md5(F.array_join(F.slice("lines", i + 1, n), "\n").cast("binary")))

    def place(at: Column) -> Column:
        near = F.sequence(F.greatest(at - n + 1, F.lit(0)), F.least(at, F.size("lines") - n))
        mine = F.filter(near, lambda i: F.element_at("picked", (i + 1).cast("int")) == at)
        windows = F.when(F.size("lines") >= n, F.transform(mine, lambda i: F.struct((at - i).cast("int").alias("back"), F.lit(n).alias("n"), digest(i).alias("run"))))
        line = F.element_at("lines", (at + 1).cast("int"))
        own = F.when(F.element_at("long", (at + 1).cast("int")), F.array(F.struct(F.lit(0).alias("back"), F.lit(1).alias("n"), F.unhex(F.md5(F.concat(F.lit("1\n"), line).cast("binary"))).alias("run"))))
        return F.struct(at.alias("at"), F.element_at("hashes", (at + 1).cast("int")).alias("fp"), F.concat(F.coalesce(windows, F.array().cast("array<struct<back:int,n:int,run:binary>>")), F.coalesce(own, F.array().cast("array<struct<back:int,n:int,run:binary>>"))).alias("runs"))

    every = F.sequence(F.lit(0), F.size("lines") - 1)
    docs = docs.withColumns({"hashes": F.transform("lines", lambda x: F.xxhash64(x)), "long": F.transform("lines", lambda x: F.size(F.split(x, r"\s+")) >= min_words)})
    docs = docs.withColumn("picked", F.when(F.size("lines") >= n, F.transform(F.sequence(F.lit(0), F.size("lines") - n), selected)).otherwise(F.array().cast("array<int>")))
    places = F.array_distinct(F.concat("picked", F.filter(every, lambda i: F.element_at("long", (i + 1).cast("int")))))
    return docs.select("_id", "_key", F.explode(F.transform(places, place)).alias("p")).select("_id", "_key", "p.*")


def repeated_lines(documents: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _key, drop): per document with later repeated runs the sorted numbers, from 0, of the lines to delete."""
    docs = documents.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_id"), text_key(F.col(text_col)).alias("_key"), F.split(F.col(text_col), "\n").alias("lines"))
    places = cut(_places(docs, min_lines, min_words))
    repeated = places.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1")
    matched = hot_join(places, repeated, ["fp"], "c", places.count(), ["_id", "_key", "at"]).drop("c")
    runs = cut(matched.select("_id", "_key", "at", F.explode("runs").alias("r")).select("_id", "_key", (F.col("at") - F.col("r.back")).alias("at"), "r.n", "r.run"))
    first = runs.groupBy("run").agg(F.min(F.struct("_id", "_key", "at")).alias("first"), F.count("*").alias("c")).where("c > 1")
    later = hot_join(runs, first, ["run"], "c", runs.count(), ["_id", "_key", "at"]).where(~F.struct("_id", "_key", "at").eqNullSafe(F.col("first")))
    return later.groupBy("_id", "_key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence("at", F.col("at") + F.col("n") - 1))))).alias("drop"))


def _with_runs(documents: DataFrame, names: tuple[str, str, str], options: dict) -> DataFrame:
    id_col, text_col = options.get("id_col", "doc_id"), options.get("text_col", "text")
    key = fresh("_text_key", documents)
    drop = repeated_lines(documents, **options).toDF(*(fresh(c, documents) for c in ("_drop_id", "_drop_key", "_drop")))
    other_id, other_key, gone_col = (F.col(c) for c in drop.columns)
    j = documents.withColumn(key, text_key(F.col(text_col))).join(drop, F.col(id_col).eqNullSafe(other_id) & (F.col(key) == other_key), "left")
    lines = F.split(F.col(text_col), "\n")
    gone = F.coalesce(gone_col, F.array().cast("array<int>"))
    kept = F.when(gone_col.isNull(), F.col(text_col)).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.array_contains(gone, i.cast("int"))), "\n"))
    runs = F.size(F.filter(gone, lambda x: ~F.array_contains(gone, x - 1)))
    counts = (F.when(F.col(text_col).isNull(), 0).otherwise(F.size(lines)), F.size(gone), runs)
    return j.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in documents.columns], *(x.cast("bigint").alias(n) for x, n in zip(counts, names)))


def line_dedup(documents: DataFrame, *, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str, str] = ("_n_lines", "_n_removed", "_n_runs")) -> DataFrame:
    """The documents with all their columns, the text without later repeated runs, and the three columns of counts more: lines,
    deleted lines and maximal deleted runs. Names in counts that the documents have are lengthened by underscores."""
    names = tuple(fresh(c, documents) for c in counts)
    return _with_runs(documents, names, {"min_lines": min_lines, "min_words": min_words, "id_col": id_col, "text_col": text_col})


def op1(documents: DataFrame) -> DataFrame:
    out = line_dedup(documents.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_runs").alias("n_runs"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def dedup_sql(source: str = "documents", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> str:
    """CTEs that end in l2 (r, i, line, gone): every line, and whether it goes. Texts are assumed to have unique doc_id."""
    return f"""
dd AS (SELECT row_number() OVER (ORDER BY doc_id) AS r, * FROM {source}),
l AS (SELECT r, generate_subscripts(string_split(text, chr(10)), 1) AS i, unnest(string_split(text, chr(10))) AS line FROM dd),
wn AS (SELECT r, i, line, lead(line) OVER (PARTITION BY r ORDER BY i) AS nx FROM l),
ru AS (SELECT r, i, {min_lines} AS n, line || chr(10) || nx AS k FROM wn WHERE nx IS NOT NULL
       UNION ALL SELECT r, i, 1 AS n, line AS k FROM l WHERE len(regexp_split_to_array(line, '\\s+')) >= {min_words}),
rk AS (SELECT r, i, n, row_number() OVER (PARTITION BY n, k ORDER BY r, i) AS o FROM ru),
gone AS (SELECT DISTINCT r, unnest(range(i, i + n)) AS i FROM rk WHERE o > 1),
l2 AS (SELECT l.r, l.i, l.line, gone.i IS NOT NULL AS gone FROM l LEFT JOIN gone ON l.r = gone.r AND l.i = gone.i)"""


ORACLE_SQL = f"""WITH {dedup_sql().replace(chr(92) * 2, chr(92))},
x AS (SELECT r, i, line, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS b FROM l2)
SELECT dd.doc_id, CAST(count(x.i) AS BIGINT) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_removed, CAST(count(*) FILTER (WHERE b) AS BIGINT) AS n_runs,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM dd LEFT JOIN x ON dd.r = x.r GROUP BY dd.r, dd.doc_id
"""
