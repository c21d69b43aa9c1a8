"""Benchmark decontamination on a distributed positional inverted index.

1. Index. Tasks take their documents in segments of about SEGMENT_BYTES and write, for every token, its posting: a segment's
   tokens in order of term and position, cut by term into buckets, one row for each segment and bucket in the shared folder.
2. Terms. The windows of the benchmark are a table of distinct phrases; their distinct terms, a row of a bounded number for each
   bucket, are joined to the index by bucket, which leaves the postings of benchmark terms and their counts in the corpus.
3. Rarest first. A phrase that holds a term without postings cannot occur. The others go to the segments that hold their rarest
   term, and there the lists, each shifted by the term's place in the phrase, are intersected from the rarest term up. A segment
   with more than PART_PHRASES phrases is a group for each part of them, so a group's size does not follow the benchmark's;
   what the parts cover of a document is merged afterwards.
4. Hits go back to the documents, and phrases to items, by joins; a phrase in many documents is salted.

Neither side passes through the driver or is gathered whole. Terms are 64-bit hashes of words. A window is `window` consecutive
words of an item, or all words of a shorter one. proximity() uses the same index, and windows around the rarest term.

Cases: null or wordless texts have no words, no hits and are not contaminated; repeated rows get equal results; a null item id
counts as an item but has no name; an empty documents table gives no rows, an empty benchmark no hits; extra columns of either
table are ignored, and kept by decontaminate().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, hot_join, text_key, words_of

WINDOW, SHARE = 13, 20
#: Bytes of text that a segment indexes at once, and benchmark terms that a bucket of the index holds on average.
SEGMENT_BYTES, BUCKET_TERMS = 8_000_000, 20_000
#: Phrases that meet a segment's lists in one group, on average.
PART_PHRASES = 100_000


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def terms_of(text: str | None, memo: dict) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words)).view(np.int64)


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), kind)


def windows_of(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> DataFrame:
    """(item, phrase, terms): every window of every item; phrase is a digest of its terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                h = terms_of(text, memo)
                n = min(window, len(h))
                parts = [h[i : i + n] for i in range(len(h) - n + 1)] if n else []
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(parts), pa.string()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in parts], pa.binary()), pa.array(parts, pa.list_(pa.int64()))], ["item", "phrase", "terms"])

    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return cut(items.mapInArrow(run, "item string, phrase binary, terms array<bigint>").distinct())


def index(docs: DataFrame, buckets: int) -> DataFrame:
    """The stored index of (id, tk, text): per segment and bucket its terms in order, their numbers of postings and the
    positions; and per segment, with a null bucket, its documents' ids, text keys, first positions and lengths."""
    kind = docs.schema["id"].dataType.simpleString()
    names = ["segment", "bucket", "terms", "counts", "positions", "ids", "tks", "starts", "lengths"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, number = _WordHashes(), TaskContext.get().partitionId() << 32
        kept: list[tuple[pa.Array, pa.Array]] = []
        arrays: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(a) for a in arrays], np.int64)
            starts = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
            flat = np.concatenate(arrays)
            positions = (np.arange(len(flat)) + np.repeat(np.arange(len(arrays)), lengths)).astype(np.int32)
            order = np.argsort(flat, kind="stable")
            order = order[np.argsort((flat[order] % buckets).astype(np.int32), kind="stable")]
            flat, positions = flat[order], positions[order]
            ends = np.searchsorted(flat % buckets, np.arange(buckets + 1))
            rows: list[list] = [[], [], [], []]
            for b in range(buckets):
                part = flat[ends[b] : ends[b + 1]]
                if len(part):
                    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
                    for c, x in zip(rows, (b, _packed(part[first]), _packed(np.diff(first, append=len(part)).astype(np.int32)), _packed(positions[ends[b] : ends[b + 1]]))):
                        c.append(x)
            n = len(rows[0])
            ids, tks = (pa.concat_arrays([k[i] for k in kept]) for i in (0, 1))
            none = [None] * n
            listed = lambda x: pa.ListArray.from_arrays(pa.array([0] * (n + 1) + [len(x)], pa.int32()), x, mask=pa.array([True] * n + [False]))
            return pa.RecordBatch.from_arrays([pa.array([number] * (n + 1), pa.int64()), pa.array([*rows[0], None], pa.int32()), *(pa.array([*c, None], pa.binary()) for c in rows[1:]), listed(ids), listed(tks), pa.array([*none, starts], pa.list_(pa.int64())), pa.array([*none, lengths], pa.list_(pa.int64()))], names)

        for batch in batches:
            begin = 0
            for i, text in enumerate(batch.column(2).to_pylist()):
                arrays.append(terms_of(text, memo))
                size += len(text or "")
                if size >= SEGMENT_BYTES or i == batch.num_rows - 1:
                    kept.append((batch.column(0)[begin : i + 1], batch.column(1)[begin : i + 1]))
                    begin = i + 1
                if size >= SEGMENT_BYTES:
                    yield flush()
                    number, size = number + 1, 0
                    kept.clear()
                    arrays.clear()
        if arrays:
            yield flush()

    return cut(docs.mapInArrow(run, f"segment bigint, bucket int, terms binary, counts binary, positions binary, ids array<{kind}>, tks array<bigint>, starts array<bigint>, lengths array<bigint>"))


def _of_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of index rows with `wanted` terms: the postings of these."""
    for batch in batches:
        for segment, terms, counts, positions, wanted in zip(*(c.to_pylist() for c in batch.columns)):
            t, n = _unpacked(terms, np.int64), _unpacked(counts, np.int32)
            chosen = np.isin(t, np.array(wanted, np.int64))
            if chosen.any():
                yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int64()), *(pa.array([_packed(x)], pa.binary()) for x in (t[chosen], n[chosen], _unpacked(positions, np.int32)[np.repeat(chosen, n)]))], ["segment", "terms", "counts", "positions"])


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for segment, terms, counts in zip(*(c.to_pylist() for c in batch.columns)):
            t = _unpacked(terms, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([segment] * len(t), pa.int64()), pa.array(t), pa.array(_unpacked(counts, np.int32).astype(np.int64))], ["segment", "term", "n"])


class Lists:
    """Position lists of one segment's terms."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray):
        ends = np.cumsum(counts)
        order = np.argsort(terms)
        self.terms, self.counts, self.begins = terms[order], counts[order], (ends - counts)[order]
        self.positions = positions

    def places(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms of phrases [phrase, place] stand among the lists, and which phrases have lists for all terms."""
        at = np.minimum(np.searchsorted(self.terms, phrases), max(0, len(self.terms) - 1))
        return at, (self.terms[at] == phrases).all(axis=1) if len(self.terms) else np.zeros(len(phrases), bool)

    def of(self, k: int) -> np.ndarray:
        return self.positions[self.begins[k] : self.begins[k] + self.counts[k]]

    def phrase(self, at: np.ndarray) -> np.ndarray:
        """First positions of the exact phrase, from the rarest term up."""
        order = np.argsort(self.counts[at], kind="stable")
        found = self.of(at[order[0]]) - order[0]
        for k in order[1:]:
            if not len(found):
                break
            other, want = self.of(at[k]), found + k
            near = np.searchsorted(other, want)
            found = found[(near < len(other)) & (other[np.minimum(near, len(other) - 1)] == want)]
        return found

    def near(self, at: np.ndarray, slop: int, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Positions of the rarest term with every other term at most slop words away, in the same document."""
        at = np.unique(at)
        order = at[np.argsort(self.counts[at], kind="stable")]
        found = self.of(order[0])
        doc = np.searchsorted(starts, found, "right") - 1
        lo, hi = np.maximum(found - slop, starts[doc]), np.minimum(found + slop, starts[doc] + lengths[doc] - 1)
        for k in order[1:]:
            other = self.of(k)
            ok = np.searchsorted(other, lo, "left") < np.searchsorted(other, hi, "right")
            found, lo, hi = found[ok], lo[ok], hi[ok]
        return found


def _found(documents: DataFrame, benchmark: DataFrame, window: int, slop: int | None, id_col: str, text_col: str, item_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (segment, place, id, tk, n_words); hits (segment, place, n_hit); matches (segment, place, at, item): exact
    phrases (at is null), or with a slop the places of the rarest terms."""
    docs = documents.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    windows = windows_of(benchmark, window, item_col, text_col)
    phrases = windows.select("phrase", "terms").dropDuplicates(["phrase"])
    places = phrases.select("phrase", "terms", F.explode(F.array_distinct("terms")).alias("term"))
    terms = cut(places.groupBy("term").agg(F.count("*").alias("phrases")))
    n_terms, n_places = terms.agg(F.count("*"), F.coalesce(F.sum("phrases"), F.lit(0))).first()
    buckets = max(16, -(-n_terms // BUCKET_TERMS))
    stored = index(docs, buckets)
    by_bucket = terms.groupBy(F.pmod("term", F.lit(buckets)).cast("int").alias("bucket")).agg(F.collect_list("term").alias("wanted"))
    lists = stored.where("bucket is not null").select("segment", "bucket", "terms", "counts", "positions").join(by_bucket, "bucket").select("segment", "terms", "counts", "positions", "wanted")
    lists = cut(lists.mapInArrow(_of_terms, "segment bigint, terms binary, counts binary, positions binary"))
    seen = cut(lists.select("segment", "terms", "counts").mapInArrow(_term_counts, "segment bigint, term bigint, n bigint"))
    counts = seen.groupBy("term").agg(F.sum("n").alias("n")).join(terms, "term")
    each = hot_join(places, counts, ["term"], "phrases", n_places, ["phrase"])
    rarest = cut(each.groupBy("phrase").agg(F.first("terms").alias("terms"), F.count("*").alias("known"), F.min(F.struct("n", "term")).alias("r")).where(F.col("known") == F.size(F.array_distinct("terms"))).select("phrase", "terms", F.col("r.term").alias("term")))
    per_term = rarest.groupBy("term").agg(F.count("*").alias("phrases"))
    per_segment = cut(seen.select("segment", "term").join(per_term, "term").groupBy("segment").agg(F.ceil(F.sum("phrases") / PART_PHRASES).cast("int").alias("n_parts")))
    asked = rarest.join(seen.select("segment", "term"), "term").join(per_segment, "segment")
    asked = asked.select("segment", F.pmod(F.xxhash64("phrase"), "n_parts").cast("int").alias("part"), "phrase", "terms")
    parts = lists.select("segment", "terms", "counts", "positions", F.lit(None).cast("array<bigint>").alias("starts"), F.lit(None).cast("array<bigint>").alias("lengths"))
    parts = parts.union(stored.where("bucket is null").select("segment", "terms", "counts", "positions", "starts", "lengths"))
    parts = parts.join(per_segment, "segment").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n_parts") - 1))).drop("n_parts")

    def intersect(left: pa.Table, right: pa.Table) -> pa.Table:
        cols: list[list] = [[], [], [], [], [], []]
        if left.num_rows and right.num_rows:
            rows = left.to_pylist()
            texts = next(r for r in rows if r["starts"] is not None)
            starts, lengths = np.array(texts["starts"], np.int64), np.array(texts["lengths"], np.int64)
            rows = [r for r in rows if r["starts"] is None]
            lists = Lists(*(np.concatenate([_unpacked(r[c], kind) for r in rows] or [np.zeros(0, kind)]) for c, kind in (("terms", np.int64), ("counts", np.int32), ("positions", np.int32))))
            segment, names, wanted = left["segment"][0].as_py(), right["phrase"].to_pylist(), right["terms"].to_pylist()
            hit = np.zeros(int(starts[-1] + lengths[-1]) + 2, np.int32)
            for n in {len(w) for w in wanted}:
                which = [k for k, w in enumerate(wanted) if len(w) == n]
                at, able = lists.places(np.array([wanted[k] for k in which], np.int64))
                for i in np.flatnonzero(able).tolist():
                    found = lists.phrase(at[i]) if slop is None else lists.near(at[i], slop, starts, lengths)
                    if not len(found):
                        continue
                    doc = np.searchsorted(starts, found, "right") - 1
                    if slop is None:
                        np.add.at(hit, found, 1)
                        np.add.at(hit, found + n, -1)
                        places, where = np.unique(doc).tolist(), None
                    else:
                        places, where = doc.tolist(), found.tolist()
                    none = [None] * len(places)
                    for c, x in zip(cols, ([segment] * len(places), places, none, none, [names[which[i]]] * len(places), where or none)):
                        c += x
            edges = np.diff((np.cumsum(hit) > 0).astype(np.int8), prepend=0)
            begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            none = [None] * len(begins)
            for c, x in zip(cols, ([segment] * len(begins), (np.searchsorted(starts, begins, "right") - 1).tolist(), begins.tolist(), ends.tolist(), none, none)):
                c += x
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], ["segment", "place", "begin", "end", "phrase", "at"])

    out = cut(parts.groupBy("segment", "part").cogroup(asked.groupBy("segment", "part")).applyInArrow(intersect, "segment bigint, place bigint, begin bigint, end bigint, phrase binary, at bigint"))
    met = out.where("phrase is not null").select("segment", "place", "phrase", "at")
    often = met.groupBy("phrase").agg(F.count("*").alias("n"))
    named = windows.select("phrase", "item").join(often, "phrase")
    matches = hot_join(met, named, ["phrase"], "n", met.count(), ["segment", "place"]).select("segment", "place", "at", "item")
    zipped = F.arrays_zip(F.col("ids").alias("id"), F.col("tks").alias("tk"), F.col("lengths").alias("n_words"))
    listed = stored.where("bucket is null").select("segment", F.posexplode(zipped).alias("place", "d")).select("segment", F.col("place").cast("bigint").alias("place"), F.col("d.id").alias("id"), F.col("d.tk").alias("tk"), F.col("d.n_words").alias("n_words"))
    spans = out.where("begin is not null").groupBy("segment", "place").agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("spans"))
    none = F.struct(F.lit(0).cast("bigint").alias("end"), F.lit(0).cast("bigint").alias("n"))
    covered = F.aggregate("spans", none, lambda done, x: F.struct(F.greatest(done["end"], x["end"]).alias("end"), (done["n"] + F.greatest(F.lit(0), x["end"] - F.greatest(x["begin"], done["end"]))).alias("n")))
    return listed, spans.select("segment", "place", covered["n"].alias("n_hit")), matches


def judged(documents: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, share: int = SHARE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """Per document: id, tk (its text's key), n_words, n_hit, n_items, items (array, sorted as strings), contaminated.

    A word is hit inside any occurrence of a window. Contaminated: at least one in `share` words is hit.
    """
    docs, hits, matches = _found(documents, benchmark, window, None, id_col, text_col, item_col)
    items = matches.distinct().groupBy("segment", "place").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_set("item")).alias("items"))
    dirty = (F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))
    out = docs.join(hits.join(items, ["segment", "place"], "left"), ["segment", "place"], "left").withColumn("n_hit", F.coalesce("n_hit", F.lit(0)).cast("bigint"))
    return out.select("id", "tk", "n_words", "n_hit", F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), dirty.alias("contaminated"))


def contamination(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items (array, sorted as strings), contaminated. Options as for judged()."""
    return judged(documents, benchmark, id_col=id_col, **options).drop("tk").withColumnRenamed("id", id_col)


def proximity(documents: DataFrame, benchmark: DataFrame, *, terms: int = 5, slop: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(id, item_id as string, n_places): places in a document where `terms` consecutive words of an item lie, in any order,
    at most `slop` words from the rarest of them. Same cases as contamination()."""
    docs, _, matches = _found(documents, benchmark, terms, slop, id_col, text_col, item_col)
    found = matches.groupBy("segment", "place", "item").agg(F.count_distinct("at").alias("n_places"))
    return docs.join(found, ["segment", "place"]).select(F.col("id").alias(id_col), F.col("item").alias(item_col), "n_places")


def items_digest(items) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def op8(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = contamination(documents, benchmark)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated")


def decontaminate(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    key = fresh("_text_key", documents)
    dirty = judged(documents, benchmark, id_col=id_col, text_col=text_col, **options).where("contaminated").select(F.col("id").alias(fresh("_dirty_id", documents)), F.col("tk").alias(fresh("_dirty_key", documents))).distinct()
    docs = documents.withColumn(key, text_key(F.col(text_col)))
    return docs.join(dirty, F.col(id_col).eqNullSafe(F.col(dirty.columns[0])) & (F.col(key) == F.col(dirty.columns[1])), "left_anti").drop(key)


ORACLE_SQL = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bg AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + 12], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
dg AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM bg) WHERE len(w) >= n)),
m AS (SELECT r, i, n, item_id FROM dg JOIN bg USING (n, g)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM m)) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""
