"""Audit of five text filters: what each removes, repeats and alone decides, in each of their 120 orders.

The filters, with words as maximal runs of bytes other than ASCII white space: A under 100 words; B fewer than 80 distinct words in 100;
C more than 10 capitals A-Z in 100 characters; D any of # $ % & * |; E the text of a row with a smaller doc_id.

E is decided by fingerprints on an RDD. A map task keeps, for each xxhash of the texts it reads, a collision chain: the full texts
with that fingerprint, each with its least id so far. A row that is not the least of its text in its own task is no minimum anywhere
and is emitted at once, so of a text with a third of all rows at most one candidate a task (and flush) travels. Candidates are
partitioned by xxhash and sorted by it within each partition (the sort spills), and chains are resolved again one fingerprint at
a time: non-minimum ids are emitted as failing, the minimum as passing.

Each row is then a mask of the filters that it fails. combineByKey adds vectors of counts by mask (all rows, good rows, toxic rows)
for each language; from those 96 numbers every order's steps follow by arithmetic.

Cases: a null text is empty; it has no words, fails A and not B or C. A null lang is the empty part. A null doc_id is smaller and
larger than none, so such a row neither fails E nor makes others fail. Rows that share doc_id and text are counted each, none being
smaller than the other. A doc_id with several labels is good or toxic if any says so; one without labels is neither. An empty table
gives no parts. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby, permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bytes of text that a map task holds before it sends its candidates on; text of a partition of candidates.
HELD, PARTITION = 32 << 20, 64 << 20
_CAPITALS = bytes(range(65, 91))
_MARKS = re.compile(rb"[#$%&*|]")
_CONTINUED = bytes(range(0x80, 0xC0))
E_BIT = 16
SCHEMA = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"


def mask_of(text: bytes) -> int:
    """Bits 1, 2, 4, 8 for A to D."""
    words = text.split()  # bytes split at the six ASCII white spaces
    points = len(text.translate(None, _CONTINUED))
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    return (len(words) < 100) + 2 * (100 * len(set(words)) < 80 * len(words)) + 4 * (100 * capitals > 10 * points) + 8 * bool(_MARKS.search(text))


class Chains:
    """Fingerprint -> its full texts, each with the least id and the counts of rows (by part and mask) that have it."""

    def __init__(self) -> None:
        self.by_print: dict[int, list[list]] = {}
        self.bytes = 0

    def add(self, key: int, text: bytes, doc: int, rows: dict[tuple, int]) -> Iterator[tuple]:
        """Takes rows of one text and id; yields (doc_id, part, mask, n) of what is now known not to be the minimum."""
        chain = self.by_print.setdefault(key, [])
        for entry in chain:
            if entry[0] == text:
                if doc == entry[1]:
                    for k, n in rows.items():
                        entry[2][k] = entry[2].get(k, 0) + n
                    return
                if doc < entry[1]:
                    entry[1], doc, entry[2], rows = doc, entry[1], dict(rows), entry[2]
                for (part, mask), n in rows.items():
                    yield doc, part, mask | E_BIT, n
                return
        chain.append([text, doc, dict(rows)])
        self.bytes += len(text) + 200


def candidates(rows: Iterator[tuple], fingerprint=xxhash.xxh3_64_intdigest, held: int = HELD) -> Iterator[tuple]:
    """(None, settled row) and (fingerprint, (text, id, counts)) of a task's (doc_id, text, lang)."""
    chains = Chains()
    for doc, text, lang in rows:
        data = (text or "").encode("utf-8", "surrogatepass")
        part, mask = lang or "", mask_of(data)
        if doc is None:
            yield None, (None, part, mask, 1)
            continue
        for settled in chains.add(fingerprint(data), data, doc, {(part, mask): 1}):
            yield None, settled
        if chains.bytes >= held:
            for key, chain in chains.by_print.items():
                for entry in chain:
                    yield key, tuple(entry)
            chains = Chains()
    for key, chain in chains.by_print.items():
        for entry in chain:
            yield key, tuple(entry)


def resolved(pairs: Iterator[tuple]) -> Iterator[tuple]:
    """(doc_id, part, mask, n) of a partition's candidates, sorted by fingerprint: one chain is held at a time."""
    for key, same in groupby(pairs, key=lambda p: p[0]):
        chains = Chains()
        for _, (text, doc, rows) in same:
            yield from chains.add(key, text, doc, rows)
        for _, doc, rows in chains.by_print[key]:
            for (part, mask), n in rows.items():
                yield doc, part, mask, n


def failing(docs: DataFrame, fingerprint=xxhash.xxh3_64_intdigest, held: int = HELD) -> DataFrame:
    """(doc_id, part, mask, n): rows of documents by the filters that they fail, bit by bit."""
    spark = docs.sparkSession
    taken = docs.select("doc_id", "text", "lang")
    size = taken.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // PARTITION)

    def keyed(index: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        """Settled rows share the shuffle under keys below 0, dealt round."""
        for place, (key, row) in enumerate(candidates(rows, fingerprint, held), index * 7919):
            yield (-1 - place % 65_521 if key is None else key), row

    routed = taken.rdd.mapPartitionsWithIndex(keyed).repartitionAndSortWithinPartitions(n, partitionFunc=lambda key: key)

    def settled(pairs: Iterator[tuple]) -> Iterator[tuple]:
        for known, some in groupby(pairs, key=lambda p: p[0] < 0):
            yield from (row for _, row in some) if known else resolved(some)

    return spark.createDataFrame(routed.mapPartitions(settled), "doc_id bigint, part string, mask int, n bigint")


def mask_counts(failed: DataFrame, labels: DataFrame):
    """An RDD of (part, [3, 32] counts by mask: all rows, good ones, toxic ones)."""
    known = labels.groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    rows = failed.join(known, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("bad", F.lit(0)).alias("bad"))

    def add(counts: np.ndarray, row: tuple) -> np.ndarray:
        mask, n, good, bad = row
        counts[:, mask] += (n, n * good, n * bad)
        return counts

    pairs = rows.rdd.map(lambda r: (r[0], tuple(r[1:])))
    return pairs.combineByKey(lambda row: add(np.zeros((3, 32), np.int64), row), add, lambda a, b: a + b)


def steps(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: every order's five steps."""
    masks = np.arange(32)
    removed: dict[tuple, tuple] = {}  # by (filters before, filter)
    for before in range(32):
        for k in range(5):
            if not before >> k & 1:
                here = (masks >> k & 1 == 1) & (masks & before == 0)
                removed[before, k] = tuple(int(x) for x in counts[:, here].sum(axis=1))
    failed = [int(counts[0, masks >> k & 1 == 1].sum()) for k in range(5)]
    paths = []
    for order in ORDERS:
        before = 0
        for step, letter in enumerate(order, 1):
            k = FILTERS.index(letter)
            paths.append((order, step, k, before))
            before |= 1 << k
    shapley = [sum(removed[before, k][0] for _, _, k, before in paths if k == f) for f in range(5)]
    for order, step, k, before in paths:
        gone, good, toxic = removed[before, k]
        after = before | 1 << k
        yield part, order, step, int(counts[0, masks & after == 0].sum()), gone, failed[k] - gone, int(counts[0, 1 << k]), good, toxic, shapley[k]


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row per part, order and step, in SCHEMA."""
    found = mask_counts(failing(docs), labels)
    return docs.sparkSession.createDataFrame(found.flatMap(lambda x: steps(*x)), SCHEMA)


def op12(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(docs, labels)


ORACLE_SQL = r"""WITH w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
lb AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS bad FROM labels GROUP BY doc_id),
m AS (SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY text), false)::INT AS mask, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad FROM w LEFT JOIN lb ON lb.doc_id = w.doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM m GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
p AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM l a, l b, l c, l d, l e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s AS (SELECT filter_order, k AS step, bits[k] AS bit, coalesce(list_sum(bits[1:k - 1]), 0) AS before FROM p, range(1, 6) z(k)),
r AS (SELECT part, filter_order, step, s.bit, sum(n) FILTER (mask & (before + s.bit)::INT = 0) AS kept, sum(n) FILTER (mask & s.bit > 0 AND mask & before::INT = 0) AS removed, sum(n) FILTER (mask & s.bit > 0 AND mask & before::INT > 0) AS redundant, sum(n) FILTER (mask = s.bit) AS unique_fails, sum(good) FILTER (mask & s.bit > 0 AND mask & before::INT = 0) AS good_lost, sum(bad) FILTER (mask & s.bit > 0 AND mask & before::INT = 0) AS toxic_lost FROM c, s GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit)::BIGINT AS shapley FROM r"""
