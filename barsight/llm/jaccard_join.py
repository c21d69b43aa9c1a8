"""N-gram Jaccard self-join with Bayesian candidate pruning (after BayesLSH, Satuluri and Parthasarathy, 2012).

1. Texts with equal shingle sets are one node; copies are never paired with each other.
2. MinHash bands (BANDS of ROWS values) put nodes into buckets; the candidates are the pairs that share a bucket. A pair at the
   threshold of 0.8 shares none with a probability of (1 - 0.8^ROWS)^BANDS = 5e-6. Components of the buckets' ties only tell
   which nodes can meet at all.
3. A component of at most BLOCK nodes is one unit of work. A larger one is dealt out the cheaper way: bucket by bucket (buckets
   with equal nodes once), or as a whole in blocks. A unit of more than BLOCK nodes is compared in pairs of blocks, a task
   each. In a unit only pairs that share a bucket are candidates, and a pair counts in the first bucket that it shares, so it
   counts once.
4. Candidates' MinHash values are compared STEP at a time; a pair is dropped when, after m of n equal values, the posterior
   probability of a similarity of at least the threshold under a uniform prior, P(Bin(n + 1, t) <= m), falls below TOLERANCE.
5. The rest are verified exactly on the shingle sets. Tasks return a node's number of links and its least linked node within
   the block pair, never pairs, and classes are the components of these.

Shingles are five consecutive words (a shorter text is one shingle of all its words), by 64-bit hashes.

Cases: null and wordless texts have no shingles, link with nothing and are classes of their own; repeated rows are copies of
each other; a null id is kept and counts as a document, but never names a class unless all ids of the class are null; empty
tables give no rows; extra columns of any name do not matter to join() and stay in keep_one().
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, fresh, hot_join, text_key, words_of

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS, STEP, TOLERANCE = 40, 6, 24, 1e-7
HASHES = BANDS * ROWS
BLOCK = 2048
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str | None, memo: dict, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of k words."""
    words = words_of(text)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1) if len(h) else 0
    out = np.full(n, np.uint64(len(h) if len(h) < k else k), np.uint64)
    for j in range(min(k, len(h))):
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def minhash(x: np.ndarray) -> np.ndarray:
    """HASHES values of 32 bits; a long set is taken in pieces."""
    out = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(x), 256):
        part = x[at : at + 256, None]
        np.minimum(out, (part * _A + _B).min(axis=0), out=out)
    return (out >> np.uint64(32)).astype(np.uint32)


def bands_of(signatures: np.ndarray) -> np.ndarray:
    """[row, band]: the bucket of each signature in each band, as 64-bit numbers that differ between bands."""
    parts = signatures.reshape(-1, BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for r in range(ROWS):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(29))


def least_matches(threshold: float, tolerance: float = TOLERANCE, step: int = STEP) -> list[tuple[int, int]]:
    """(n, m): after n values a pair needs m equal ones at least to stay."""
    out = []
    for n in range(step, HASHES + 1, step):
        tail, m = 0.0, 0
        while m <= n:
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append((n, m))
    return out


def _sketches(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tk, node, buckets): node is a digest of the shingle set, null without one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                nodes, buckets = [], []
                for text in part.column(2).to_pylist():
                    x = shingles(text, memo)
                    if not len(x):
                        nodes.append(None)
                        buckets.append(None)
                        continue
                    nodes.append(xxhash.xxh3_128_digest(x.tobytes()))
                    buckets.append(bands_of(minhash(x))[0].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(nodes, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["id", "tk", "node", "buckets"])

    base = documents.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    return base.mapInArrow(run, f"id {documents.schema[id_col].dataType.simpleString()}, tk bigint, node binary, buckets array<bigint>")


class _Block:
    """Nodes of one block: signatures, and shingle sets as one array of numbers."""

    def __init__(self, table: pa.Table):
        self.nodes = table["node"].to_pylist()
        self.weights = table["weight"].to_numpy()
        self.signatures = np.array([np.frombuffer(s, np.uint32) for s in table["signature"].to_pylist()]).reshape(-1, HASHES)
        self.bands = bands_of(self.signatures)
        sets = [np.frombuffer(s, np.uint64) for s in table["shingles"].to_pylist()]
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))
        self.flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)


def linked_pairs(a: _Block, b: _Block, threshold: float, same: bool, band: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Places (i in a, j in b) of the pairs at the threshold that share a bucket, with i < j if a and b are the same block.
    In the bucket of a band only those that share no bucket of a band before."""
    needs = least_matches(threshold)
    vocabulary, numbers = np.unique(np.concatenate([a.flat, b.flat]), return_inverse=True)
    of_a, of_b = numbers[: len(a.flat)], numbers[len(a.flat) :]
    mask = np.zeros(len(vocabulary), bool)
    left, right = [], []
    for i in range(len(a.nodes)):
        js = np.arange(i + 1 if same else 0, len(b.nodes))
        small, large = np.minimum(a.sizes[i], b.sizes[js]), np.maximum(a.sizes[i], b.sizes[js])
        js = js[small >= threshold * large - 1e-9]
        shared = (b.bands[js, : band if band >= 0 else BANDS] == a.bands[i, : band if band >= 0 else BANDS]).any(axis=1)
        js = js[~shared if band >= 0 else shared]
        matches = np.zeros(len(js), np.int64)
        for n, m in needs:
            if not len(js):
                break
            matches += (b.signatures[js, n - STEP : n] == a.signatures[i, n - STEP : n]).sum(axis=1)
            stay = matches >= m
            js, matches = js[stay], matches[stay]
        if not len(js):
            continue
        own = of_a[a.starts[i] : a.starts[i + 1]]
        mask[own] = True
        sizes = b.sizes[js]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(b.starts[js] - ends + sizes, sizes)
        common = np.add.reduceat(mask[of_b[at]].astype(np.int64), ends - sizes)
        mask[own] = False
        js = js[common >= threshold * (a.sizes[i] + sizes - common) - 1e-9]
        left.append(np.full(len(js), i))
        right.append(js)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _compare(a: _Block, b: _Block, threshold: float, same: bool, band: int = -1) -> tuple[list[bytes], list[bytes], list[int]]:
    """(node, least node of its local component, links) of the nodes with links."""
    i, j = linked_pairs(a, b, threshold, same, band)
    nodes = a.nodes if same else a.nodes + b.nodes
    j = j if same else j + len(a.nodes)
    weights = a.weights if same else np.concatenate([a.weights, b.weights])
    links = np.bincount(i, weights[j], len(nodes)) + np.bincount(j, weights[i], len(nodes)) if len(i) else np.zeros(len(nodes))
    root = np.argsort(np.argsort(np.array(nodes, object))) if len(i) else np.zeros(0, np.int64)
    name = dict(zip(root.tolist(), nodes))
    while len(i):
        least = root.copy()
        np.minimum.at(least, i, root[j])
        np.minimum.at(least, j, root[i])
        if (least == root).all():
            break
        root = least
    with_links = np.flatnonzero(links)
    return [nodes[k] for k in with_links], [name[int(root[k])] for k in with_links], [int(links[k]) for k in with_links]


def _units(places: DataFrame, ties: DataFrame) -> DataFrame:
    """(unit, band, blocks, node) from (component, node): where each node of a component is compared. Band -1: all bands."""
    sized = cut(places.groupBy("component").agg(F.count("*").alias("size")))
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    large = sized.where(F.col("size") > BLOCK)
    whole = places.join(sized, "component").select(F.col("component").alias("unit"), F.lit(-1).alias("band"), blocks.alias("blocks"), "node")
    if large.isEmpty():
        return whole
    tied = cut(ties.join(hot_join(places, large, ["component"], "size", places.count(), ["node"]).select("component", "node"), "node").select("component", "bucket", "band", "node"))
    # Buckets with the same nodes are told by their number and two exclusive-or sums of hashes.
    sets = tied.groupBy("component", "bucket", "band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    sets = cut(sets.groupBy("component", "n", "x", "y").agg(F.min(F.struct("band", "bucket")).alias("b")).select("component", "n", "b.*"))
    cost = sets.groupBy("component").agg(F.sum(F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("cost"))
    cheap = cut(large.join(cost, "component").where(F.col("cost") < F.col("size") * F.ceil(F.col("size") / BLOCK)).select("component"))
    chosen = sets.join(cheap, "component").select("component", "bucket", "band", "n")
    dealt = hot_join(tied, chosen, ["component", "bucket", "band"], "n", tied.count(), ["node"])
    dealt = dealt.select(F.concat("component", F.encode(F.concat_ws("/", F.lit(""), "band", "bucket"), "UTF-8")).alias("unit"), "band", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"), "node")
    return whole.join(cheap.select(F.col("component").alias("unit")), "unit", "left_anti").union(dealt)


def _links(members: DataFrame, ties: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) from (component, node, weight, text) of candidate components and (node, band, bucket)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingles(t, memo) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([minhash(x).tobytes() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], ["node", "weight", "signature", "shingles"])

    groups = max(1, members.count() // 400)
    sketched = cut(members.select("node", "weight", "text").mapInArrow(sketch, "node binary, weight bigint, signature binary, shingles binary"))
    units = cut(_units(members.select("component", "node"), ties))
    # A unit of one block shares a group with others; a larger one has a group for each pair of its blocks.
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = F.when(F.col("blocks") == 1, F.array(F.struct(F.lit(-1).alias("i"), F.lit(-1).alias("j")))).otherwise(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j"))))
    units = units.withColumn("own", own).withColumn("pair", F.explode(pairs))
    group = F.when(F.col("pair.i") < 0, F.pmod(F.xxhash64("unit"), F.lit(groups)).cast("string")).otherwise(F.concat_ws("/", F.hex("unit"), "pair.i", "pair.j"))
    dealt = units.select(group.alias("group"), "unit", "band", F.col("pair.i").alias("i"), F.col("pair.j").alias("j"), "own", "node").join(sketched, "node")

    def compare(table: pa.Table) -> pa.Table:
        found: tuple[list, list, list] = ([], [], [])
        first = table["i"][0].as_py()
        if first >= 0 and first != table["j"][0].as_py():
            side = table["own"].to_numpy() == first
            parts = [(_Block(table.filter(pa.array(side))), _Block(table.filter(pa.array(~side))), False, table["band"][0].as_py())]
        else:
            codes = np.array(table["unit"].combine_chunks().dictionary_encode().indices)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            picked = (table.take(pa.array(ix)) for ix in np.split(order, cuts) if len(ix) > 1)
            parts = ((b, b, True, t["band"][0].as_py()) for t in picked for b in (_Block(t),))
        for a, b, same, band in parts:
            for out, new in zip(found, _compare(a, b, threshold, same, band)):
                out += new
        return pa.table({"node": pa.array(found[0], pa.binary()), "root": pa.array(found[1], pa.binary()), "links": pa.array(found[2], pa.int64())})

    return cut(dealt.groupBy("group").applyInArrow(compare, "node binary, root binary, links bigint"))


def join(documents: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: _id, _tk (text key), class_id (least id of its class), n_links (other documents at the threshold
    or with equal shingles), _first (struct of the class's first document)."""
    sketches = cut(_sketches(documents, id_col, text_col))
    nodes = cut(sketches.where("node is not null").groupBy("node").agg(F.min(F.struct("id", "tk")).alias("first"), F.min("id").alias("least"), F.count("*").alias("weight")))
    keys = sketches.where("node is not null").select("id", "tk", "node", "buckets")
    reps = keys.join(nodes.select("node", "first"), "node").where(F.struct("id", "tk").eqNullSafe(F.col("first"))).dropDuplicates(["node"])
    ties = cut(reps.select("node", F.posexplode("buckets").alias("band", "bucket")))
    heads = ties.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
    candidates = components(hot_join(ties, heads, ["bucket"], "n", ties.count(), ["node"]).select(F.col("node").alias("a"), F.col("head").alias("b")).where("a <> b"))
    members = candidates.union(candidates.select(F.col("component").alias("node"), "component")).distinct()
    chosen = members.join(nodes, "node").select("node", "component", "weight", F.col("first.id").alias("_id"), F.col("first.tk").alias("_tk"))
    texts = documents.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    texts = texts.join(chosen, (F.col("tk") == F.col("_tk")) & F.col("id").eqNullSafe(F.col("_id"))).select("component", "node", "weight", "text").dropDuplicates(["node"])
    found = _links(cut(texts), ties, threshold)
    classes = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(classes, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    heads = known.groupBy("component").agg(F.min("least").alias("class_id"), F.min("first").alias("class_first"))
    known = known.join(heads, "component").select("node", "class_id", "class_first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    out = sketches.select("id", "tk", "node").join(known, "node", "left")
    alone = F.col("node").isNull()
    return out.select(F.col("id").alias("_id"), F.col("tk").alias("_tk"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(alone, F.struct("id", "tk")).otherwise(F.col("class_first")).alias("_first"))


def keep_one(documents: DataFrame, *, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first document of each class (least id, then text key), with its own columns. Of repeated rows one stays;
    other rows without shingles all stay."""
    found = join(documents, threshold=threshold, id_col=id_col, text_col=text_col)
    key = fresh("_text_key", documents)
    gone = found.where(~F.struct("_id", "_tk").eqNullSafe(F.col("_first"))).select(F.col("_id").alias(fresh("_gone_id", documents)), F.col("_tk").alias(fresh("_gone_key", documents))).distinct()
    docs = documents.withColumn(key, text_key(F.col(text_col)))
    kept = docs.join(gone, F.col(id_col).eqNullSafe(F.col(gone.columns[0])) & (F.col(key) == F.col(gone.columns[1])), "left_anti")
    return kept.dropDuplicates([id_col, key]).drop(key)


def op9(documents: DataFrame) -> DataFrame:
    return join(documents).select(F.col("_id").alias("doc_id"), "class_id", "n_links")
