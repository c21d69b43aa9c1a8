"""Embedding near-dedup on an inverted multi-index (after Babenko and Lempitsky, 2012).

Two codebooks, one for each half of the unit vectors, form a grid of cells; every vector is stored under its label in the cell
of its halves' nearest codewords. A cosine of `threshold` is a squared distance of 2 - 2 * threshold. A query sorts each half's
codewords by a lower bound of its squared distance to what they hold (the triangle inequality with the least and greatest
distance of a codeword's vectors to it, and the planes between it and the query's nearest codewords); the multi-sequence
traversal visits the cells by the sum of both bounds, nearest first, and stops at the first sum beyond the threshold's
distance. What is left holds no link, so none is lost, whatever the data; what a visit finds is verified by cosine in double precision.

The grid only sets the cost. Of grids of 1, 4, 16... cells, up to PER_CELL vectors a cell, the one whose visits cost least on a
sample is taken: fine ones for clustered vectors, few large cells where the bounds exclude little and every query meets most
vectors of its label. Equal vectors of a label are one node. A cell of more than BLOCK nodes of a label is kept in several
blocks and its visitors in blocks of QUERY_BLOCK; each pair of blocks is a group of its own, so a hot cell spreads over tasks.
Tasks return per query its links in the block, and for every node met a node of its part of the links found there, so that all
links of a block stay joined; never pairs. A cosine within NEAR of the threshold is taken anew from the vectors
themselves by the SQL's formula, as products of rounded unit vectors miss pairs at the threshold itself.

Codebooks are fitted (Lloyd steps) on about SAMPLE vectors, chosen by a hash of their values; every vector is indexed.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null label, link with nothing
and are components of their own; vectors of different lengths never link; repeated rows are copies that link with each other;
a null id counts as a vector; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, cut, hot_join

#: RECALL is the least share of links to keep; the traversal keeps all.
THRESHOLD, RECALL = 0.93, 0.995
PER_CELL, MOST_CODES, SAMPLE, QUERIES, ROUNDS, BLOCK, QUERY_BLOCK = 32, 1024, 20_000, 128, 12, 4096, 16_384
#: A visit costs about as much as so many comparisons. Planes to so many nearest codewords bound a query's distances.
VISIT_PAIRS, PLANES = 2000, 8
#: Taken off each bound for rounding, and the least distance of two codewords that have a plane.
SLACK, APART = 1e-6, 1e-3
#: Cosines of unit vectors this close to the threshold are computed anew, so many pairs at once.
NEAR, PAIRS = 1e-9, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """At most k codewords by Lloyd steps from evenly spaced sample points."""
    distinct = np.unique(x, axis=0)
    words = distinct[np.linspace(0, len(distinct) - 1, min(k, len(distinct))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, words)
        counts = np.bincount(near, minlength=len(words))
        sums = np.zeros_like(words)
        np.add.at(sums, near, x)
        words[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return words


def squares(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ words.T + (words * words).sum(axis=1), 0)


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return squares(x, words).argmin(axis=1)


class Bounds:
    """What the codewords of a half hold: least and greatest distance to each; a word that holds nothing is never visited."""

    def __init__(self, words: np.ndarray, least: np.ndarray, most: np.ndarray) -> None:
        self.words, self.least, self.most = words, least, most
        gaps = np.sqrt(squares(words, words))
        self.gaps = np.where(gaps > APART, 2 * gaps, np.inf)

    def below(self, x: np.ndarray) -> np.ndarray:
        """[i, k]: a lower bound of the squared distance of x[i] to all that codeword k holds."""
        square = squares(x, self.words)
        d = np.sqrt(square)
        low = np.maximum(d - self.most, self.least - d)
        for near in np.argsort(square, axis=1)[:, :PLANES].T:
            low = np.maximum(low, (square - np.take_along_axis(square, near[:, None], 1)) / self.gaps[near])
        return np.maximum(low - SLACK, 0) ** 2


def traverse(first: list[float], second: list[float], reach: float) -> Iterator[tuple[int, int]]:
    """The multi-sequence algorithm over two ascending lists: places (i, j) in the order of first[i] + second[j], up to reach.

    A place enters the frontier once its neighbours before it, (i - 1, j) and (i, j - 1), have been visited, so the frontier
    holds at most one place a row and nothing beyond reach.
    """
    frontier, visited = [], [0] * len(first)

    def enter(i: int, j: int) -> None:
        if i < len(first) and j < len(second) and visited[i] == j and (not i or visited[i - 1] > j) and first[i] + second[j] <= reach:
            heapq.heappush(frontier, (first[i] + second[j], i, j))

    enter(0, 0)
    while frontier:
        _, i, j = heapq.heappop(frontier)
        yield i, j
        visited[i] = j + 1
        enter(i, j + 1)
        enter(i + 1, j)


def visits(x: np.ndarray, bounds: tuple[Bounds, Bounds], occupied: np.ndarray, threshold: float) -> Iterator[np.ndarray]:
    """Per vector the cells that may hold a vector with a cosine of at least `threshold`, those of the least bounds first."""
    half, codes, reach = x.shape[1] // 2, len(bounds[1].words), 2 - 2 * threshold + SLACK
    for first, second in zip(bounds[0].below(x[:, :half]), bounds[1].below(x[:, half:])):
        a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
        met = np.array(list(traverse(first[a].tolist(), second[b].tolist(), reach)), np.int64).reshape(-1, 2)
        found = a[met[:, 0]] * codes + b[met[:, 1]]
        yield found[occupied[found]].astype(np.int32)


def bounds_of(books: tuple[np.ndarray, np.ndarray], cell: np.ndarray, spans: np.ndarray) -> tuple[tuple[Bounds, Bounds], np.ndarray]:
    """Bounds and occupied cells from cells and their (least, most) distances in the first and in the second half."""
    out = []
    for words, at, k in ((books[0], cell // len(books[1]), 0), (books[1], cell % len(books[1]), 2)):
        least, most = np.full(len(words), np.inf), np.full(len(words), -np.inf)
        np.minimum.at(least, at, spans[:, k])
        np.maximum.at(most, at, spans[:, k + 1])
        out.append(Bounds(words, least, most))
    occupied = np.zeros(len(books[0]) * len(books[1]), bool)
    occupied[cell] = True
    return (out[0], out[1]), occupied


def distances(x: np.ndarray, books: tuple[np.ndarray, np.ndarray], cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each vector's halves to the codewords of its cell."""
    half = x.shape[1] // 2
    gap = x[:, :half] - books[0][cell // len(books[1])], x[:, half:] - books[1][cell % len(books[1])]
    return np.sqrt((gap[0] ** 2).sum(axis=1)), np.sqrt((gap[1] ** 2).sum(axis=1))


def grid(x: np.ndarray, labels: np.ndarray, total: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The codebooks whose visits cost least, judged on QUERIES of the sampled vectors x; whatever they are, nothing is lost."""
    half, most = x.shape[1] // 2, int(min(MOST_CODES, max(1, (total / PER_CELL) ** 0.5)))
    asked = np.linspace(0, len(x) - 1, min(QUERIES, len(x))).astype(int)
    best, least, codes = None, np.inf, 1
    while codes <= most:
        books = (kmeans(x[:, :half], codes), kmeans(x[:, half:], codes))
        cell = cells(x, books)
        d = distances(x, books, cell)
        bounds, occupied = bounds_of(books, cell, np.stack([d[0], d[0], d[1], d[1]], axis=1))
        cost = 0.0
        for q, found in zip(asked, visits(x[asked], bounds, occupied, threshold)):
            met = np.zeros(len(occupied), bool)
            met[found] = True
            cost += VISIT_PAIRS * len(found) + (met[cell] & (labels == labels[q])).sum() * (total / len(x))
        if cost > 4 * least:
            break
        if cost < least:
            best, least = books, cost
        codes *= 2
    return best


def cells(x: np.ndarray, books: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    half = x.shape[1] // 2
    return nearest(x[:, :half], books[0]) * len(books[1]) + nearest(x[:, half:], books[1])


def values(vectors: list[bytes]) -> np.ndarray:
    """The vectors, each by the power of two that brings its largest component to [0.5, 1): no square overflows or vanishes."""
    x = np.array([np.frombuffer(v, np.float64) for v in vectors])
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def units(vectors: list[bytes]) -> np.ndarray:
    x = values(vectors)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of x[i] and y[i]: sums in the order of components, one division by the product of both lengths."""
    dot, xx, yy = (np.cumsum(z, axis=1)[:, -1] for z in (x * y, x * x, y * y))
    return dot / (np.sqrt(xx) * np.sqrt(yy))


def linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """[i, j]: whether the cosine of x[i] and y[j] is at least the threshold."""
    unit_x, unit_y = (v / np.sqrt((v * v).sum(axis=1))[:, None] for v in (x, y))
    cosine = unit_x @ unit_y.T
    hit = cosine >= threshold
    a, b = np.nonzero(np.abs(cosine - threshold) <= NEAR)
    for at in range(0, len(a), PAIRS):
        i, j = a[at : at + PAIRS], b[at : at + PAIRS]
        hit[i, j] = cosines(x[i], y[j]) >= threshold
    return hit


class Parts:
    """Nodes joined link by link; `top` is the node that stands for a node's part."""

    def __init__(self, n: int) -> None:
        self.above = np.arange(n)

    def top(self, i: int) -> int:
        while self.above[i] != i:
            self.above[i] = self.above[self.above[i]]
            i = int(self.above[i])
        return i

    def join(self, js: np.ndarray) -> int:
        tops = [self.top(int(i)) for i in np.unique(self.above[js])]
        self.above[tops] = self.above[js] = min(tops)
        return min(tops)


def _sample(nodes: DataFrame, size: int, total: int, seed: int) -> DataFrame:
    """About `size` nodes by a hash; the nodes are distinct, so no value weighs more than once."""
    share = min(1.0, size / max(1, total))
    return nodes.where(F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(1_000_000)) < F.lit(int(np.ceil(share * 1_000_000))))


def _nodes(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, node, vector): node is a digest of label and vector, null if the row links with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, vectors = [], []
            for label, v in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                x = np.array([], np.float64) if label is None or not v or None in v else np.array(v, np.float64)
                ok = np.isfinite(x).all() and x.any()
                vectors.append((x + 0.0).tobytes() if ok else None)
                nodes.append(xxhash.xxh3_128_digest(f"{label}|".encode() + vectors[-1]) if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(nodes, pa.binary()), pa.array(vectors, pa.binary())], ["id", "label", "node", "vector"])

    base = df.select(F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    return base.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, label string, node binary, vector binary")


def _links(nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, root, links) of one vector length: node and root are linked, directly or by others; links of a node add up."""
    spark = nodes.sparkSession
    total = nodes.count()
    sample = _sample(nodes, SAMPLE, total, seed=3).select("label", "vector").toArrow()
    if not sample.num_rows:
        sample = nodes.limit(1).select("label", "vector").toArrow()
    books = grid(units(sample["vector"].to_pylist()), np.array(sample["label"].to_pylist(), object), total, threshold)
    sent_books = spark.sparkContext.broadcast(books)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = sent_books.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = units(part.column(2).to_pylist())
                cell = cells(x, books)
                first, second = distances(x, books, cell)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell, pa.int32()), pa.array(first), pa.array(second)], [*part.schema.names, "cell", "first", "second"])

    placed = cut(nodes.select("node", "label", "vector", "weight").mapInArrow(place, "node binary, label string, vector binary, weight bigint, cell int, first double, second double"))
    # At most a row for each cell of the grid.
    spans = placed.groupBy("cell").agg(F.min("first"), F.max("first"), F.min("second"), F.max("second")).toArrow()
    sent = spark.sparkContext.broadcast(bounds_of(books, spans.column(0).to_numpy(), np.stack([spans.column(k).to_numpy() for k in range(1, 5)], axis=1)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds, occupied = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                found = list(visits(units(part.column(2).to_pylist()), bounds, occupied, threshold))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.list_(pa.int32()))], [*part.schema.names, "visits"])

    placed = placed.drop("first", "second")
    asking = cut(placed.drop("cell").mapInArrow(visit, "node binary, label string, vector binary, weight bigint, visits array<int>"))
    visiting = asking.select("label", F.explode("visits").alias("cell"), "node", "vector", "weight")
    asks = visiting.groupBy("label", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("askers"))
    full = placed.groupBy("label", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).join(asks, ["label", "cell"])

    def dealt(rows: DataFrame, query: bool) -> DataFrame:
        """Each row in its own block of its side, once for every block of the other side."""
        own, other = ("askers", "blocks") if query else ("blocks", "askers")
        mine = F.pmod(F.xxhash64("node"), F.col(own)).cast("int")
        each = rows.join(full, ["label", "cell"]).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1))).withColumn("mine", mine)
        return each.select("label", "cell", F.col("other" if query else "mine").alias("block"), F.col("mine" if query else "other").alias("asker"), F.lit(query).alias("query"), "node", "vector", "weight")

    rows = dealt(placed, False).union(dealt(visiting, True))

    def compare(table: pa.Table) -> pa.Table:
        ask = table["query"].to_numpy()
        mine, theirs = table.filter(pa.array(~ask)), table.filter(pa.array(ask))
        out: tuple[list, list, list] = ([], [], [])
        if mine.num_rows and theirs.num_rows:
            base, names, weights = values(mine["vector"].to_pylist()), mine["node"].to_pylist(), mine["weight"].to_numpy()
            parts, met, via = Parts(len(names)), np.zeros(len(names), bool), []
            for at in range(0, theirs.num_rows, 2048):
                part = theirs.slice(at, 2048)
                hit = linked(values(part["vector"].to_pylist()), base, threshold)
                asking = part["node"].to_pylist()
                for i in np.flatnonzero(hit.any(axis=1)):
                    js = np.flatnonzero(hit[i])
                    js = js[[names[j] != asking[i] for j in js]]
                    if len(js):
                        met[js] = True
                        via.append(parts.join(js))
                        out[0].append(asking[i])
                        out[2].append(int(weights[js].sum()))
            out[1].extend(names[parts.top(i)] for i in via)
            # A least neighbour alone would lose links: on a path 1 - 3 - 4 - 2 that of 3 is 1 and that of 4 is 2.
            for j in np.flatnonzero(met):
                if parts.top(int(j)) != j:
                    out[0].append(names[j])
                    out[1].append(names[parts.top(int(j))])
                    out[2].append(0)
        return pa.table({"node": pa.array(out[0], pa.binary()), "root": pa.array(out[1], pa.binary()), "links": pa.array(out[2], pa.int64())})

    return rows.groupBy("label", "cell", "block", "asker").applyInArrow(compare, "node binary, root binary, links bigint")


def near_duplicates(df: DataFrame, *, threshold: float = THRESHOLD, recall: float = RECALL, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """One row per vector: id, n_links (other vectors of the label linked directly) and component_id (least id that links
    reach). Any recall is met, as no link is lost."""
    rows = cut(_nodes(df, id_col, vector_col, label_col))
    nodes = cut(rows.where("node is not null").groupBy("node").agg(F.first("label").alias("label"), F.first("vector").alias("vector"), F.count("*").alias("weight"), F.min("id").alias("least")))
    lengths = [r[0] for r in nodes.select(F.length("vector")).distinct().collect()]
    found = None
    for n in lengths:
        part = _links(nodes.where(F.length("vector") == n), threshold)
        found = part if found is None else found.union(part)
    if found is None:
        found = df.sparkSession.createDataFrame([], "node binary, root binary, links bigint")
    found = cut(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    joined = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = cut(nodes.select("node", "weight", "least").join(joined, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    known = hot_join(known, least, ["component"], "members", known.count(), ["node"]).select("node", "component_id", "weight", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    linked = hot_join(rows.where("node is not null").select("id", "node"), known, ["node"], "weight", rows.count(), ["id"]).select("id", "node", "component_id", "n_links")
    out = linked.union(rows.where("node is null").select("id", "node", F.col("id").alias("component_id"), F.lit(0).cast("bigint").alias("n_links")))
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def op10(embeddings: DataFrame) -> DataFrame:
    return near_duplicates(embeddings).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
u AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND a.n > 0 AND b.n > 0 AND len(a.e) = len(b.e)
      AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.vec_id) AS n_links, m.component_id, e.vec_id = m.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY a) m ON m.a = e.vec_id
"""
