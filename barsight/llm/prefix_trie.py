"""Prefix trie of conversations, as the Cartesian tree over the LCP array of the sorted ones.

1. Turns become digests (128 bits of SHA-256 over role and text) and word counts; a conversation is the text of its digests in
   order, so that text order is an order by turns with prefixes first. Equal conversations meet in runs: ids travel as chunks of
   ascending ids, a chunk per run of a sorted partition, and the hash of a group's ids takes in one chunk after the other.
2. Distinct sequences are range-partitioned and sorted; a partition is a block. LCP[i] counts the turns that sequence i shares
   with the one before it, across block borders too.
3. All nearest smaller values: each block finds, with a stack, the nearest smaller LCP on both sides of each of its places.
   What stays open goes to the nearest block whose minimum is smaller, found in the list of block minima, and there to the place in
   its chain of suffix (or prefix) minima. Places of equal LCP between the same smaller neighbours are one node.
4. A node spans sequences [l, r). Counts and sums over it are differences of running sums at its ends; its smallest id is the
   stack's inside a block, else the least of a suffix, of whole blocks and of a prefix. Depths between a node and its parent are
   expanded last.

The driver sees a few numbers for each block, as many as partitions. A block's numbers, not its texts, are held by one task. One
conversation is one record: its digests (32 characters a turn) and word counts must fit a task.

Cases: turns are ordered by turn, null first, then role, then text, so repeated turns stay and ties have one order; a null role or text is
empty; rows without conv_id belong to no conversation and count nowhere; an empty table has no nodes, not even a root; long texts
are hashed where they are read. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, hot_join

#: Characters of a turn in a sequence's text; ids of a chunk.
TURN, CHUNK = 32, 4096
NOTHING = hashlib.sha256().hexdigest()
RESULT = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def numbered_turns(convs: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's (place, digest, tokens) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = convs.where("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text"))
    digest = F.substring(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256), 1, TURN)
    tokens = F.size(F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")).cast("bigint")
    turns = rows.select("conv_id", F.struct(place.alias("place"), digest.alias("digest"), tokens.alias("tokens")).alias("turn"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))


def rebuilt(convs: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """(conv_id, turns): the first h turns of the group's first conversation, then those after the first h of one's own."""
    own = numbered_turns(convs)
    heads = own.where(F.col("conv_id") % group == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, most - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    both = own.withColumn("h", h).join(heads, F.col("conv_id") - F.col("conv_id") % group == F.col("base"), "left")
    first = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).otherwise(F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(first, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def _shared(a: str, b: str) -> int:
    """Turns that two sequences share at their start."""
    lo, hi = 0, min(len(a), len(b)) // TURN
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a.startswith(b[: mid * TURN]):
            lo = mid
        else:
            hi = mid - 1
    return lo


def _chunks(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Runs of equal sequences in a sorted partition, at most so many ids a row."""
    now, ids, tokens = None, [], None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"key": now, "lo": ids[0], "n": len(ids), "ids": ",".join(map(str, ids)), "tokens": tokens}], schema)

    schema = pa.schema([("key", pa.string()), ("lo", pa.int64()), ("n", pa.int64()), ("ids", pa.string()), ("tokens", pa.list_(pa.int64()))])
    for b in batches:
        keys, convs, counts = b.column(0), b.column(1).to_pylist(), b.column(2)
        for k, (key, conv) in enumerate(zip(keys.to_pylist(), convs)):
            if key != now or len(ids) >= most:
                if ids:
                    yield out()
                now, ids, tokens = key, [], counts[k].as_py()
            ids.append(conv)
    if ids:
        yield out()


SEQUENCES = "block int, i bigint, key string, size bigint, lcp bigint, conv_id bigint, n bigint, ends string, upto array<bigint>"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct sequences of a block in order, from their chunks; upto counts words up to each depth, from depth 0."""
    block, i, now, before = TaskContext.get().partitionId(), 0, None, None
    names = [f.split()[0] for f in SEQUENCES.split(", ")]

    def done() -> dict:
        lcp = None if before is None else _shared(before, now["key"])
        return {"block": block, "i": i, "key": now["key"], "size": len(now["key"]) // TURN, "lcp": lcp, "conv_id": now["lo"], "n": now["n"], "ends": now["sha"].hexdigest(), "upto": now["upto"]}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
        return pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(names, kinds))))

    for b in batches:
        rows = []
        for r in b.to_pylist():
            if now is not None and r["key"] == now["key"]:
                now["n"] += r["n"]
                now["sha"].update(b"," + r["ids"].encode())
                continue
            if now is not None:
                rows.append(done())
                before, i = now["key"], i + 1
            now = {"key": r["key"], "lo": r["lo"], "n": r["n"], "sha": hashlib.sha256(r["ids"].encode()), "upto": np.concatenate(([0], np.cumsum(r["tokens"] or [0], dtype=np.int64)[: len(r["tokens"])])).tolist()}
        yield batch(rows)
    if now is not None:
        yield batch([done()])


def sorted_sequences(conversations: DataFrame) -> DataFrame:
    """SEQUENCES of (conv_id, turns), in sorted order by (block, i); lcp is null at a block's start."""
    most = CHUNK
    keyed = conversations.select(F.array_join(F.transform("turns", lambda x: x["digest"]), "").alias("key"), "conv_id", F.col("turns.tokens").alias("tokens"))
    runs = keyed.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda batches: _chunks(batches, most), "key string, lo bigint, n bigint, ids string, tokens array<bigint>")
    return runs.repartitionByRange("key").sortWithinPartitions("key", "lo").mapInArrow(_sequences, SEQUENCES)


def _borders(seqs: DataFrame) -> DataFrame:
    """(block, start, border, size_before): of each block the place of its first sequence, and LCP and size across its border."""
    ends = seqs.groupBy("block").agg(F.min_by("key", "i").alias("first"), F.max_by("key", "i").alias("last"), F.count("*").alias("n"))
    # A row for each partition, so one task may order them.
    w = W.orderBy("block")
    ends = ends.select("block", "first", F.lag("last").over(w).alias("before"), (F.sum("n").over(w) - F.col("n")).alias("start"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(1).to_pylist(), b.column(2).to_pylist())
            shared = [(-1, -1) if y is None else (_shared(y, x), len(y) // TURN) for x, y in pairs]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), pa.array([s for s, _ in shared], pa.int64()), pa.array([n for _, n in shared], pa.int64())], ["block", "start", "border", "size_before"])

    return ends.mapInArrow(compare, "block int, start bigint, border bigint, size_before bigint")


PLACES = "block int, pos bigint, lcp bigint, size bigint, conv_id bigint, n bigint, ends string, upto array<bigint>, fresh bigint, cum_n bigint, cum_words bigint, cum_fresh bigint, cum_more bigint, least_from bigint, least_before bigint, rep bigint, same bigint, l bigint, r bigint, least bigint, in_suffix boolean, in_prefix boolean"


def _nearest(key: tuple, table: pa.Table) -> pa.Table:
    """A block's places with what they need of each other: running sums before the place, least ids from and before it, and, at the
    first place of each local node (rep = pos), how many places it merges, its nearest smaller places and its least id."""
    table = table.sort_by("i")
    n = table.num_rows
    start, border, size_before = (table[c][0].as_py() for c in ("start", "border", "size_before"))
    lcp = table["lcp"].to_numpy(zero_copy_only=False).astype(float)
    lcp[0] = border
    lcp = lcp.astype(np.int64)
    size, conv, count = (table[c].to_numpy() for c in ("size", "conv_id", "n"))
    upto = table["upto"].to_pylist()
    words = np.array([u[-1] for u in upto], np.int64)
    fresh = words - np.array([u[max(v, 0)] for u, v in zip(upto, lcp.tolist())], np.int64)
    # The place before is a prefix of this one, so it has children.
    more = (lcp == np.concatenate(([size_before], size[:-1]))) & (lcp >= 0)
    before = lambda x: np.cumsum(x) - x

    v, ids = lcp.tolist(), conv.tolist()
    rep, same, left, right, least, last = list(range(n)), [1] * n, [None] * n, [None] * n, [None] * n, list(range(n))
    stack: list[int] = []
    for i in range(n):
        low = None  # the least id of what ends here
        while stack and v[stack[-1]] > v[i]:
            j = stack.pop()
            right[j] = i
            low = least[j] if low is None else min(low, least[j])
            if stack:
                least[stack[-1]] = min(least[stack[-1]], least[j])
        if stack and v[stack[-1]] == v[i]:
            j = stack[-1]
            rep[i], same[j], last[j] = j, same[j] + 1, i
        else:
            if stack:
                left[i] = last[stack[-1]]
                low = ids[left[i]] if low is None else min(low, ids[left[i]])
            least[i] = ids[i] if low is None else low
            stack.append(i)
        least[stack[-1]] = min(least[stack[-1]], ids[i])
    place = lambda xs: pa.array([None if x is None else x + start for x in xs], pa.int64())
    from_here = np.minimum.accumulate(conv[::-1])[::-1]
    so_far = np.minimum.accumulate(conv)
    suffix = np.concatenate((np.minimum.accumulate(lcp[::-1])[::-1][1:], [np.iinfo(np.int64).max])) > lcp
    prefix = np.concatenate(([np.iinfo(np.int64).max], np.minimum.accumulate(lcp)[:-1])) > lcp
    columns = [table["block"], pa.array(np.arange(n) + start), lcp, table["size"], table["conv_id"], table["n"], table["ends"], table["upto"], fresh, before(count), before(count * words), before(fresh), np.cumsum(more), from_here, pa.array([None, *so_far[:-1].tolist()], pa.int64()), place(rep), pa.array(same, pa.int64()), place(left), place(right), pa.array(least, pa.int64()), suffix, prefix]
    return pa.table(columns, names=[f.split()[0] for f in PLACES.split(", ")])


def trie(conversations: DataFrame) -> DataFrame:
    """A row per node (RESULT) of the trie of (conv_id, turns), turns being (place, digest, tokens) in order."""
    spark = conversations.sparkSession
    seqs = cut(sorted_sequences(conversations))
    rows = seqs.drop("key").join(F.broadcast(_borders(seqs)), "block")
    places = cut(rows.groupBy("block").applyInArrow(_nearest, PLACES))
    # A row for each block.
    totals = places.groupBy("block").agg(F.count("*"), F.min("lcp"), F.min("conv_id"), F.sum("n"), F.sum(F.col("n") * F.element_at("upto", -1)), F.sum("fresh"), F.max("cum_more"), F.min("pos")).orderBy("block").collect()
    if not totals:
        return spark.createDataFrame([], ", ".join(f"{c} {'string' if c == 'ends_sha256' else 'bigint'}" for c in RESULT))
    blocks = [t[0] for t in totals]
    number = {b: k for k, b in enumerate(blocks)}
    minima, ids = np.array([t[2] for t in totals]), np.array([t[3] for t in totals])
    cums = np.array([t[4:8] for t in totals], np.int64)
    ends, cums = cums.sum(axis=0), np.cumsum(cums, axis=0) - cums
    m = sum(t[1] for t in totals)
    base = spark.createDataFrame([(b, *map(int, c)) for b, c in zip(blocks, cums)], "block int, b_n bigint, b_words bigint, b_fresh bigint, b_more bigint")
    at = places.join(F.broadcast(base), "block").withColumns({"cum_n": F.col("cum_n") + F.col("b_n"), "cum_words": F.col("cum_words") + F.col("b_words"), "cum_fresh": F.col("cum_fresh") + F.col("b_fresh"), "cum_more": F.col("cum_more") + F.col("b_more")})

    # Local nodes; those that reach over a border ask the nearest block with a smaller minimum.
    local = places.where("rep = pos and pos > 0").select("pos", "block", "lcp", "same", "l", "r", "least")
    closed = local.where("l is not null and r is not null")

    def targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lb, rb = [], []
            for block, v, l, r in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(4).to_pylist(), b.column(5).to_pylist()):
                k = number[block]
                smaller = np.flatnonzero(minima < v)
                lb.append(blocks[smaller[np.searchsorted(smaller, k) - 1]] if l is None else None)
                after = np.searchsorted(smaller, k, "right")
                rb.append(blocks[smaller[after]] if r is None and after < len(smaller) else None)
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(lb, pa.int32()), pa.array(rb, pa.int32())], ["pos", "block", "lcp", "same", "l", "r", "lb", "rb"])

    open_ = local.where("l is null or r is null").drop("least").mapInArrow(targets, "pos bigint, block int, lcp bigint, same bigint, l bigint, r bigint, lb int, rb int")
    chain = lambda flag, name, col: places.where(flag).groupBy(F.col("block").alias(name)).agg(F.collect_list(F.struct("lcp", "pos")).alias(col))
    open_ = open_.join(chain("in_suffix", "lb", "suffix"), "lb", "left").join(chain("in_prefix", "rb", "prefix"), "rb", "left")
    reach = lambda col, pick: pick(F.transform(F.filter(col, lambda c: c["lcp"] < F.col("lcp")), lambda c: c["pos"]))
    open_ = open_.select("pos", "lcp", "same", F.coalesce("l", reach("suffix", F.array_max)).alias("l"), F.coalesce("r", reach("prefix", F.array_min), F.lit(m)).alias("r"))
    open_ = cut(open_)
    merged = open_.groupBy("l", "r").agg(F.min("pos").alias("node"), F.max("lcp").alias("v"), F.sum("same").alias("same"))
    alias = open_.select(F.col("pos").alias("rep"), "l", "r").join(merged.select("l", "r", "node"), ["l", "r"]).select("rep", "node")
    single = places.select((-F.col("pos") - 1).alias("node"), F.col("pos").alias("l"), (F.col("pos") + 1).alias("r"), F.col("size").alias("v"), F.lit(0).cast("bigint").alias("same"), F.col("conv_id").alias("least"))
    nodes = closed.select(F.col("pos").alias("node"), "l", "r", F.col("lcp").alias("v"), "same", "least").unionByName(merged.withColumn("least", F.lit(None).cast("bigint"))).unionByName(single)

    # Ends: the place l, and the place r after the last.
    keep = ("block", "lcp", "rep", "cum_n", "cum_words", "cum_fresh", "cum_more")
    left = at.select(F.col("pos").alias("l"), *[F.col(c).alias(f"l_{c}") for c in keep], "size", "ends", "upto", "fresh", "least_from")
    right = at.select(F.col("pos").alias("r"), *[F.col(c).alias(f"r_{c}") for c in keep], "least_before")
    full = {"lcp": -1, "cum_n": int(ends[0]), "cum_words": int(ends[1]), "cum_fresh": int(ends[2]), "cum_more": int(ends[3])}
    joined = nodes.join(left, "l").join(right, "r", "left").withColumns({f"r_{c}": F.coalesce(f"r_{c}", F.lit(x)) for c, x in full.items()})
    above = F.greatest("l_lcp", "r_lcp")
    joined = joined.withColumn("u", above).where("v > u")
    joined = joined.withColumn("rep", F.when(F.col("u") >= 0, F.when(F.col("l_lcp") >= F.col("r_lcp"), F.col("l_rep")).otherwise(F.col("r_rep"))))
    joined = joined.join(alias.withColumnRenamed("node", "parent"), "rep", "left").withColumn("parent", F.coalesce("parent", "rep"))
    n = F.col("r_cum_n") - F.col("l_cum_n")
    joined = joined.select("node", "parent", "u", "v", "least", "least_from", "least_before", "l_block", "r_block", "same", "size", "ends", "upto", n.alias("n_convs"), (F.col("r") - F.col("l") - (F.col("r_cum_more") - F.col("l_cum_more"))).alias("n_leaves"), (F.col("r_cum_words") - F.col("l_cum_words") - (F.col("r_cum_fresh") - F.col("l_cum_fresh") - F.col("fresh")) - F.element_at("upto", -1)).alias("words"))

    def with_least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The least id of nodes that reach over a border: of a suffix, of whole blocks and of a prefix."""
        for b in batches:
            out = []
            for least, suffix, prefix, lb, rb in zip(*(b.column(k).to_pylist() for k in range(1, 6))):
                if least is None:
                    whole = ids[number[lb] + 1 : len(ids) if rb is None else number[rb]]
                    least = min([suffix, *([] if prefix is None else [prefix]), *([int(whole.min())] if len(whole) else [])])
                out.append(least)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["node", "conv_id"])

    joined = cut(joined)
    asked = joined.where("least is null").select("node", "least", "least_from", "least_before", "l_block", "r_block")
    joined = joined.join(asked.mapInArrow(with_least, "node bigint, conv_id bigint"), "node", "left").withColumn("conv_id", F.coalesce("conv_id", "least"))
    joined = cut(joined.drop("least", "least_from", "least_before", "l_block", "r_block"))
    # A node may have a third of all nodes as children.
    parents = joined.where("node > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("above"), (F.col("same") + 1).alias("children"))
    total = joined.count()
    joined = hot_join(joined, parents, ["parent"], "children", total, ["node"], "left")
    d, last = F.col("depth"), F.col("depth") == F.col("v")
    upto = F.when(d > 0, F.element_at("upto", F.greatest(d, F.lit(1)).cast("int"))).otherwise(0)
    ended = last & (F.col("size") == F.col("v"))
    out = joined.withColumn("depth", F.explode(F.sequence(F.col("u") + 1, F.col("v"))))
    return out.select("conv_id", "depth", F.when(d > F.col("u") + 1, F.col("conv_id")).when(d > 0, F.col("above")).alias("parent_conv_id"), "n_convs", F.when(~last, 1).when(F.col("node") < 0, 0).otherwise(F.col("same") + 1 - ended.cast("int")).cast("bigint").alias("n_children"), "n_leaves", (F.col("words") - (F.col("n_convs") - 1) * upto).alias("saved_tokens"), F.when(ended, F.col("ends")).otherwise(NOTHING).alias("ends_sha256"))


def op13(convs: DataFrame) -> DataFrame:
    return trie(rebuilt(convs))


ORACLE_SQL = """WITH t AS (SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS s, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT DISTINCT conv_id, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT) AS bytes FROM t),
c AS (SELECT conv_id, xor(list_reduce(list_prepend(4294967295, bytes), lambda c, y: list_reduce([xor(c, y), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 4 AS h FROM b),
rb AS (SELECT c.conv_id, pos, s FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 20 AND pos <= h UNION ALL SELECT c.conv_id, pos, s FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
q AS (SELECT c.conv_id, coalesce(list(s ORDER BY pos) FILTER (s IS NOT NULL), []) AS seq FROM c LEFT JOIN rb ON rb.conv_id = c.conv_id GROUP BY c.conv_id),
p AS (SELECT conv_id, seq, d FROM q, unnest(range(0, len(seq) + 1)) z(d)),
n AS (SELECT seq[1:d] AS node, d, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(seq) = d), '')) AS ends_sha256 FROM p GROUP BY ALL),
k AS (SELECT node[1:d - 1] AS up, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN d > 0 THEN (n_convs - 1) * len(regexp_extract_all(node[d].x, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS own FROM n LEFT JOIN k ON k.up = n.node),
a AS (SELECT node[1:e] AS up, sum((n_children = 0)::INT) AS n_leaves, sum(own) AS saved FROM f, unnest(range(0, d + 1)) z(e) GROUP BY ALL)
SELECT f.conv_id, f.d::BIGINT AS depth, g.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, f.ends_sha256 FROM f JOIN a ON a.up = f.node LEFT JOIN n g ON f.d > 0 AND g.node = f.node[1:f.d - 1]"""
