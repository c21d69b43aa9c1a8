"""Exact substring dedup on a sparse suffix array built by a common-prefix-aware distributed merge sort.

Which bytes go. Texts are UTF-8 bytes; a byte goes if it lies in a string of LENGTH bytes that also starts anywhere else, in
any document. Strings are judged on the input and never cross documents.

1. Sparse suffixes. Every string of LENGTH bytes names as its anchor the least (leftmost of ties) of its first WINDOW hashes of
   GRAM bytes. Equal strings name anchors at equal offsets, so two equal strings meet in the suffixes of their anchors, which
   share HEAD = LENGTH - WINDOW + 1 bytes at least. About one place in WINDOW / 2 is an anchor.
2. Prefix filter. Anchors whose HEAD bytes have a unique hash are dropped. Anchors whose surroundings, WINDOW - 1 bytes before to
   LENGTH behind, have one digest are a class; if it has two members, all strings that name them are repeated. Classes are
   partial aggregates, and hot heads and classes are salted before joins.
3. Merge sort (after Bingmann, Sanders and Schimek, 2020). An anchor's key is its suffix and, behind it, what stands before it,
   read backwards. Tasks compare the keys of a class byte by byte, sort the distinct ones and exchange them as front-coded runs:
   the common prefix with the one before, and the rest. Splitters from a bounded sample of the keys deal the runs, so the
   receivers hold one sorted order. A receiver merges its runs with a loser tree that keeps each loser's common prefix with the
   winner that beat it and compares bytes only behind it; the merged order comes with its array of common prefixes.
4. Neighbours in that order that share r >= HEAD bytes and agree on l bytes before share all strings that start a bytes before
   the anchor, LENGTH - r <= a <= l. The spans go back to all members of the classes and are united per document.

A splitter is cut to HEAD bytes, so that neighbours stay together. Only where a head has more keys than a receiver takes do
further splitters divide it. The anchors that share bytes with a splitter on either side then go through a second pass, sorted
by what stands before them. Strings that both orders cut apart are made of the bytes that two splitters share, so few are left,
and these are compared by 128-bit BLAKE2b digests. Two keys of one class that differ are an error, never a silent match.

Cases: null and empty texts have no bytes, spans or removals; repeated rows are copies of each other; texts shorter than LENGTH
lose nothing; removal may cut a multi-byte character, so kept bytes need not be UTF-8 (kept_bytes is binary); an empty table
gives no rows; extra columns of any name are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_join, text_key

LENGTH, WINDOW, GRAM = 400, 320, 16
#: Distinct keys that a receiver gets on average, sampled keys for each splitter, and the most receivers: a bound for what
#: the driver samples. Beyond it receivers grow.
RECEIVED, SAMPLED, MOST_RECEIVERS = 20_000, 32, 4096
#: Bytes of suffixes that a task sorts at once into one run for each receiver.
RUN_BYTES = 48_000_000

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(7).integers(1, 2**63, 256, dtype=np.uint64)
_powers: list[np.ndarray] = []


def _tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, up to n at least."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        _powers[:] = []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers


class Hasher:
    """Hashes of any substrings of one text, vectorised over places."""

    def __init__(self, data: bytes):
        self.n = len(data)
        powers, self.inverse = _tables(self.n)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(_BYTES[np.frombuffer(data, np.uint8)] * powers[: self.n], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.inverse[begin])

    def grams(self, size: int) -> np.ndarray:
        return _mix((self.sums[size:] - self.sums[:-size]) * self.inverse[: self.n - size + 1])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def anchors(data: bytes, hasher: Hasher, length: int, window: int) -> np.ndarray:
    """Places that some string of `length` bytes names as its anchor."""
    v = (hasher.grams(GRAM) & ~np.uint64(0xFFFFFFF)) | np.arange(len(data) - GRAM + 1, dtype=np.uint64)
    size = 1
    while size * 2 <= window:
        v = np.minimum(v[:-size], v[size:])
        size *= 2
    if size < window:
        v = np.minimum(v[: len(v) - (window - size)], v[window - size :])
    return np.unique(v[: len(data) - length + 1] & np.uint64(0xFFFFFFF)).astype(np.int64)


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _anchor_rows(docs: DataFrame, length: int, window: int) -> DataFrame:
    """(id, tk, p, h, c1, c2), the last four arrays: anchors, hashes of their heads and of their surroundings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                cols: list[list] = [[], [], [], []]
                for text in part.column(2).to_pylist():
                    data = (text or "").encode()
                    if len(data) < length:
                        for c in cols:
                            c.append([])
                        continue
                    hasher = Hasher(data)
                    p = anchors(data, hasher, length, window)
                    digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[max(0, x - window + 1) : x + length], min(x, window - 1)) for x in p.tolist()), np.int64).reshape(-1, 2)
                    for c, x in zip(cols, (p.astype(np.int32), _signed(hasher.of(p, p + length - window + 1)), digests[:, 0], digests[:, 1])):
                        c.append(x)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cols[0], pa.list_(pa.int32())), *(pa.array(c, pa.list_(pa.int64())) for c in cols[1:])], ["id", "tk", "p", "h", "c1", "c2"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, tk bigint, p array<int>, h array<bigint>, c1 array<bigint>, c2 array<bigint>")


def common_prefix(a: bytes, b: bytes, begin: int = 0) -> int:
    """Length of the common prefix, known to be `begin` at least."""
    n = min(len(a), len(b)) - begin
    x, y = a[begin : begin + n], b[begin : begin + n]
    if x == y:
        return begin + n
    return begin + n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


class Run:
    """A sorted run, front-coded: prefixes[i] bytes are those of the key before. A label is (length of the first part, h, c1, c2).
    Keys and labels stay in Arrow's buffers until their turn."""

    def __init__(self, table: pa.RecordBatch):
        self.prefixes, self.rests, self.size = table.column(0).to_numpy(), table.column(1), table.num_rows
        self.columns = [table.column(k).to_numpy() for k in (2, 3, 4, 5)]
        self.at, self.current = 0, self.rests[0].as_py()

    def label(self) -> tuple[int, ...]:
        return tuple(int(c[self.at]) for c in self.columns)

    def advance(self) -> int | None:
        """Decodes the next key and returns its common prefix with the one before; None at the end."""
        self.at += 1
        if self.at == self.size:
            return None
        n = int(self.prefixes[self.at])
        self.current = self.current[:n] + self.rests[self.at].as_py()
        return n


def front_code(rows: list[tuple]) -> bytes:
    """A run from (key, length of the suffix, h, c1, c2) in order."""
    prefixes, rests, before = [], [], b""
    for r in rows:
        n = common_prefix(before, r[0])
        prefixes.append(n)
        rests.append(r[0][n:])
        before = r[0]
    batch = pa.RecordBatch.from_arrays([pa.array(prefixes, pa.int32()), pa.array(rests, pa.binary()), *(pa.array([r[k] for r in rows], pa.int64()) for k in (1, 2, 3, 4))], ["prefix", "rest", "suffix", "h", "c1", "c2"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, bytes, tuple]]:
    """(common prefix with the one before, key, label) in sorted order.

    The tree holds at each inner node the loser of the match there and `shared[run]`, its common prefix with the winner. Of two
    players that share different lengths with the last winner, the one that shares more is less; only at equal lengths are
    bytes compared, and only those behind.
    """
    k = 1
    while k < len(runs):
        k *= 2
    losers, shared, ended = [-1] * k, [0] * len(runs), [False] * len(runs)

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); -1 is an empty seat."""
        if a < 0 or (b >= 0 and ended[a]):
            return b, a
        if b < 0 or ended[b]:
            return a, b
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        x, y = runs[a].current, runs[b].current
        n = common_prefix(x, y, shared[a])
        if x[n : n + 1] <= y[n : n + 1]:
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    seats = [i if i < len(runs) else -1 for i in range(k)]
    level = seats
    base = k
    while len(level) > 1:
        base //= 2
        winners = []
        for i in range(0, len(level), 2):
            w, lost = play(level[i], level[i + 1])
            losers[base + i // 2] = lost
            winners.append(w)
        level = winners
    winner = level[0]
    while winner >= 0 and not ended[winner]:
        run = runs[winner]
        yield shared[winner], run.current, run.label()
        n = run.advance()
        if n is None:
            ended[winner] = True
        else:
            shared[winner] = n
        node = (k + winner) // 2
        while node:
            winner, losers[node] = play(winner, losers[node])
            node //= 2


def offsets(group: list[tuple[int, bytes, bytes, tuple]], length: int) -> list[list[tuple[int, int]]]:
    """Per suffix of a group (common prefix of the keys with the one before, suffix, reversed left, label) the ranges of a, ends
    included, whose strings another suffix of the group has too. In the second pass the two parts have changed places."""
    m = len(group)
    out: list[list[tuple[int, int]]] = [[] for _ in group]
    if m <= 24:
        for i in range(m):
            r = length
            for j in range(i + 1, m):
                r = min(r, group[j][0])
                if length - r > len(group[i][2]):
                    break
                low = length - min(r, len(group[i][1]), len(group[j][1]))
                l = common_prefix(group[i][2], group[j][2])
                if low <= l:
                    out[i].append((low, l))
                    out[j].append((low, l))
        return out
    # For each a the suffixes that share length - a bytes are a block of this order, and those that agree on a bytes before are
    # a block of the order by what stands before; a string is repeated where two suffixes are in the same two blocks. Blocks
    # change only at the a's below, so one round serves all a's up to the next change.
    shared = np.array([g[0] for g in group[1:]])
    room, reach = np.array([len(g[2]) for g in group]), np.array([len(g[1]) for g in group])
    lefts = [g[2] for g in group]
    order = np.array(sorted(range(m), key=lefts.__getitem__))
    agreed = np.array([common_prefix(lefts[x], lefts[y]) for x, y in zip(order, order[1:])])
    low = max(0, length - int(min(reach.max(), shared.max())))
    high = max(low - 1, int(min(room.max(), agreed.max())))
    found = np.zeros((m, high + 1 - low + 2), bool)
    block, before = np.zeros(m, np.int64), np.zeros(m, np.int64)
    changes = sorted({low} | {a for a in np.concatenate((length - shared, length - reach, agreed + 1, room + 1)).tolist() if low < a <= high})
    for a, behind in zip(changes, [*changes[1:], high + 1]):
        np.cumsum(shared < length - a, out=block[1:])
        before[order[1:]] = np.cumsum(agreed < a)
        able = np.flatnonzero((reach >= length - a) & (room >= a))
        both = block[able] * m + before[able]
        at = np.argsort(both)
        same = np.flatnonzero(both[at[1:]] == both[at[:-1]])
        found[able[at[np.concatenate((same, same + 1))]], a - low + 1 : behind - low + 1] = True
    for i in np.flatnonzero(found.any(axis=1)).tolist():
        edges = np.flatnonzero(found[i, 1:] != found[i, :-1]).tolist()
        out[i] = [(low + x, low + y - 1) for x, y in zip(edges[::2], edges[1::2])]
    return out


def open_lengths(group: list[tuple[int, bytes, bytes, tuple]], below: int, above: int, length: int) -> list[int]:
    """How many bytes each suffix of a group may share with suffixes of the receiver before or behind: `below` is the common
    prefix of the group's first key with the splitter before it, `above` of the last key with the one behind it, 0 if the group
    does not stand at that end."""
    m, first, last = len(group), length, length
    out = [0] * m
    for k in range(m):
        first = min(first, group[k][0]) if k else length
        out[k] = min(first, below, len(group[k][1]))
    for k in range(m - 1, -1, -1):
        out[k] = max(out[k], min(last, above, len(group[k][1])))
        last = min(last, group[k][0])
    return out


def _keys(data: bytes, wanted: list[dict], length: int, window: int) -> Iterator[tuple]:
    """(key, length of the suffix, h, c1, c2) of wanted anchors."""
    for w in wanted:
        p = w["p"]
        suffix = data[p : p + length]
        yield suffix + data[max(0, p - window + 1) : p][::-1], len(suffix), w["h"], w["c1"], w["c2"]


def _splitters(sampled: DataFrame, receivers: int, head: int) -> list[bytes]:
    """At most receivers - 1 keys in order from a sample; the first of those that share `head` bytes is cut to these."""
    # Twice as many as wanted would be a sample that its hash did not thin out as expected.
    keys = sorted(sampled.distinct().limit(2 * SAMPLED * receivers).toArrow()["key"].to_pylist())
    picked = sorted({keys[len(keys) * k // receivers] for k in range(1, receivers)}) if keys else []
    return [k if not head or before[:head] == k[:head] else k[:head] for before, k in zip([b"", *picked], picked)]


def _exchange(keys: Iterable[tuple], splitters: list[bytes]) -> Iterator[pa.RecordBatch]:
    """(receiver, run) of (key, length of its first part, h, c1, c2); of equal keys one."""
    kept: dict[tuple, tuple] = {}
    size = 0

    def flush() -> pa.RecordBatch:
        by: dict[int, list[tuple]] = {}
        for r in sorted(kept.values()):
            by.setdefault(bisect_right(splitters, r[0]), []).append(r)
        return pa.RecordBatch.from_arrays([pa.array(list(by), pa.int32()), pa.array([front_code(v) for v in by.values()], pa.binary())], ["receiver", "run"])

    for r in keys:
        before = kept.setdefault(r[2:], r)
        if before is r:
            size += len(r[0])
            if size >= RUN_BYTES:
                yield flush()
                kept, size = {}, 0
        elif before != r:
            raise ValueError("two different keys have one digest")
    if kept:
        yield flush()


SPANS = "h bigint, c1 bigint, c2 bigint, lo bigint, hi bigint, key binary, n int, digest binary, a int"


def _merged(runs: DataFrame, splitters: list[bytes], length: int, head: int, swapped: bool) -> DataFrame:
    """Per class the union (lo, hi) of what a receiver finds repeated, and what its neighbours may hold too: not swapped, the
    anchors with as much of their suffix as may be shared, for the second pass; swapped, digests of whole strings."""

    def receive(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        at = key[0].as_py()
        runs = [Run(pa.ipc.open_stream(x).read_next_batch()) for x in table["run"].to_pylist()]
        cols: list[list] = [[] for _ in range(9)]
        group: list[tuple] = []
        started = False

        def put(label: tuple, *values) -> None:
            for c, x in zip(cols, (*label[1:], *values)):
                c.append(x)

        def done(last: bool) -> None:
            if len({g[3][1:] for g in group}) < len(group):
                raise ValueError("two different keys have one digest")
            for (_, _, _, label), ranges in zip(group, offsets(group, length) if len(group) > 1 else [[]]):
                if ranges:
                    low, high = min(r[0] for r in ranges), max(r[1] for r in ranges)
                    put(label, *((low - length, high) if swapped else (-high, length - low)), None, None, None, None)
            key_of = lambda g: g[1] + g[2]
            below = common_prefix(splitters[at - 1], key_of(group[0])) if at and not started and len(splitters[at - 1]) > head else 0
            above = common_prefix(splitters[at], key_of(group[-1])) if last and at < len(splitters) and len(splitters[at]) > head else 0
            if not splitters or max(below, above) < head:
                return
            seen = set()
            for (_, first, second, label), n in zip(group, open_lengths(group, below, above, length)):
                if not swapped and n >= head:
                    put(label, None, None, second + first[:n], len(second), None, None)
                for k in range(length - n, len(second) + 1) if swapped else ():
                    digest = hashlib.blake2b(first[: length - k][::-1] + second[:k], digest_size=16).digest()
                    if (k, digest) not in seen:
                        seen.add((k, digest))
                        put(label, None, None, None, None, digest, length - k)

        before = None
        for shared, k, label in merge_runs(runs):
            if k == before and label == group[-1][3]:
                continue
            before = k
            if group and shared < head:
                done(False)
                started, group = True, []
            group.append((shared, k[: label[0]], k[label[0] :], label))
        done(True)
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.int32(), pa.binary(), pa.int32()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], [x.split()[0] for x in SPANS.split(", ")])

    return cut(runs.groupBy("receiver").applyInArrow(receive, SPANS))


def _sorted_spans(needed: DataFrame, length: int, window: int, classes: int, received: int) -> DataFrame:
    """(h, c1, c2, lo, hi) of classes with repeated strings, from (text, wanted): lo and hi are relative to the anchor."""
    head = length - window + 1
    names = ["key", "n", "h", "c1", "c2"]

    def sized(n: int) -> tuple[int, int]:
        """Receivers, and one in how many classes is sampled."""
        receivers = min(MOST_RECEIVERS, 1 + n // received)
        return receivers, max(1, round(n / SAMPLED / receivers))

    def keys_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if wanted:
                    yield from _keys(text.encode(), wanted, length, window)

    def sampled_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array({k[0] for k in keys_of(batches)}, pa.binary())], ["key"])

    receivers, share = sized(classes)
    chosen = needed.select("text", F.filter("wanted", lambda w: F.pmod(w["c1"], F.lit(share)) == 0).alias("wanted"))
    splitters = _splitters(chosen.mapInArrow(sampled_keys, "key binary"), receivers, head)
    found = _merged(needed.mapInArrow(lambda batches: _exchange(keys_of(batches), splitters), "receiver int, run binary"), splitters, length, head, False)
    spans = found.where("lo is not null").select("h", "c1", "c2", "lo", "hi")
    opened = found.where("key is not null").select(names)
    n = opened.count()
    if not n:
        return spans

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    receivers, share = sized(n)
    others = _splitters(opened.where(F.pmod("c1", F.lit(share)) == 0).select("key"), receivers, 0)
    again = _merged(opened.mapInArrow(lambda batches: _exchange(rows_of(batches), others), "receiver int, run binary"), others, length, 0, True)
    ends = again.where("digest is not null")
    both = ends.groupBy("digest", "a").agg(F.count("*").alias("both")).where("both > 1")
    met = ends.join(both, ["digest", "a"]).select("h", "c1", "c2", (-F.col("a")).cast("bigint").alias("lo"), (length - F.col("a")).cast("bigint").alias("hi"))
    return spans.union(again.where("lo is not null").select("h", "c1", "c2", "lo", "hi")).union(met)


def repeated_spans(documents: DataFrame, *, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", received: int = RECEIVED) -> DataFrame:
    """(_id, _tk, spans): per document with repeated strings an array of (lo, hi), not clipped to the text and not united."""
    docs = documents.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    found = cut(_anchor_rows(docs, length, window))
    rows = found.select("id", "tk", F.explode(F.arrays_zip("p", "h", "c1", "c2")).alias("a")).select("id", "tk", "a.*")
    classes = cut(rows.groupBy("h", "c1", "c2").agg(F.count("*").alias("n")))
    heads = classes.groupBy("h").agg(F.sum("n").alias("all"), F.count("*").alias("m")).where("all > 1").select("h", "m")
    classes = cut(hot_join(classes, heads, ["h"], "m", classes.count(), ["c1", "c2"]).select("h", "c1", "c2", "n"))
    total = classes.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    anchored = cut(hot_join(rows, classes, ["h", "c1", "c2"], "n", total[1], ["id", "tk", "p"]).select("id", "tk", "p", "h", "c1", "c2"))
    places = anchored.groupBy(F.col("id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_list(F.struct("p", "h", "c1", "c2")).alias("wanted"))
    needed = cut(docs.join(places, (docs["tk"] == places["_tk"]) & docs["id"].eqNullSafe(places["_id"])).dropDuplicates(["_id", "_tk"]).select("text", "wanted"))
    spans = _sorted_spans(needed, length, window, total[0], received)
    spans = spans.union(classes.where("n > 1").select("h", "c1", "c2", F.lit(-(window - 1)).cast("bigint").alias("lo"), F.lit(length).cast("bigint").alias("hi")))
    # All spans of an anchor hold its head, so their union is one span.
    by_class = spans.groupBy("h", "c1", "c2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).join(classes, ["h", "c1", "c2"])
    covered = hot_join(anchored, by_class, ["h", "c1", "c2"], "n", total[1], ["id", "tk", "p"])
    return covered.groupBy(F.col("id").alias("_id"), F.col("tk").alias("_tk")).agg(F.collect_list(F.struct((F.col("p") + F.col("lo")).alias("lo"), (F.col("p") + F.col("hi")).alias("hi"))).alias("spans"))


def united(spans: list[dict], n: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes of a text of n bytes."""
    out: list[list[int]] = []
    for lo, hi in sorted((max(0, s["lo"]), min(n, s["hi"])) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def substring_dedup(documents: DataFrame, *, length: int = LENGTH, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", received: int = RECEIVED) -> DataFrame:
    """Per document: id, n_bytes, removed (array of (lo, hi) byte spans), kept_bytes."""
    spans = repeated_spans(documents, length=length, window=window, id_col=id_col, text_col=text_col, received=received)
    docs = documents.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("tk"), F.col(text_col).alias("text"))
    joined = docs.join(spans, (docs["tk"] == spans["_tk"]) & docs["id"].eqNullSafe(spans["_id"]), "left").select("id", "text", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for text, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = (text or "").encode()
                gone = united(s or [], len(data))
                ends = [0, *(b for _, b in gone)]
                sizes.append(len(data))
                removed.append([{"lo": a, "hi": b} for a, b in gone])
                kept.append(b"".join(data[a:b] for a, b in zip(ends, [*(a for a, _ in gone), len(data)])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))), pa.array(kept, pa.binary())], ["id", "n_bytes", "removed", "kept_bytes"])

    out = joined.mapInArrow(strip, f"id {docs.schema['id'].dataType.simpleString()}, n_bytes bigint, removed array<struct<lo:bigint,hi:bigint>>, kept_bytes binary")
    return out.withColumnRenamed("id", id_col)


def op5(documents: DataFrame) -> DataFrame:
    out = substring_dedup(documents)
    gone = F.aggregate("removed", F.lit(0).cast("bigint"), lambda s, r: s + r["hi"] - r["lo"])
    return out.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"), (F.col("n_bytes") - gone).alias("n_kept"))


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """The spans to remove, by counting every string: for tests."""
    data = [(t or "").encode() for t in texts]
    counts: dict[bytes, int] = {}
    for d in data:
        for s in range(len(d) - length + 1):
            k = hashlib.md5(d[s : s + length]).digest()
            counts[k] = counts.get(k, 0) + 1
    return [united([{"lo": s, "hi": s + length} for s in range(len(d) - length + 1) if counts[hashlib.md5(d[s : s + length]).digest()] > 1], len(d)) for d in data]
