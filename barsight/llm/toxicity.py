"""Toxicity by class-conditional Kneser-Ney word bigrams: the calibrated, length-normalised log-likelihood difference.

Counts. Of every label all distinct (word before the last, last word, word) triples of its texts are gathered, so copies of a
text count once. N_c(v, w) is in how many distinct places before v the pair v w stands, N_c(w) behind how many distinct words w
stands: Kneser-Ney's continuation counts. Two halves of the texts count for themselves and are added; the discounts are those of a half, and
the final model of both takes them once for each half, times the root of a half, as noise grows with the root of the counts.

Model. P_c(w | v) = max(N_c(v, w) / N_c(v) - d2(v), 0) + b(v) * P_c(w), P_c(w) = max(N_c(w) / N_c - d1, 0) + b * P(w). The absolute
discounts are DISCOUNT counts for words and one of PAIR_DISCOUNTS for pairs, of the class that has fewer, as rates equal in both classes, and what they free goes to backoff
weights that both classes share; P(w) comes from the pooled counts of both and half a count more for every word. So rare words
and pairs get nearly the same probability from both classes and weigh nothing, and only words and pairs that pass a discount
need a log-ratio of their own.

Score. The difference of the two log-likelihoods over a stretch of words, divided by its number of words, of the most toxic
stretch. Of the lengths in STRETCHES (0: the whole text) and of PAIR_DISCOUNTS (the last: words alone) the two with the best F1 at
THRESHOLD on labelled rows are taken (equal ones by their ranking), as larger corpora hold more pairs that near copies repeat, and a logistic curve in that one number, never
falling, makes it a probability. All are fitted on labelled rows that the counts do not come from:
counts are kept in two halves by text, each half's rows are scored with the other's, and the final scores use both.

Bounds. All labelled learning rows are counted, whatever their number; about CALIBRATION_ROWS of them, chosen by a hash of the
text and each text once, fit the curve. Words are 64-bit hashes, the words before them count by 32 bits each.
The MODEL_ROWS most used log-ratios are broadcast, the others are joined to the texts that hold their words. Labels are
broadcast up to BROADCAST_LABELS rows and joined by shuffle beyond that.

Cases: rows labelled differently count for each label; null labels teach nothing; null and empty texts get the score of a text
without evidence; without both labels every score is the smoothed share of label 1; equal texts get equal scores; empty tables
give no rows; extra columns are ignored by score() unless named in keep.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, fresh, text_key, words_of

DISCOUNT, PAIR_DISCOUNTS, STRETCHES = 3.0, (20.0, 100.0, 500.0, float("inf")), (1, 10, 50, 0)
CALIBRATION_ROWS, BROADCAST_LABELS, MODEL_ROWS, THRESHOLD = 40_000, 250_000, 4_000_000, 0.7
_FLUSH_WORDS = 1_500_000
_BEGIN = np.uint64(7)
_COUNTS = [f"c{half}{label}" for half in (0, 1) for label in (0, 1)]


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def _hashed(text: str | None, memo: _Hashes) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def _before(h: np.ndarray, places: int) -> np.ndarray:
    return np.concatenate((np.full(min(places, len(h)), _BEGIN), h[:-places]))


def pair_codes(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for each pair of the word before (32 bits) and the word."""
    x = (w ^ (v * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _packed(x: np.ndarray) -> bytes:
    return zstandard.compress(x.tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint64)


def _distinct(w: np.ndarray, vu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs in order of w, then vu."""
    order = np.lexsort((vu, w))
    w, vu = w[order], vu[order]
    new = np.ones(len(w), bool)
    new[1:] = (w[1:] != w[:-1]) | (vu[1:] != vu[:-1])
    return w[new], vu[new]


def _half(text: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(2)).cast("int")


def learning_rows(documents: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, half, label) of labelled rows. The label table is small next to the texts; its size decides the join."""
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label")).distinct()
    if known.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    docs = documents.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    return docs.join(known, "_id").select("text", _half(F.col("text")).alias("half"), "label")


def continuation_counts(rows: DataFrame) -> DataFrame:
    """(kind, key, v, code, c00, c01, c10, c11): counts by half and label. Kind 0: N(w) of the word `key`; 1: N(v) of the word
    before; 2: N(v, w) of the pairs that can pass the discount in both halves together.

    Tasks send their distinct triples, sorted, packed and dealt by pair, so that equal ones meet and a frequent word's pairs
    spread over all groups.
    """
    chunks = max(64, 4 * rows.rdd.getNumPartitions())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, kept, size = _Hashes(), {}, 0

        def flush() -> pa.RecordBatch:
            out = []
            for (half, label), parts in kept.items():
                w, vu = _distinct(*(np.concatenate(x) for x in zip(*parts)))
                chunk = pair_codes(vu >> np.uint64(32), w) % np.uint64(chunks)
                order = np.argsort(chunk, kind="stable")
                bounds = np.searchsorted(chunk[order], np.arange(chunks + 1))
                out += [(c, half, label, _packed(np.diff(w[order[a:b]], prepend=np.uint64(0))), _packed(vu[order[a:b]])) for c, (a, b) in enumerate(zip(bounds, bounds[1:])) if b > a]
            cols = list(zip(*out)) or [[]] * 5
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["chunk", "half", "label", "w", "vu"])

        for part in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            for text, half, label in zip(*(c.to_pylist() for c in part.columns)):
                h = _hashed(text, memo)
                if len(h):
                    kept.setdefault((half, label), []).append((h, (_before(h, 1) >> np.uint64(32) << np.uint64(32)) | (_before(h, 2) >> np.uint64(32))))
                    size += len(h)
                    if size >= _FLUSH_WORDS:
                        yield flush()
                        kept, size = {}, 0
        if kept:
            yield flush()

    def merge(table: pa.Table) -> pa.Table:
        words, befores, columns = [], [], []
        which = 2 * table["half"].to_numpy() + table["label"].to_numpy()
        for k in range(4):
            part = table.filter(pa.array(which == k))
            if part.num_rows:
                w, vu = _distinct(np.concatenate([np.cumsum(_unpacked(x)) for x in part["w"].to_pylist()]), np.concatenate([_unpacked(x) for x in part["vu"].to_pylist()]))
                words.append(w)
                befores.append(vu >> np.uint64(32))
                columns.append(np.full(len(w), k))
        w, v, column = np.concatenate(words), np.concatenate(befores), np.concatenate(columns)
        order = np.lexsort((v, w))
        w, v, column = w[order], v[order], column[order]
        first = np.ones(len(w), bool)
        first[1:] = (w[1:] != w[:-1]) | (v[1:] != v[:-1])
        pair = np.cumsum(first) - 1
        counts = np.bincount(pair * 4 + column, minlength=4 * (pair[-1] + 1)).reshape(-1, 4)
        w, v = w[first], v[first]

        def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(keys, return_inverse=True)
            return found, np.stack([np.bincount(at, values[:, k], len(found)).astype(np.int64) for k in range(4)], axis=1)

        by_word, by_before = summed(w, counts > 0), summed(v, counts)
        strong = (counts[:, :2] + counts[:, 2:]).max(axis=1) > min(PAIR_DISCOUNTS)
        pairs = w[strong], counts[strong]
        kinds = [np.full(len(x[0]), k, np.int32) for k, x in enumerate((by_word, by_before, pairs))]
        nothing = [np.zeros(len(x[0]), np.int64) for x in (by_word, by_before)]
        columns = [np.concatenate(kinds), np.concatenate([x[0].view(np.int64) for x in (by_word, by_before, pairs)]), np.concatenate([*nothing, v[strong].view(np.int64)]), np.concatenate([by_word[0].view(np.int64), nothing[1], pair_codes(v[strong], w[strong]).view(np.int64)])]
        sums = np.concatenate([x[1] for x in (by_word, by_before, pairs)]).astype(np.int64)
        return pa.table([pa.array(x) for x in (*columns, *sums.T)], ["kind", "key", "v", "code", *_COUNTS])

    packed = rows.mapInArrow(collect, "chunk int, half int, label int, w binary, vu binary")
    found = packed.groupBy("chunk").applyInArrow(merge, "kind int, key bigint, v bigint, code bigint, " + ", ".join(f"{c} bigint" for c in _COUNTS))
    return cut(found.groupBy("kind", "key", "v", "code").agg(*(F.sum(c).alias(c) for c in _COUNTS)))


def log_ratios(counts: DataFrame, halves: tuple[int, ...], pair_discount: float, share: float = 1.0) -> DataFrame | None:
    """(kind, code, uses, ratio) of the words and pairs whose log P_1 - log P_0 is their own, from the counts of these halves;
    null if a label has no counts. `share` is that of the discounts which is taken."""
    n = [reduce(lambda a, b: a + b, (F.col(f"c{h}{y}") for h in halves)).alias(f"n{y}") for y in (0, 1)]
    known = counts.select("kind", "key", "v", "code", *n)
    words = known.where("kind = 0 and n0 + n1 > 0")
    types, *total = words.agg(F.count("*"), F.sum("n0"), F.sum("n1")).first()
    if not all(total):
        return None
    n0, n1 = F.col("n0"), F.col("n1")
    kept = [F.greatest(n / t - share * DISCOUNT * len(halves) / min(total), F.lit(0.0)) for n, t in zip((n0, n1), total)]
    freed = 1 - (words.agg(F.sum(kept[0] + kept[1])).first()[0] or 0.0) / 2
    shared = (n0 + n1 + 0.5) / (sum(total) + 0.5 * types)
    words = words.select("kind", "key", "code", (n0 + n1).alias("uses"), *[(k + freed * shared).alias(f"p{y}") for y, k in enumerate(kept)], (kept[0] + kept[1] > 0).alias("own"))
    own_words = words.where("own").select("kind", "code", "uses", (F.log("p1") - F.log("p0")).alias("ratio"))
    if pair_discount == float("inf"):
        return cut(own_words)
    before = known.where("kind = 1").select(F.col("key").alias("v"), n0.alias("t0"), n1.alias("t1")).where("least(t0, t1) > 0")
    rate = [F.greatest(F.col(f"n{y}") / F.col(f"t{y}") - share * pair_discount * len(halves) / F.least("t0", "t1"), F.lit(0.0)).alias(f"k{y}") for y in (0, 1)]
    pairs = cut(known.where("kind = 2").join(before, "v").select("key", "v", "code", (n0 + n1).alias("uses"), *rate).where("k0 + k1 > 0"))
    freed_by = pairs.groupBy("v").agg(F.greatest(1 - F.sum(F.col("k0") + F.col("k1")) / 2, F.lit(1e-6)).alias("b"))
    p = [F.col(f"k{y}") + F.col("b") * F.col(f"p{y}") for y in (0, 1)]
    pairs = pairs.join(freed_by, "v").join(words.select("key", "p0", "p1"), "key").select(F.lit(2).alias("kind"), "code", "uses", (F.log(p[1]) - F.log(p[0])).alias("ratio"))
    return cut(own_words.union(pairs))


class Ratios:
    """Log-ratios by code, words and pairs apart; what is not in them is 0 for a word and the word's own for a pair."""

    def __init__(self, table: pa.Table) -> None:
        kind, code, ratio = (table[c].to_numpy() for c in ("kind", "code", "ratio"))
        self.tables = []
        for k in (0, 2):
            codes, values = code[kind == k].view(np.uint64), ratio[kind == k]
            order = np.argsort(codes)
            self.tables.append((codes[order], values[order]))

    def find(self, which: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, ratio) of codes of words (0) or pairs (1)."""
        known, values = self.tables[which]
        if not len(known):
            return np.zeros(len(codes), bool), np.zeros(len(codes))
        at = np.minimum(np.searchsorted(known, codes), len(known) - 1)
        return known[at] == codes, values[at]


def _codes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a text's words and of its pairs."""
    return h, pair_codes(_before(h, 1) >> np.uint64(32), h)


def statistics(h: np.ndarray, models: list[Ratios]) -> list[float]:
    """For each of STRETCHES the greatest length-normalised log-likelihood difference of a text's stretches."""
    n = len(h)
    if not n:
        return [0.0] * len(STRETCHES)
    words, pairs = _codes(h)
    ratio = np.zeros(n)
    for which, codes in ((0, words), (1, pairs)):
        for m in models:
            found, values = m.find(which, codes)
            ratio[found] = values[found]
    sums = np.concatenate(([0.0], np.cumsum(ratio)))
    sizes = [min(n, k) if k else n for k in STRETCHES]
    return [float((sums[k:] - sums[: n + 1 - k]).max()) / k for k in sizes]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> tuple[float, float]:
    """Slope, not below 0, and intercept, by Newton steps on the standardised number."""
    mean, sd = x.mean(), x.std() + 1e-9
    z = np.column_stack([(x - mean) / sd, np.ones(len(x))])
    w, penalty = np.zeros(2), np.array([ridge, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z.T * (p * (1 - p) + 1e-9)) @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    slope = max(0.0, w[0] / sd)
    return float(slope), float(w[1] - slope * mean if slope else np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))


def ranking(x: np.ndarray, y: np.ndarray) -> float:
    """Area under the ROC curve, ties half."""
    _, place = np.unique(x, return_inverse=True)
    pos, neg = np.bincount(place, y), np.bincount(place, 1 - y)
    return float((pos * (neg.cumsum() - neg / 2)).sum() / (pos.sum() * neg.sum()))


def found_at(z: np.ndarray, y: np.ndarray, threshold: float = THRESHOLD) -> float:
    """F1 of the rows whose log-odds reach the threshold, to three digits."""
    said = z >= np.log(threshold / (1 - threshold))
    hits = (said & (y == 1)).sum()
    return round(2 * hits / max(1, said.sum() + y.sum()), 3)


def _split(model: DataFrame | None) -> tuple[pa.Table, DataFrame | None]:
    """The MODEL_ROWS most used ratios, and the others if there are any."""
    if model is None:
        return pa.table({"kind": pa.array([], pa.int32()), "code": pa.array([], pa.int64()), "ratio": pa.array([], pa.float64())}), None
    if model.count() <= MODEL_ROWS:
        return model.select("kind", "code", "ratio").toArrow(), None
    top = cut(model.orderBy(F.desc("uses"), "kind", "code").limit(MODEL_ROWS))
    return top.select("kind", "code", "ratio").toArrow(), cut(model.join(top.select("kind", "code"), ["kind", "code"], "left_anti"))


def _rare_ratios(rows: DataFrame, rest: DataFrame, known: Ratios) -> DataFrame:
    """(_tk, kinds, codes, ratios): the ratios beyond the broadcast ones that each distinct text needs."""
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Hashes()
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                cols: list[list] = [[], []]
                for which, codes in enumerate(_codes(_hashed(text, memo))):
                    codes = np.unique(codes)
                    codes = codes[~sent.value.find(which, codes)[0]]
                    cols[0].append(np.full(len(codes), 2 * which, np.int32))
                    cols[1].append(codes.view(np.int64))
                kinds, codes = (np.concatenate(c) for c in cols)
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(kinds), pa.int64()), pa.array(kinds), pa.array(codes)], ["_tk", "kind", "code"])

    texts = rows.select(text_key(F.col("text")).alias("_tk"), "text").dropDuplicates(["_tk"])
    met = texts.mapInArrow(run, "_tk bigint, kind int, code bigint").join(rest, ["kind", "code"])
    return met.groupBy("_tk").agg(F.collect_list(F.struct("kind", "code", "ratio")).alias("rare"))


def _statistic_rows(rows: DataFrame, models: list[tuple[pa.Table, DataFrame | None]], halves: bool, others: list[str]) -> DataFrame:
    """The columns of others and `x`, the statistics of `text`; with halves, a row of half h is scored by models[1 - h]."""
    if halves:
        parts = [_statistic_rows(rows.where(F.col("half") == h), [models[1 - h]], False, others) for h in (0, 1)]
        return parts[0].union(parts[1])
    table, rest = models[0]
    known = Ratios(table)
    picked = rows.select(*others, *([] if "text" in others else ["text"]))
    if rest is not None:
        rare = cut(_rare_ratios(rows, rest, known))
        picked = picked.withColumn("_tk", text_key(F.col("text"))).join(rare, "_tk", "left").drop("_tk")
    sent = rows.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, used = _Hashes(), [sent.value]
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                if "rare" in part.schema.names:
                    own = ([*used, Ratios(pa.Table.from_pylist(r, schema=RARE))] if r else used for r in part.column(part.schema.get_field_index("rare")).to_pylist())
                else:
                    own = [used] * len(texts)
                x = [statistics(_hashed(t, memo), m) for t, m in zip(texts, own)]
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in others), pa.array(x, pa.list_(pa.float64()))], [*others, "x"])

    return picked.mapInArrow(run, ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others) + ", x array<double>")


RARE = pa.schema([("kind", pa.int32()), ("code", pa.int64()), ("ratio", pa.float64())])


def train(rows: DataFrame) -> tuple[tuple[pa.Table, DataFrame | None], int, float, float]:
    """The model of both halves, the place in STRETCHES, slope and intercept, from (text, half, label)."""
    counts = continuation_counts(rows)
    share = CALIBRATION_ROWS / max(1, rows.count())
    chosen = rows.withColumn("o", F.xxhash64(F.coalesce("text", F.lit("")), F.lit(1)))
    if share < 1:
        chosen = chosen.where(F.pmod("o", F.lit(1_000_000)) < int(share * 1_000_000))
    sample = cut(chosen.dropDuplicates(["o", "label"]).select("text", "half", "label"))
    best: tuple = ((-1.0, -1.0),)
    for discount in PAIR_DISCOUNTS:
        cross = [_split(log_ratios(counts, (half,), discount)) for half in (0, 1)]
        got = _statistic_rows(sample, cross, True, ["label"]).toArrow()
        y = got["label"].to_numpy().astype(np.float64)
        x = np.array(got["x"].to_pylist(), np.float64).reshape(len(y), len(STRETCHES))
        if not 0 < y.sum() < len(y):
            return _split(None), 0, 0.0, float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        for k in range(len(STRETCHES)):
            slope, intercept = fit_logistic(x[:, k], y)
            found = (found_at(slope * x[:, k] + intercept, y), ranking(x[:, k], y))
            if found > best[0]:
                best = found, discount, k, slope, intercept
    _, discount, k, slope, intercept = best
    # Two halves have twice the counts, but only the root of two times the noise that discounts are there for.
    return _split(log_ratios(counts, (0, 1), discount, 0.5**0.5)), k, slope, intercept


def score(documents: DataFrame, labels: DataFrame, learn: Column | None = None, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: tuple[str, ...] = (), score_col: str = "score") -> DataFrame:
    """id, the columns of keep, and score_col for every document; only documents where `learn` holds lend their labels."""
    rows = learning_rows(documents.where(learn) if learn is not None else documents, labels, id_col, text_col, label_col)
    model, k, slope, intercept = train(rows)
    names = [id_col, *(c for c in keep if c != id_col)]
    # A kept text travels to the tasks once, under the name that the scoring reads.
    at = {c: "text" if c == text_col else f"_c{i}" for i, c in enumerate(names)}
    base = documents.select(*[F.col(c).alias(at[c]) for c in names], *([] if text_col in names else [F.col(text_col).alias("text")]))
    scored = _statistic_rows(base, [model], False, [at[c] for c in names])
    z = F.lit(slope) * F.col("x")[k] + F.lit(intercept)
    return scored.select(*[F.col(at[c]).alias(c) for c in names], (1 / (1 + F.exp(-z))).alias(score_col))


def third(id_col: str = "doc_id") -> Column:
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3))


def op7(documents: DataFrame, labels: DataFrame) -> DataFrame:
    learn = F.coalesce(third() != 1, F.lit(False))
    out = score(documents, labels, learn)
    return out.select("doc_id", F.coalesce(third() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score below the threshold, with their own columns. Learns from the same rows as op7."""
    learn = F.coalesce(third() != 1, F.lit(False))
    name = fresh("score", documents)
    return score(documents, labels, learn, keep=tuple(documents.columns), score_col=name).where(F.col(name) < threshold).select(*[F.col(f"`{c}`") for c in documents.columns])
