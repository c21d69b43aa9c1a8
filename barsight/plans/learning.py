"""Learned scores: features, purged splits, logistic regression and boosted trees fitted by Spark jobs, walk-forward ranking.

Training rows stay in Spark, as numpy blocks of a few thousand rows. A step of either model adds up the tasks' sums (normal
equations, or gradient histograms) in a tree of tasks; what reaches the driver depends on the number of features and models only.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.random32 import draws
from ..functions.scalars import sigmoid
from ..operators import cross_section as X
from ..operators import indicators as I
from ..operators import ordered, stats
from ..sources import panel as P
from . import rules as R

STOCK = ("ret5", "ret21", "ret63", "ret126", "ret252", "mom", "vol20", "vol63", "rsi5", "rsi14", "gap20", "gap50", "gap200", "trend", "dhigh20", "dhigh252", "dlow252", "macd")
MARKET = ("iret21", "iret63", "igap200", "ivol20")
FEATURES = (*STOCK, *MARKET, "rules")
NF = len(FEATURES)
#: Of the stored walk-forward models; trees after which the rows' log-odds are written; rows of a training partition.
VERSION, RENEWED, PART = 1, 20, 50_000
#: Seeds of the trees' halves and of the bootstrap's days.
TREE_SEED, DAY_SEED = 42, 7
#: Walk-forward ranking: horizon, sampling step, days between fits, least history, window of days, penalty.
HORIZON, STEP, EVERY, HISTORY, WINDOW, PENALTY = 21, 5, 63, 252, 756, 100.0
#: Boosted trees.
DEPTH, RATE, MOST_TREES, SHARE, RIDGE, LEAST_HESSIAN, BINS, PATIENCE, LEAST_TREES = 3, 0.1, 200, 0.5, 1.0, 50.0, 32, 40, 10


EXTREMES = {"_hi20": ("max", "close", 20), "_hi252": ("max", "close", 252), "_lo252": ("min", "close", 252)}


def raw_features() -> dict[str, Column]:
    c, r = F.col("close"), F.col("r")
    return {f"ret{n}": I.change(c, n) * 100 for n in (5, 21, 63, 126, 252)} | {"mom": I.momentum_12_1(c), "vol20": I.volatility(r, 20), "vol63": I.volatility(r, 63)} | {f"gap{n}": I.gap_to_sma(c, n) for n in (20, 50, 200)} | {"trend": I.trend(c), "dhigh20": I.off(c, F.col("_hi20")), "dhigh252": I.off(c, F.col("_hi252")), "dlow252": I.off(c, F.col("_lo252"))}


def features(panel: DataFrame, index: DataFrame, market: DataFrame, algo: dict, days: Column) -> DataFrame:
    """(t, sym_ix, symbol, sector, close, and the FEATURES as floats) of the days where `days` holds: ranks across the day's
    priced symbols, the market's state if the label is 'up' (else 0), and the share of entry rules met."""
    rules = algo["entry"]["rules"]
    rows = R.with_operands(panel, index, algo) if rules else panel
    rows = I.with_recurrences(rows, [("rsi5", "rsi", 5)]).withColumn("_met", R.met(rules) / max(1, len(rules)))
    rows = rows.select("rsi5", "rsi14", "macd", "symbol", "sector", "sym_ix", "t", "close", "_met", "r")
    raw = raw_features()
    rows = I.windows(rows.drop(*raw), 253, I.extremes(**EXTREMES), raw).where(F.col("close").isNotNull() & days)
    ranked = X.average_ranks(rows.select("t", "sym_ix", "symbol", "sector", "close", "_met", *STOCK), list(STOCK))
    on = algo.get("eval", {}).get("label") == "up"
    ranked = ranked.join(F.broadcast(market.select(F.col("t").alias("_t"), *MARKET)), F.col("t") == F.col("_t"))
    return ranked.select("t", "sym_ix", "symbol", "sector", "close", *STOCK, *[(F.coalesce(k, F.lit(0.0)) if on else F.lit(0.0)).cast("float").alias(k) for k in MARKET], F.col("_met").cast("float").alias("rules"))


def vector() -> Column:
    return F.array(*[F.col(k).cast("double") for k in FEATURES]).alias("x")


def purged(rows: DataFrame, horizon: int) -> DataFrame:
    """rows with `role`: test from the split on; before it, less the horizon, the pool, whose last fifth of days is val and
    whose days that end before val are fit; the rest is null or 'gap'."""
    pool = F.col("t") < F.col("split") - horizon
    days = rows.where(pool).select("t").distinct().select("t", F.row_number().over(W.orderBy("t")).alias("k"), F.count("*").over(W.partitionBy()).alias("n"))
    start = days.where(F.col("k") - 1 == F.floor(F.col("n") * 0.8)).select(F.col("t").alias("val_start"))
    out = rows.join(F.broadcast(start))
    role = F.when(F.col("t") >= F.col("split"), "test").when(pool & (F.col("t") >= F.col("val_start")), "val").when(pool & (F.col("t") < F.col("val_start") - horizon), "fit").when(pool, "gap")
    return out.withColumn("role", role)


# --- training rows as blocks ---


def blocks(rows: DataFrame, *columns: str) -> RDD:
    """The rows as tuples of numpy arrays, one tuple a batch: x as a matrix, other columns as vectors. Kept while a fit reads them over
    and over; a lost part is made again from the rows."""
    taken = rows.select("x", *columns)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((matrix(b.column(0)), *(c.to_numpy(zero_copy_only=False) for c in b.columns[1:])))], pa.binary())], ["b"])

    return taken.mapInArrow(pack, "b binary").rdd.map(lambda r: pickle.loads(r[0])).persist(StorageLevel.MEMORY_AND_DISK)


def matrix(x: pa.ListArray) -> np.ndarray:
    """Lists of one length as the rows of a matrix."""
    return x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(x), -1)


def total(data: RDD, of) -> np.ndarray:
    """The sum over all blocks of what `of` gives for each; an array of one shape."""

    def task(parts: Iterator[tuple]) -> Iterator[np.ndarray]:
        found = None
        for block in parts:
            found = of(*block) if found is None else found + of(*block)
        if found is not None:
            yield found

    return data.mapPartitions(task).treeReduce(np.add)


# --- logistic regression ---


@dataclass
class Logistic:
    mean: np.ndarray
    sd: np.ndarray
    w: np.ndarray
    penalty: float

    def column(self, x: str = "x") -> Column:
        """The log-odds as a column expression."""
        slope = self.w[1:] / self.sd
        terms = F.zip_with(x, F.array(*[F.lit(float(v)) for v in slope]), lambda a, b: a * b)
        return F.aggregate(terms, F.lit(float(self.w[0] - (slope * self.mean).sum())), lambda a, b: a + b)

    def contributions(self, x: str = "x") -> Column:
        """What each feature adds to the log-odds against a mean row."""
        return F.transform(F.arrays_zip(F.col(x).alias("v"), F.array(*[F.lit(float(v)) for v in self.mean]).alias("m"), F.array(*[F.lit(float(v)) for v in self.w[1:] / self.sd]).alias("k")), lambda z: z["k"] * (z["v"] - z["m"]))


def newton(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hessian and gradient of the rows' loss; weights of the hessian have a floor."""
    p = 1 / (1 + np.exp(-(x @ w)))
    return (x.T * np.maximum(p * (1 - p), 1e-6)) @ x, x.T @ (p - y)


def solve(parts, penalty: float, w: np.ndarray) -> tuple[np.ndarray, float]:
    h, g = (np.sum([p[k] for p in parts], axis=0) for k in (0, 1))
    ridge = np.full(len(w), penalty)
    ridge[0] = 0
    step = np.linalg.solve(h + np.diag(ridge + 1e-12), g + ridge * w)
    return w - step, float(np.abs(step).max())


def standardised(x: np.ndarray, mean: np.ndarray, sd: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(x)), (x - mean) / sd])


def fit_local(x: np.ndarray, y: np.ndarray, penalty: float) -> Logistic:
    """The fit of one retrain day's window, which is one task's."""
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.where(sd > 0, sd, 1.0)
    z, w = standardised(x, mean, sd), np.zeros(x.shape[1] + 1)
    for _ in range(25):
        w, moved = solve([newton(z, y, w)], penalty, w)
        if moved < 1e-6:
            break
    return Logistic(mean, sd, w, penalty)


def moments(data: RDD) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each feature; 1 for a feature that does not vary."""
    first = total(data, lambda x, *_: np.concatenate(([len(x)], x.sum(axis=0))))
    mean = first[1:] / first[0]
    sd = np.sqrt(total(data, lambda x, *_: ((x - mean) ** 2).sum(axis=0)) / first[0])
    return mean, np.where(sd > 0, sd, 1.0)


def fit_systems(data: RDD, mean: np.ndarray, sd: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    """Weights of several logistic models at once: block rows (x, y, lo, hi) belong to the models from lo up to hi, not included. One
    pass over the rows a Newton step sums the normal equations of all models that still move."""
    w = np.zeros((len(mean), mean.shape[1] + 1))
    active = np.arange(len(w))
    for _ in range(25):
        at, now = active, w[active]

        def sums(x: np.ndarray, y: np.ndarray, lo: np.ndarray, hi: np.ndarray, at=at, now=now) -> np.ndarray:
            out = np.zeros((len(at), now.shape[1], now.shape[1] + 1))
            for k, r in enumerate(at):
                here = (lo <= r) & (r < hi)
                if here.any():
                    h, g = newton(standardised(x[here], mean[r], sd[r]), y[here].astype(float), now[k])
                    out[k, :, :-1], out[k, :, -1] = h, g
            return out

        got = total(data, sums)
        moving = []
        for k, r in enumerate(at):
            w[r], moved = solve([(got[k, :, :-1], got[k, :, -1])], penalty[r], w[r])
            if moved >= 1e-6:
                moving.append(r)
        active = np.array(moving, int)
        if not len(active):
            break
    return w


def in_all(data: RDD, models: int) -> RDD:
    """Blocks (x, y) whose rows belong to every model."""
    return data.map(lambda b: (b[0], b[1], np.zeros(len(b[1]), int), np.full(len(b[1]), models)))


def fit_logistic(rows: DataFrame, *penalties: float) -> list[Logistic]:
    """A model for each penalty, in one run over the rows."""
    data = blocks(rows, "label")
    mean, sd = moments(data)
    n = len(penalties)
    w = fit_systems(in_all(data, n), np.tile(mean, (n, 1)), np.tile(sd, (n, 1)), np.array(penalties))
    data.unpersist()
    return [Logistic(mean, sd, w[k], p) for k, p in enumerate(penalties)]


def auc_of(rows: DataFrame, score: Column) -> float:
    got = stats.auc(rows.select(F.lit(1).alias("one"), score.alias("score"), "label"), ["one"]).first()
    return float("nan") if got is None or got["auc"] is None else got["auc"]


def choose_penalty(rows: DataFrame, penalties=(1.0, 100.0, 3000.0)) -> tuple[Logistic, float]:
    """The penalty whose fit has the best validation AUC (the first of ties), refitted on the whole pool."""
    models = fit_logistic(rows.where("role = 'fit'"), *penalties)
    scores = F.array(*[F.struct(F.lit(k).alias("k"), m.column().alias("score")) for k, m in enumerate(models)])
    val = rows.where("role = 'val'").select("label", F.explode(scores).alias("m")).select("label", "m.*")
    found = {r["k"]: r["auc"] for r in stats.auc(val, ["k"]).collect()}
    best = max(range(len(penalties)), key=lambda k: (found.get(k) or -1.0, -k))
    return fit_logistic(rows.where("role in ('fit', 'gap', 'val')"), penalties[best])[0], found.get(best) or float("nan")


# --- boosted trees ---


@dataclass
class Trees:
    """Nodes of a tree: (feature, bin, left, right) or a leaf's value."""

    prior: float
    edges: list[np.ndarray]
    trees: list[list[tuple]] = field(default_factory=list)
    gains: np.ndarray = field(default_factory=lambda: np.zeros(NF))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)])

    @staticmethod
    def leaf_of(tree: list[tuple], z: np.ndarray) -> np.ndarray:
        at = np.zeros(len(z), np.int64)
        for _ in range(DEPTH):
            for n in np.unique(at):
                if len(tree[n]) == 4:
                    f, b, left, right = tree[n]
                    here = at == n
                    at[here] = np.where(z[here, f] <= b, left, right)
        return at

    def score(self, z: np.ndarray) -> np.ndarray:
        out = np.full(len(z), self.prior)
        for tree in self.trees:
            values = np.array([n[0] if len(n) == 1 else 0.0 for n in tree])
            out += values[self.leaf_of(tree, z)]
        return out


def bin_edges(rows: DataFrame, bins: int = BINS, names: tuple[str, ...] = FEATURES) -> list[np.ndarray]:
    """Distinct values at the places floor(b * n / bins) of each sorted feature. Values are counted first; at most bins - 1
    edges a feature come back."""
    values = rows.select(F.posexplode("x").alias("f", "v")).groupBy("f", "v").agg(F.count("*").alias("n"))
    places = ordered.with_before(values, ["f"], [F.col("v")], {"lo": F.col("n")})
    places = places.join(values.groupBy("f").agg(F.sum("n").alias("all")), "f")
    wanted = F.transform(F.sequence(F.lit(1), F.lit(bins - 1)), lambda b: F.floor(b * F.col("all") / bins))
    got = places.where(F.exists(wanted, lambda p: (p >= F.col("lo")) & (p < F.col("lo") + F.col("n")))).select("f", "v").collect()
    return [np.array(sorted(v for k, v in got if k == f)) for f in range(len(names))]


def histogram(z: np.ndarray, g: np.ndarray, h: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
    """[2, slots, features, bins]: sums of gradients and hessians; rows of slot -1 count nowhere."""
    here = slot >= 0
    z, g, h, slot = z[here], g[here], h[here], slot[here]
    nf = z.shape[1]
    cell = ((slot[:, None] * nf + np.arange(nf)) * BINS + z).ravel()
    return np.stack([np.bincount(cell, np.repeat(v, nf), slots * nf * BINS).reshape(slots, nf, BINS) for v in (g, h)])


def best_split(grad: np.ndarray, hess: np.ndarray) -> tuple | None:
    """(gain, feature, bin, left sums, right sums) of the first best split of a node's [features, bins], or null."""
    gl, hl = grad.cumsum(axis=1)[:, :-1], hess.cumsum(axis=1)[:, :-1]
    gs, hs = grad[0].sum(), hess[0].sum()
    gain = np.where((hl >= LEAST_HESSIAN) & (hs - hl >= LEAST_HESSIAN), gl**2 / (hl + RIDGE) + (gs - gl) ** 2 / (hs - hl + RIDGE) - gs**2 / (hs + RIDGE), 0.0)
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    if gain[f, b] <= 0:
        return None
    return float(gain[f, b]), int(f), int(b), (gl[f, b], hl[f, b]), (gs - gl[f, b], hs - hl[f, b])


def leaf(g: float, h: float) -> tuple:
    return (float(-RATE * g / (h + RIDGE)),)


def grow(data: RDD) -> tuple[list[tuple], list[tuple[int, float]]]:
    """A tree from blocks (z, gradient, hessian), and the gain of each split by feature. One job a level: of two siblings only the one
    with less hessian is summed, the other is what remains of their parent."""
    whole = total(data, lambda z, g, h: histogram(z, g, h, np.zeros(len(z), int), 1))
    sums = {0: whole[:, 0]}
    tree: list[tuple] = [leaf(sums[0][0, 0].sum(), sums[0][1, 0].sum())]
    gains, level = [], [0]
    for depth in range(DEPTH):
        pairs = []
        for node in level:
            found = best_split(*sums[node])
            if found:
                gain, f, b, left, right = found
                gains.append((f, gain))
                tree[node] = (f, b, len(tree), len(tree) + 1)
                pairs.append((node, len(tree), len(tree) + 1, left[1] <= right[1]))
                tree += [leaf(*left), leaf(*right)]
        if not pairs or depth == DEPTH - 1:
            break
        smaller = [a if first else b for _, a, b, first in pairs]

        def some(z: np.ndarray, g: np.ndarray, h: np.ndarray, tree=list(tree), smaller=smaller) -> np.ndarray:
            slot = np.full(len(tree), -1)
            slot[smaller] = np.arange(len(smaller))
            return histogram(z, g, h, slot[Trees.leaf_of(tree, z)], len(smaller))

        got = total(data, some)
        for k, (node, a, b, first) in enumerate(pairs):
            less, more = (a, b) if first else (b, a)
            sums[less], sums[more] = got[:, k], sums[node] - got[:, k]
        level = [c for _, a, b, _ in pairs for c in (a, b)]
    return tree, gains


def fit_trees(rows: DataFrame, fit: str, val: str | None, edges: list[np.ndarray], rounds: int | None = None) -> Trees:
    """Boosts log-loss trees on rows where `fit` holds; with `val`, stops when its AUC no longer improves.

    Rows are binned and numbered in the order of (t, sym_ix) once. Blocks keep their rows' log-odds, moved by each new tree where they
    lie, and the tree's half, chosen once: row r is in tree m's half if draw m * n + r of the seeded generator is below SHARE, which
    any task finds by itself. Every RENEWED trees the blocks are written, so what is lost is never made again from further back.
    """
    spark = rows.sparkSession
    base, n = rows.where(fit).agg(F.avg("label"), F.count("*")).first()
    model, best, best_n = Trees(float(np.log(base / (1 - base))), edges), -1.0, 0
    prior, folder = model.prior, f"{P.own_folder(spark)}/trees-{uuid.uuid4().hex}"

    def binned(df: DataFrame, *columns: str) -> RDD:
        return blocks(df.coalesce(max(1, n // PART)), *columns).map(lambda b: (Trees(0.0, edges).bins(b[0]).astype(np.uint8), *b[1:], np.full(len(b[0]), prior)))

    numbered = ordered.numbered(rows.where(fit).select("t", "sym_ix", "x", "label"), [], [F.col("t"), F.col("sym_ix")], "place")

    def start(z: np.ndarray, y: np.ndarray, place: np.ndarray, margin: np.ndarray, m: int) -> tuple:
        """A block with its rows of the half of tree m: (z, gradient, hessian)."""
        half = draws(TREE_SEED, m * n + place) < SHARE
        p = 1 / (1 + np.exp(-margin[half]))
        return z, y, place, margin, (z[half], p - y[half], p * (1 - p))

    def written(data: RDD, name: str) -> RDD:
        data.saveAsPickleFile(f"{folder}/{name}")
        return spark.sparkContext.pickleFile(f"{folder}/{name}", 1)

    kept = written(binned(numbered, "label", "place"), "fit").map(lambda b: start(*b, 0)).persist(StorageLevel.MEMORY_AND_DISK)
    judged = written(binned(rows.where(val), "label"), "val") if val else None
    older: list[RDD] = []
    for m in range(rounds or MOST_TREES):
        tree, gains = grow(kept.map(lambda b: b[4]))
        model.trees.append(tree)
        for f, gain in gains:
            model.gains[f] += gain
        moved = kept.map(lambda b, tree=tree: (*b[:3], b[3] + Trees(0.0, [], [tree]).score(b[0])))
        if (m + 1) % RENEWED == 0:
            moved = written(moved, f"fit-{m}")
        before, kept = kept, moved.map(lambda b, m=m: start(*b, m + 1)).persist(StorageLevel.MEMORY_AND_DISK)
        older.append(before)
        while len(older) > 2:  # the newest is made from the one before it when the next tree first reads it
            older.pop(0).unpersist()
        if val and (m + 1) % 10 == 0:
            now = auc_of_blocks(judged, model.trees)
            if now > best:
                best, best_n = now, m + 1
            elif m + 1 - best_n >= PATIENCE:
                break
    for data in (*older, kept):
        data.unpersist()
    if val:
        model.trees = model.trees[: max(best_n, LEAST_TREES)]
    return model


def auc_of_blocks(judged: RDD, trees: list[list[tuple]]) -> float:
    """AUC of the trees over blocks (z, y, prior log-odds). A block sends its distinct scores with their counts; sorted parts count wins
    within, and three sums a part tell the rest."""

    def groups(block: tuple) -> list[tuple]:
        score, at = np.unique(block[2] + Trees(0.0, [], trees).score(block[0]), return_inverse=True)
        p = np.bincount(at, block[1] == 1)
        return list(zip(score.tolist(), np.column_stack([p, np.bincount(at) - p])))

    def within(rows: Iterator[tuple]) -> Iterator[tuple]:
        pos = neg = u = 0.0
        for _, (p, n) in rows:
            u += p * (neg + n / 2)
            pos, neg = pos + p, neg + n
        yield pos, neg, u

    parts = judged.getNumPartitions()
    pos = neg = u = 0.0
    for p, n, own in judged.flatMap(groups).reduceByKey(np.add, parts).sortByKey(True, parts).mapPartitions(within).collect():
        u += own + p * neg
        pos, neg = pos + p, neg + n
    return float(u / (pos * neg)) if pos and neg else float("nan")


def scored_by_trees(rows: DataFrame, model: Trees) -> DataFrame:
    """rows with z, the trees' log-odds."""
    sent = rows.sparkSession.sparkContext.broadcast(model)
    place = rows.columns.index("x")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = sent.value.score(sent.value.bins(matrix(b.column(place)))) if b.num_rows else np.array([], float)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(z)], [*b.schema.names, "z"])

    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", z double")


# --- bootstrap, walk-forward ranking, reasons ---


def day_counts(resamples: int, days: int, seed: int = DAY_SEED) -> np.ndarray:
    """[resamples, days]: how often a resample holds a day. Its draw d has the number resample * days + d, so any task finds all."""
    drawn = np.floor(draws(seed, np.arange(resamples * days)) * days).astype(int) + np.repeat(np.arange(resamples), days) * days
    return np.bincount(drawn, minlength=resamples * days).reshape(resamples, days).astype(float)


def bootstrap(rows: DataFrame, a: str, b: str, resamples: int = 200, seed: int = DAY_SEED, batch: int = 4096) -> DataFrame:
    """(resample, gain): AUC(a) - AUC(b) when whole days are drawn again.

    Rows are counted by model, score, day and label and range-partitioned by score. A range finds every resample's weights by itself and sums
    them within; what lies in ranges below adds to it by their sums, a row for each range and resample.
    """
    # A row for each day.
    days = rows.select("t").distinct().select("t", (F.row_number().over(W.orderBy("t")) - 1).alias("day"))
    n_days = days.count()
    long = rows.join(F.broadcast(days), "t").select("day", "label", F.explode(F.array(F.struct(F.lit(0).alias("m"), F.col(a).alias("score")), F.struct(F.lit(1).alias("m"), F.col(b).alias("score")))).alias("s"))
    groups = long.groupBy("s.m", "s.score", "day").agg(F.sum("label").cast("double").alias("p"), F.sum(1 - F.col("label")).cast("double").alias("n"))
    dealt = ordered.ranged(groups, ["m"], [F.col("score")]).sortWithinPartitions("m", "score").select("m", ordered.RANGE, "score", "day", "p", "n")

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        model, part, score, day, p, n = (c.to_numpy() for c in table.columns)
        weight = day_counts(resamples, n_days, seed)
        for m in np.unique(model):
            here = np.flatnonzero(model == m)
            starts = here[np.concatenate(([True], score[here][1:] != score[here][:-1]))]
            pos, neg, u = (np.zeros(resamples) for _ in range(3))
            k, end = 0, here[-1] + 1
            while k < len(starts):  # whole scores, about `batch` rows at a time
                j = max(k + 1, int(np.searchsorted(starts, starts[k] + batch)))
                lo, hi = starts[k], starts[j] if j < len(starts) else end
                w = weight[:, day[lo:hi]]
                wp, wn = (np.add.reduceat(w * v[lo:hi], starts[k:j] - lo, axis=1) for v in (p, n))
                below = np.cumsum(wn, axis=1) - wn + neg[:, None]
                u += (wp * (below + wn / 2)).sum(axis=1)
                pos, neg, k = pos + wp.sum(axis=1), neg + wn.sum(axis=1), j
            out = [pa.array(np.full(resamples, x)) for x in (m, part[here[0]])]
            yield pa.RecordBatch.from_arrays([*out, pa.array(np.arange(resamples)), pa.array(pos), pa.array(neg), pa.array(u)], ["m", ordered.RANGE, "resample", "p", "n", "u"])

    parts = dealt.mapInArrow(local, f"m int, {ordered.RANGE} int, resample bigint, p double, n double, u double")
    below = F.coalesce(F.sum("n").over(W.partitionBy("m", "resample").orderBy(ordered.RANGE).rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    sums = parts.select("m", "resample", "p", "n", (F.col("u") + F.col("p") * below).alias("u")).groupBy("resample", "m").agg((F.sum("u") / (F.sum("p") * F.sum("n"))).alias("auc"))
    return sums.groupBy("resample").agg((F.max(F.when(F.col("m") == 0, F.col("auc"))) - F.max(F.when(F.col("m") == 1, F.col("auc")))).alias("gain"))


def bootstrap_summary(gains: DataFrame) -> DataFrame:
    """Bounds of 95 % of the gains by place in order, and the share at or below 0."""
    placed = gains.select("gain", (F.row_number().over(W.orderBy("gain")) - 1).alias("k"), F.count("*").over(W.partitionBy()).alias("n"))
    return placed.agg(F.max(F.when(F.col("k") == F.floor(F.col("n") * 0.025), F.col("gain"))).alias("lo"), F.max(F.when(F.col("k") == F.floor(F.col("n") * 0.975), F.col("gain"))).alias("hi"), F.avg((F.col("gain") <= 0).cast("int")).alias("p_worse"), F.count("*").alias("resamples"))


def window_moments(data: RDD, retrain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, mean, deviation) of each retrain day's window, from blocks (x, y, t): each day's count and sums come once, and running sums
    over the days give every window by a difference."""

    def by_day(block: tuple) -> list[tuple]:
        x, _, t = block
        days, at = np.unique(t, return_inverse=True)
        both = np.column_stack([np.ones(len(x)), x, x * x])
        out = np.zeros((len(days), both.shape[1]))
        np.add.at(out, at, both)
        return list(zip(days.tolist(), out))

    found = sorted(data.flatMap(by_day).reduceByKey(np.add).collect(), key=lambda r: r[0])  # a row for each day
    days = np.array([d for d, _ in found])
    upto = np.vstack([np.zeros(2 * NF + 1), np.cumsum([s for _, s in found], axis=0)])
    window = upto[np.searchsorted(days, retrain - HORIZON, "right")] - upto[np.searchsorted(days, retrain - WINDOW, "left")]
    n = window[:, :1]
    mean = window[:, 1 : NF + 1] / np.maximum(n, 1)
    var = window[:, NF + 1 :] / np.maximum(n, 1) - mean**2
    return n[:, 0].astype(int), mean, np.where(var > 1e-12, np.sqrt(np.maximum(var, 0)), 1.0)


def walk_forward(rows: DataFrame, fwd: DataFrame, days: DataFrame) -> DataFrame:
    """(retrain_t, n, mean, sd, w): on each retrain day a fit on the sampled days of its window whose outcome was known then.

    A row is sent once: the windows that hold its day follow each other, so it carries the first and the last of them, and each Newton
    step sums the systems of all windows in one pass. The driver solves them, one small system a retrain day.
    """
    spark = rows.sparkSession
    sampled = rows.where((F.col("t") - 252) % STEP == 0).select("t", "sym_ix", vector()).join(fwd, ["t", "sym_ix"])
    retrain = np.array(sorted({r[0] for r in days.collect()}), int)
    data = blocks(sampled, "label", "t")
    n, mean, sd = window_moments(data, retrain)
    held = data.map(lambda b: (b[0], b[1], np.searchsorted(retrain, b[2] + HORIZON, "left"), np.searchsorted(retrain, b[2] + WINDOW, "right")))
    w = fit_systems(held, mean, sd, np.full(len(retrain), PENALTY))
    data.unpersist()
    models = [(int(r), int(n[k]), mean[k].tolist(), sd[k].tolist(), w[k].tolist()) for k, r in enumerate(retrain) if n[k]]
    return spark.createDataFrame(models, "retrain_t int, n bigint, mean array<double>, sd array<double>, w array<double>")


def walk_forward_scores(rows: DataFrame, models: DataFrame) -> DataFrame:
    """(t, sym_ix, symbol, retrain_t, score) by the latest model; before the first, the 126-day return's rank."""
    spans = models.select("retrain_t", "mean", "sd", "w", F.lead("retrain_t").over(W.orderBy("retrain_t")).alias("until"))
    spans = spans.withColumn("mt", F.explode(F.sequence("retrain_t", F.coalesce(F.col("until") - 1, F.col("retrain_t") + EVERY))))  # a row for each day
    j = rows.select("t", "sym_ix", "symbol", "sector", "ret126", vector()).join(F.broadcast(spans), F.col("t") == F.col("mt"), "left")
    terms = F.transform(F.arrays_zip("x", "mean", "sd", F.slice("w", 2, NF).alias("k")), lambda z: z["k"] * (z["x"] - z["mean"]) / z["sd"])
    score = F.aggregate(terms, F.col("w")[0], lambda a, b: a + b)
    return j.select("t", "sym_ix", "symbol", "sector", "retrain_t", F.coalesce(score, F.col("ret126").cast("double")).alias("score"))


def picks(rows: DataFrame, z: Column, model: Logistic, off: tuple[str, ...] = ()) -> DataFrame:
    """(symbol, z, prob, place, pctl, reasons): reasons are the four largest contributions of the logistic model."""
    named = F.zip_with(model.contributions(), F.array(*[F.lit(k) for k in FEATURES]), lambda v, k: F.struct((-F.abs(v)).alias("o"), k.alias("feature"), v.alias("v")))
    used = F.filter(named, lambda r: (F.abs(r["v"]) > 1e-9) & ~r["feature"].isin(*off)) if off else F.filter(named, lambda r: F.abs(r["v"]) > 1e-9)
    reasons = F.transform(F.slice(F.array_sort(used), 1, 4), lambda r: F.struct(r["feature"].alias("feature"), r["v"].alias("contribution")))
    out = ordered.numbered(rows.withColumn("z", z), [], [F.desc("z"), F.col("sym_ix")], "above").withColumn("place", (F.col("above") + 1).cast("int"))
    out = out.join(F.broadcast(out.agg(F.count("*").alias("n"))))
    return out.select("symbol", "sector", "z", sigmoid(F.col("z")).alias("prob"), "place", (1 - (F.col("place") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("pctl"), reasons.alias("reasons"))
