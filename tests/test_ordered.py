"""Ordered statistics over many ranges, the seeded generator, and the learned models, against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barsight.functions import random32
from barsight.functions import scalars as S
from barsight.operators import cross_section as X
from barsight.operators import ordered, stats
from barsight.plans import learning as L


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def scored(spark, n=600, seed=4):
    r = random.Random(seed)
    rows = [(("a", "b")[k % 7 == 0], r.choice([r.random(), 0.5, 0.25]), r.randint(0, 1), k, r.choice([r.random(), 0.0])) for k in range(n)]
    return rows, spark.createDataFrame(rows, "key string, score double, label int, k int, fwd double")


def test_running_sums_over_ranges(spark, many_ranges):
    rows, df = scored(spark)
    out = ordered.with_before(df, ["key"], [F.desc("score"), F.col("k")], {"n": F.lit(1), "y": F.col("label")}).collect()
    for key in "ab":
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[3]))
        got = {r["k"]: (r["n"], r["y"]) for r in out if r["key"] == key}
        assert got == {r[3]: (i, sum(x[2] for x in mine[:i])) for i, r in enumerate(mine)}
    dealt = ordered.ranged(df, ["key"], [F.desc("score"), F.col("k")]).groupBy(ordered.RANGE).count().collect()
    assert len(dealt) > 4 and max(r["count"] for r in dealt) < 300


def test_statistics_over_ranges(spark, many_ranges):
    rows, df = scored(spark)
    found = {r["key"]: r for r in stats.auc(df, ["key"]).collect()}
    ic = {r["key"]: r["ic"] for r in stats.spearman(df, ["key"]).collect()}
    roc = stats.roc_points(df, ["key"]).collect()
    tens = stats.deciles(df, ["key"], ["k"]).collect()
    for key in "ab":
        mine = [r for r in rows if r[0] == key]
        pos, neg = [r[1] for r in mine if r[2]], [r[1] for r in mine if not r[2]]
        assert found[key]["auc"] == pytest.approx(sum((p > q) + (p == q) / 2 for p in pos for q in neg) / len(pos) / len(neg), abs=1e-12)
        rank = lambda xs: [sum(y < x for y in xs) + (sum(y == x for y in xs) + 1) / 2 for x in xs]
        assert ic[key] == pytest.approx(np.corrcoef(rank([r[1] for r in mine]), rank([r[4] for r in mine]))[0, 1], abs=1e-12)
        levels = sorted({r[1] for r in mine}, reverse=True)
        points = [(0.0, 0.0)] + [(sum(x >= v for x in neg) / len(neg), sum(x >= v for x in pos) / len(pos)) for v in levels]
        every = len(points) / 400
        chosen = range(len(points)) if len(points) <= 400 else sorted({int(j * every) for j in range(400)} | {len(points) - 1})
        assert sorted((r["k"], r["fpr"], r["tpr"]) for r in roc if r["key"] == key) == [(k, *map(pytest.approx, points[k])) for k in chosen]
        mine.sort(key=lambda r: (r[1], r[3]))
        n = len(mine)
        want = [mine[b * n // 10 : (b + 1) * n // 10] for b in range(10)]
        assert [(r["n"], r["score_lo"], r["score_hi"]) for r in sorted(tens, key=lambda r: r["bucket"]) if r["key"] == key] == [(len(w), w[0][1], w[-1][1]) for w in want]


def test_no_window_wider_than_a_range(spark):
    """Windows are by range, but for the one over a row per range."""
    import re

    _, df = scored(spark)
    plan = stats.auc(df, ["key"])._jdf.queryExecution().optimizedPlan().toString()
    windows = re.findall(r"Window \[.*?\], \[(.*?)\], \[(.*?)\]", plan)
    assert len(windows) == 2 and sum(ordered.RANGE not in by for by, _ in windows) == 1 and all(ordered.RANGE in by or ordered.RANGE in order for by, order in windows)


def test_draws_are_the_generator_step_by_step(spark):
    def sequence(seed, n):
        for _ in range(n):
            seed = (seed + 0x6D2B79F5) % 2**32
            t = (seed ^ seed >> 15) * (1 | seed) % 2**32
            t = (t + (t ^ t >> 7) * (61 | t)) % 2**32 ^ t
            yield (t ^ t >> 14) / 2**32

    for seed in (0, 7, 42, 2**32 - 1, -3):
        want = list(sequence(seed, 300))
        assert random32.draws(seed, np.arange(300)).tolist() == want
        assert [r[0] for r in spark.range(300).coalesce(1).select(random32.draw(seed, F.col("id"))).collect()] == want
    far = 10**12 + 5
    assert random32.draws(42, np.array([far]))[0] == spark.range(far, far + 1).select(random32.draw(42, F.col("id"))).first()[0]
    # Worked by hand from the mixer's definition: seed 0.
    assert next(sequence(0, 1)) == 0.26642920868471265


def test_ranks_in_one_sort(spark):
    r = random.Random(3)
    rows = [(t, k, r.choice([None, 1.0, 2.0, r.random()]), None if t == 3 else float(k)) for t in range(9) for k in range(1 if t == 5 else 12)]
    df = spark.createDataFrame(rows, "t int, k int, a double, b double")
    for batch in (1, 5, 10_000):
        got = {(x["t"], x["k"]): (x["a"], x["b"]) for x in X.average_ranks(df, ["a", "b"], batch).collect()}
        for t, k, a, b in rows:
            for j, v in ((2, a), (3, b)):
                day = [x[j] for x in rows if x[0] == t and x[j] is not None]
                want = 0.5 if v is None or len(day) < 2 else (sum(x < v for x in day) + (sum(x == v for x in day) - 1) / 2) / (len(day) - 1)
                assert got[t, k][j - 2] == np.float32(want)
    assert X.average_ranks(df.limit(0), ["a"]).count() == 0


def learnable(spark, n=1500, seed=2, parts=3):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, L.NF)), 2)
    y = (r.random(n) < 1 / (1 + np.exp(-2 * x[:, 0] * x[:, 1] - x[:, 2]))).astype(int)
    t = np.arange(n) // 10
    rows = [(int(t[k]), k % 10, [float(v) for v in x[k]], int(y[k])) for k in range(n)]
    return t, x, y, spark.createDataFrame(rows, "t int, sym_ix int, x array<double>, label int").repartition(parts)


def plain_trees(x, y, edges, rounds):
    """Every node's histogram summed directly, rows drawn one after the other."""
    z = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    prior = np.log(y.mean() / (1 - y.mean()))
    margin, trees, k = np.full(len(y), prior), [], 0
    for _ in range(rounds):
        half = []
        for _ in range(len(y)):
            half.append(random32.draws(42, np.array([k]))[0] < 0.5)
            k += 1
        p = 1 / (1 + np.exp(-margin))
        g, h, half = p - y, p * (1 - p), np.array(half)
        tree, level = [None], [(0, np.flatnonzero(half))]
        value = lambda rows: (-0.1 * g[rows].sum() / (h[rows].sum() + 1.0),)
        tree[0] = value(level[0][1])
        for _ in range(3):
            following = []
            for node, rows in level:
                best = (0.0, None, None)
                for f in range(x.shape[1]):
                    for b in range(31):
                        left = z[rows, f] <= b
                        hl, hr, gl, gr = h[rows][left].sum(), h[rows][~left].sum(), g[rows][left].sum(), g[rows][~left].sum()
                        if hl >= L.LEAST_HESSIAN and hr >= L.LEAST_HESSIAN:
                            gain = gl**2 / (hl + 1) + gr**2 / (hr + 1) - (gl + gr) ** 2 / (hl + hr + 1)
                            if gain > best[0] + 1e-12:
                                best = (gain, f, b)
                if best[1] is not None:
                    left = z[rows, best[1]] <= best[2]
                    tree[node] = (best[1], best[2], len(tree), len(tree) + 1)
                    for part in (rows[left], rows[~left]):
                        following.append((len(tree), part))
                        tree.append(value(part))
            level = following
        trees.append(tree)
        for r in range(len(y)):
            n = tree[0]
            while len(n) == 4:
                n = tree[n[2] if z[r, n[0]] <= n[1] else n[3]]
            margin[r] += n[0]
    return trees


@pytest.mark.parametrize("renewed,part", [(1000, 50_000), (2, 400)], ids=["one part", "parts, written again"])
def test_trees_are_those_of_direct_sums(spark, monkeypatch, renewed, part):
    monkeypatch.setattr(L, "LEAST_HESSIAN", 15.0)
    monkeypatch.setattr(L, "RENEWED", renewed)
    monkeypatch.setattr(L, "PART", part)
    _, x, y, rows = learnable(spark, 700)
    edges = L.bin_edges(rows)
    found = L.fit_trees(rows, "true", None, edges, rounds=4)
    want = plain_trees(x, y, edges, 4)
    assert [[n[:4] if len(n) == 4 else "leaf" for n in t] for t in found.trees] == [[n[:4] if len(n) == 4 else "leaf" for n in t] for t in want]
    assert [n[0] for t in found.trees for n in t if len(n) == 1] == pytest.approx([n[0] for t in want for n in t if len(n) == 1], abs=1e-9)
    assert max(len(t) for t in want) > 5


def test_boosting_stops_and_scores(spark, monkeypatch):
    monkeypatch.setattr(L, "LEAST_HESSIAN", 5.0)
    monkeypatch.setattr(L, "MOST_TREES", 20)
    _, x, y, rows = learnable(spark)
    model = L.fit_trees(rows, "t < 100", "t >= 100", L.bin_edges(rows.where("t < 100")))
    assert len(model.trees) in (10, 20)
    val = rows.where("t >= 100")
    auc = L.auc_of(L.scored_by_trees(val, model), F.col("z"))
    judged = L.blocks(val.repartition(3), "label").map(lambda b: (model.bins(b[0]), b[1], np.full(len(b[1]), model.prior)))
    assert L.auc_of_blocks(judged, model.trees) == pytest.approx(auc, abs=1e-12) and auc > 0.6


def test_several_penalties_in_one_run(spark):
    _, x, y, rows = learnable(spark)
    for m in L.fit_logistic(rows, 1.0, 100.0, 3000.0):
        want = L.fit_local(x, y.astype(float), m.penalty)
        assert m.w == pytest.approx(want.w, abs=1e-9) and m.mean == pytest.approx(want.mean) and m.sd == pytest.approx(want.sd)


def test_walk_forward_is_a_fit_of_each_window(spark, monkeypatch):
    monkeypatch.setattr(L, "WINDOW", 200)
    r = np.random.default_rng(8)
    keys = [(t, s) for t in range(252, 900, 5) for s in range(6)]
    x = r.random((len(keys), L.NF)).astype(np.float32)
    x[:, 3], x[:, 4] = 0.5, 0
    y = (r.random(len(keys)) < x[:, 0]).astype(int)
    rows = spark.createDataFrame([(t, s, *map(float, v)) for (t, s), v in zip(keys, x)], "t int, sym_ix int, " + ", ".join(f"{k} float" for k in L.FEATURES))
    fwd = spark.createDataFrame([(t, s, int(v)) for (t, s), v in zip(keys, y)], "t int, sym_ix int, label int")
    days = spark.createDataFrame([(d,) for d in (100, 300, 363, 600, 899)], "r int")
    found = {m["retrain_t"]: m for m in L.walk_forward(rows, fwd, days).collect()}
    t = np.array([k[0] for k in keys])
    assert set(found) == {300, 363, 600, 899}
    for d, m in found.items():
        here = (t + L.HORIZON <= d) & (t >= d - 200)
        want = L.fit_local(x[here].astype(float), y[here].astype(float), L.PENALTY)
        assert m["n"] == here.sum() and m["w"] == pytest.approx(want.w.tolist(), abs=1e-9) and m["mean"] == pytest.approx(want.mean.tolist(), abs=1e-12)
        assert m["sd"] == pytest.approx(np.where(want.sd > 1e-6, want.sd, 1.0).tolist(), abs=1e-9)


@pytest.mark.parametrize("batch", [3, 4096])
def test_bootstrap_weighs_whole_days(spark, many_ranges, batch):
    r = random.Random(6)
    rows = [(t * 5, r.choice([r.random(), 0.5]), r.choice([r.random(), 0.1]), r.randint(0, 1)) for t in range(11) for _ in range(9)]
    df = spark.createDataFrame(rows, "t int, a double, b double, label int")
    got = {x["resample"]: x["gain"] for x in L.bootstrap(df, "a", "b", 25, batch=batch).collect()}
    draws = iter(random32.draws(7, np.arange(25 * 11)))
    for k in range(25):
        w = [0] * 11
        for _ in range(11):
            w[int(next(draws) * 11)] += 1

        def auc(j):
            pairs = [(w[p[0] // 5] * w[q[0] // 5], (p[j] > q[j]) + (p[j] == q[j]) / 2) for p in rows if p[3] for q in rows if not q[3]]
            return sum(a * b for a, b in pairs) / sum(a for a, _ in pairs)

        assert got[k] == pytest.approx(auc(1) - auc(2), abs=1e-12)


# Cases at and beside every threshold, and without a number.
CASES = [None, float("nan"), float("inf"), 0.0, 0.47, 0.48, 0.4999, 0.5, 0.5099, 0.51, 0.5199, 0.52, 0.5201, 0.5499, 0.55, 0.5999, 0.6, 1.0]


def test_verdicts_at_every_threshold(spark):
    number = lambda x: x is not None and np.isfinite(x)
    word = lambda x: None if not number(x) else "strong" if x >= 0.6 else "useful" if x >= 0.55 else "weak" if x > 0.52 else "none" if x >= 0.48 else "inverted"
    got = spark.createDataFrame([(k, x) for k, x in enumerate(CASES)], "k int, x double").select("k", S.auc_verdict(F.col("x"))).collect()
    assert {r[0]: r[1] for r in got} == {k: word(x) for k, x in enumerate(CASES)}
    level = lambda a, b, c: "better than the rules" if number(a) and number(b) and number(c) and a >= 0.52 and b >= 0.52 and c > 0 else "uncertain" if number(a) and number(b) and a >= 0.51 and b >= 0.5 else "no edge"
    rows = [(i * 400 + j * 20 + k, a, b, c) for i, a in enumerate(CASES) for j, b in enumerate(CASES) for k, c in enumerate(CASES[:5])]
    got = spark.createDataFrame(rows, "k int, a double, b double, c double").select("k", S.model_verdict(F.col("a"), F.col("b"), F.col("c"))).collect()
    assert {r[0]: r[1] for r in got} == {k: level(a, b, c) for k, a, b, c in rows}
