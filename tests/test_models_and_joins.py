"""Boosting, isotonic fits, folds, point-in-time joins, rounding, landing and boards against
brute force."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.functions import odds as fo
from scoreline.operators import sequence
from scoreline.plans import backtest, board, boost, evaluate
from scoreline.sources import landing


# ---------------------------------------------------------------------------- boosting

def table(spark, n=3000, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, n), rng.integers(0, 30, n), rng.integers(0, 2, n)]).astype(float)
    p = 1 / (1 + np.exp(-(0.4 * (x[:, 0] - 6) + 1.5 * (x[:, 2] - 0.5) * (x[:, 1] > 15))))
    y = (rng.random(n) < p).astype(int)
    rows = [(i, i % 4 > 0, int(y[i]), *x[i].tolist()) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, train boolean, y int, a double, b double, c double")


def grow(x, y, params, trees):
    """Plain second-order boosting on all rows and all cuts (values are few)."""
    base = math.log(y.mean() / (1 - y.mean()))
    margin, out = np.full(len(y), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(len(y), dtype=int)
        for _ in range(params.depth):
            nxt = node * 2
            for i in np.unique(node):
                at = node == i
                best = (0.0, None, None)
                for f in range(x.shape[1]):
                    for cut in np.unique(x[:, f])[:-1]:
                        left = at & (x[:, f] <= cut)
                        right = at & ~left
                        if h[left].sum() < params.child_weight or h[right].sum() < params.child_weight:
                            continue
                        gain = sum(g[s].sum() ** 2 / (h[s].sum() + params.ridge) for s in (left, right)) \
                            - g[at].sum() ** 2 / (h[at].sum() + params.ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, f, cut)
                if best[1] is not None:
                    nxt[at] += x[at, best[1]] > best[2]
            node = nxt
        for i in np.unique(node):
            at = node == i
            margin[at] -= params.rate * g[at].sum() / (h[at].sum() + params.ridge)
        out.append(margin.copy())
    return out[-1]


def test_trees_equal_plain_boosting(spark):
    x, y, df = table(spark)
    params = boost.Params(trees=6, depth=2, rate=0.3, rows=1.0, columns=1.0, patience=99)
    got = boost.fit(df.repartition(5), ["a", "b", "c"], "y", F.lit(True), "id", params)
    assert len(got.trees) == 6
    want = grow(x, y, params, 6)
    assert np.allclose(got.margin(x), want, atol=1e-9)
    p = {r.id: r.p for r in df.select("id", got.probability().alias("p")).collect()}
    assert np.allclose([p[i] for i in range(len(y))], 1 / (1 + np.exp(-want)))
    assert math.isclose(sum(got.gains.values()), 1.0)


def test_patience_and_renewed_margins(spark, monkeypatch):
    _, _, df = table(spark)
    params = boost.Params(trees=60, depth=2, rate=0.5, patience=8)
    one = boost.fit(df, ["a", "b", "c"], "y", F.col("train"), "id", params)
    monkeypatch.setattr(boost, "RENEW", 3)
    two = boost.fit(df.repartition(3), ["a", "b", "c"], "y", F.col("train"), "id", params)
    assert len(one.trees) == len(two.trees) < 60
    best = int(np.argmin(one.valid_loss))
    assert len(one.trees) == best and len(one.valid_loss) == best + 9
    assert np.allclose(one.valid_loss, two.valid_loss)
    constant = boost.fit(df.withColumn("y", F.lit(1)), ["a"], "y", F.col("train"), "id", params)
    assert constant.trees == [] and constant.base > 5


def test_passes_read_blocks_of_rows(spark, monkeypatch):
    """What a pass over the rows reads is a few blocks, and the walk equals a row's own descent."""
    _, y, df = table(spark)
    written, put = [], boost.Tables.put
    monkeypatch.setattr(boost.Tables, "put", lambda self, d, *done: written.append(put(self, d, *done)) or written[-1])
    params = boost.Params(trees=3, depth=3, rate=0.3)
    got = boost.fit(df.coalesce(2), ["a", "b", "c"], "y", F.col("train"), "id", params)
    assert written[0].count() <= 2 < len(y)
    x = np.random.default_rng(1).normal(size=(500, 3))
    for t in got.trees:
        at = []
        for row in x:
            node = 0
            for _ in range(3):
                f = t.feature[node]
                node = 2 * node + 1 + (f >= 0 and row[f] > t.cut[node])
            at.append(node - 7)
        assert t.walk(np.ascontiguousarray(x.T), t.cut, 3).tolist() == at


def test_tasks_get_the_trees_that_margins_lack(spark, monkeypatch):
    """A pass walks the trees since the margins were written, not all so far."""
    _, _, df = table(spark)
    seen, histogram = [], boost._histogram
    monkeypatch.setattr(boost, "RENEW", 4)
    monkeypatch.setattr(boost, "_histogram", lambda trees, *a: seen.append(len(trees)) or histogram(trees, *a))
    got = boost.fit(df, ["a", "b", "c"], "y", F.col("train"), "id", boost.Params(trees=10, depth=1, rate=0.1))
    assert seen == [i % 4 for i in range(11)] and len(got.trees) > 4


def test_walk_of_bytes_equals_a_descent():
    """Trees of several depths, nodes without a cut among them, over bytes up to 255."""
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (3, 400)).astype(np.uint8)
    for depth in (0, 1, 2, 4):
        inner = 2 ** depth - 1
        t = boost.Tree(rng.integers(-1, 3, inner), rng.integers(0, 255, inner), np.zeros(inner), np.zeros(2 ** depth))
        got = t.walk(x, t.bin, depth)
        assert got.dtype == np.uint8
        for i in range(x.shape[1]):
            node = 0
            for _ in range(depth):
                f = t.feature[node]
                node = 2 * node + 1 + int(f >= 0 and x[f, i] > t.bin[node])
            assert got[i] == node - inner


def test_lookups_by_turns_equal_walks():
    """Leaves looked up by all turns of a row are those of its descent, also in deeper trees."""
    rng = np.random.default_rng(5)
    x, start = rng.integers(0, 256, (3, 500)).astype(np.uint8), rng.normal(size=500)
    trees = []
    for depth in (0, 1, 2, 3, 3, 4):
        inner = 2 ** depth - 1
        trees.append(boost.Tree(rng.integers(-1, 3, inner), rng.integers(0, 255, inner), np.zeros(inner),
                                rng.normal(size=2 ** depth)))
    want = start.copy()
    for t in trees:
        want += t.leaf.take(t.walk(x, t.bin, len(t.leaf).bit_length() - 1))
    assert np.array_equal(boost._walked(trees)(x, start), want)
    assert boost._walked(trees)(x[:, :0], start[:0]).shape == (0,)


def test_passes_walk_only_the_rows_they_count(spark, monkeypatch):
    """Lower levels add the missing trees to the sampled training rows alone."""
    import pyarrow as pa
    rng = np.random.default_rng(2)
    n, d = 1000, 3
    block = (np.arange(n), np.arange(n) % 4 > 0, (np.arange(n) % 3 == 0).astype(float),
             rng.integers(0, 16, (d, n)).astype(np.uint8), rng.normal(size=n))
    walked, whole = [], boost._walked
    monkeypatch.setattr(boost, "_walked", lambda trees: lambda x, m: walked.append(len(m)) or whole(trees)(x, m))
    tree = boost.Tree(np.zeros(7, np.int64), np.full(7, 8), np.zeros(7), rng.normal(size=8))
    params, sums = boost.Params(rows=0.5), []
    for level in (0, 1):
        task = boost._histogram([tree], tree, level, 0, params, np.arange(d), d, 16)
        sums.append(pa.Table.from_batches(task(boost._written(iter([block])))).to_pandas().set_index("slot"))
    drawn = block[1] & (boost._uniform(block[0], 0) < 0.5)
    assert walked == [250, drawn.sum(), drawn.sum()]
    margin = whole([tree])(block[3], block[4])
    p = 1 / (1 + np.exp(-margin))
    for s in sums:
        own = s[s.index >= 0]
        assert math.isclose(own.g.sum(), d * (p - block[2])[drawn].sum(), abs_tol=1e-9)
        assert math.isclose(own.h.sum(), d * (p * (1 - p))[drawn].sum(), abs_tol=1e-9)
    held = ~block[1]
    loss = (np.logaddexp(0, margin) - block[2] * margin)[held].sum()
    assert math.isclose(sums[0].g[boost.LOSS], loss) and sums[0].g[boost.WEIGHT] == 250


def test_matchups_share_the_inputs_of_the_fit(spark, monkeypatch):
    """Games, form and ratings are built once for the fit and the latest form, with the same rows."""
    from scoreline import registry
    from tests.conftest import SF_SMALL

    built = {"elo_ratings": 0, "team_form": 0, "fx_games": 0}
    for module, name in ((registry.rating, "elo_ratings"), (registry.form, "team_form"), (registry.fx, "fx_games")):
        def counted(*a, _f=getattr(module, name), _n=name, **k):
            built[_n] += 1
            return _f(*a, **k)
        monkeypatch.setattr(module, name, counted)
    fit = registry.model.fit
    monkeypatch.setattr(registry.model, "fit", lambda split: fit(split, params=boost.Params(trees=2)))
    got = registry.q_score_matchups(spark, SF_SMALL).collect()
    assert built == {"elo_ratings": 1, "team_form": 1, "fx_games": 1}
    g = registry.games_shared(spark, SF_SMALL)
    want = registry.features.matchup_features(registry.upcoming(spark, SF_SMALL, g), registry.latest_of(spark, SF_SMALL, g))
    assert sorted((r.game_id, r.elo_exp_home) for r in got) == sorted(
        (r.game_id, r.elo_exp_home) for r in want.collect()) and got


# ---------------------------------------------------------------------------- isotonic

@pytest.mark.parametrize("parts, merge", [(8, 2), (1, 16), (7, 3)])
def test_isotonic_equals_the_library(spark, parts, merge):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    rng = np.random.default_rng(parts)
    p = np.round(rng.random(20000), 5)
    y = (rng.random(20000) < p ** 2).astype(float)
    df = spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y double, p double")
    points = evaluate._points(df, "y", "p")
    assert points.count() >= 10000
    fitted = evaluate._knots(evaluate.isotonic_blocks(points, parts, merge))
    assert len(fitted.x) < 400                         # what the driver holds
    lib = IsotonicRegression(featuresCol="f", labelCol="y", predictionCol="q").fit(
        VectorAssembler(inputCols=["p"], outputCol="f").transform(df))
    asks = spark.createDataFrame([(x,) for x in [-1.0, 0.0, 2.0, *rng.random(500).tolist(), *p[:500].tolist()]],
                                 "p double")
    want = {r.p: r.q for r in lib.transform(VectorAssembler(inputCols=["p"], outputCol="f").transform(asks)).collect()}
    got = {r.p: r.p_cal for r in evaluate.apply_isotonic(asks, fitted).collect()}
    assert all(math.isclose(got[x], want[x], abs_tol=1e-9) for x in want)


def test_isotonic_edges(spark):
    def fit(rows):
        return evaluate.fit_isotonic(spark.createDataFrame(rows, "y double, p double"))

    falling = fit([(1.0, 0.1), (0.0, 0.5), (1.0, 0.6), (0.0, 0.9), (None, 0.2), (1.0, None)])
    assert (falling.x, falling.y) == ([0.1, 0.9], [0.5, 0.5])
    assert fit([(1.0, 0.3)]).y == [1.0]
    none = fit([])
    out = evaluate.apply_isotonic(spark.createDataFrame([(0.5,), (None,)], "p double"), none).collect()
    assert [r.p_cal for r in out] == [None, None]


# ---------------------------------------------------------------------------- folds

def test_folds_equal_refits(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(1500):
        s = 2000 + i // 300
        a, b = rng.standard_normal(2) * [1, 5] + [0, 3]
        y = int(rng.random() < 1 / (1 + math.exp(-(0.8 * a - 0.1 * b))))
        rows.append((i, s, dt.date(s, 1, 1) + dt.timedelta(days=i % 300), y, float(a), float(b), 0.5))
    df = spark.createDataFrame(rows, "id long, season int, game_date date, home_win int, a double, b double, "
                                     "elo_exp_home double").repartition(4)
    scored, fit = backtest.fit_folds(df, ["a", "b"])
    assert fit["converged"] == 4
    first = np.array([r[4:6] for r in rows if r[1] == 2000])
    mean, scale = first.mean(0), first.std(0)
    got = {r.id: r.p_fold for r in scored.collect()}
    assert len(got) == 1200
    for fold in range(2001, 2005):
        old = [r for r in rows if r[1] < fold]
        x = np.column_stack([np.ones(len(old)), (np.array([r[4:6] for r in old]) - mean) / scale])
        y, beta = np.array([r[3] for r in old]), np.zeros(3)
        pen = np.diag([0.0, backtest.RIDGE, backtest.RIDGE])
        for _ in range(50):
            p = 1 / (1 + np.exp(-x @ beta))
            beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pen, x.T @ (y - p) - pen @ beta)
        for r in rows:
            if r[1] == fold:
                z = np.concatenate([[1.0], (np.array(r[4:6]) - mean) / scale])
                assert math.isclose(got[r[0]], 1 / (1 + math.exp(-z @ beta)), abs_tol=1e-7)
    sizes = {r.fold: (r.n_train, r.n_test) for r in backtest.fold_sizes(fit).collect()}
    assert sizes == {2001: (300, 300), 2002: (600, 300), 2003: (900, 300), 2004: (1200, 300)}
    mets = backtest.walk_forward_fit(df, ["a", "b"]).collect()
    assert {(r.fold, r.model) for r in mets} == {(f, m) for f in range(2001, 2005) for m in ("fitted", "rating")}
    by = {(r.fold, r.model): r.log_loss for r in mets}
    assert all(by[f, "fitted"] < by[f, "rating"] for f in range(2001, 2005))
    one = df.where("season = 2000")
    assert backtest.fit_folds(one, ["a", "b"])[0].count() == 0


def test_folds_share_passes(spark, monkeypatch):
    """Late folds are solved from sums of the loss's expansion that a group of them shares, within
    the tolerance of their refits; few folds take Newton steps of their own."""
    rng = np.random.default_rng(11)
    seasons, n = 60, 600
    x = rng.standard_normal((seasons * n, 2))
    x[:, 1] += x[:, 0]
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(0.3 + 0.8 * x[:, 0] - 0.2 * x[:, 1])))).astype(int)
    df = spark.createDataFrame(
        [(2000 + i // n, dt.date(2000 + i // n, 1, 1), int(y[i]), float(x[i, 0]), float(x[i, 1])) for i in range(len(x))],
        "season int, game_date date, home_win int, a double, b double").repartition(5)
    own, newton = [], backtest._newton
    monkeypatch.setattr(backtest, "_newton", lambda design, beta, folds, penalty: own.extend(folds) or newton(
        design, beta, folds, penalty))
    monkeypatch.setattr(backtest, "OWN_FOLDS", 6)
    monkeypatch.setattr(backtest, "LADDER", 1.4)
    monkeypatch.setattr(backtest, "NEWTON_TOL", 1e-6)
    monkeypatch.setattr(backtest, "SEASON_ROWS", 200)        # a season lies in several tasks
    _, fit = backtest.fit_folds(df, ["a", "b"])
    assert fit["converged"] == seasons - 1
    assert len(own) == len(set(own)) < (seasons - 1) // 2
    design = np.column_stack([np.ones(len(x)), (x - fit["mean"]) / fit["scale"]])
    pen = np.diag([0.0, backtest.RIDGE, backtest.RIDGE])
    for f in range(seasons - 1):
        z, t, beta = design[:(f + 1) * n], y[:(f + 1) * n], np.zeros(3)
        for _ in range(12):
            p = 1 / (1 + np.exp(-z @ beta))
            beta += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + pen, z.T @ (t - p) - pen @ beta)
        assert np.abs(fit["weights"][:, f] - beta).max() <= 1e-6


def test_folds_of_a_constant_outcome_end(spark):
    """Weights without a limit are reported as not converged, folds of their own or shared."""
    rows = [(2000 + i // 8, dt.date(2000 + i // 8, 1, 1), 1, float(i % 3), 0.5) for i in range(8 * 80)]
    df = spark.createDataFrame(rows, "season int, game_date date, home_win int, a double, elo_exp_home double")
    scored, fit = backtest.fit_folds(df, ["a"])
    assert fit["weights"].shape == (2, 79) and scored.count() == 8 * 79
    assert np.isfinite(fit["weights"]).all()
    assert fit["converged"] < 79


# ---------------------------------------------------------------------------- as of

@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("width", [5, 100000])
def test_as_of_equals_brute_force(spark, strict, width):
    rng = random.Random(7)
    right = [(rng.choice([1, 1, 1, 1, 2, 3, None]), rng.choice([None, *range(300)]), i, i * 10) for i in range(500)]
    left = [(i, rng.choice([1, 1, 1, 2, 4, None]), rng.choice([None, *range(-5, 320)]), "x") for i in range(400)]
    r = spark.createDataFrame(right, "k long, at long, n long, value long")
    l = spark.createDataFrame(left, "id long, k long, t long, bk string")
    got = {x.id: x.value for x in sequence.as_of(
        l, r, ["k"], "t", "at", ["value"], F.floor(F.col("at") / width), ["n"], strict).collect()}
    assert len(got) == 400
    for i, k, t, _ in left:
        ok = [x for x in right if x[0] == k and k is not None and t is not None and x[1] is not None
              and (x[1] < t if strict else x[1] <= t)]
        assert got[i] == (max(ok, key=lambda x: (x[1], x[2]))[3] if ok else None)
    empty = sequence.as_of(l, r.where("false"), ["k"], "t", "at", ["value"], F.lit(0))
    assert empty.where("value IS NOT NULL").count() == 0 and empty.count() == 400


# ---------------------------------------------------------------------------- rounding

def test_rounding_equals_python(spark):
    rng = random.Random(9)
    values = [0.0625, 0.5005, 0.1875, 2.5, -2.5, 0.0005, 0.0015, -0.0005, 1e-12, 0.0, 0.99949999999, 123456.7895]
    values += [rng.uniform(-3, 3) for _ in range(3000)] + [rng.randint(-20000, 20000) / 2000 for _ in range(3000)]
    values += [math.nextafter(v, math.inf) for v in values[:3000]] + [math.nextafter(v, -math.inf) for v in values[:3000]]
    values += [(2 * k + 1) / 2 ** 10 for k in range(-500, 500)]
    df = spark.createDataFrame(list(enumerate(values)), "i long, x double").repartition(4)
    out = df.select("i", *[fo.round_half_even("x", d).alias(f"r{d}") for d in (0, 3, 4)]).collect()
    for r in out:
        for d in (0, 3, 4):
            assert r[f"r{d}"] == round(values[r.i], d), (values[r.i], d)
    odd = spark.createDataFrame([(None,), (float("nan"),), (float("inf"),)], "x double")
    got = [r.r for r in odd.select(fo.round_half_even("x", 3).alias("r")).collect()]
    assert got[0] is None and math.isnan(got[1]) and got[2] == float("inf")


# ---------------------------------------------------------------------------- landing

@pytest.mark.parametrize("dies_after", ["nothing", "data", "keys", "manifest"])
def test_a_killed_landing_neither_loses_nor_doubles(spark, scratch, dies_after):
    rows = spark.createDataFrame([(i, f"g{i}") for i in range(100)], "id long, text string")
    assert landing.land_run(spark, rows.where("id < 30"), scratch, "id", "a") == 30

    def die(name):
        if name == dies_after:
            raise InterruptedError(name)

    before = landing.read_landed(spark, scratch, rows.schema).count()
    if dies_after == "nothing":
        landing.land_run(spark, rows, scratch, "id", "b", die)
    else:
        with pytest.raises(InterruptedError):
            landing.land_run(spark, rows, scratch, "id", "b", die)
        seen = landing.read_landed(spark, scratch, rows.schema).count()
        assert seen == (100 if dies_after == "manifest" else before)
    landing.land_run(spark, rows, scratch, "id", "b")                    # the same run again
    assert landing.land_run(spark, rows, scratch, "id", "c") == 0        # nothing left
    got = landing.read_landed(spark, scratch, rows.schema)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.collect()))


# ---------------------------------------------------------------------------- board

def test_board_falls_back_to_the_sample(spark):
    preds = spark.createDataFrame(
        [(i, 1 + i % 3, 5 + i % 4, i % 2, 0.3 + i / 100, 0.5) for i in range(20)],
        "game_id long, home_team_id long, away_team_id long, home_win int, p_model double, p_market double")
    sample = board.heldout_board(preds, "p_model", "p_market")
    live = sample.drop("result").withColumn("source", F.lit("live"))
    shown = board.live_or_sample(live, sample)
    assert {r.source for r in shown.collect()} == {"live"} and shown.columns == sample.columns
    spare = board.live_or_sample(live.where("false"), sample).collect()
    assert len(spare) == 8 and {r.result for r in spare} <= {"HOME win", "AWAY win"}
    for r, o in zip(sorted(board.rounded_board(sample).collect(), key=lambda r: r.game_id),
                    sorted(sample.collect(), key=lambda r: r.game_id)):
        assert r.p_home == round(o.p_home, 3) and r.kelly_stake == round(o.kelly_stake, 4)
