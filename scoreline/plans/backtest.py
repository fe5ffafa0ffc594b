"""Out-of-sample evaluation of the +EV rule and walk-forward folds.

``backtest``: for every priced line, bet at the opening price when the model's
probability gives positive EV there, stake the capped fractional Kelly, settle
with the game result, and measure closing-line value against the last pre-tip
price.  One summary row per book.

``walk_forward``: fold = season; a model trained on all earlier seasons scores
the fold's season.  The per-fold model here is histogram-binning calibration of
the rating probability: the observed win share per probability bin over earlier
seasons, shrunk toward the raw probability by one pseudo-game.  The running
per-bin totals across seasons are a window over one row per (bin, season), so
all folds are computed in one pass, with no driver loop.  ``walk_forward_fit`` fits
a logistic regression per fold instead, neighbouring folds from shared sums.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions import odds as fo
from scoreline.operators.prices import LINE_KEYS, WIN_MARKET
from scoreline.plans.evaluate import prob_metrics
from scoreline.sources.scratch import Tables

CAL_BINS = 10   # fixed-width probability bins of the walk-forward calibrator


def open_close(snaps: DataFrame, tipoffs: DataFrame, tip: str = "tip_ts") -> DataFrame:
    s = snaps.join(tipoffs.select("game_id", tip), "game_id").filter(F.col("captured_at") < F.col(tip))
    order = F.struct("captured_at", "snapshot_id")
    return s.groupBy(*LINE_KEYS).agg(F.min_by("american_odds", order).alias("open_odds"),
                                     F.max_by("american_odds", order).alias("close_odds"))


def backtest_bets(lines: DataFrame, games: DataFrame, p_home: str = "p_home") -> DataFrame:
    """Lines (game, book, market, side, open_odds, close_odds) x games (game_id, p_home,
    home_win) -> the +EV bets at the opening price, settled, with CLV.  Only the win market
    is bet: the model's probability says nothing about others."""
    lines = lines.where(F.col("market") == WIN_MARKET)
    g = games.select("game_id", p_home, "home_win")
    x = lines.join(g, "game_id").withColumn(
        "p", F.when(F.col("side") == "HOME", F.col(p_home)).otherwise(1.0 - F.col(p_home)))
    bets = x.filter(fo.expected_value("p", "open_odds") > 0)
    won = (F.col("side") == "HOME") == (F.col("home_win") == 1)
    stake = fo.recommended_stake("p", "open_odds")
    return bets.select(
        *LINE_KEYS, "open_odds", "close_odds", "p", stake.alias("stake"), won.alias("won"),
        F.when(won, stake * (fo.american_to_decimal("open_odds") - 1.0)).otherwise(-stake)
        .alias("profit"),
        fo.clv("open_odds", "close_odds").alias("clv"))


def backtest_summary(bets: DataFrame, by: str = "book") -> DataFrame:
    return bets.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_bets"), F.sum("stake").alias("staked"),
        F.sum("profit").alias("profit"),
        F.avg(F.col("won").cast("double")).alias("hit_rate"),
        F.avg("clv").alias("avg_clv"),
        F.avg((F.col("clv") > 0).cast("double")).alias("share_beat_close"),
    ).withColumn("roi", F.try_divide(F.col("profit"), F.col("staked")))


def walk_forward(scored: DataFrame, season: str = "season", y: str = "y", p: str = "p",
                 bins: int = CAL_BINS) -> DataFrame:
    """Metrics per (fold season, model) for the raw probability and the fold's
    calibrated probability; folds are seasons with at least one earlier season."""
    first = scored.groupBy(season).agg(F.min("game_date").alias("_first"))
    ords = first.select(season, F.dense_rank().over(Window.orderBy("_first", season)).alias("_ord"))
    s = (scored.join(F.broadcast(ords), season)   # one row per season: bounded
               .withColumn("_bin", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))))
    per = s.groupBy("_bin", "_ord").agg(F.sum(y).alias("_pos"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy("_bin").orderBy("_ord").rowsBetween(Window.unboundedPreceding, -1)
    hist = per.select("_bin", "_ord", F.coalesce(F.sum("_pos").over(w), F.lit(0)).alias("_hp"),
                      F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_hn"))
    # one row per (bin, season): bounded by the calendar
    test = s.filter(F.col("_ord") >= 2).join(F.broadcast(hist), ["_bin", "_ord"])
    cal = (F.col("_hp") + F.col(p)) / (F.col("_hn") + 1.0)
    long = test.select(F.col(season).alias("fold"), y, F.inline(F.array(
        F.struct(F.lit("raw").alias("model"), F.col(p).alias("p")),
        F.struct(F.lit("binned").alias("model"), cal.alias("p")))))
    return prob_metrics(long, model=["fold", "model"], y=y, p="p")


RIDGE = 1.0          # added to the diagonal of the Hessian (not for the intercept)
NEWTON_STEPS = 25
NEWTON_TOL = 1e-10
OWN_FOLDS = 64       # so many folds, then every fold a LADDER-th later, take Newton steps of their own
LADDER = 1.1
SHARING = 5          # folds that share an expansion: at least, as fewer are cheaper alone
SHARED_FOLDS = 512   # and at most
FOURTH = 0.128       # bound of the logistic function's fourth derivative
SEASON_ROWS = 1 << 16   # rows of a season beyond which several tasks share it


def _by_season(batches: Iterator[pa.RecordBatch], d: int, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(season, target, design) of at most ``most`` rows, by season."""
    for batch in batches:
        season, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        x = batch.column(2).flatten().to_numpy().reshape(-1, d)
        if (np.diff(season) < 0).any():
            order = np.argsort(season, kind="stable")
            season, y, x = season[order], y[order], x[order]
        for at in range(0, len(season), most):
            yield season[at:at + most], y[at:at + most], x[at:at + most]


def _statistics(beta: np.ndarray, folds: Sequence[int], d: int):
    """Task: gradient and Hessian of the logistic loss of some folds over their earlier seasons,
    as (fold, slot, value).  ``beta``: a column of weights per fold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(folds), d + d * d))
        for season, y, x in _by_season(batches, d, 1 << 14):
            for i, f in enumerate(folds):          # fold f: the season with ordinal f + 2
                n = np.searchsorted(season, f + 2)
                if n:
                    z = x[:n]
                    p = 1.0 / (1.0 + np.exp(-(z @ beta[:, f])))
                    total[i, :d] += z.T @ (y[:n] - p)
                    total[i, d:] += ((z * (p * (1 - p))[:, None]).T @ z).ravel()
        at, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(folds, np.int32)[at]), pa.array(slot.astype(np.int32)), pa.array(total[at, slot])],
            names=["fold", "slot", "value"])
    return run


class _Products:
    """Where the distinct products of two, three and four of ``d`` inputs stand, in sums of
    pairs x inputs and pairs x pairs."""

    def __init__(self, d: int):
        self.i, self.j = np.triu_indices(d)
        n = len(self.i)
        self.twice = np.where(self.i == self.j, 1.0, 2.0)      # a pair off the diagonal occurs twice
        self.square = np.zeros((d, d), dtype=np.int64)
        self.square[self.i, self.j] = self.square[self.j, self.i] = np.arange(n)
        pairs = np.column_stack([self.i, self.j])
        self.third, self.to_third = self._distinct(pairs, np.arange(d)[:, None])
        self.fourth, self.to_fourth = self._distinct(pairs, pairs)
        # gradient, Hessian, third and fourth order, fifth powers of the rows' norms
        self.ends = np.cumsum([d, n, len(self.third), len(self.fourth)])

    @staticmethod
    def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = np.sort(np.hstack([np.repeat(a, len(b), 0), np.tile(b, (len(a), 1))]), axis=1)
        _, first, place = np.unique(keys, axis=0, return_index=True, return_inverse=True)
        return first, place.reshape(len(a), len(b))

    def sums(self, z: np.ndarray, zz: np.ndarray, y: np.ndarray, fifth: np.ndarray, beta: np.ndarray) -> np.ndarray:
        """Of rows ``z`` with products of pairs ``zz``: the terms of the loss's expansion at ``beta``."""
        p = 1.0 / (1.0 + np.exp(-(z @ beta)))
        w = p * (1.0 - p)
        heavy = zz * (w * (1.0 - 6.0 * w))[:, None]
        return np.concatenate([z.T @ (y - p), w @ zz, (zz.T @ (z * (w * (1.0 - 2.0 * p))[:, None])).ravel()[self.third],
                               (heavy.T @ zz).ravel()[self.fourth], [fifth.sum()]])


def _expansions(groups: Sequence[tuple[int, int]], anchors: np.ndarray, whiten: np.ndarray, d: int):
    """Task: sums of the loss's expansion at the anchor (a column) of every group of folds
    [a, b), as (grp, ord, sums): those of the seasons that all folds of the group learn from
    under a + 1, and one row per later season."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        products, held = _Products(d), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in held], pa.int32()), pa.array([o for _, o in held], pa.int32()),
                 pa.array([v.tobytes() for v in held.values()], pa.binary())], names=["grp", "ord", "sums"])

        for season, y, x in _by_season(batches, d, 1 << 11):
            zz = x[:, products.i] * x[:, products.j]
            fifth = ((x @ whiten.T) ** 2).sum(1) ** 2.5
            for k, (a, b) in enumerate(groups):
                shared, n = np.searchsorted(season, [a + 1, b], side="right")
                starts = [0] * int(shared > 0) + [
                    int(shared + i) for i in np.flatnonzero(np.diff(season[shared:n], prepend=-1))]
                for lo, hi in zip(starts, [*starts[1:], n]):
                    at = (k, max(a + 1, int(season[lo])))
                    sums = products.sums(x[lo:hi], zz[lo:hi], y[lo:hi], fifth[lo:hi], anchors[:, k])
                    held[at] = held[at] + sums if at in held else sums
            if len(held) > 2048:
                yield out()
                held.clear()
        yield out()
    return run


def _near(sums: np.ndarray, anchor: np.ndarray, penalty: np.ndarray, whiten: np.ndarray,
          products: _Products) -> tuple[np.ndarray, float, float]:
    """A fold's weights from the expansion at ``anchor``; how far off they can be at most, by the
    remainder of the expansion; and how far from the anchor (in the norm of the whitened rows)
    that would still be within the tolerance."""
    d = len(anchor)
    g, h, third, fourth, fifth = np.split(sums, products.ends)
    h, third, fourth = h[products.square], third[products.to_third], fourth[products.to_fourth]
    ridge, delta, reached = penalty + 1e-9 * np.eye(d), np.zeros(d), False
    for _ in range(NEWTON_STEPS):
        m3 = (third @ delta)[products.square]
        m4 = (fourth @ (products.twice * delta[products.i] * delta[products.j]))[products.square]
        slope = h + m3 + m4 / 2
        step = np.linalg.solve(slope + ridge, g - (h + m3 / 2 + m4 / 6) @ delta - penalty @ (anchor + delta))
        delta = delta + step
        if not np.isfinite(delta).all():
            break
        if np.abs(step).max() < NEWTON_TOL:
            reached = True
            break
    least = np.linalg.eigvalsh(whiten @ (slope + penalty) @ whiten.T)[0] if reached else 0.0
    if least <= 0:                       # too far for the expansion: a Newton step
        return anchor + np.linalg.solve(h + ridge, g - penalty @ anchor), np.inf, 0.0
    move = float(np.linalg.norm(np.linalg.solve(whiten.T, delta)))
    # twice: the slope between these weights and the fold's own is more than half of ``slope``
    factor = 2 * FOURTH / 24 * float(fifth[0]) / least * np.linalg.norm(whiten, axis=0).max()
    return anchor + delta, factor * move ** 4, float((NEWTON_TOL / factor) ** 0.25)


SOLVED = "fold int, weights array<double>, error double, reach double"


def _solve(groups: Sequence[tuple[int, int]], anchors: np.ndarray, penalty: np.ndarray, whiten: np.ndarray):
    """Group of sums of one group of folds -> its folds' weights."""
    def run(table: pa.Table) -> pa.Table:
        k = table["grp"][0].as_py()
        products, found = _Products(len(penalty)), []
        by: dict[int, np.ndarray] = {}
        for o, v in zip(table["ord"].to_pylist(), table["sums"]):
            by[o] = by.get(o, 0.0) + np.frombuffer(v.as_buffer())
        total, (a, b) = 0.0, groups[k]
        for f in range(a, b):
            total = total + by.get(f + 1, 0.0)
            found.append((f, *_near(total, anchors[:, k], penalty, whiten, products)))
        fold, weights, error, reach = zip(*found)
        return pa.table({"fold": pa.array(fold, pa.int32()), "error": pa.array(error, pa.float64()),
                         "weights": pa.array([w.tolist() for w in weights], pa.list_(pa.float64())),
                         "reach": pa.array(reach, pa.float64())}).select(["fold", "weights", "error", "reach"])
    return run


def _groups(open_: Sequence[int], beta: np.ndarray, reach: np.ndarray, whiten: np.ndarray) -> list[tuple[int, int]]:
    """Ranges [a, b) of open folds whose weights, as far as known, lie near enough to those of
    the fold in the middle."""
    place = np.linalg.solve(whiten.T, beta)

    def cut(a: int, b: int) -> list[tuple[int, int]]:
        away = np.linalg.norm(place[:, a:b] - place[:, [(a + b) // 2]], axis=0)
        if b - a == 1 or b - a <= SHARED_FOLDS and (away <= 0.8 * reach[a:b]).all():
            return [(a, b)]
        return cut(a, (a + b) // 2) + cut((a + b) // 2, b)

    runs = np.split(np.array(open_), np.flatnonzero(np.diff(open_) > 1) + 1)
    return [g for r in runs for g in cut(int(r[0]), int(r[-1]) + 1)]


def _newton(design: DataFrame, beta: np.ndarray, folds: Sequence[int], penalty: np.ndarray) -> tuple[set, np.ndarray]:
    """Newton steps of some folds from the weights in ``beta``, which they change: (folds that did
    not settle, the last fold's Hessian)."""
    d, open_ = len(beta), set(folds)
    hessian = np.eye(d)
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        now = sorted(open_)
        sums = design.mapInArrow(_statistics(beta, now, d), "fold int, slot int, value double").groupBy(
            "fold", "slot").agg(F.sum("value").alias("value")).toArrow()
        total = np.zeros((max(now) + 1, d + d * d))
        total[sums["fold"].to_numpy(), sums["slot"].to_numpy()] = sums["value"].to_numpy()
        for f in now:
            h = total[f, d:].reshape(d, d) + penalty
            step = np.linalg.solve(h + 1e-9 * np.eye(d), total[f, :d] - penalty @ beta[:, f])
            beta[:, f] += step
            if np.abs(step).max() < NEWTON_TOL:
                open_.discard(f)
        if now[-1] == folds[-1]:
            hessian = h
    return open_, hessian


def fit_folds(frame: DataFrame, features: Sequence[str], season: str = "season", y: str = "home_win",
              date: str = "game_date", ridge: float = RIDGE) -> tuple[DataFrame, dict]:
    """Logistic regression per fold season on all seasons before it.

    The first folds, and later ones at growing distances, take Newton steps of their own, all
    together: one aggregate per step over the rows, each adding to the folds after its season.
    The folds between them lie near each other, the nearer the longer their history: a group of
    them shares one pass over its history, which sums up the loss's expansion to the fourth order
    at the group's middle, and every fold is solved from these sums.  The remainder bounds the
    error of its weights; folds beyond ``NEWTON_TOL`` go into smaller groups around better
    weights, and take Newton steps of their own where only a few would share.  The rows read so
    grow with the history, not with folds x history.  The driver holds folds x features^2 sums of
    the folds that step alone, and folds x features weights.  Features are standardised over
    the first season, so that no fold sees its future.
    Returns the frame with ``fold`` ordinals and p_fold for rows of season 2 on, and the fit:
    weights, mean, scale, converged."""
    features, d = list(features), len(features) + 1
    first = frame.groupBy(season).agg(F.min(date).alias("first"), F.count(F.lit(1)).alias("n"))
    ords = first.select(F.col(season).alias("season_"), F.dense_rank().over(
        Window.orderBy("first", season)).alias("ord"), F.floor(F.col("n") / SEASON_ROWS).alias("parts_"))
    tables, spark = Tables(frame.sparkSession, "walk-forward"), frame.sparkSession
    known = frame.join(F.broadcast(ords), F.col(season) == F.col("season_"))
    share = F.pmod(F.xxhash64(*features), F.col("parts_") + 1)
    rows = tables.put(known.withColumn("parts_", share).repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "ord", "parts_").sortWithinPartitions("ord")
        .drop("season_", "parts_"))
    head = rows.where("ord = 1").agg(*[f(c) for c in features for f in (F.avg, F.stddev_pop)]).first()
    mean = np.array([head[2 * i] or 0.0 for i in range(d - 1)])
    scale = np.array([head[2 * i + 1] or 1.0 for i in range(d - 1)])
    folds = max(0, (rows.agg(F.max("ord")).first()[0] or 0) - 1)
    design = rows.select("ord", F.col(y).cast("double").alias("y"), F.array(F.lit(1.0), *[
        (F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(features, mean, scale)]).alias("x"))
    beta, penalty = np.zeros((d, folds)), ridge * np.diag([0.0] + [1.0] * (d - 1))
    own = list(range(min(folds, OWN_FOLDS)))
    while own and own[-1] < folds - 1:
        own.append(min(folds - 1, max(own[-1] + 1, int(own[-1] * LADDER))))
    unsettled, hessian = _newton(design, beta, own, penalty)
    open_ = sorted(set(range(folds)) - set(own))
    if open_:
        finite = np.isfinite(hessian).all()
        whiten = np.linalg.inv(np.linalg.cholesky((hessian if finite else 0.0) + 1e-9 * np.eye(d)))
        for row in beta:
            row[open_] = np.interp(open_, own, row[own])
        reach = np.full(folds, np.inf)
    for _ in range(NEWTON_STEPS):
        if not open_:
            break
        groups = _groups(open_, beta, reach, whiten)
        alone = [f for a, b in groups if b - a < SHARING for f in range(a, b)]
        if alone:
            unsettled |= _newton(design, beta, alone, penalty)[0]
            open_ = sorted(set(open_) - set(alone))
            groups = [(a, b) for a, b in groups if b - a >= SHARING]
        if not groups:
            break
        anchors = beta[:, [(a + b) // 2 for a, b in groups]]
        found = design.mapInArrow(_expansions(groups, anchors, whiten, d), "grp int, ord int, sums binary").groupBy(
            "grp").applyInArrow(_solve(groups, anchors, penalty, whiten), SOLVED).toArrow()
        fold = found["fold"].to_numpy()
        beta[:, fold] = found["weights"].combine_chunks().flatten().to_numpy().reshape(-1, d).T
        reach[fold] = found["reach"].to_numpy()
        open_ = sorted(set(open_) - set(fold[found["error"].to_numpy() <= NEWTON_TOL].tolist()))
    unsettled |= set(open_)

    @F.arrow_udf("double")
    def probability(ord_: pa.Array, *cols: pa.Array) -> pa.Array:
        x = np.column_stack([np.ones(len(ord_)), *(
            (c.to_numpy(zero_copy_only=False).astype(float) - m) / s for c, m, s in zip(cols, mean, scale))])
        own = np.maximum(ord_.to_numpy(zero_copy_only=False).astype(int) - 2, 0)
        return pa.array(1.0 / (1.0 + np.exp(-(x * beta[:, own].T).sum(1))))

    scored = rows.where("ord >= 2").withColumn("p_fold", probability(
        "ord", *[F.col(c).cast("double") for c in features]))
    return scored, {"weights": beta, "mean": mean, "scale": scale, "converged": folds - len(unsettled),
                    "rows": rows}


def walk_forward_fit(frame: DataFrame, features: Sequence[str], season: str = "season",
                     y: str = "home_win", rating: str = "elo_exp_home") -> DataFrame:
    """Metrics per fold season of the fold's own model and of the rating."""
    scored, _ = fit_folds(frame, features, season, y)
    long = scored.select(F.col(season).alias("fold"), F.col(y).alias("y"), F.inline(F.array(
        F.struct(F.lit("rating").alias("model"), F.col(rating).alias("p")),
        F.struct(F.lit("fitted").alias("model"), F.col("p_fold").alias("p")))))
    return prob_metrics(long, model=["fold", "model"], y="y", p="p")


def fold_sizes(fit: dict, season: str = "season") -> DataFrame:
    """(fold, n_train, n_test): rows before the fold season, and in it."""
    per = fit["rows"].groupBy(season, "ord").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)    # a row per season
    return per.withColumn("n_train", F.sum("n").over(before)).where("ord >= 2").select(
        F.col(season).alias("fold"), "n_train", F.col("n").alias("n_test"))
