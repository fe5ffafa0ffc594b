"""Second-order boosted trees on histograms.

Features are cut into bins once and written as blocks of rows, a byte per bin, so that a pass
hands whole arrays to the tasks.  Each level of a tree is one aggregate: every task adds up
gradients and hessians per (node, feature, bin) of its rows, Spark sums the partial
histograms, and the driver picks the best cut of every node from at most 2^depth x features x
bins sums.  The margins of the rows come from the trees so far, from a written table that is
renewed every ``RENEW`` trees.  The validation loss of the trees so far is part of the same
aggregate, so growing stops as soon as patience has run out, inside one fit.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.sources.scratch import Tables

BINS = 64          # at most 256: a bin is a byte
RENEW = 25
BLOCK = 1 << 16    # rows of one block
CORES = 32         # cores whose partial histograms one task adds up, about


@contextmanager
def _small_sums(spark: SparkSession):
    """Some hundred aggregates with a few thousand result rows each: planned without
    re-planning and added up by few tasks."""
    reducers = max(2, spark.sparkContext.defaultParallelism // CORES)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(reducers)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@dataclass(frozen=True)
class Params:
    """The booster's settings."""

    trees: int = 300
    depth: int = 3
    rate: float = 0.04
    rows: float = 0.8          # share of the training rows that a tree sees
    columns: float = 0.8       # share of the features that a tree sees
    child_weight: float = 5.0  # least sum of hessians of a child
    ridge: float = 1.0         # added to the hessian of a leaf
    patience: int = 30         # trees without a better validation loss


@dataclass
class Tree:
    """A full binary tree: node i has the children 2i + 1 and 2i + 2; a feature of -1 sends
    everything to the left.  ``cut``: rows with a value up to it go left."""

    feature: np.ndarray
    bin: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def walk(self, x: np.ndarray, cuts: np.ndarray, levels: int) -> np.ndarray:
        """Node of every row after some levels (counted inside the level).  ``x``: a row per
        feature."""
        n = x.shape[1]
        node, taken = np.zeros(n, dtype=np.uint8 if levels <= 8 else np.int64), []
        for level in range(levels):
            first = 2 ** level - 1
            at = slice(first, 2 * first + 1)
            # plain numbers: bytes are compared as bytes
            right = [x[f] > cut if f >= 0 else np.zeros(n, dtype=bool)
                     for f, cut in zip(self.feature[at], cuts[at].tolist())]
            for turn in reversed(taken):     # of two neighbours, the one that the row's last turn led to
                right = [a ^ (turn & (a ^ b)) for a, b in zip(right[::2], right[1::2])]
            taken.append(right[0])
            node = 2 * node + right[0]
        return node

    def by_turns(self) -> np.ndarray:
        """Leaf value of a row by its turns at all inner nodes (bit i: right at node i)."""
        inner = len(self.feature)
        turns, node = np.arange(2 ** inner), np.zeros(2 ** inner, np.int64)
        for _ in range(_depth(self)):
            node = 2 * node + 1 + (turns >> node & 1)
        return self.leaf[node - inner]


@dataclass
class Booster:
    features: list[str]
    trees: list[Tree] = field(default_factory=list)
    base: float = 0.0
    gains: dict[str, float] = field(default_factory=dict)
    valid_loss: list[float] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        x = np.ascontiguousarray(x.T)
        out = np.full(x.shape[1], self.base)
        for t in self.trees:
            out += t.leaf.take(t.walk(x, t.cut, _depth(t)))
        return out

    def probability(self) -> Column:
        """Probability of the target, from the feature columns."""
        @F.arrow_udf("double")
        def p(*cols: pa.Array) -> pa.Array:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in cols]).T
            return pa.array(1.0 / (1.0 + np.exp(-self.margin(x))))
        return p(*[F.col(c).cast("double") for c in self.features])


def _depth(tree: Tree) -> int:
    return int(len(tree.leaf)).bit_length() - 1


def _uniform(ids: np.ndarray, tree: int) -> np.ndarray:
    """A number in [0, 1) per row and tree, the same wherever the row lies."""
    h = ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = h + np.uint64((tree + 1) * 0xD1B54A32D192ED03 % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)).astype(np.float64) / 2.0 ** 53


STATE = "id binary, train binary, y binary, x binary, margin binary"


def _blocks(batches: Iterator[pa.RecordBatch], d: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of rows: ids, whether they train, targets, bins (a row per feature), margins."""
    for batch in batches:
        for row in zip(*batch.columns):
            ids, train, y, x, margin = (np.frombuffer(c.as_buffer(), t) for c, t in zip(
                row, (np.int64, bool, np.float64, np.uint8, np.float64)))
            yield ids, train, y, x.reshape(d, -1), margin


def _written(blocks: Iterator[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
    for block in blocks:
        yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in block],
                                         names=["id", "train", "y", "x", "margin"])


LOSS, WEIGHT = -1, -2          # slots of the validation loss and its rows


def _histogram(trees: Sequence[Tree], tree: Tree, level: int, number: int, params: Params,
               used: np.ndarray, d: int, bins: int):
    """Task: sums per (node of the level, feature, bin) as (slot, g, h).  ``trees``: those that the
    written margins lack."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 2 ** level * d * bins
        g_all, h_all = np.zeros(size), np.zeros(size)
        loss = weight = 0.0
        grown = _walked(trees)
        for ids, train, y, x, margin in _blocks(batches, d):
            if level == 0:
                held = np.flatnonzero(~train)
                m = grown(x.take(held, axis=1), margin[held])
                loss += float((np.logaddexp(0.0, m) - y[held] * m).sum())
                weight += len(m)
            # only rows that the pass counts are walked
            at = np.flatnonzero(train & (_uniform(ids, number) < params.rows))
            x = x.take(at, axis=1)
            p = 1.0 / (1.0 + np.exp(-grown(x, margin[at])))
            g, h = p - y[at], p * (1 - p)
            node = tree.walk(x, tree.bin, level).astype(np.int64) * bins
            for f in used:
                slot = node + x[f]
                for total, weights in ((g_all, g), (h_all, h)):
                    total.reshape(-1, d, bins)[:, f] += np.bincount(
                        slot, weights=weights, minlength=2 ** level * bins).reshape(-1, bins)
        slots = np.flatnonzero(h_all)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(slots, [LOSS, WEIGHT])), pa.array(np.append(g_all[slots], [loss, weight])),
             pa.array(np.append(h_all[slots], [0.0, 0.0]))], names=["slot", "g", "h"])
    return run


def _split(g: np.ndarray, h: np.ndarray, params: Params) -> tuple[int, int, float]:
    """Best (feature, bin, gain) of a node from its histograms (feature x bin); ties to the
    first feature and bin."""
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    total_g, total_h = g.sum(1), h.sum(1)
    gr, hr = total_g[:, None] - gl, total_h[:, None] - hl

    def value(a, b):
        return a * a / (b + params.ridge)

    gain = value(gl, hl) + value(gr, hr) - value(total_g, total_h)[:, None]
    gain = np.where((hl >= params.child_weight) & (hr >= params.child_weight), gain, -np.inf)
    if not gain.size or not np.isfinite(gain).any() or gain.max() <= 0:
        return -1, 0, 0.0
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return int(f), int(b), float(gain[f, b])


def best_length(losses: list[float], patience: int) -> tuple[int, bool]:
    """(losses up to the lowest one before patience runs out, whether it ran out)."""
    best = 0
    for t, loss in enumerate(losses):
        if loss < losses[best]:
            best = t
        elif t - best >= patience:
            return best + 1, True
    return best + 1, False


def fit(data: DataFrame, features: Sequence[str], target: str, train: Column, key: str,
        params: Params = Params(), seed: int = 7, bins: int = BINS) -> Booster:
    """Grow trees on the rows where ``train`` holds; the others are the validation rows.

    ``key`` names a unique long per row (it decides which trees see the row).  Features must
    not be null.  The driver holds cuts, trees and one level's sums."""
    features, d = list(features), len(features)
    tables = Tables(data.sparkSession, "boost")
    rows = data.select(F.col(key).cast("long").alias("id"), train.alias("train"),
                       F.col(target).cast("double").alias("y"),
                       *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    shares = [i / bins for i in range(1, bins)]
    cuts = [np.unique(c) for c in rows.where("train").approxQuantile(
        [f"f{i}" for i in range(d)], shares, 0.001)]
    prior = rows.where("train").agg(F.avg("y")).first()[0]
    booster = Booster(features)
    if prior is None or prior in (0.0, 1.0):
        booster.base = 0.0 if prior is None else (1 if prior else -1) * 10.0
        return booster
    booster.base = float(np.log(prior / (1 - prior)))

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks() -> Iterator[tuple[np.ndarray, ...]]:
            for table in _gathered(batches):
                x = np.stack([np.searchsorted(cuts[i], table.column(3 + i).to_numpy(), side="left")
                              for i in range(d)]).astype(np.uint8)
                yield (table.column(0).to_numpy().astype(np.int64), table.column(1).to_numpy().astype(bool),
                       table.column(2).to_numpy(), x, np.full(table.num_rows, booster.base))
        return _written(blocks())

    if bins > 256:
        raise ValueError("at most 256 bins")
    state = tables.put(rows.mapInArrow(binned, STATE))
    state = _kept(state)
    from_tree = 0
    rng = np.random.default_rng(seed)
    gains, splits = np.zeros(d), np.zeros(d)
    best = 0
    for number in range(params.trees + 1):
        inner, leaves = 2 ** params.depth - 1, 2 ** params.depth
        tree = Tree(np.full(inner, -1), np.zeros(inner, np.int64), np.zeros(inner), np.zeros(leaves))
        used = np.sort(rng.permutation(d)[:max(1, int(params.columns * d))])
        for level in range(params.depth):
            with _small_sums(data.sparkSession):
                sums = state.mapInArrow(_histogram(booster.trees[from_tree:], tree, level, number, params, used,
                                                   d, bins), "slot long, g double, h double").groupBy("slot").agg(
                    F.sum("g").alias("g"), F.sum("h").alias("h")).toArrow()
            slot, gs, hs = (sums[c].to_numpy() for c in ("slot", "g", "h"))
            if level == 0:
                rows_valid = gs[slot == WEIGHT].sum()
                booster.valid_loss.append(float(gs[slot == LOSS].sum() / max(rows_valid, 1)))
                length, settled = best_length(booster.valid_loss, params.patience)
                best = length - 1             # the first loss is that of no tree
                if number == params.trees or (rows_valid and settled):
                    break
            g, h = np.zeros(2 ** level * d * bins), np.zeros(2 ** level * d * bins)
            real = slot >= 0
            g[slot[real]], h[slot[real]] = gs[real], hs[real]
            g, h = g.reshape(-1, d, bins), h.reshape(-1, d, bins)
            for i in range(2 ** level):
                node = 2 ** level - 1 + i
                f, b, gain = _split(g[i], h[i], params)
                tree.feature[node] = f
                if f >= 0:
                    tree.bin[node], tree.cut[node] = b, cuts[f][b]
                    gains[f] += gain
                    splits[f] += 1
                if level == params.depth - 1:
                    column = f if f >= 0 else used[0]
                    left = slice(0, b + 1) if f >= 0 else slice(None)
                    for side, part in ((0, left), (1, slice(b + 1, None))):
                        if side and f < 0:
                            continue
                        total_g, total_h = g[i, column, part].sum(), h[i, column, part].sum()
                        tree.leaf[2 * i + side] = -params.rate * total_g / (total_h + params.ridge)
        else:
            booster.trees.append(tree)
            if len(booster.trees) - from_tree == RENEW:
                state = _kept(tables.put(state.mapInArrow(_renew(booster.trees[from_tree:], d), STATE)), state)
                from_tree = len(booster.trees)
            continue
        break
    if booster.valid_loss and rows_valid:
        booster.trees = booster.trees[:best]          # tree ``best`` was judged with so many trees
    state.unpersist()
    mean = np.divide(gains, splits, out=np.zeros(d), where=splits > 0)
    booster.gains = dict(zip(features, (mean / (mean.sum() or 1.0)).tolist()))
    return booster


def _kept(state: DataFrame, done: DataFrame | None = None) -> DataFrame:
    """The written table, held in memory or on disk while it is read again and again."""
    written = state._written
    state = state.persist()
    state._written = written
    if done is not None:
        done.unpersist()
    return state


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about ``BLOCK`` rows."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= BLOCK:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _walked(trees: Sequence[Tree]):
    """A function (bins, margins) -> margins with the trees added.  A row's turns at all inner nodes
    of a tree make a byte that looks up its leaf; trees of more than 3 levels are walked."""
    lookups = [(t, t.by_turns() if _depth(t) <= 3 else None) for t in trees]

    def grown(x: np.ndarray, margin: np.ndarray) -> np.ndarray:
        margin, n = margin.copy(), len(margin)
        turn, turns = np.empty(n, dtype=bool), np.empty(n, dtype=np.uint8)
        for t, leaves in lookups:
            if leaves is None:
                margin += t.leaf.take(t.walk(x, t.bin, _depth(t)))
                continue
            turns[:] = 0
            for f, cut in zip(t.feature[::-1].tolist(), t.bin[::-1].tolist()):
                np.add(turns, turns, out=turns)
                if f >= 0:
                    np.bitwise_or(turns, np.greater(x[f], cut, out=turn).view(np.uint8), out=turns)
            margin += leaves.take(turns)
        return margin
    return grown


def _renew(trees: Sequence[Tree], d: int):
    """Task: the written table with new margins."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grown = _walked(trees)
        return _written((ids, train, y, x, grown(x, margin))
                        for ids, train, y, x, margin in _blocks(batches, d))
    return run
