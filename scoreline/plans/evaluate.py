"""Probability quality: metrics, reliability bins, isotonic calibration, walk-forward.

Input is long form (model, y, p), so any number of models is scored in one pass
grouped by model.  No scores are collected: AUC comes from per-score counts and a
running count of negatives below each score; quantile edges come from global
positions.  Both running quantities use bucketed offsets (``running_below``):
per-bucket totals are a small table, and the running sum inside a bucket is a
window over that bucket's distinct scores only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed value: clipping of p in log loss (float64 machine epsilon, library default)
LOG_LOSS_EPS = 2.220446049250313e-16
N_BINS = 10
METRIC_DIGITS = 4
SCORE_BUCKETS = 4096


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def _score_bucket(p: Column) -> Column:
    return F.least(F.greatest(F.floor(p * SCORE_BUCKETS), F.lit(-1)), F.lit(SCORE_BUCKETS))


def running_below(d: DataFrame, part: str, score: str, count_col: str, out: str) -> DataFrame:
    """Add ``out`` = sum of ``count_col`` over rows of the same ``part`` with a smaller
    ``score`` (``d`` has one row per (part, score))."""
    part = _cols(part)
    b = d.withColumn("_bk", _score_bucket(F.col(score)))
    tot = b.groupBy(*part, "_bk").agg(F.sum(count_col).alias("_t"))
    off = tot.select(*part, "_bk", F.coalesce(F.sum("_t").over(
        Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    inner = F.coalesce(F.sum(count_col).over(
        Window.partitionBy(*part, "_bk").orderBy(score)
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # both sides are partitioned by part and bucket; the planner broadcasts a small ``off``
    return (b.withColumn("_in", inner).join(off, [*part, "_bk"])
             .withColumn(out, F.col("_off") + F.col("_in")).drop("_bk", "_in", "_off"))


def score_counts(scored: DataFrame, model, y: str = "y", p: str = "p") -> DataFrame:
    """One row per (model, score): positives and negatives.  Every metric and bin below
    is computed from this table, so the scored rows are read by one aggregate."""
    model = _cols(model)
    return scored.groupBy(*model, p).agg(F.sum(F.col(y)).cast("double").alias("_pos"),
                                         F.sum(1 - F.col(y)).cast("double").alias("_neg"))


def auc(d: DataFrame, model, p: str = "p") -> DataFrame:
    """Exact ROC AUC per model from score counts; tied scores count one half."""
    model = _cols(model)
    d = running_below(d, model, p, "_neg", "_neg_below")
    return d.groupBy(*model).agg(
        (F.sum(F.col("_pos") * (F.col("_neg_below") + 0.5 * F.col("_neg")))
         / (F.sum("_pos") * F.sum("_neg"))).alias("auc"))


def prob_metrics(scored: DataFrame, model="model", y: str = "y", p: str = "p",
                 digits: int = METRIC_DIGITS) -> DataFrame:
    """n, log loss, Brier, accuracy at p > 0.5 and AUC per model, rounded."""
    model = _cols(model)
    d = score_counts(scored, model, y, p)
    pc = F.least(F.greatest(F.col(p), F.lit(LOG_LOSS_EPS)), F.lit(1.0 - LOG_LOSS_EPS))
    n = F.col("_pos") + F.col("_neg")
    hi = (F.col(p) > 0.5).cast("double")
    base = d.groupBy(*model).agg(
        F.sum(n).cast("bigint").alias("n"),
        (-F.sum(F.col("_pos") * F.log(pc) + F.col("_neg") * F.log(1.0 - pc)) / F.sum(n))
        .alias("log_loss"),
        (F.sum(F.col("_pos") * F.pow(F.col(p) - 1.0, 2) + F.col("_neg") * F.pow(F.col(p), 2))
         / F.sum(n)).alias("brier"),
        (F.sum(F.col("_pos") * hi + F.col("_neg") * (1.0 - hi)) / F.sum(n)).alias("accuracy"))
    out = base.join(auc(d, model, p), model)
    return out.select(*model, "n", *[F.round(c, digits).alias(c)
                                    for c in ("log_loss", "brier", "accuracy", "auc")])


def quantile_edges(d: DataFrame, model: str = "model", p: str = "p",
                   n_bins: int = N_BINS) -> DataFrame:
    """Inner edges q = 1/n .. (n-1)/n per model from score counts ``d``: linear
    interpolation between closest ranks (position (n-1) q), exact, nothing collected."""
    d = d.withColumn("_c", F.col("_pos") + F.col("_neg"))
    n = d.groupBy(F.col(model).alias("_m")).agg(F.sum("_c").alias("_n"))
    d = running_below(d, model, p, "_c", "_before").join(n, F.col(model).eqNullSafe(F.col("_m")))
    # the ranks that this score covers, of the two around each quantile: most scores have none
    first, end = F.col("_before"), F.col("_before") + F.col("_c")
    at = [F.lit(i / n_bins) * (F.col("_n") - 1) for i in range(1, n_bins)]
    ranks = F.array(*[F.struct(F.lit(i).alias("i"), (h - F.floor(h)).alias("frac"),
                               F.lit(up).alias("up"), (F.floor(h) + up).alias("r"))
                      for i, h in enumerate(at) for up in (0, 1)])
    hit = d.select(model, F.col(p).alias("_p"), F.explode(
        F.filter(ranks, lambda x: (x["r"] >= first) & (x["r"] < end))).alias("x"))
    edge = hit.groupBy(model, F.col("x.i").alias("_qi"), F.col("x.frac").alias("_f")).agg(
        F.max(F.when(F.col("x.up") == 0, F.col("_p"))).alias("_lo"),
        F.max(F.when(F.col("x.up") == 1, F.col("_p"))).alias("_hi"))
    # at the last rank there is none above it, and its share is 0
    above = F.coalesce("_hi", "_lo")
    return edge.select(model, "_qi", (F.col("_lo") + (above - F.col("_lo")) * F.col("_f")).alias("edge"))


def calibration_bins(scored: DataFrame, model: str = "model", y: str = "y", p: str = "p",
                     n_bins: int = N_BINS) -> DataFrame:
    """Equal-frequency reliability curve: bin = number of inner edges strictly below p;
    per non-empty bin the mean prediction and the observed share of positives.

    Edges come from the score counts; the bin averages are taken over the rows
    themselves (a mean of p from (p, count) pairs rounds differently at exact ties).
    """
    edges = quantile_edges(score_counts(scored, model, y, p), model, p, n_bins) \
        .groupBy(model).agg(F.array_sort(F.collect_list("edge")).alias("_edges"))
    # one row of n_bins - 1 edges per model: bounded, broadcast
    b = scored.join(F.broadcast(edges), model).withColumn(
        "bin", F.size(F.filter("_edges", lambda e: e < F.col(p))))
    return b.groupBy(model, "bin").agg(F.count(F.lit(1)).alias("n"),
                                       F.avg(p).alias("mean_pred"),
                                       F.avg(F.col(y).cast("double")).alias("frac_pos"))


@dataclass
class Isotonic:
    """Knots of an increasing fit: predictions clip outside them and are linear between."""

    x: list[float]
    y: list[float]

    def predict(self, p: Column) -> Column:
        x, y = np.array(self.x), np.array(self.y)

        @F.arrow_udf("double")
        def at(col: pa.Array) -> pa.Array:
            v = col.to_numpy(zero_copy_only=False).astype(float)
            out = np.interp(v, x, y) if len(x) else np.full(len(v), np.nan)
            return pa.array(out, mask=np.isnan(v) | np.isnan(out))
        return at(p.cast("double"))


BLOCK = "lo double, hi double, pos double, w double"     # scores [lo, hi], outcomes, weight
MERGE = 16                                               # stacks of blocks merged at once


def _pool(lo: np.ndarray, hi: np.ndarray, pos: np.ndarray, w: np.ndarray) -> list[list[float]]:
    """Neighbouring blocks (by score) whose shares of positives do not increase become one."""
    stack: list[list[float]] = []
    for block in zip(lo.tolist(), hi.tolist(), pos.tolist(), w.tolist()):
        block = list(block)
        while stack and stack[-1][2] * block[3] >= block[2] * stack[-1][3]:
            last = stack.pop()
            block = [last[0], block[1], last[2] + block[2], last[3] + block[3]]
        stack.append(block)
    return stack


def _pool_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows, which are in the order of their scores."""
    stack: list[list[float]] = []
    part = TaskContext.get().partitionId()
    for batch in batches:
        rows = [np.array([r[i] for r in stack]) for i in range(4)]
        stack = _pool(*(np.append(rows[i], batch.column(i).to_numpy()) for i in range(4)))
    cols = list(zip(*stack)) if stack else [()] * 4
    yield pa.RecordBatch.from_arrays(
        [*(pa.array(c, pa.float64()) for c in cols), pa.array([part] * len(stack), pa.int64())],
        names=["lo", "hi", "pos", "w", "part"])


def _pool_group(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("lo")
    cols = list(zip(*_pool(*(rows[c].to_numpy() for c in ("lo", "hi", "pos", "w")))))
    part = rows["part"][0].as_py()
    return pa.table({**{c: pa.array(v, pa.float64()) for c, v in zip(("lo", "hi", "pos", "w"), cols)},
                     "part": pa.array([part] * len(cols[0]), pa.int64())})


def isotonic_blocks(points: DataFrame, parts: int | None = None, merge: int = MERGE) -> DataFrame:
    """Blocks of the increasing least-squares fit of ``points`` (p, pos, w; p unique).

    Scores are dealt out in ranges and pooled per range to a stack of blocks; neighbouring
    stacks are then merged, ``merge`` at a time.  Pooling blocks that are pooled already gives
    the same fit, so a task holds the blocks of its stacks and never all scores."""
    spark = points.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = (points.select(F.col("p").alias("lo"), F.col("p").alias("hi"), "pos", "w")
              .repartitionByRange(parts, "lo").sortWithinPartitions("lo")
              .mapInArrow(_pool_task, f"{BLOCK}, part long"))
    while parts > 1:
        parts = -(-parts // merge)
        blocks = blocks.withColumn("part", F.floor(F.col("part") / merge)).groupBy("part").applyInArrow(
            _pool_group, f"{BLOCK}, part long")
    return blocks.drop("part")


def _knots(blocks: DataFrame) -> Isotonic:
    """The model on the driver: two knots per block (far fewer than scores: shares of positives
    that rise from block to block need ever longer blocks)."""
    x: list[float] = []
    y: list[float] = []
    for r in sorted(blocks.collect(), key=lambda r: r["lo"]):
        for at in (r["lo"], r["hi"]) if r["hi"] > r["lo"] else (r["lo"],):
            x.append(at)
            y.append(r["pos"] / r["w"])
    return Isotonic(x, y)


def _points(train: DataFrame, y: str, p: str) -> DataFrame:
    """Equal scores pool to their mean whatever the fit: one weighted point per score."""
    return train.where(F.col(p).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(p).cast("double").alias("p")).agg(
        F.sum(F.col(y).cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("w"))


def fit_isotonic(train: DataFrame, y: str = "y", p: str = "p") -> Isotonic:
    """Isotonic (increasing) fit of y on p."""
    return _knots(isotonic_blocks(_points(train, y, p)))


PSEUDO = 10.0   # games at the raw score that each calibrated block is mixed with


def fit_calibrator(train: DataFrame, y: str = "y", p: str = "p", pseudo: float = 0.0) -> Isotonic:
    """Isotonic fit; with ``pseudo`` games one for small samples: every block becomes one point
    at its mean score, its share of positives is drawn toward that score by so many games, and
    a second fit joins the points by lines.  A block of a few games then claims no certainty."""
    if not pseudo:
        return fit_isotonic(train, y, p)
    fitted = fit_isotonic(train, y, p)
    blocks = train.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p"),
                          fitted.predict(F.col(p)).alias("p_cal"))
    points = blocks.groupBy("p_cal").agg(F.avg("p").alias("p"), F.sum("y").alias("s"),
                                         F.count(F.lit(1)).cast("double").alias("w"))
    points = points.select("p", "w", (F.col("w") * (F.col("s") + pseudo * F.col("p"))
                                      / (F.col("w") + pseudo)).alias("pos"))
    return _knots(isotonic_blocks(points.groupBy("p").agg(F.sum("pos").alias("pos"), F.sum("w").alias("w"))))


def apply_isotonic(df: DataFrame, fitted: Isotonic, p: str = "p") -> DataFrame:
    return df.withColumn("p_cal", fitted.predict(F.col(p)))


def isotonic_calibrate(train: DataFrame, apply_to: DataFrame, y: str = "y",
                       p: str = "p") -> DataFrame:
    return apply_isotonic(apply_to, fit_isotonic(train, y, p), p)


def metric_gate(metrics: DataFrame, calibrated: str, baseline: str,
                model: str = "model") -> bool:
    """Quality gate: calibrated log loss no worse than the baseline's."""
    rows = {r[model]: r["log_loss"] for r in
            metrics.filter(F.col(model).isin(calibrated, baseline)).collect()}
    return rows[calibrated] <= rows[baseline]
