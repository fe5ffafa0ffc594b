"""Toxicity: character n-grams scaled by naive Bayes log-count ratios, linear classifier.

Features are the distinct hashed byte n-grams of a lower-cased text that lie inside one
word (with a blank on either side as part of it).  From labelled rows come document counts
per bucket in toxic and other texts; r = log of the ratio of the smoothed, normalised
counts.  A logistic regression on r-scaled presence features gives the weights.

The fit uses a bounded sample of labelled rows (``max_toxic`` and ``max_other`` rows, chosen
by a hash of the id); scoring reads every byte of every row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd
from scoreline.llm.linear import fit_sparse, sigmoid
from scoreline.llm.tables import Tables

SIZES = (4, 6)            # n-gram lengths in bytes
BUCKETS = 1 << 20
MAX_TOXIC, MAX_OTHER = 4000, 8000   # bound of the training sample
MIN_DOCS = 5              # documents that a feature needs
MAX_FEATURES = 1 << 14    # features with the largest evidence


def buckets(buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, start) of each n-gram of ``n`` bytes inside a word, with its blanks."""
    if len(buf) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = len(buf) - n + 1
    h = np.zeros(size, dtype=np.uint32)
    for k in range(n):
        h = h * np.uint32(0x01000193) + buf[k:k + size]
    h ^= h >> np.uint32(15)
    h = h * np.uint32(0x2C1B3C6D + 2 * n)
    h ^= h >> np.uint32(12)
    blank = ~wd.PLAIN[buf]
    inner = np.append(0, np.cumsum(blank, dtype=np.int32))
    ok = inner[n - 1:n - 1 + size] == inner[1:1 + size]       # bytes 1 .. n-2
    cuts = offs[1:-1]
    for k in range(1, n):                                     # not across documents
        at = cuts - k
        ok[at[(at >= 0) & (at < size)]] = False
    pos = np.flatnonzero(ok)
    return (h[pos] & np.uint32(BUCKETS - 1)).astype(np.int64), pos


def features(buf: np.ndarray, offs: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
    """Distinct (document * BUCKETS + bucket) of a block, of the buckets in ``keep`` only."""
    buf = wd.LOWER[buf]
    found = []
    for n in SIZES:
        b, pos = buckets(buf, offs, n)
        if keep is not None:
            at = np.flatnonzero(keep[b])
            b, pos = b[at], pos[at]
        found.append((np.searchsorted(offs, pos, "right") - 1) * BUCKETS + b)
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


@dataclass
class Model:
    weights: np.ndarray      # per bucket, float32; 0 for buckets without a feature
    bias: float

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        f = features(buf, offs, self.weights != 0)
        total = np.bincount(f // BUCKETS, weights=self.weights[f % BUCKETS],
                            minlength=len(offs) - 1)
        return sigmoid(total + self.bias)


def _counts(rows: DataFrame) -> DataFrame:
    """Documents per (bucket, label) of the sample, summed per block before the shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                y = part.column(1).to_numpy(zero_copy_only=False)
                f = features(buf, offs, None)
                label = y[f // BUCKETS]
                n = np.bincount(f % BUCKETS, minlength=BUCKETS)
                t = np.bincount(f % BUCKETS, weights=label, minlength=BUCKETS).astype(np.int64)
                at = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at, pa.int64()), pa.array(n[at], pa.int64()),
                     pa.array(t[at], pa.int64())], names=["bucket", "n", "toxic"])
    return rows.mapInArrow(run, "bucket long, n long, toxic long").groupBy("bucket").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= MIN_DOCS)


def labelled(labels: DataFrame, label: str, where: F.Column | None = None) -> DataFrame:
    """(doc_id, y) of every labelled id, once."""
    one = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("y"))
    one = one.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    if where is not None:
        one = one.where(where)
    return one.groupBy("doc_id").agg(F.max("y").cast("int").alias("y"))


def sample_ids(labels: DataFrame, label: str, max_toxic: int, max_other: int,
               where: F.Column | None = None) -> DataFrame:
    """At most ``max_toxic`` + ``max_other`` ids (doc_id, y), chosen by a hash of the id."""
    one = labelled(labels, label, where)
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    return (one.where("y = 1").orderBy(order, "doc_id").limit(max_toxic)
            .unionByName(one.where("y = 0").orderBy(order, "doc_id").limit(max_other)))


def train(docs: DataFrame, labels: DataFrame, where: F.Column | None = None,
          label: str = "toxic", max_toxic: int = MAX_TOXIC, max_other: int = MAX_OTHER,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on labelled rows of ``docs`` (that satisfy ``where``, a condition on doc_id).

    The sample's ids are bounded, so they are broadcast and no text is shuffled.  Without
    rows of both labels the model scores every text by the (smoothed) share of label 1.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "toxicity")
    ids = tables.put(sample_ids(labels, label, max_toxic, max_other, where))
    rows = tables.put(
        docs.select(F.col(id_col).cast("long").alias("doc_id"),
                    F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(ids), "doc_id").select("doc_id", "y", "text"))
    n_all, n_tox = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n_tox or n_tox == n_all:
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((n_tox + 1) / (n_all - n_tox + 1))))
    got = _counts(rows).toPandas()
    n, t = np.zeros(BUCKETS), np.zeros(BUCKETS)
    n[got["bucket"]], t[got["bucket"]] = got["n"], got["toxic"]
    used = n >= MIN_DOCS
    p, q = t + 1.0, n - t + 1.0
    r = np.where(used, np.log(p / (n_tox + 2.0)) - np.log(q / (n_all - n_tox + 2.0)), 0.0)
    # evidence of a bucket: its ratio in units of the ratio's standard error
    z = np.where(used, np.abs(r) / np.sqrt(1 / p + 1 / q), 0.0)
    keep = np.zeros(BUCKETS, dtype=bool)
    best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
    keep[best[z[best] > 0]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                f = features(buf, offs, keep)
                ends = np.searchsorted(f, np.arange(1, len(offs)) * BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.ListArray.from_arrays(
                        pa.array(np.append(0, ends), pa.int32()),
                        pa.array(f % BUCKETS, pa.int32()))], names=["y", "f"])

    sample = rows.mapInArrow(run, "y int, f array<int>").toArrow()
    y = sample["y"].to_numpy().astype(np.float64)
    f = sample["f"].combine_chunks()
    cols = f.flatten().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(y)), np.diff(f.offsets.to_numpy()))
    feature = np.cumsum(keep) - 1
    w, bias = fit_sparse(row, feature[cols], r[keep], y)
    weights = np.zeros(BUCKETS, dtype=np.float32)
    weights[keep] = w * r[keep]
    tables.drop(ids, rows)
    return Model(weights, bias)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.5) -> DataFrame:
    """(doc_id, score, predicted) of every row.

    Null and empty texts have the score of a text without features.  One row per input row,
    repeated rows included; a null id stays null; an empty table gives an empty result;
    other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                p = model.score(buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(p, pa.float64()),
                     pa.array((p >= threshold).astype(np.int32), pa.int32())],
                    names=["doc_id", "score", "predicted"])

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double, predicted int")
