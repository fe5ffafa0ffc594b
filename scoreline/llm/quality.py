"""Quality: document evidence combined with host and path posteriors (empirical Bayes).

A logistic regression on form features gives each document's probability of good quality.
Sites are described by the expected number of good documents among their documents, by
grouped aggregation over all rows: the global rate is the prior of the host rates, a
host's posterior is the prior of its paths.  The prior weights (how many documents a prior
is worth) come from the spread of the rates between hosts and between the paths of a host,
by the method of moments, so a sparse site falls back on its host and a sparse host on the
global rate.  A document's score is

    logit(score) = logit(p) - logit(global rate) + logit(rate of its path without itself)

The fit uses a bounded sample of labelled rows, weighed back to the class ratio of all labelled
rows; every site count covers all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd
from scoreline.llm.linear import fit_dense, sigmoid
from scoreline.llm.tables import Tables
from scoreline.llm.toxicity import labelled, sample_ids

MAX_GOOD, MAX_BAD = 10_000, 10_000    # bound of the training sample
THRESHOLD = 0.5
EPS = 1e-4                            # probabilities stay this far from 0 and 1
MAX_WEIGHT = 1e6                      # documents that a prior is worth at most
NAMES = ("log_words", "mean_word", "upper", "digit", "symbol", "bang", "pipe", "distinct",
         "repeated", "lines", "distinct_lines", "short", "tail_symbol", "stops", "blank")


def _set(chars: str) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    t[list(chars.encode())] = True
    return t


_UPPER, _DIGIT = _set("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _set("0123456789")
_ALPHA = _UPPER | _set("abcdefghijklmnopqrstuvwxyz")
_SYMBOL, _BANG, _PIPE, _STOP = _set("#$%&*@^~<>{}[]=_\\/+"), _set("!?"), _set("|"), _set(".")
_NOT_NEWLINE = ~_set("\n")


def features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Form features (rows: documents, columns: NAMES)."""
    n = len(offs) - 1
    w = wd.Words(buf, offs)
    size = np.diff(offs).astype(np.float64)
    words, byte_n = np.maximum(w.counts, 1).astype(np.float64), np.maximum(size, 1.0)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags, dtype=np.int64))
        return (total[offs[1:]] - total[offs[:-1]]).astype(np.float64)

    def per_word(values: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(values, dtype=np.int64))
        return (total[w.first[1:]] - total[w.first[:-1]]).astype(np.float64)

    doc = w.doc()
    same = np.zeros(len(w), dtype=np.int64)
    if len(w) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    distinct = _distinct(doc, w.hash, n)
    lines = wd.Words(buf, offs, _NOT_NEWLINE)
    n_lines = np.maximum(lines.counts, 1).astype(np.float64)
    length = w.ends - w.starts
    tail = (_SYMBOL | _BANG)[buf[w.ends - 1]] if len(w) else np.zeros(0, bool)
    alpha = np.maximum(per_doc(_ALPHA[buf]), 1.0)
    return np.column_stack([
        np.log1p(w.counts), np.minimum(per_word(length) / words, 50) / 10,
        per_doc(_UPPER[buf]) / alpha, per_doc(_DIGIT[buf]) / byte_n,
        per_doc(_SYMBOL[buf]) / byte_n * 10, per_doc(_BANG[buf]) / byte_n * 10,
        per_doc(_PIPE[buf]) / byte_n * 10, distinct / words, per_word(same) / words,
        np.log1p(lines.counts), _distinct(lines.doc(), lines.hash, n) / n_lines,
        per_word(length <= 3) / words, per_word(tail) / words,
        per_doc(_STOP[buf]) / words, (w.counts == 0).astype(np.float64)])


def _distinct(doc: np.ndarray, names: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((names, doc))
    d, h = doc[order], names[order]
    new = np.ones(len(d), dtype=bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n).astype(np.float64)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def probability(self, text: Column) -> Column:
        """Probability of good quality of a text column; null counts as empty."""
        model = self

        @F.arrow_udf("double")
        def p(col: pa.Array) -> pa.Array:
            batch = pa.RecordBatch.from_arrays([col], names=["text"])
            out = [sigmoid(((features(buf, offs) - model.mean) / model.scale)
                           @ model.weights[:-1] + model.weights[-1])
                   for _, buf, offs in wd.blocks(batch)]
            return pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

        return p(text)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality",
          max_good: int = MAX_GOOD, max_bad: int = MAX_BAD,
          id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit on at most ``max_good`` + ``max_bad`` labelled rows (ids chosen by a hash).

    A row weighs as many labelled ids as it stands for in its class, so the caps change neither
    the class ratio nor, beyond the noise of the sample, the decisions.  Without rows of both labels every text gets the (smoothed) share of good."""
    spark = docs.sparkSession
    tables = Tables(spark, "quality-train")
    ids = tables.put(sample_ids(labels, label, max_good, max_bad))
    total = {r["y"]: r["count"] for r in labelled(labels, label).groupBy("y").count().collect()}
    stands_for = [max(1.0, total.get(k, 0) / max(1, cap)) for k, cap in enumerate((max_bad, max_good))]

    @F.arrow_udf("array<double>")
    def feats(col: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([col], names=["text"])
        x = [features(buf, offs) for _, buf, offs in wd.blocks(batch)]
        x = np.concatenate(x) if x else np.zeros((0, len(NAMES)))
        return pa.ListArray.from_arrays(
            pa.array(np.arange(len(x) + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))

    rows = (docs.select(F.col(id_col).cast("long").alias("doc_id"),
                        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
            .join(F.broadcast(ids), "doc_id").select("y", feats("text").alias("x")).toArrow())
    tables.drop(ids)
    y = rows["y"].to_numpy().astype(np.float64)
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(-1, len(NAMES)) if len(y) else \
        np.zeros((0, len(NAMES)))
    weight = np.where(y > 0.5, stands_for[1], stands_for[0])
    if not len(y) or y.min() == y.max():
        w = np.zeros(len(NAMES) + 1)
        w[-1] = np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1))
        return Model(np.zeros(len(NAMES)), np.ones(len(NAMES)), w)
    mean = np.average(x, 0, weight)
    scale = np.sqrt(np.average((x - mean) ** 2, 0, weight)) + 1e-3
    return Model(mean, scale, fit_dense((x - mean) / scale, y, weight=weight))


def _logit(c: Column | str) -> Column:
    p = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.col(c) if isinstance(c, str) else c))
    return F.log(p / (1 - p))


def _prior_weight(sites: DataFrame, rate: Column) -> float:
    """Documents that a prior is worth: from the spread of the sites' counts around it, less
    what sampling alone gives (method of moments).  One aggregate row."""
    # E[(k - n r)^2 / n] = r (1 - r) (1 + (n - 1) rho), rho = 1 / (1 + weight)
    spread, noise, more = sites.agg(
        F.sum((F.col("k") - F.col("n") * rate) ** 2 / F.col("n")),
        F.sum(rate * (1 - rate)), F.sum(rate * (1 - rate) * (F.col("n") - 1))).first()
    rho = (spread - noise) / more if more else 0.0
    return 1 / min(0.999, max(1 / MAX_WEIGHT, rho)) - 1


def site_rates(tables: Tables, scored: DataFrame) -> DataFrame:
    """Written table per (host, path): documents n, expected good k, global rate mu, the
    host's posterior rate and the weight of the path prior.

    ``scored`` has host, path and p.  Grouped sums with partial aggregation: a host with a
    third of all rows costs one row per task.  Only the global rate and the two weights
    (three numbers) come to the driver."""
    paths = tables.put(scored.groupBy("host", "path").agg(F.count("*").alias("n"),
                                                          F.sum("p").alias("k")))
    hosts = tables.put(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k")))
    n, k = hosts.agg(F.sum("n"), F.sum("k")).first()
    mu = F.lit(k / n if n else 0.5)
    m = _prior_weight(hosts, mu)
    rate = hosts.select(F.col("host").alias("host_"),
                        ((F.col("k") + m * mu) / (F.col("n") + m)).alias("host_rate"))
    both = tables.put(paths.join(rate, F.col("host").eqNullSafe(F.col("host_"))).drop("host_"),
                      paths, hosts)
    path_m = _prior_weight(both, F.col("host_rate"))
    return tables.put(both.withColumns({"mu": mu, "path_m": F.lit(path_m)}), both)


def combine(scored: DataFrame, rates: DataFrame) -> DataFrame:
    """``scored`` (host, path, p, ...) plus host_rate, path_rate (without the row itself)
    and score.  The join with ``rates`` (a written table) is broadcast if it is small, else
    shuffled; hot sites are then split by the adaptive skew join."""
    rates = rates.select(F.col("host").alias("_h"), F.col("path").alias("_q"), "n", "k", "mu",
                         "host_rate", "path_m")
    site = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_q"))
    out = scored.join(rates, site, "left").withColumn("path_rate", (
        F.col("k") - F.col("p") + F.col("path_m") * F.col("host_rate")) / (
        F.col("n") - 1 + F.col("path_m")))
    logit = _logit("p") - _logit("mu") + _logit("path_rate")
    return out.withColumn("score", 1 / (1 + F.exp(-logit))).drop(
        "_h", "_q", "n", "k", "mu", "path_m")


def _sites(df: DataFrame, host: Column, path: Column, text_col: str, model: Model,
           *keep: Column) -> DataFrame:
    return df.select(*keep, host.cast("string").alias("host"), path.cast("string").alias("path"),
                     model.probability(F.col(text_col).cast("string")).alias("p"))


def assess(docs: DataFrame, model: Model, host: Column, path: Column,
           id_col: str = "doc_id", text_col: str = "text",
           threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, p, host_rate, path_rate, score, keep) of every row.

    Null and empty texts have the features of a text without words; null hosts and paths
    form a site of their own.  One row per input row, repeated rows included; a null id
    stays null; an empty table gives an empty result; other columns are not read.
    """
    tables = Tables(docs.sparkSession, "quality")
    scored = tables.put(_sites(docs, host, path, text_col, model,
                               F.col(id_col).cast("long").alias("doc_id")))
    rates = site_rates(tables, scored)
    return combine(scored, rates).select(
        "doc_id", "p", "host_rate", "path_rate", "score",
        (F.col("score") >= threshold).cast("int").alias("keep"))


def keep_good(docs: DataFrame, model: Model, host: Column, path: Column,
              text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` whose score reaches ``threshold``, with their columns.

    Decided per row (no join by id), so null and repeated ids are no special case."""
    tables = Tables(docs.sparkSession, "quality")
    rates = site_rates(tables, _sites(docs, host, path, text_col, model))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    scored = _sites(docs, host, path, text_col, model, whole)
    return combine(scored, rates).where(F.col("score") >= threshold).select("_row.*")
