"""Exact top-k search by inner product with a pivot-distance index.

Components become integers, floor(256 x).  A further component, sqrt(M - |x|^2) with M the
largest squared length, puts all rows on one sphere, so the largest inner products of a query
belong to its nearest rows, and the triangle inequality holds.  Every row is keyed by its
nearest pivot and its distance to it; rows in this order form blocks, each a thin ring
(annulus) around one pivot.  A query looks at the rings whose lower bound of the distance is
smallest, then expands: as soon as the k-th best row found lies nearer than the bounds of all
rings not yet seen, no other row can do better and it stops.

The queries are answered in blocks that travel with the tasks; each expansion is one pass
over the rings, in which a task reads only what the bounds leave and returns its best few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.lexical import INDEX_ROWS, _rows_per_batch
from scoreline.llm.tables import Tables

SCALE = 256
SAMPLE = 8192           # rows that the pivots are chosen from, at most
MAX_PIVOTS = 128
BINS = 16               # rings per pivot in the directory that plans the first expansion
RING_ROWS = 1024        # rows of a block
QUERY_BLOCK = 4096      # queries that travel with the tasks at once
FIRST_ROWS = 1024       # rows that a query's first expansion covers, at least
GROWTH = 16             # each further expansion covers so many times the rows


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def choose_pivots(x: np.ndarray, top: float, seed: int = 3) -> np.ndarray:
    """Centres of a sample of integer rows (some rounds of k-means) on the sphere's space."""
    z = lift(x, top)
    rng = np.random.default_rng(seed)
    n = min(MAX_PIVOTS, int(np.ceil(np.sqrt(len(z)))))
    centre = z[rng.permutation(len(z))[:n]].copy()
    for _ in range(8):
        own = distances(z, centre).argmin(1)
        size = np.bincount(own, minlength=n)
        total = np.zeros_like(centre)
        np.add.at(total, own, z)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Rows with the component that brings them to squared length ``top``."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0.0))])


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None]
    return np.sqrt(np.maximum(d, 0.0))


@dataclass
class Directory:
    """Rings (pivot, distance bin): limits and rows; at most MAX_PIVOTS x BINS entries."""

    pivot: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    rows: np.ndarray

    def radius(self, far: np.ndarray, want: int) -> np.ndarray:
        """Per query: the bound within which its nearest rings hold ``want`` rows
        (infinite if all do not)."""
        out = np.empty(len(far))
        for i in range(0, len(far), 512):
            bound = lower_bounds(far[i:i + 512], self.pivot, self.lo, self.hi)
            order = np.argsort(bound, axis=1)
            enough = np.cumsum(self.rows[order], axis=1) >= want
            at = enough.argmax(1)
            rows = np.arange(len(bound))
            out[i:i + 512] = np.where(enough[:, -1], bound[rows, order[rows, at]], np.inf)
        return out


def lower_bounds(far: np.ndarray, pivot: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Least distance (query, ring) by the triangle inequality: to the ring around its pivot,
    and to the cell of the pivot seen from the query's own nearest pivot."""
    d = far[:, pivot]
    return np.maximum(np.maximum(lo[None] - d, d - hi[None]), (d - far.min(1)[:, None]) / 2)


@dataclass
class Asking:
    """A block of queries: ids, vectors, distances to the pivots, the k-th best score so far,
    and the bounds (over, upto] of the rings to look at."""

    ids: np.ndarray
    vectors: np.ndarray
    far: np.ndarray
    floor: np.ndarray
    over: np.ndarray
    upto: np.ndarray


def _scores(q: np.ndarray, x: np.ndarray, narrow: bool) -> np.ndarray:
    """Integer inner products; doubles hold them exactly where ``narrow``."""
    if narrow:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q.astype(np.int64) @ x.astype(np.int64).T


class _Best:
    """The k best (score, id) of every query seen by a task."""

    def __init__(self, asked: Asking, k: int):
        self.k, self.floor = k, asked.floor.copy()
        self.parts: list[np.ndarray] = []
        self.rows = 0

    def add(self, query: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        self.parts.append(np.stack([query, ids, score]))
        self.rows += len(query)
        if self.rows > 1 << 18:
            self.cut()

    def cut(self) -> np.ndarray:
        if not self.parts:
            return np.zeros((3, 0), dtype=np.int64)
        all_ = np.concatenate(self.parts, axis=1)
        all_ = all_[:, np.lexsort((all_[1], -all_[2], all_[0]))]
        place = np.arange(all_.shape[1]) - np.searchsorted(all_[0], all_[0])
        all_ = all_[:, place < self.k]
        kth = place[place < self.k] == self.k - 1
        np.maximum.at(self.floor, all_[0][kth], all_[2][kth])
        self.parts, self.rows = [all_], all_.shape[1]
        return all_


def _visit(asked: Asking, k: int, d: int, kind: str, narrow: bool):
    """Task: the best rows of the rings that the bounds leave to each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = _Best(asked, k)
        for batch in batches:
            pivot = batch.column(0).to_numpy()
            bound = lower_bounds(asked.far, pivot, batch.column(1).to_numpy(),
                                 batch.column(2).to_numpy())
            wanted = (bound > asked.over[:, None]) & (bound <= asked.upto[:, None])
            for j in np.flatnonzero(wanted.any(0)):
                ids = np.frombuffer(batch.column(3)[j].as_py(), dtype=np.int64)
                x = np.frombuffer(batch.column(4)[j].as_py(), dtype=kind).reshape(-1, d)
                own = np.flatnonzero(wanted[:, j])
                for i in range(0, len(own), 512):
                    q = own[i:i + 512]
                    s = _scores(asked.vectors[q], x, narrow)
                    other = asked.ids[q][:, None] != ids[None]
                    limit = best.floor[q]
                    if s.shape[1] > k:     # the k + 1 highest hold k other rows
                        high = np.partition(s, s.shape[1] - k - 1, axis=1)[:, s.shape[1] - k - 1]
                        limit = np.maximum(limit, high)
                    a, b = np.nonzero((s >= limit[:, None]) & other)
                    best.add(q[a], ids[b], s[a, b])
        got = best.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked.ids[got[0]], pa.int64()), pa.array(got[1], pa.int64()),
             pa.array(got[2], pa.int64())], names=["query_id", "vec_id", "score"])
    return run


def _rings(d: int, kind: str):
    """Task: rows in the order of (pivot, distance) as blocks, each around one pivot."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, dist = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            ids, x = batch.column(0).to_numpy(), _matrix(batch.column(1), d)
            new = np.append(True, pivot[1:] != pivot[:-1]) if len(pivot) else np.zeros(0, bool)
            begin = np.flatnonzero(new)
            rows = []
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(pivot)]):
                for i in range(a, b, RING_ROWS):
                    j = min(i + RING_ROWS, b)
                    rows.append((pivot[i], dist[i:j].min(), dist[i:j].max(),
                                 ids[i:j].astype(np.int64).tobytes(), x[i:j].astype(kind).tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=["pivot", "lo", "hi", "ids", "vectors"])
    return run


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def search(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id",
           vec_col: str = "embedding", scale: int = SCALE, sample: int = SAMPLE,
           first_rows: int = FIRST_ROWS, query_block: int = QUERY_BLOCK,
           stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest integer inner product with
    every query row; ties go to the smaller id, the query's own id is no candidate, and all
    candidates come back if they are fewer than k.

    ``is_query`` is a condition on ``vec_id``.  Rows with a null id, and vectors that are null,
    hold null or non-finite components or differ from the commonest length, take no part; of
    rows that repeat an id the one with the smallest vector (first component first) does.
    Zero vectors take part.  Products must fit 64 bits.  An empty table gives an empty result;
    other columns are not read.  ``stats`` receives the number of passes over the rings.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "pivots")
    schema = "query_id long, rank int, vec_id long, score long"
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vec_col).cast("array<double>").alias("x")).where(
        "vec_id IS NOT NULL AND x IS NOT NULL AND size(x) > 0 AND NOT exists(x, "
        "c -> c IS NULL OR isnan(c) OR abs(c) = double('Infinity'))")
    length = src.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    ints = (src.where(F.size("x") == d)
            .select("vec_id", F.expr(f"transform(x, c -> CAST(floor({scale} * c) AS BIGINT))").alias("v"))
            .groupBy("vec_id").agg(F.min("v").alias("v")))
    ints = tables.put(ints)
    size = ints.select(
        F.expr("aggregate(v, 0D, (s, c) -> s + CAST(c AS DOUBLE) * c)").alias("norm"),
        F.expr("greatest(abs(array_max(v)), abs(array_min(v)))").alias("high")).agg(
        F.max("norm"), F.max("high"), F.count("*")).first()
    top, high, total = float(size[0]), int(size[1]), int(size[2])
    narrow = high * high * d < 1 << 53
    kind = "<i4" if high < 1 << 31 else "<i8"
    rows = ints.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    x = _matrix(rows["v"].combine_chunks(), d)
    pivots = choose_pivots(x, top)
    edges = np.quantile(distances(lift(x, top), pivots).min(1), np.arange(1, BINS) / BINS)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = distances(lift(_matrix(batch.column(1), d), top), pivots)
            own = far.argmin(1)
            dist = far[np.arange(len(far)), own]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(own, pa.int32()), pa.array(dist),
                 pa.array(np.searchsorted(edges, dist), pa.int32())],
                names=["vec_id", "v", "pivot", "dist", "bin"])

    keyed = tables.put(ints.mapInArrow(
        key, "vec_id long, v array<bigint>, pivot int, dist double, bin int"))
    entries = keyed.groupBy("pivot", "bin").agg(
        F.min("dist").alias("lo"), F.max("dist").alias("hi"), F.count("*").alias("n")).toArrow()
    directory = Directory(*(entries[c].to_numpy() for c in ("pivot", "lo", "hi", "n")))
    rings = tables.put(
        keyed.repartitionByRange("pivot", "dist", "vec_id")
        .sortWithinPartitions("pivot", "dist", "vec_id").select("vec_id", "v", "pivot", "dist")
        .mapInArrow(_rings(d, kind), "pivot int, lo double, hi double, ids binary, vectors binary"),
        keyed)
    queries = ints.where(is_query)
    number = queries.count()
    blocks = max(1, -(-number // query_block))
    results, passes = [], 0
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        ids, q = own["vec_id"].to_numpy(), _matrix(own["v"].combine_chunks(), d).astype(np.int64)
        flat = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
        asked = Asking(ids, q, distances(flat, pivots),
                       np.full(len(q), np.iinfo(np.int64).min), np.full(len(q), -np.inf),
                       np.full(len(q), -np.inf))
        length2 = (flat * flat).sum(1)
        reach = np.full(len(q), np.inf)          # distance of the k-th best row so far
        active = np.arange(len(q))
        place = {int(v): i for i, v in enumerate(ids)}
        want, best = first_rows, None
        while len(active):
            asked.over = asked.upto.copy()
            asked.upto[active] = np.minimum(directory.radius(asked.far[active], want), reach[active])
            part = Asking(*(a[active] for a in (asked.ids, asked.vectors, asked.far, asked.floor,
                                                 asked.over, asked.upto)))
            with _rows_per_batch(spark, INDEX_ROWS):
                found = rings.mapInArrow(_visit(part, k, d, kind, narrow),
                                         "query_id long, vec_id long, score long")
                if best is None:
                    best = tables.put(_ranked(found, k))
                else:
                    best = tables.put(_ranked(found.unionByName(best.drop("rank")), k), best)
            passes += 1
            for r in best.where(F.col("rank") == k).select("query_id", "score").collect():
                i = place[r["query_id"]]
                asked.floor[i] = r["score"]
                near = max(length2[i] + top - 2.0 * r["score"], 0.0) ** 0.5
                reach[i] = near * (1 + 1e-9) + 1e-6 * (1 + top ** 0.5)
            active = active[(asked.upto[active] < reach[active]) & np.isfinite(asked.upto[active])]
            want *= GROWTH
        results.append(best)
    if stats is not None:
        stats.update(passes=passes, rows=total)
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    tables.drop(rings, ints)
    return out
