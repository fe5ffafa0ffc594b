"""Nearest neighbours through learned partitions.

On a bounded sample, the neighbour graph (each vector with its nearest ones) is cut into
parts of equal size by recursive spectral bisection, so that neighbours mostly share a
part.  A small network learns from it: its target for a vector is the distribution of its
neighbours over the parts.  In a table much larger than the sample every part is cut once
more in the same way, by a network of its own fitted in a task on a bounded sample of the
part's rows; so the number of leaves follows the number of rows.

Every row of the table is indexed under its most probable leaf; a query visits the leaves
that the networks hold most probable, and their rows are ranked by the exact distance.  The
number of leaves to visit is the smallest one that finds ``target`` of the neighbours of
held-out sample vectors.  Queries are answered in blocks that travel with the tasks; the
index is read in place, leaf by leaf, and each task returns its nearest few.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm.lexical import INDEX_ROWS, _rows_per_batch
from scoreline.llm.tables import Tables

SAMPLE = 8192          # vectors that the partition and the network are fitted on, at most
PER_PART = 64          # sample vectors per part
MAX_PARTS = 128
LEAF_ROWS = 512        # rows of a part per leaf, where the table is larger than the sample
MAX_LEAVES = 64        # leaves of a part
PART_SAMPLE = 4096     # rows that a part's own network is fitted on, at most
GRAPH = 10             # neighbours per vector in the graph
TARGET = 0.95          # share of neighbours that the visited leaves must hold on the sample
HIDDEN = 128
EPOCHS = 60
BLOCK_ROWS = 1024      # rows of an index block
QUERY_BLOCK = 8192     # queries that travel with the tasks at once


def nearest(base: np.ndarray, query: np.ndarray, k: int, skip: np.ndarray | None = None) -> np.ndarray:
    """Rows of the k nearest base vectors of each query, without row ``skip``."""
    out = np.empty((len(query), k), dtype=np.int64)
    norm = (base ** 2).sum(1)
    for i in range(0, len(query), 512):
        d = norm[None] - 2 * query[i:i + 512] @ base.T
        if skip is not None:
            d[np.arange(len(d)), skip[i:i + 512]] = np.inf
        out[i:i + 512] = np.argpartition(d, k - 1, axis=1)[:, :k]
    return out


def bisect(graph: np.ndarray, parts: int, rng: np.random.Generator) -> np.ndarray:
    """Part (0 .. parts - 1, a power of two) of every vertex, all parts of equal size.

    Halves are cut at the median of the second eigenvector of the (lazy) random walk on the
    part's own edges, by power iteration."""
    n, k = graph.shape
    u, v = np.repeat(np.arange(n), k), graph.ravel()
    u, v = np.concatenate([u, v]), np.concatenate([v, u])
    part = np.zeros(n, dtype=np.int64)
    size = 1
    while size < parts:
        inside = part[u] == part[v]
        a, b = u[inside], v[inside]
        degree = np.maximum(np.bincount(a, minlength=n), 1).astype(np.float64)
        total = np.bincount(part, weights=degree, minlength=size)
        x = rng.standard_normal(n)
        for _ in range(60):
            x -= (np.bincount(part, weights=degree * x, minlength=size) / total)[part]
            x = 0.5 * x + 0.5 * np.bincount(a, weights=x[b], minlength=n) / degree
            scale = np.sqrt(np.bincount(part, weights=x * x, minlength=size)) + 1e-300
            x /= scale[part]
        order = np.lexsort((np.arange(n), x, part))
        rank = np.empty(n, dtype=np.int64)
        begin = np.searchsorted(part[order], np.arange(size))
        rank[order] = np.arange(n) - begin[part[order]]
        half = np.bincount(part, minlength=size) / 2
        part = part * 2 + (rank >= half[part])
        size *= 2
    return part


@dataclass
class Router:
    """Network (one hidden layer) from vectors to part probabilities."""

    shift: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.shift) * self.scale
        return np.maximum(z @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def log_probability(self, x: np.ndarray) -> np.ndarray:
        o = self.logits(x)
        o = o - o.max(1, keepdims=True)
        return o - np.log(np.exp(o).sum(1, keepdims=True))


@dataclass
class Tree:
    """Leaves: parts, and the parts' own leaves where they are cut once more."""

    top: Router
    below: dict[int, Router] = field(default_factory=dict)
    visits: int = 1

    def __post_init__(self):
        size = [self.below[p].parts if p in self.below else 1 for p in range(self.top.parts)]
        self.first = np.append(0, np.cumsum(size))

    @property
    def leaves(self) -> int:
        return int(self.first[-1])

    def leaf(self, x: np.ndarray, part: np.ndarray | None = None) -> np.ndarray:
        """The leaf of every row."""
        part = self.top.logits(x).argmax(1) if part is None else part
        out = self.first[part]
        for p, router in self.below.items():
            own = np.flatnonzero(part == p)
            if len(own):
                out[own] += router.logits(x[own]).argmax(1)
        return out

    def order(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Leaves by falling probability (query, rank), some queries at a time."""
        for i in range(0, len(x), 256):
            q = x[i:i + 256]
            top = self.top.log_probability(q)
            score = np.repeat(top, np.diff(self.first), axis=1)
            for p, router in self.below.items():
                score[:, self.first[p]:self.first[p + 1]] += router.log_probability(q)
            yield np.argsort(-score, axis=1, kind="stable")


def train_router(x: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> Router:
    """Cross entropy with soft targets, Adam on mini-batches."""
    d, p = x.shape[1], target.shape[1]
    shift, scale = x.mean(0), 1.0 / (x.std() + 1e-12)
    z = (x - shift) * scale
    params = [rng.standard_normal((d, HIDDEN)) * np.sqrt(2 / d), np.zeros(HIDDEN),
              rng.standard_normal((HIDDEN, p)) * np.sqrt(1 / HIDDEN), np.zeros(p)]
    m, v = [np.zeros_like(q) for q in params], [np.zeros_like(q) for q in params]
    t = 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS) + 1e-4
        order = rng.permutation(len(x))
        for i in range(0, len(x), 256):
            at = order[i:i + 256]
            h = np.maximum(z[at] @ params[0] + params[1], 0)
            o = h @ params[2] + params[3]
            e = np.exp(o - o.max(1, keepdims=True))
            g = (e / e.sum(1, keepdims=True) - target[at]) / len(at)
            gh = (g @ params[2].T) * (h > 0)
            grads = [z[at].T @ gh, gh.sum(0), h.T @ g, g.sum(0)]
            t += 1
            for q, gr, a, b in zip(params, grads, m, v):
                a *= 0.9
                a += 0.1 * gr
                b *= 0.999
                b += 0.001 * gr * gr
                q -= rate * (a / (1 - 0.9 ** t)) / (np.sqrt(b / (1 - 0.999 ** t)) + 1e-8) + 1e-5 * q
    return Router(shift, scale, *params)


def _power(n: int, most: int) -> int:
    """The largest power of two up to n and ``most``, 2 at least."""
    return max(2, 1 << (min(n, most).bit_length() - 1))


def fit(x: np.ndarray, parts: int, seed: int = 7) -> Router:
    """Cut the vectors' neighbour graph into ``parts`` and learn the parts."""
    rng = np.random.default_rng(seed)
    graph = nearest(x, x, min(GRAPH, len(x) - 1), np.arange(len(x)))
    part = bisect(graph, parts, rng)
    soft = np.zeros((len(x), parts))
    for column in graph.T:
        np.add.at(soft, (np.arange(len(x)), part[column]), 1.0)
    soft[np.arange(len(x)), part] += 1.0
    return train_router(x, soft / soft.sum(1, keepdims=True), rng)


def visits(tree: Tree, own: np.ndarray, test: np.ndarray, k: int, target: float) -> int:
    """Leaves to visit so that ``target`` of the test vectors' nearest own ones are found."""
    true = nearest(own, test, min(k, len(own)))
    where = tree.leaf(own)[true]
    need = []
    at = 0
    for order in tree.order(test):
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(order.shape[1])[None].repeat(len(order), 0), 1)
        need.append(np.take_along_axis(rank, where[at:at + len(order)], 1).ravel())
        at += len(order)
    found = np.cumsum(np.bincount(np.concatenate(need), minlength=tree.leaves)) / true.size
    return int(np.argmax(found >= target - 1e-12)) + 1


def _vectors(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def usable(vec: str) -> Column:
    """Neither null nor zero nor with null or non-finite components."""
    return F.expr(f"`{vec}` IS NOT NULL AND NOT exists(`{vec}`, x -> x IS NULL OR isnan(x) "
                  f"OR abs(x) = double('Infinity')) AND exists(`{vec}`, x -> x <> 0)")


def _fit_part(leaf_rows: int):
    """A part's own network: (part, model)."""
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.unique(np.stack(rows["v"].to_numpy()).astype(np.float64), axis=0)
        leaves = _power(int(rows["n"].iloc[0]) // leaf_rows, min(MAX_LEAVES, max(2, len(x) // 16)))
        if len(x) < 4:
            return pd.DataFrame({"part": [], "model": []})
        return pd.DataFrame({"part": [key[0]], "model": [pickle.dumps(fit(x, leaves))]})
    return run


def _pack(d: int):
    """Task: rows in the order of their leaves as blocks of one leaf."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _vectors(batch.column(2), d)
            begin = np.flatnonzero(np.append(True, leaf[1:] != leaf[:-1])) if len(leaf) else []
            rows = [(leaf[i], ids[i:j].astype(np.int64).tobytes(), x[i:j].tobytes())
                    for a, b in zip(begin, [*begin[1:], len(leaf)])
                    for i in range(a, b, BLOCK_ROWS) for j in [min(i + BLOCK_ROWS, b)]]
            cols = list(zip(*rows)) if rows else [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.binary(), pa.binary()])],
                names=["leaf", "ids", "vectors"])
    return run


class _Nearest:
    """The k nearest (query, id, distance) seen by a task."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.limit = np.full(queries, np.inf)         # squared k-th distance of each query
        self.parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        self.rows = 0

    def add(self, query: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        self.parts.append((query, ids, dist))
        self.rows += len(query)
        if self.rows > 1 << 17:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, ids, dist = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((ids, dist, query))
        query, ids, dist = query[order], ids[order], dist[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.k - 1
        self.limit[query[last]] = dist[last] ** 2
        keep = place < self.k
        self.parts = [(query[keep], ids[keep], dist[keep])]
        self.rows = int(keep.sum())
        return self.parts[0]


def _rank(asked: np.ndarray, q: np.ndarray, leaf: np.ndarray, query: np.ndarray, k: int):
    """Task: the nearest rows of the index blocks for the queries (numbers ``query``) that
    visit their leaves; ``leaf`` is sorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = q.shape[1]
        length = (q ** 2).sum(1)
        near = _Nearest(len(q), k)
        for batch in batches:
            for j, own in enumerate(batch.column(0).to_numpy()):
                here = query[np.searchsorted(leaf, own):np.searchsorted(leaf, own, "right")]
                ids = np.frombuffer(batch.column(1)[j].as_py(), dtype=np.int64)
                base = np.frombuffer(batch.column(2)[j].as_py(), dtype=np.float64).reshape(-1, d)
                norm = (base ** 2).sum(1)
                for i in range(0, len(here), 512):
                    at = here[i:i + 512]
                    rough = norm[None] - 2 * q[at] @ base.T + length[at][:, None]
                    rough[asked[at][:, None] == ids[None]] = np.inf
                    limit = near.limit[at]
                    if len(ids) > k:
                        limit = np.minimum(limit, np.partition(rough, k - 1, axis=1)[:, k - 1])
                    limit = limit + 1e-9 * (norm.max() + length[at])
                    a, b = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
                    near.add(at[a], ids[b], np.sqrt(((base[b] - q[at[a]]) ** 2).sum(1)))
        got = near.cut()
        yield pa.RecordBatch.from_arrays(
            [pa.array(asked[got[0]], pa.int64()), pa.array(got[1], pa.int64()), pa.array(got[2])],
            names=["query_id", "vec_id", "score"])
    return run


def search(vectors: DataFrame, k: int, is_query: Column, id_col: str = "vec_id",
           vec_col: str = "embedding", sample: int = SAMPLE, target: float = TARGET,
           per_part: int = PER_PART, leaf_rows: int = LEAF_ROWS, query_block: int = QUERY_BLOCK,
           stats: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for every query row.

    ``is_query`` is a condition on ``vec_id``.  Score is the Euclidean distance in double
    precision; ties go to the smaller id; the query's own id is no candidate; all candidates
    come back if they are fewer than k.  Rows with a null id, and vectors that are null,
    zero, hold null or non-finite components or differ from the commonest length, take no
    part.  Of rows that repeat an id the one with the smallest vector (first component first)
    does.  An empty table gives an empty result; other columns are not read.  ``stats``
    receives the number of leaves, of leaves visited, and the share of the rows read.
    """
    spark = vectors.sparkSession
    tables = Tables(spark, "neighbours")
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"),
                         F.col(vec_col).cast("array<double>").alias("v")).where(
        F.col("vec_id").isNotNull() & usable("v"))
    schema = "query_id long, rank int, vec_id long, score double"
    length = src.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if length is None:
        return spark.createDataFrame([], schema)
    d = length["d"]
    src = tables.put(src.where(F.size("v") == d).groupBy("vec_id").agg(F.min("v").alias("v")))
    rows = src.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()
    # equal vectors count once: a hot vector is one vertex of the graph
    x = np.unique(_vectors(rows["v"].combine_chunks(), d), axis=0)
    tree, test = _top(x, k, per_part)
    if tree is None:                             # no more than k other rows: all are results
        tree = Tree(Router(np.zeros(d), 1.0, np.zeros((d, 1)), np.zeros(1), np.zeros((1, 1)),
                           np.zeros(1)))
    top = tree.top

    @F.arrow_udf("int")
    def part_of(col: pa.Array) -> pa.Array:
        return pa.array(top.logits(_vectors(col, d)).argmax(1).astype(np.int32))

    placed = tables.put(src.select("vec_id", "v", part_of("v").alias("part")), src)
    sizes = placed.groupBy("part").count()
    total = sizes.agg(F.sum("count")).first()[0]
    if total > sample and test is not None:
        # a bounded sample of each part with more than a leaf's rows
        order = Window.partitionBy("part").orderBy(F.xxhash64("vec_id"), "vec_id")
        some = (placed.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PART_SAMPLE)
                .join(sizes.where(F.col("count") >= 2 * leaf_rows).withColumnRenamed("count", "n"),
                      "part"))
        models = some.groupBy("part").applyInPandas(_fit_part(leaf_rows), "part int, model binary")
        tree = Tree(top, {r["part"]: pickle.loads(r["model"]) for r in models.collect()})
    if test is not None:
        tree.visits = visits(tree, x[~test], x[test], k, target)

    @F.arrow_udf("int")
    def leaf_of(col: pa.Array, part: pa.Array) -> pa.Array:
        return pa.array(tree.leaf(_vectors(col, d), part.to_numpy().astype(np.int64)).astype(np.int32))

    index = tables.put(
        placed.select(leaf_of("v", "part").alias("leaf"), "vec_id", "v")
        .repartitionByRange("leaf", F.xxhash64("vec_id")).sortWithinPartitions("leaf")
        .mapInArrow(_pack(d), "leaf int, ids binary, vectors binary"))
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in index.groupBy("leaf").agg(F.sum(F.length("ids")).alias("n")).collect():
        held[r["leaf"]] = r["n"] // 8
    queries = placed.where(is_query)
    number = queries.count()
    blocks = max(1, -(-number // query_block))
    results, read = [], 0
    for block in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        asked, q = own["vec_id"].to_numpy(), _vectors(own["v"].combine_chunks(), d)
        leaf, query, at = [], [], 0
        for order in tree.order(q):
            # at least the tree's visits, and more until k other rows are there
            rows_to = np.cumsum(held[order], axis=1)
            n = np.maximum((rows_to < k + 1).sum(1) + 1, tree.visits).clip(max=tree.leaves)
            read += int(np.take_along_axis(rows_to, n[:, None] - 1, 1).sum())
            i, j = np.nonzero(np.arange(tree.leaves)[None] < n[:, None])
            leaf.append(order[i, j])
            query.append(i + at)
            at += len(order)
        leaf, query = np.concatenate(leaf), np.concatenate(query)
        sort = np.argsort(leaf, kind="stable")
        wanted = np.unique(leaf).tolist()
        part = index if len(wanted) == tree.leaves else index.where(F.col("leaf").isin(wanted))
        order = Window.partitionBy("query_id").orderBy("score", "vec_id")
        with _rows_per_batch(spark, INDEX_ROWS):
            near = part.mapInArrow(_rank(asked, q, leaf[sort].astype(np.int32), query[sort], k),
                                   "query_id long, vec_id long, score double")
            results.append(tables.put(
                near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
                .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")))
    if stats is not None:
        stats.update(leaves=tree.leaves, visits=tree.visits,
                     share=read / max(1, number * int(total)))
    tables.drop(index, placed)
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _top(x: np.ndarray, k: int, per_part: int) -> tuple[Tree | None, np.ndarray | None]:
    """The first cut of a sample, and which of its rows were held out from it."""
    n = len(x)
    if n <= max(k + 1, 8):
        return None, None
    held = np.zeros(n, dtype=bool)
    held[np.random.default_rng(7).permutation(n)[:min(max(64, n // 8), n // 4)]] = True
    parts = _power(int((~held).sum()) // per_part, MAX_PARTS)
    return Tree(fit(x[~held], parts)), held
