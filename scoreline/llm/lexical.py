"""Ranked lexical search over bit-sliced Bloom signatures.

Every document gets a Bloom signature of its terms.  A term that occurs more often is also
entered once for each frequency level that it reaches (1, 2, 3, 4, 6, 8, 12, 16, ...
occurrences).  Signatures of documents of like size form a block, stored by bit position: one
bitmap over the block's documents per position (a slice).  The documents that may hold a term
at a level are the AND of its slices: every one that does, and a few that do not.

For a block of query items, the slices of each item's terms are summed with the terms'
weights; sums per level times the growth of the score from level to level bound a document's
score from above.  The documents with the highest bounds are scored exactly; the k-th best of
these scores excludes every document whose bound lies below it, and all others are scored
exactly as well.

Corpus statistics (documents, terms, documents per term) are counted exactly in the pass that
writes the signatures.  Terms are compared by 64-bit hashes, a document's against the items'.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scoreline.llm import bloom
from scoreline.llm import words as wd
from scoreline.llm.tables import Tables

U64 = np.uint64
HASHES = 3
BITS = 16               # signature bits per entry, at least
MIN_CLASS = 6
MAX_WIDTH = 1 << 21     # bits of a signature; a longer document's bounds are looser, not wrong
CELLS = 1 << 21         # signature width x documents of a block
BLOCK_DOCS = 1024
BLOCK_ITEMS = 256       # items that travel with the tasks at once
FIRST = 32              # documents per item scored exactly to set the limit
INDEX_ROWS = 64         # blocks of signatures that pass to a Python worker at once
_LEVEL = U64(0x9E3779B97F4A7C15)

#: least number of occurrences of each level
LEVELS = [1, 2, *sorted(x << i for i in range(48) for x in (3, 4))]


def gain(top: np.ndarray | int, m: np.ndarray) -> np.ndarray:
    """Share of a term's weight that ``top`` occurrences earn, in millionths."""
    return (1000000000 * top) // (1000 * top + 8 * m)


def damping(n: np.ndarray, docs: int, terms: int) -> np.ndarray:
    """m of documents with n terms."""
    return 100 - 90 + (90 * n * docs) // terms


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def _positions(term: np.ndarray, level: int | np.ndarray, width: int) -> list[np.ndarray]:
    name = wd.mix(term + np.asarray(level, dtype=U64) * _LEVEL)
    step = wd.mix(name) | U64(1)
    return [((name + U64(i) * step) & U64(width - 1)).astype(np.int64) for i in range(HASHES)]


def _term_words(buf: np.ndarray, offs: np.ndarray) -> wd.Words:
    return wd.Words(buf, offs, wd.ALNUM, lower=True)


# ---------------------------------------------------------------------------- the index

INDEX = "kind int, a long, b long, ids binary, lens binary, sig binary"
SIGNATURES, DF, TOTAL = 0, 1, 2       # a, b: width, documents / term, documents / documents, terms


class Signer:
    """Blocks of signatures of one task; documents wait until their size class is full."""

    def __init__(self):
        self.open: dict[int, list[tuple]] = defaultdict(list)

    @staticmethod
    def shape(size_class: int) -> tuple[int, int]:
        width = min(BITS << size_class, MAX_WIDTH)
        return width, min(max(8, CELLS // width), BLOCK_DOCS)

    def add(self, doc: int, n: int, term: np.ndarray, level: np.ndarray) -> tuple | None:
        size_class = max(MIN_CLASS, int(len(term) - 1).bit_length())
        group = self.open[size_class]
        group.append((doc, n, term, level))
        if len(group) == self.shape(size_class)[1]:
            return self._block(size_class)
        return None

    def _block(self, size_class: int) -> tuple:
        group = self.open.pop(size_class)
        width, _ = self.shape(size_class)
        size = -(-len(group) // 8) * 8
        bits = np.zeros((width, size), dtype=bool)
        for i, (_, _, term, level) in enumerate(group):
            for at in _positions(term, level, width):
                bits[at, i] = True
        return (SIGNATURES, width, len(group),
                np.array([g[0] for g in group], dtype=np.int64).tobytes(),
                np.array([g[1] for g in group], dtype=np.int64).tobytes(),
                np.packbits(bits, axis=1).tobytes())

    def rest(self) -> list[tuple]:
        return [self._block(c) for c in sorted(self.open)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                      names=["kind", "a", "b", "ids", "lens", "sig"])


def _index(wanted: bloom.Bloom):
    """Signatures, document frequencies of the wanted terms, and totals of a task's rows."""
    levels = np.array(LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, docs, terms = Signer(), 0, 0
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = _term_words(buf, offs)
                docs += int((w.counts > 0).sum())
                terms += len(w)
                if not len(w):
                    continue
                name, back = np.unique(w.hash, return_inverse=True)
                pair, tf = np.unique(w.doc() * len(name) + back, return_counts=True)
                doc, term = np.divmod(pair, len(name))
                seen = np.bincount(term, minlength=len(name))
                asked = wanted.has(name)
                rows = [(DF, a, b, None, None, None)
                        for a, b in zip(wd.i64(name[asked]).tolist(), seen[asked].tolist())]
                entries = np.searchsorted(levels, tf, side="right")
                at = np.append(0, np.cumsum(entries))
                entry = np.repeat(name[term], entries)
                level = wd.ragged(np.zeros(len(entries), np.int64), entries)
                bound = at[np.searchsorted(doc, np.arange(part.num_rows + 1))]
                for i, key in enumerate(part.column(0).to_pylist()):
                    a, b = bound[i], bound[i + 1]
                    if key is not None and b > a:
                        full = signer.add(key, int(w.counts[i]), entry[a:b], level[a:b])
                        if full:
                            rows.append(full)
                if rows:
                    yield _batch(rows)
        rows = signer.rest() + [(TOTAL, docs, terms, None, None, None)]
        for row in rows:
            yield _batch([row])
    return run


# ---------------------------------------------------------------------------- bounds

@dataclass
class Asked:
    """A block of items: distinct terms with weights, and each item's terms."""

    items: np.ndarray          # item ids
    term: np.ndarray           # distinct term hashes
    weight: np.ndarray         # of the terms
    own: list[np.ndarray]      # terms of each item (positions in ``term``)
    docs: int
    terms: int

    def bounds(self, width: int, lens: np.ndarray, sig: bytes) -> np.ndarray:
        """Upper bounds of all scores (item, document) of a block of signatures."""
        n = len(lens)
        bits = np.frombuffer(sig, dtype=np.uint8).reshape(width, -1)
        m = damping(lens, self.docs, self.terms)
        total = np.zeros((len(self.items), n), dtype=np.int64)
        before = np.zeros(n, dtype=np.int64)
        alive = np.arange(len(self.term))
        held: np.ndarray | None = None
        for level, upper in zip(range(len(LEVELS) - 1), LEVELS[1:]):
            at = _positions(self.term[alive], level, width)
            row = bits[at[0]]
            for p in at[1:]:
                row &= bits[p]
            if held is not None:
                row &= held
            some = row.any(axis=1)
            alive, held = alive[some], row[some]
            if not len(alive):
                break
            place = np.full(len(self.term), -1)
            place[alive] = np.arange(len(alive))
            present = np.unpackbits(held, axis=1, count=n).astype(np.float64)
            now = gain(upper - 1, m)
            for i, own in enumerate(self.own):
                here = place[own]
                ok = here >= 0
                if ok.any():
                    total[i] += (now - before) * (self.weight[own[ok]] @ present[here[ok]]
                                                  ).astype(np.int64)
            before = now
        return total


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bytes]]:
    for batch in batches:
        for width, ids, lens, sig in zip(*(batch.column(i) for i in range(4))):
            yield (width.as_py(), np.frombuffer(ids.as_py(), dtype=np.int64),
                   np.frombuffer(lens.as_py(), dtype=np.int64), sig.as_py())


PAIR = "item_id long, doc_id long"


def _pairs(items: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(docs, pa.int64())],
                                      names=["item_id", "doc_id"])


def _highest(asked: Asked, keep: int):
    """The documents with the highest bounds of each item, per task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.zeros((len(asked.items), 0), dtype=np.int64)
        doc = np.zeros((len(asked.items), 0), dtype=np.int64)
        for width, ids, lens, sig in _blocks(batches):
            best = np.concatenate([best, asked.bounds(width, lens, sig)], axis=1)
            doc = np.concatenate([doc, np.broadcast_to(ids, (len(doc), len(ids)))], axis=1)
            if best.shape[1] > keep:
                top = np.argpartition(-best, keep - 1, axis=1)[:, :keep]
                best = np.take_along_axis(best, top, 1)
                doc = np.take_along_axis(doc, top, 1)
        at = best > 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.broadcast_to(asked.items[:, None], at.shape)[at], pa.int64()),
             pa.array(doc[at], pa.int64()), pa.array(best[at], pa.int64())],
            names=["item_id", "doc_id", "bound"])
    return run


def _possible(asked: Asked, least: np.ndarray, last: np.ndarray):
    """All documents that the k-th best score ``least`` (of document ``last``) leaves possible."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for width, ids, lens, sig in _blocks(batches):
            bound = asked.bounds(width, lens, sig)
            ok = (bound > least[:, None]) | ((bound == least[:, None]) & (ids[None] <= last[:, None]))
            i, j = np.nonzero(ok)
            yield _pairs(asked.items[i], ids[j])
    return run


def _exact(asked: Asked):
    """Exact scores of documents (with text) for the items listed with them."""
    place = {int(x): i for i, x in enumerate(asked.items)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = _term_words(buf, offs)
                ids, lists = part.column(0).to_pylist(), part.column(2).to_pylist()
                got: list[tuple] = []
                for d, (key, items) in enumerate(zip(ids, lists)):
                    name, tf = np.unique(w.hash[w.first[d]:w.first[d + 1]], return_counts=True)
                    if not len(name):
                        continue
                    m = int(damping(int(w.counts[d]), asked.docs, asked.terms))
                    for item in items:
                        own = asked.own[place[item]]
                        at = np.minimum(np.searchsorted(name, asked.term[own]), len(name) - 1)
                        hit = name[at] == asked.term[own]
                        score = int((asked.weight[own[hit]].astype(np.int64)
                                     * gain(tf[at[hit]], m)).sum())
                        if score > 0:
                            got.append((item, key, score))
                cols = list(zip(*got)) if got else [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols],
                                                 names=["item_id", "doc_id", "score"])
    return run


@contextmanager
def _rows_per_batch(spark: SparkSession, rows: int):
    """Fewer rows per hand-over to Python while wide rows are read."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return (scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id",
         text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
         block_items: int = BLOCK_ITEMS, first: int = FIRST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 of
    every item; equal scores by ascending id.

    Terms are runs of ASCII letters and digits and non-ASCII characters, A-Z lower-cased.  Null
    and empty texts have no terms, in documents and items; an item without terms, or whose
    terms no document has, has no rows.  Every row of ``docs`` is a document, rows that repeat
    an id too (they may share an item's list); rows with a null id count in the corpus
    statistics and are not returned.  Rows that repeat an item id form one item with the terms
    of all of them; a null item id is no item.  Empty tables give an empty result; other
    columns are not read.  Items are answered in blocks of about ``block_items``.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "lexical")
    schema = "item_id long, rank int, doc_id long, score long"
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = _term_words(buf, offs)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(w.doc())), pa.array(wd.i64(w.hash))],
                    names=["item_id", "term"])

    asked_terms = tables.put(
        items.select(F.col(item_col).cast("long").alias("item_id"),
                     F.col(item_text).cast("string").alias("text"))
        .where("item_id IS NOT NULL").mapInArrow(terms, "item_id long, term long").distinct())
    number = asked_terms.select("item_id").distinct().count()
    if not number:
        return spark.createDataFrame([], schema)
    wanted = bloom.build(asked_terms.select("term").distinct(), "term")
    index = tables.put(src.mapInArrow(_index(wanted), INDEX))
    total = index.where(F.col("kind") == TOTAL).agg(F.sum("a"), F.sum("b")).first()
    if not total[0]:
        return spark.createDataFrame([], schema)
    n_docs, n_terms = int(total[0]), int(total[1])
    df = (index.where(F.col("kind") == DF).groupBy(F.col("a").alias("term"))
          .agg(F.sum("b").alias("df")))
    blocks = -(-number // block_items)
    weighed = tables.put(asked_terms.join(df, "term").withColumn(
        "block", F.pmod(F.xxhash64("item_id"), F.lit(blocks))), asked_terms)
    signatures = index.where(F.col("kind") == SIGNATURES).select(
        F.col("a").alias("width"), "ids", "lens", "sig")

    results = []
    for block in range(blocks):
        asked = _asked(weighed.where(F.col("block") == block), n_docs, n_terms)
        if asked is None:
            continue

        def score(pairs: DataFrame, asked: Asked = asked) -> DataFrame:
            lists = pairs.groupBy("doc_id").agg(F.collect_list("item_id").alias("items"))
            return src.join(lists, "doc_id").select("doc_id", "text", "items").mapInArrow(
                _exact(asked), "item_id long, doc_id long, score long")

        with _rows_per_batch(spark, INDEX_ROWS):
            high = signatures.mapInArrow(_highest(asked, first),
                                         "item_id long, doc_id long, bound long")
            order = Window.partitionBy("item_id").orderBy(F.desc("bound"), "doc_id")
            high = tables.put(high.withColumn("n", F.row_number().over(order))
                              .where(F.col("n") <= first).select("item_id", "doc_id").distinct())
        limit = _best(score(high), k).where(F.col("rank") == k).collect()   # a row per item
        least = np.ones(len(asked.items), dtype=np.int64)
        last = np.full(len(asked.items), np.iinfo(np.int64).max)
        place = {int(x): i for i, x in enumerate(asked.items)}
        for r in limit:
            least[place[r["item_id"]]], last[place[r["item_id"]]] = r["score"], r["doc_id"]
        with _rows_per_batch(spark, INDEX_ROWS):
            left = tables.put(signatures.mapInArrow(_possible(asked, least, last), PAIR)
                              .distinct(), high)
        results.append(tables.put(_best(score(left), k), left))
    tables.drop(index, weighed)
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def _asked(block: DataFrame, docs: int, terms: int) -> Asked | None:
    """A block of items on the driver: bounded by its number of items."""
    rows = block.select("item_id", "term", "df").toArrow()
    if not rows.num_rows:
        return None
    items, item = np.unique(rows["item_id"].to_numpy(), return_inverse=True)
    term, first, at = np.unique(rows["term"].to_numpy().view(U64), return_index=True,
                                return_inverse=True)
    weights = np.array([weight(docs, int(x)) for x in rows["df"].to_numpy()[first]],
                       dtype=np.float64)
    return Asked(items, term, weights,
                 [np.flatnonzero(x) for x in _incidence(item, at, len(items), len(term))],
                 docs, terms)


def _incidence(item: np.ndarray, term: np.ndarray, items: int, terms: int) -> Iterator[np.ndarray]:
    order = np.argsort(item, kind="stable")
    cuts = np.searchsorted(item[order], np.arange(items + 1))
    for a, b in zip(cuts, cuts[1:]):
        row = np.zeros(terms, dtype=bool)
        row[term[order[a:b]]] = True
        yield row
