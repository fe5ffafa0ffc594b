"""Benchmark decontamination by spaced seeds: substitution-tolerant overlaps.

A mask marks the word positions of a window that count (1) and that are ignored (0).
Every place of a benchmark item and of a document is hashed under each mask; equal hashes
propose an alignment even where ignored words differ, so a substituted word spoils only
the masks and places that look at it; the masks are chosen so that some place is left.  Proposed alignments are verified word by word
around the hit: a document is contaminated by an item if some stretch of the alignment
reaches ``length`` words (the whole item, if it is shorter) with a share ``identity`` of
equal words.

Words are compared without regard to case and without punctuation at their edges, on both
sides; words of punctuation alone do not count as words.

Documents are hashed where they are scanned.  A Bloom filter of the benchmark's hashes
(fixed number of bits, so its size does not grow with either side) drops places without a
partner; the stretches of words around the other places are joined by hash, so only they
are shuffled.  False positives of the filter vanish in that join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd
from scoreline.llm.bloom import MAX_BITS, Bloom, build
from scoreline.llm.tables import Tables

# fixed masks by least words of the item.  Whatever words the rule lets differ (2 of 8, 3 of
# 12, 3 of 13), some mask at some place looks at none of them, so no stretch that the rule
# accepts is missed (the tests enumerate all patterns).
MASKS = {
    8: ("11011", "11000011", "10100101"),
    12: ("110111", "110001011", "11010011", "10001100011"),
    13: ("1111011", "1101000111", "11011101", "111000010011", "11001111"),
}
LENGTH = 13              # words of the shortest verified stretch
IDENTITY = 0.75          # share of equal words in it
SHORTEST = 8             # items with fewer words are compared as a whole, exactly
LEAST = 3                # words of the shortest item that removes a longer text
PER_KEY = 256            # bits of the Bloom filter per seed: few places of a text pass by chance
AROUND = 64              # words kept on either side of a hit, at least
U64 = np.uint64


def seeds(names: np.ndarray, counts: np.ndarray, mask: str, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every place of a mask inside documents."""
    span = len(mask)
    if len(names) < span:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    size = len(names) - span + 1
    h = np.full(size, U64(0x51ED270B + salt), dtype=U64)
    for k, bit in enumerate(mask):
        if bit == "1":
            h = h * U64(0xD6E8FEB86659FD93) + names[k:k + size]
    doc = np.repeat(np.arange(len(counts)), counts)
    pos = np.flatnonzero(doc[:size] == doc[span - 1:])
    return wd.mix(h[pos]), pos


def chosen(n: int, masks: dict[int, tuple[str, ...]] = MASKS) -> list[tuple[str, int]]:
    """Masks and salts for items of ``n`` words; the whole length for the shortest items."""
    if n < SHORTEST:
        return [("1" * n, 100 + n)]
    least = max(k for k in masks if k <= n)
    return [(mask, 1000 * least + i) for i, mask in enumerate(masks[least])]


def benchmark_words(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, words) of the benchmark."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = wd.BareWords(*wd.caseless(buf, offs))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(w.first, pa.int32()),
                                                              pa.array(wd.i64(w.hash)))],
                    names=["item", "words"])

    src = bench.select(F.col(id_col).cast("long").alias("item"),
                       F.col(text_col).cast("string").alias("text")).where("item IS NOT NULL")
    return src.mapInArrow(run, "item long, words array<long>").distinct()


def benchmark_seeds(items: DataFrame, masks: dict[int, tuple[str, ...]]) -> DataFrame:
    """(h, item, pos) of every item under every mask of its length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            first = lists.offsets.to_numpy().astype(np.int64)
            names, first = lists.flatten().to_numpy().view(U64), first - first[0]
            counts = np.diff(first)
            kind = np.minimum(counts, max(masks))
            for n in np.unique(kind[kind > 0]).tolist():
                for mask, salt in chosen(n, masks):
                    h, pos = seeds(names, counts, mask, salt)
                    at = kind[np.searchsorted(first, pos, "right") - 1] == n
                    yield rows(batch, first, h[at], pos[at])

    def rows(batch: pa.RecordBatch, first: np.ndarray, h: np.ndarray, pos: np.ndarray):
        doc = np.searchsorted(first, pos, "right") - 1
        return pa.RecordBatch.from_arrays(
            [pa.array(wd.i64(h)), batch.column(0).take(pa.array(doc)),
             pa.array(pos - first[doc], pa.int64())], names=["h", "item", "pos"])

    return items.mapInArrow(run, "h long, item long, pos long").distinct()


def stretches(docs: DataFrame, bloom: Bloom, masks: list[tuple[str, int]],
              around: int) -> DataFrame:
    """(row, segment, first, words, seeds, places) of the parts of documents around hits.

    ``docs`` has row and text; ``masks`` come with their salts.  Hits closer than twice ``around`` share a stretch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = wd.BareWords(*wd.caseless(buf, offs))
                hs, ps = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
                for mask, salt in masks:
                    h, pos = seeds(w.hash, w.counts, mask, salt)
                    at = bloom.has(h)
                    hs.append(h[at])
                    ps.append(pos[at])
                h, pos = np.concatenate(hs), np.concatenate(ps)
                if not len(pos):
                    continue
                order = np.argsort(pos, kind="stable")
                h, pos = h[order], pos[order]
                doc = np.searchsorted(w.first, pos, "right") - 1
                new = np.ones(len(pos), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (pos[1:] - pos[:-1] > 2 * around)
                begin = np.flatnonzero(new)
                end = np.append(begin[1:], len(pos))
                d = doc[begin]
                lo = np.maximum(pos[begin] - around, w.first[d])
                hi = np.minimum(pos[end - 1] + 1 + around, w.first[d + 1])
                cuts = pa.array(np.append(begin, len(pos)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(d)), pa.array(lo - w.first[d], pa.int64()),
                     pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(hi - lo)), pa.int32()),
                                              pa.array(wd.i64(w.hash[wd.ragged(lo, hi - lo)]))),
                     pa.ListArray.from_arrays(cuts, pa.array(wd.i64(h))),
                     pa.ListArray.from_arrays(cuts, pa.array(pos - np.repeat(lo, end - begin),
                                                             pa.int64()))],
                    names=["row", "first", "words", "h", "p"])

    return docs.mapInArrow(
        run, "row long, first long, words array<long>, h array<long>, p array<long>")


def _verify(length: int, identity: float):
    """Longest verified stretch of an alignment: (words, equal words, first word in the item)."""
    def best(item: np.ndarray, text: np.ndarray, shift: int) -> tuple[int, int]:
        """``shift``: place of the item's first word in the text."""
        lo, hi = max(0, -shift), min(len(item), len(text) - shift)
        if hi <= lo:
            return 0, 0
        same = (item[lo:hi] == text[lo + shift:hi + shift]).astype(np.int64)
        need = min(length, len(item))
        if len(same) < need or need == 0:
            return 0, 0
        share = 1.0 if len(item) < SHORTEST else identity
        run = np.append(0, np.cumsum(same))
        window = run[need:] - run[:-need]
        if window.max() < share * need:
            return 0, 0
        ok = np.zeros(len(same), dtype=bool)
        for s in np.flatnonzero(window >= share * need):
            ok[s:s + need] = True
        return int(ok.sum()), int((same.astype(bool) & ok).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, items = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shift = batch.column(2).to_numpy()
            a, b = batch.column(3), batch.column(4)
            av, ao = a.flatten().to_numpy(), a.offsets.to_numpy() - a.offsets[0].as_py()
            bv, bo = b.flatten().to_numpy(), b.offsets.to_numpy() - b.offsets[0].as_py()
            got = [best(av[ao[i]:ao[i + 1]], bv[bo[i]:bo[i + 1]], int(shift[i]))
                   for i in range(batch.num_rows)]
            n = np.array([g[0] for g in got], dtype=np.int64)
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[at]), pa.array(items[at]), pa.array(n[at]),
                 pa.array(np.array([g[1] for g in got], dtype=np.int64)[at])],
                names=["row", "item", "n", "equal"])
    return run


def overlaps(docs: DataFrame, bench: DataFrame, masks: dict[int, tuple[str, ...]] = MASKS,
             length: int = LENGTH, identity: float = IDENTITY, around: int = AROUND,
             bits: int = MAX_BITS, row_col: str = "doc_id", text_col: str = "text",
             item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(row, item_id, n_words, n_equal): the longest verified stretch per document and item.

    ``row_col`` (a long) names the rows of ``docs``.  Rows with a null name, and null or
    empty texts and items, match nothing; items and rows that share a name (repeated rows)
    count together; empty tables give an empty result; other columns are not read.  The
    default masks find every stretch of the default rule; other rules need other masks.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "decontaminate")
    items = tables.put(benchmark_words(bench, item_col, item_text))
    seed = tables.put(benchmark_seeds(items, masks))
    bloom = build(seed, "h", bits, PER_KEY)
    sizes = [r[0] for r in items.select(F.least(F.size("words"), F.lit(max(masks))).alias("n"))
             .where("n > 0").distinct().collect()]
    used = sorted({m for n in sizes for m in chosen(n, masks)})
    src = docs.select(F.col(row_col).cast("long").alias("row"),
                      F.col(text_col).cast("string").alias("text")).where("row IS NOT NULL")
    parts = tables.put(stretches(src, bloom, used, around)
                       .withColumn("part", F.monotonically_increasing_id()))
    hits = parts.select("part", F.explode(F.arrays_zip("h", "p")).alias("x")).select(
        "part", F.col("x.h").alias("h"), F.col("x.p").alias("p"))
    # one row per stretch, item and alignment, however many seeds agree on it
    found = (hits.join(seed, "h")
             .select("part", "item", (F.col("p") - F.col("pos")).alias("shift")).distinct())
    # of a stretch only the words beside the item go on, so repeats of an item cost their own size
    begin = F.greatest("shift", F.lit(0))
    end = F.least(F.col("shift") + F.size("item_words"), F.size("words"))
    pairs = (found.join(items.withColumnRenamed("words", "item_words"), "item")
             .join(parts.select("part", "row", "words"), "part")
             .select("row", "item", F.least("shift", F.lit(0)).alias("shift"), "item_words",
                     F.slice("words", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0))
                             .cast("int")).alias("words")))
    best = pairs.mapInArrow(_verify(length, identity), "row long, item long, n long, equal long")
    return best.groupBy(F.col("row"), F.col("item").alias("item_id")).agg(
        F.max(F.struct("n", "equal")).alias("x")).select(
        "row", "item_id", F.col("x.n").alias("n_words"), F.col("x.equal").alias("n_equal"))


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, words) of every row."""
    for batch in batches:
        for part, buf, offs in wd.blocks(batch):
            w = wd.BareWords(*wd.caseless(buf, offs))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(w.counts, pa.int64())],
                                             names=["row", "size"])


def remove_contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id",
                        text_col: str = "text", least: int = LEAST, **kw) -> DataFrame:
    """Rows of ``docs`` without a verified overlap with any item, with all their columns.

    Items of fewer than ``least`` words (a bare answer) count only if they are the whole
    text; ``overlaps`` reports them wherever they stand.  Decided per id: rows with one id
    share the decision; rows with a null id are compared under no name and stay.  Columns pass
    through whatever their names."""
    tables = Tables(docs.sparkSession, "decontaminated")
    found = tables.put(overlaps(docs, bench, row_col=id_col, text_col=text_col, **kw)
                       .select("row", "n_words").distinct())
    key = F.col(f"`{id_col}`").cast("long")
    bad = found.where(F.col("n_words") >= least).select(F.col("row").alias("key"))
    short = found.where(F.col("n_words") < least)
    if short.limit(1).count():
        size = (docs.select(key.alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
                .join(short.select("row").distinct(), "row", "left_semi")
                .mapInArrow(_sizes, "row long, size long"))
        bad = bad.unionByName(short.join(size, "row").where("size = n_words")
                              .select(F.col("row").alias("key")))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    named = docs.select(whole, key.alias("key"))
    return named.join(tables.put(bad.distinct()), "key", "left_anti").select("row.*")
