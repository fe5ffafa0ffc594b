"""Removal of repeated word windows by recompression.

Every text is compressed round by round, with names that depend on content alone (hashes),
so they agree over all documents without any exchange: runs of one symbol become a symbol,
then pairs of a left and a right symbol do (a hash bit of the symbol and the round says
which).  Whether two symbols join depends on them and, for a symbol that stays as it is,
on its neighbours; the span of words that decided over a symbol is its context.  A symbol
whose context lies inside a window therefore also arises, at the same place, in every
other occurrence of the window: equal windows have equal interior symbols.

Each window takes one interior symbol, of the highest round that has any (the one that
covers most words, then the one with the largest name), as its key, together with the words
of its context; a window without interior symbol is its own key.  Neighbouring windows mostly share their key, so far fewer keys than
windows are sent.  Keys that occur in two documents reveal the candidates; only windows
with such a key are then named as a whole and compared, which verifies the repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd
from scoreline.llm.tables import Tables

WINDOW = 13
ROUNDS = 3
U64 = np.uint64
FAR = 1 << 40        # context of a symbol that the end of the text decided over


class Level:
    """Symbols of a block: name, document, words [lo, hi) and context [from, to)."""

    def __init__(self, name, doc, lo, hi, left, right):
        self.name, self.doc, self.lo, self.hi = name, doc, lo, hi
        self.left, self.right = left, right

    def __len__(self) -> int:
        return len(self.name)


def first_level(w: wd.Words) -> Level:
    at = np.arange(len(w), dtype=np.int64)
    return Level(w.hash, w.doc(), at, at + 1, at, at + 1)


def _neighbours(s: Level) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per symbol: has a left / right neighbour in its document; contexts of these
    (far away where the text ends)."""
    n = len(s)
    has_l, has_r = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
    if n > 1:
        has_r[:-1] = s.doc[1:] == s.doc[:-1]
        has_l[1:] = has_r[:-1]
    from_l = np.full(n, -FAR)
    to_r = np.full(n, FAR)
    from_l[1:][has_l[1:]] = s.left[:-1][has_l[1:]]
    to_r[:-1][has_r[:-1]] = s.right[1:][has_r[:-1]]
    return has_l, has_r, from_l, to_r


def runs(s: Level, salt: int) -> Level:
    """Maximal runs of one symbol become a symbol; the neighbours decide where a run ends."""
    n = len(s)
    if not n:
        return s
    _, has_r, from_l, to_r = _neighbours(s)
    same = np.zeros(n, dtype=bool)                    # equal to the symbol before
    same[1:] = has_r[:-1] & (s.name[1:] == s.name[:-1])
    begin = np.flatnonzero(~same)
    last = np.append(begin[1:], n) - 1
    length = (last - begin + 1).astype(U64)
    name = s.name[begin]
    many = length > 1
    name = np.where(many, wd.mix(name ^ wd.mix(length + U64(salt << 32))), name)
    return Level(name, s.doc[begin], s.lo[begin], s.hi[last],
                 np.minimum(s.left[begin], from_l[begin]), np.maximum(s.right[last], to_r[last]))


def pairs(s: Level, salt: int) -> Level:
    """A left symbol and a right symbol after it become a symbol."""
    n = len(s)
    if not n:
        return s
    has_l, has_r, from_l, to_r = _neighbours(s)
    is_left = (wd.mix(s.name + U64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> U64(63)).astype(bool)
    joins = np.zeros(n, dtype=bool)                   # with the next symbol
    joins[:-1] = has_r[:-1] & is_left[:-1] & ~is_left[1:]
    second = np.zeros(n, dtype=bool)
    second[1:] = joins[:-1]
    begin = np.flatnonzero(~second)
    two = joins[begin]
    nxt = np.minimum(begin + 1, n - 1)
    name = np.where(two, wd.mix(s.name[begin] * U64(0xD6E8FEB86659FD93)
                                + wd.mix(s.name[nxt] + U64(salt))), s.name[begin])
    # a symbol that stays alone: a left one because of what follows, a right one because of
    # what comes before
    left = np.where(two, np.minimum(s.left[begin], s.left[nxt]),
                    np.where(is_left[begin], s.left[begin], np.minimum(s.left[begin], from_l[begin])))
    right = np.where(two, np.maximum(s.right[begin], s.right[nxt]),
                     np.where(is_left[begin], np.maximum(s.right[begin], to_r[begin]), s.right[begin]))
    return Level(name, s.doc[begin], s.lo[begin], np.where(two, s.hi[nxt], s.hi[begin]), left, right)


def levels(w: wd.Words, rounds: int = ROUNDS) -> list[Level]:
    """Symbols after 0, 1, ... rounds."""
    out = [runs(first_level(w), 1)]
    for r in range(1, rounds + 1):
        out.append(runs(pairs(out[-1], 2 * r), 2 * r + 1) if r > 1 else pairs(out[-1], 2))
    return out


def window_keys(w: wd.Words, size: int = WINDOW,
                rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, window name, document, first word) of every window of ``size`` words."""
    whole, doc, pos = wd.ngrams(w.hash, w.counts, size)
    key = whole.copy()
    todo = np.arange(len(pos))
    total = len(w)
    if not len(pos):
        return key, whole, doc, pos
    # running polynomial of word names: a context's name is a difference of two entries
    run = np.append(U64(0), np.cumsum(w.hash * wd.powers(total), dtype=U64))
    for s in reversed(levels(w, rounds)):
        if not len(todo):
            break
        inner = np.flatnonzero((s.left >= 0) & (s.right - s.left <= size) & (s.right < FAR))
        # symbols by their first word (one per word and level)
        name = np.zeros(total + size, dtype=U64)
        left = np.full(total + size, -1, dtype=np.int64)
        right = np.full(total + size, FAR, dtype=np.int64)
        at = s.lo[inner]
        covers = np.minimum(s.hi[inner] - at, 255).astype(U64)
        context = (run[s.right[inner]] - run[s.left[inner]]) * wd.powers(total, True)[s.left[inner]]
        # order: more words first, then the larger name; 0 means none
        name[at] = (covers << U64(56)) | (wd.mix(wd.mix(context) + s.name[inner]) >> U64(8)) | U64(1)
        left[at], right[at] = s.left[inner], s.right[inner]
        best = np.zeros(len(todo), dtype=U64)
        p = pos[todo]
        for k in range(size):
            q = p + k
            cand = np.where((left[q] >= p) & (right[q] <= p + size), name[q], U64(0))
            np.maximum(best, cand, out=best)
        ok = best > 0
        key[todo[ok]] = wd.mix(best[ok])
        todo = todo[~ok]
    return key, whole, doc, pos


def _hex_kept(buf: np.ndarray, w: wd.Words, removed: np.ndarray, d: int) -> str:
    """SHA-256 of the kept words of document ``d`` of a block, joined by one space."""
    a, b = w.first[d], w.first[d + 1]
    keep = np.flatnonzero(~removed[a:b]) + a
    starts, ends = w.starts[keep], w.ends[keep]
    size = ends - starts + 1
    out = np.full(int(size.sum()), 0x20, dtype=np.uint8)
    to = np.cumsum(size) - size
    out[wd.ragged(to, size - 1)] = buf[wd.ragged(starts, size - 1)]
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def _second(names: np.ndarray, pos: np.ndarray, size: int) -> np.ndarray:
    """A second, 32-bit name of windows: with the first one, 96 bits tell windows apart."""
    h = np.zeros(len(pos), dtype=U64)
    other = wd.mix(names ^ U64(0x5851F42D4C957F2D))
    for k in range(size):
        h = h * U64(0x2545F4914F6CDD1D) + other[pos + k]
    return (wd.mix(h) >> U64(32)).astype(np.uint32).view(np.int32)


def remove_repeats(docs: DataFrame, size: int = WINDOW, rounds: int = ROUNDS,
                   id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row.

    A word goes if it lies in a window of ``size`` words whose words also stand, in this
    order, in a document with a smaller id; windows are judged on the input.  Null and
    empty texts have no words (hash of the empty text).  Rows with a null id neither lose
    words nor make others lose any.  Rows that share an id do not make each other lose words,
    and each is judged by its own text.  One row per input row; an empty table gives an empty
    result; other columns are not read.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "recompression")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))
    known = F.col("doc_id").isNotNull()
    again = tables.put(src.where(known).groupBy("doc_id").count()
                       .where("count > 1").select("doc_id", F.lit(True).alias("again")))
    if again.limit(1).count():
        # rows are told apart by their texts where an id repeats, else by the id alone
        src = src.join(again, "doc_id", "left").select(
            "doc_id", "text", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("row"))
        own = ["doc_id", "row"]
        texts = src.where(known).dropDuplicates(own)
    else:
        own = ["doc_id"]
        texts = src.where(known)
    texts = texts.select("text", *own)
    kinds = ", ".join(f"{c} long" for c in own)
    more = len(own) + 1                        # the column after the row's text and name

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = wd.Words(buf, offs)
                key, _, doc, _ = window_keys(w, size, rounds)
                order = np.lexsort((key, doc))
                k, d = key[order], doc[order]
                new = np.ones(len(k), dtype=bool)
                new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
                at = pa.array(d[new])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wd.i64(k[new])), *(part.column(1 + i).take(at) for i in range(len(own)))],
                    names=["key", *own])

    sent = tables.put(texts.mapInArrow(keys, f"key long, {kinds}"))
    shared = tables.put(sent.groupBy("key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                        .where("a < b").select("key"))
    # rows with their shared keys; the list is as long as the text at most
    with_keys = tables.put(sent.join(shared, "key").groupBy(*own).agg(
        F.collect_list("key").alias("keys")), sent, shared)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = wd.Words(buf, offs)
                key, whole, doc, pos = window_keys(w, size, rounds)
                lists = part.column(more)
                have = lists.flatten().to_numpy().view(U64)
                n_have = np.diff(lists.offsets.to_numpy())
                # (document, key) pairs in both
                have = np.unique(_pair(np.repeat(np.arange(len(n_have)), n_have), have))
                mine = _pair(doc, key)
                at = np.searchsorted(have, mine)
                at[at == len(have)] = 0
                ok = np.flatnonzero(have[at] == mine) if len(have) else np.zeros(0, np.int64)
                of = pa.array(doc[ok])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(wd.i64(whole[ok])), pa.array(_second(w.hash, pos[ok], size)),
                     *(part.column(1 + i).take(of) for i in range(len(own))),
                     pa.array(pos[ok] - w.first[doc[ok]], pa.int32())],
                    names=["name", "second", *own, "pos"])

    cand = tables.put(texts.join(with_keys, own).select("text", *own, "keys").mapInArrow(
        windows, f"name long, second int, {kinds}, pos int"))
    whole = ["name", "second"]
    firsts = tables.put(cand.groupBy(*whole).agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
                        .where("a < b").select(*whole, "a"))
    gone = tables.put(cand.join(firsts, whole).where("doc_id > a").groupBy(*own).agg(
        F.collect_list("pos").alias("at")), cand, firsts, with_keys)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                w = wd.Words(buf, offs)
                lists = part.column(2).fill_null([]) if part.column(2).null_count else part.column(2)
                at = lists.flatten().to_numpy().astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
                step = np.zeros(len(w) + size + 1, dtype=np.int32)
                begin = w.first[doc] + at
                np.add.at(step, begin, 1)
                np.add.at(step, begin + size, -1)
                removed = np.cumsum(step)[:len(w)] > 0
                total = np.append(0, np.cumsum(removed))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(w.counts, pa.int64()),
                     pa.array(total[w.first[1:]] - total[w.first[:-1]], pa.int64()),
                     pa.array([_hex_kept(buf, w, removed, d) for d in range(part.num_rows)],
                              pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return (src.join(gone, own, "left").select("doc_id", "text", "at")
            .mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def _pair(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """One 64-bit name of (document of the block, key)."""
    return wd.mix(key + wd.mix(doc.astype(U64) + U64(0x632BE59BD9B4E019)))
