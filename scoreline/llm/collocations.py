"""Phrase collocations from count streams in prefix and suffix order.

The streams hold, per language, the number of occurrences of every word, pair and triple of
words that can matter.  They are built shortest first, as a phrase is no more frequent than
its parts: pairs are counted of words that reach the least count, triples of pairs that do
(a Bloom filter thins them out while the texts are read; the exact counts decide).

A phrase meets its parts by merge joins of sorted streams, read in lockstep, never by a hash
table: in prefix order (first word, second, third) every phrase stands beside its left part,
and the pair beside the triples that extend it to the right; in suffix order (last word
first) beside its right part and the triples that extend it to the left.  Spark deals the
keys out to the tasks and sorts on disk; a stream is never held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scoreline.llm import bloom
from scoreline.llm import words as wd
from scoreline.llm.tables import Tables

U64 = np.uint64
LEAST = 10              # occurrences of a candidate, at least
COVER = 50              # percent of a phrase's occurrences inside a longer one that drop it
UNKNOWN = "und"
CHUNK_BYTES = 2 << 20   # text that is counted together inside a task
BATCH_PHRASES = 1 << 15 # phrases handed to Spark at once

_STOP = np.zeros(256, dtype=bool)                     # fixed values: piece ends
_STOP[[ord(c) for c in ".,;:!?"]] = _STOP[0x0A:0x0E] = True
_WORD = np.ones(256, dtype=bool)
_WORD[[0x20, 0x09]] = False
_WORD[_STOP] = False
_SALT = U64(0xC2B2AE3D27D4EB4F)


def _name(lang: str, words: np.ndarray) -> np.ndarray:
    """Filter keys of words or pairs of a language."""
    salt = wd.word_hash(lang if lang.strip() else "?")[:1] * _SALT
    return wd.mix(words + salt)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return wd.mix(a * U64(0xD6E8FEB86659FD93) + wd.mix(b))


class Counted:
    """Phrases of ``n`` words of some texts of one language, with their counts."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, lang: str, n: int,
                 known: bloom.Bloom | None):
        w = wd.Words(buf, offs, _WORD, lower=True)
        self.buf, self.starts, self.ends, self.n = w.buf, w.starts, w.ends, n
        size = max(len(w) - n + 1, 0)
        ok = np.ones(size, dtype=bool)
        if n > 1 and size:
            # inside one piece: no stop between the first and the last word, and one text
            stops = np.append(0, np.cumsum(_STOP[w.buf]))
            doc = w.doc()
            ok = (stops[w.starts[n - 1:]] == stops[w.starts[:size]]) & (doc[:size] == doc[n - 1:])
        names, first, ids = np.unique(w.hash, return_index=True, return_inverse=True)
        if known is not None and n == 2:
            good = np.zeros(len(names), dtype=bool)
            good[known.has(_name(lang, names))] = True
            ok &= good[ids[:size]] & good[ids[1:size + 1]]
        elif known is not None and n == 3 and size:
            good = np.zeros(len(w) - 1, dtype=bool)
            good[known.has(_name(lang, _pair(w.hash[:-1], w.hash[1:])))] = True
            ok &= good[:size] & good[1:]
        at = np.flatnonzero(ok)
        # exact names inside the chunk: numbers of words, or of the pair and a word
        key = ids[at].astype(np.int64)
        for k in range(1, n):
            if k > 1:
                key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            key = key * len(names) + ids[at + k]
        _, pick, self.counts = np.unique(key, return_index=True, return_counts=True)
        self.at = at[pick]

    def rows(self, lang: str) -> Iterator[pa.RecordBatch]:
        """(key, f): the language, a line break (no word has one), the words and single spaces."""
        head = np.frombuffer(lang.encode() + b"\n", dtype=np.uint8)
        for i in range(0, len(self.at), BATCH_PHRASES):
            at = self.at[i:i + BATCH_PHRASES]
            word = at[:, None] + np.arange(self.n)
            size = self.ends[word] - self.starts[word]
            end = np.cumsum(len(head) + size.sum(1) + self.n - 1)
            offs = np.append(0, end)
            data = np.full(int(end[-1]), 0x20, dtype=np.uint8)
            data[(offs[:-1, None] + np.arange(len(head))).ravel()] = np.tile(head, len(at))
            to = offs[:-1, None] + len(head) + np.cumsum(size + 1, axis=1) - size - 1
            data[wd.ragged(to.ravel(), size.ravel())] = self.buf[
                wd.ragged(self.starts[word].ravel(), size.ravel())]
            key = pa.LargeStringArray.from_buffers(
                len(at), pa.py_buffer(offs.astype(np.int64).tobytes()), pa.py_buffer(data.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [key.cast(pa.string()), pa.array(self.counts[i:i + BATCH_PHRASES], pa.int64())],
                names=["key", "f"])


def _count(n: int, known: bloom.Bloom | None):
    """Task: counts of phrases of ``n`` words, a row per phrase, language and chunk of text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang in sorted(set(langs)):
                rows = pa.array([i for i, x in enumerate(langs) if x == lang])
                for _, buf, offs in wd.blocks(batch.take(rows), max_bytes=CHUNK_BYTES):
                    yield from Counted(buf, offs, lang, n, known).rows(lang)
    return run


def _words(n: int) -> list[str]:
    return [f"w{k + 1}" for k in range(n)]


def _filter(stream: DataFrame, n: int) -> bloom.Bloom:
    """Bloom filter of a stream of words or pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = []
            for k in range(1, n + 1):
                buf, offs = wd.text_buffer(batch.column(k))
                part.append(wd.names(buf, offs[:-1], offs[1:]))
            names = part[0] if n == 1 else _pair(*part)
            langs = np.array(batch.column(0).to_pylist(), dtype=object)
            key = np.empty(len(names), dtype=U64)
            for lang in set(langs.tolist()):
                own = np.flatnonzero(langs == lang)
                key[own] = _name(lang, names[own])
            yield pa.RecordBatch.from_arrays([pa.array(wd.i64(key))], names=["key"])

    return bloom.build(stream.select("lang", *_words(n)).mapInArrow(run, "key long"), "key")


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact (a, l, r below 10^16)."""
    return F.expr(f"CAST((CAST({a} AS DECIMAL(16,0)) * CAST({a} AS DECIMAL(16,0)) "
                  f"* CAST(1000000 AS DECIMAL(7,0))) DIV (CAST({left} AS DECIMAL(16,0)) "
                  f"* CAST({right} AS DECIMAL(16,0))) AS BIGINT)")


def mine(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = 2000,
         text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the best phrases of two or three words of
    each language.

    Texts are lower-cased (A-Z), split at ``. , ; : ! ?`` and line breaks, then at spaces and
    tabs.  n counts all words of the language; a, l and r count the phrase and the two parts of
    its weakest cut.  Phrases with fewer than ``least`` occurrences are no candidates; a
    candidate inside a longer one with at least ``cover`` percent of its occurrences is
    dropped.  A null language is ``und``; null and empty texts have no words; every row counts,
    repeated rows too.  An empty table, or one without candidates, gives an empty result;
    other columns are not read.
    """
    tables = Tables(docs.sparkSession, "collocations")
    src = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit(UNKNOWN)).alias("lang"),
                      F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")

    def stream(n: int, known: bloom.Bloom | None) -> DataFrame:
        counted = src.mapInArrow(_count(n, known), "key string, f long").groupBy("key").agg(
            F.sum("f").alias("f"))
        if n > 1:
            counted = counted.where(F.col("f") >= least)
        phrase = F.substring_index("key", "\n", -1)
        word = F.split(phrase, " ")
        return counted.select(
            F.expr("left(key, length(key) - length(substring_index(key, '\\n', -1)) - 1)").alias("lang"),
            *(word[k].alias(w) for k, w in enumerate(_words(n))), "f")

    words = tables.put(stream(1, None))
    total = words.groupBy("lang").agg(F.sum("f").alias("n"))
    frequent = words.where(F.col("f") >= least)
    pairs = tables.put(stream(2, _filter(frequent, 1)))
    triples = tables.put(stream(3, _filter(pairs, 2)))

    def meets(phrases: DataFrame, parts: DataFrame, on: list[str], as_: dict[str, str],
              names: list[str]) -> DataFrame:
        """Lockstep merge of two sorted streams: the phrases' ``on`` words with the parts'."""
        right = parts.select(F.col("lang"), *(F.col(a).alias(b) for a, b in zip(names, on)),
                             *(F.col(a).alias(b) for a, b in as_.items()))
        return phrases.join(right.hint("merge"), ["lang", *on])

    one = meets(pairs, frequent, ["w1"], {"f": "f1"}, ["w1"])
    two = tables.put(meets(one, frequent, ["w2"], {"f": "f2"}, ["w1"]), pairs)
    # prefix order: f(w1 w2) and f(w1); suffix order: f(w2 w3) and f(w3)
    three = meets(triples, two, ["w1", "w2"], {"f": "l2", "f1": "l1"}, ["w1", "w2"])
    three = meets(three, two, ["w2", "w3"], {"f": "r2", "f2": "r1"}, ["w1", "w2"])
    three = tables.put(three, triples)
    # extensions of a pair: the most frequent triple that begins or ends with it
    begins = three.groupBy("lang", "w1", "w2").agg(F.max("f").alias("longer"))
    ends = three.groupBy("lang", F.col("w2").alias("w1"), F.col("w3").alias("w2")).agg(
        F.max("f").alias("longer"))
    longer = begins.unionByName(ends).groupBy("lang", "w1", "w2").agg(
        F.max("longer").alias("longer"))
    # a pair alone: no anti join on counts, the longest extension decides
    kept = two.join(longer.hint("merge"), ["lang", "w1", "w2"], "left").where(
        F.coalesce(100 * F.col("longer") < cover * F.col("f"), F.lit(True)))
    kept = kept.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), F.col("f").alias("a"),
                       F.col("f1").alias("l"), F.col("f2").alias("r"),
                       _score("f", "f1", "f2").alias("score"))
    cut1, cut2 = _score("f", "l1", "r2"), _score("f", "l2", "r1")
    three = three.withColumns({"s1": cut1, "s2": cut2}).select(
        "lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("f").alias("a"),
        F.when(F.col("s1") <= F.col("s2"), F.col("l1")).otherwise(F.col("l2")).alias("l"),
        F.when(F.col("s1") <= F.col("s2"), F.col("r2")).otherwise(F.col("r1")).alias("r"),
        F.least("s1", "s2").alias("score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = (kept.unionByName(three).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= top))
    out = best.join(total, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    result = tables.put(out)
    tables.drop(words, two)
    return result
