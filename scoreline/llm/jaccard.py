"""Similarity join of word-shingle sets by T-occurrence search (DivideSkip).

Two documents link when ``den * |A and B| >= num * |A or B|``.  A document that links with
r shares at least T = ceil(num / den * |r|) shingles with it, so it stands in at least T of
the inverted lists of r's shingles.  DivideSkip splits these lists: the L longest are set
aside, the short ones are merged and counted, documents with fewer than T - L occurrences
are dropped, and the long lists are probed by binary search for the rest.

Distribution.  Documents with equal sets are one class; only classes are compared.  Which
classes must meet in one task is found exactly: in any common order of the shingles, linked
sets A and B share one of the first |A| - ceil(num / den * |A|) + 1 shingles of A that is
also among B's first ones.  The order puts rare shingles first, by levels of their counts
over all documents (once, twice, 8, 64, 512 times or more) and then by hash; the levels
travel as Bloom filters.  Shingles that occur once match nobody and are not sent, so a
class with enough of them sends nothing at all.  The classes of similar size that sent one
shingle are a list, and linked classes stand in a common list.

Lists that hang together (connected components) and fit a task are searched in one task.
Larger components are mostly chains, whose far ends have nothing in common, so they are cut:
every class lives in the longest of its lists, and visits the homes of those classes with
longer lists that it shares a list with.  A home compares its residents with each other and
with its visitors, never visitors among themselves, so every pair with a common list meets in
one home and only there.  A home that exceeds a task's bound is dealt out in blocks, and every
pair of blocks is searched in a task of its own.  Tasks return, per class, the number of links
and one link that keeps it connected, never pairs, so a group of m near copies costs about m
rows per task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.llm import words as wd
from scoreline.llm.bloom import Bloom, build
from scoreline.llm.tables import Tables, components

LEVELS = (2, 8, 64, 512)   # counts at which a shingle's level rises
PASSES = 4             # shares of the shingles counted one after the other (a power of two)
SLICE = 1 << 18        # shingles handled at once inside a task
BLOCK_DOCS = 1024      # classes of one block
BLOCK_SHINGLES = 1 << 20
MU = 0.0085            # DivideSkip's cost ratio of probing to merging
U64 = np.uint64


def shingle_sets(w: wd.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes sorted per document, first of each document + total).

    Fewer than n words give the whole sequence as one shingle; no words give none."""
    h, doc, _ = wd.ngrams(w.hash, w.counts, n)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        one = np.zeros(len(short), dtype=U64)
        for k in range(n - 1):
            has = w.counts[short] > k
            at = w.first[short[has]] + k
            one[has] = one[has] * U64(0xD6E8FEB86659FD93) + w.hash[at]
        h = np.concatenate([h, wd.mix(one + w.counts[short].astype(U64) * U64(0x9E3779B97F4A7C15))])
        doc = np.concatenate([doc, short])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(w.counts) + 1))


def set_names(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """64-bit name of each document's set (sum of mixed hashes, and its size)."""
    total = np.append(U64(0), np.cumsum(wd.mix(h ^ U64(0xA24BAED4963EE407)), dtype=U64))
    size = np.diff(first).astype(U64)
    return wd.mix(total[first[1:]] - total[first[:-1]] + size * U64(0x9FB21C651E98DF25))


class SizeClasses:
    """Ranges of set sizes; linked sets lie in one range or in two neighbouring ones."""

    def __init__(self, num: int, den: int, limit: int):
        lo, his = 1, []
        while lo <= limit:
            his.append(max(lo, lo * den // num))
            lo = his[-1] + 1
        self.hi = np.array(his, dtype=np.int64)
        #: partners of the range's largest size reach this far
        self.reach = self.hi * den // num

    def registrations(self, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, range): its own range, and the one below if partners may be there."""
        docs = np.flatnonzero(size > 0)
        own = np.searchsorted(self.hi, size[docs])
        low = own - 1
        also = (low >= 0) & (size[docs] <= self.reach[np.maximum(low, 0)])
        return np.concatenate([docs, docs[also]]), np.concatenate([own, low[also]])


def prefixes(h: np.ndarray, first: np.ndarray, levels: list[Bloom], num: int,
             den: int) -> tuple[np.ndarray, np.ndarray]:
    """(shingle, document): of each document's first shingles in the common order, those
    that may occur elsewhere."""
    size = np.diff(first)
    doc = np.repeat(np.arange(len(size)), size)
    level = np.zeros(len(h), dtype=np.int8)
    at = np.arange(len(h))
    for bloom in levels:
        at = at[bloom.has(h[at])]
        level[at] += 1
    order = np.lexsort((h, level, doc))
    rank = np.arange(len(h)) - first[doc]          # documents keep their places
    keep = (rank < (size - -(-num * size // den) + 1)[doc]) & (level[order] > 0)
    return h[order][keep], doc[keep]


class Group:
    """Classes of one task: T-occurrence search over their inverted lists."""

    def __init__(self, sets: list[np.ndarray], num: int, den: int):
        self.num, self.den = num, den
        self.size = np.array([len(s) for s in sets], dtype=np.int64)
        first = np.append(0, np.cumsum(self.size))
        doc = np.repeat(np.arange(len(sets)), self.size)
        tokens, ids = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(ids, kind="stable")
        self.lists = doc[order]                               # sorted inside each list
        self.begin = np.append(0, np.cumsum(np.bincount(ids, minlength=len(tokens))))
        self.tokens = [ids[first[i]:first[i + 1]] for i in range(len(sets))]

    def links(self, r: int, among: np.ndarray) -> np.ndarray:
        """Classes that link with class ``r``, of those with ``among`` set."""
        m, a = len(self.size), int(self.size[r])
        need = -(-self.num * a // self.den)                   # T
        mine = self.tokens[r]
        length = self.begin[mine + 1] - self.begin[mine]
        mine = mine[np.argsort(length, kind="stable")]
        longest = int(length.max())
        n_long = min(need - 1, int(need / (MU * np.log(max(2, longest)) + 1)))
        short, long = mine[:a - n_long], mine[a - n_long:]
        count = self._merge(short, m)
        cand = np.flatnonzero((count >= max(1, need - n_long)) & among)
        cand = cand[(cand != r) & (self.size[cand] * self.num <= a * self.den)
                    & (a * self.num <= self.size[cand] * self.den)]
        if not len(cand):
            return cand
        if n_long:
            # probing costs about 20 steps where merging takes one
            if 20 * len(cand) * n_long < int((self.begin[long + 1] - self.begin[long]).sum()):
                total = count[cand] + self._probe(long, cand)
            else:
                total = (count + self._merge(long, m))[cand]
        else:
            total = count[cand]
        union = self.size[cand] + a - total
        return cand[self.den * total >= self.num * union]

    def _merge(self, tokens: np.ndarray, m: int) -> np.ndarray:
        at = wd.ragged(self.begin[tokens], self.begin[tokens + 1] - self.begin[tokens])
        return np.bincount(self.lists[at], minlength=m)

    def _probe(self, tokens: np.ndarray, cand: np.ndarray) -> np.ndarray:
        """Binary search of every candidate in every list, all at once."""
        lo = np.repeat(self.begin[tokens], len(cand))
        end = np.repeat(self.begin[tokens + 1], len(cand))
        want = np.tile(cand, len(tokens))
        hi = end.copy()
        while (lo < hi).any():
            mid = (lo + hi) >> 1
            open_ = lo < hi
            less = open_ & (self.lists[np.minimum(mid, len(self.lists) - 1)] < want)
            lo = np.where(less, mid + 1, lo)
            hi = np.where(open_ & ~less, mid, hi)
        hit = (lo < end) & (self.lists[np.minimum(lo, len(self.lists) - 1)] == want)
        return hit.reshape(len(tokens), len(cand)).sum(0)


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _search(num: int, den: int):
    """One task: a block or a pair of blocks -> (node, other, links)."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("node", kind="stable")
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        side = group["side"].to_numpy()
        pair = bool((group["i"].to_numpy() != group["j"].to_numpy()).any())
        found = Group([np.asarray(x, dtype=np.int64) for x in group["h"]], num, den)
        up = list(range(len(node)))
        links = np.zeros(len(node), dtype=np.int64)
        for r in range(len(node)):
            among = side != side[r] if pair else np.ones(len(node), dtype=bool)
            if pair and side[r]:
                continue                      # the other block's classes are found from here
            got = found.links(r, among)
            links[r] += copies[got].sum()
            if pair:
                links[got] += copies[r]
            for s in got.tolist():
                a, b = _root(up, r), _root(up, s)
                if a != b:
                    up[max(a, b)] = min(a, b)
        root = [int(node[_root(up, i)]) for i in range(len(node))]
        out = pd.DataFrame({"node": node, "other": root, "links": links})
        return out[out["links"] > 0]
    return run


def homes(lists: DataFrame) -> DataFrame:
    """(name, home, visitor) from the members (sig, name) of lists.

    A class lives in the longest of its lists (ties: the largest sig) and visits the longer
    homes of the classes that it shares a list with.  The homes of a list are named once, before
    they meet its members."""
    length = lists.groupBy("sig").agg(F.count("*").alias("n"))
    own = lists.join(length, "sig").groupBy("name").agg(F.max(F.struct("n", "sig")).alias("home"))
    housed = lists.join(own, "name")
    hosts = housed.select("sig", F.col("home").alias("host")).distinct()
    visits = (housed.join(hosts, "sig").where("host > home")
              .select("name", F.col("host.sig").alias("home")).distinct())
    return own.select("name", F.col("home.sig").alias("home"), F.lit(False).alias("visitor")).unionByName(
        visits.withColumn("visitor", F.lit(True)))


def near_duplicates(docs: DataFrame, n: int, num: int, den: int, lower: bool = False,
                    id_col: str = "doc_id", text_col: str = "text",
                    block_docs: int = BLOCK_DOCS,
                    block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every row.

    A row's set has the distinct n-word shingles of its whole text (words: runs of
    characters other than space and 0x09-0x0D; A-Z lower-cased on request); with fewer
    words the whole sequence is its one shingle.  Rows link when the sets' similarity is at
    least num / den; component_id is the smallest id reachable by links, the row's own
    included; n_links counts the linked other rows.

    Null and empty texts have no shingles and link with nothing (component_id: their own
    id).  Repeated rows are copies of each other.  Rows with a null id link with nothing,
    and their component_id is null.  Rows with one id and different texts count as one
    document for component_id.  An empty table gives an empty result; other columns are not
    read.
    """
    spark = docs.sparkSession
    tables = Tables(spark, "jaccard")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                      F.col(text_col).cast("string").alias("text"))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, buf, offs in wd.blocks(batch):
                h, first = shingle_sets(wd.Words(buf, offs, lower=lower), n)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(first), pa.int64()),
                     pa.array(wd.i64(set_names(h, first))),
                     pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(wd.i64(h)))],
                    names=["doc_id", "n_shingles", "name", "h"])

    # the texts are read once; all later steps read the sets
    rows = tables.put(src.mapInArrow(
        name, "doc_id long, n_shingles long, name long, h array<long>"))
    known = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = tables.put(known.groupBy("name").agg(
        F.min("doc_id").alias("node"), F.count("*").alias("copies"),
        F.first("n_shingles").alias("size")))
    largest = classes.agg(F.max("size")).first()[0] or 1
    sizes = SizeClasses(num, den, largest)

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with at most ``SLICE`` shingles together, or one row."""
        for batch in batches:
            first = batch.column(1).offsets.to_numpy()
            i = 0
            while i < batch.num_rows:
                j = int(np.searchsorted(first, first[i] + SLICE, side="right")) - 1
                j = min(max(j, i + 1), batch.num_rows)
                yield batch.slice(i, j - i)
                i = j
        wd.release()

    def once(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names, shingles and firsts of a batch, equal sets of the batch once."""
        names, lists = batch.column(0).to_numpy().view(U64), batch.column(1)
        first = lists.offsets.to_numpy().astype(np.int64)
        h = lists.values.to_numpy()[first[0]:first[-1]].view(U64)
        first = first - first[0]
        keep = np.zeros(len(names), dtype=bool)
        keep[np.unique(names, return_index=True)[1]] = True
        size = np.where(keep, np.diff(first), 0)
        return names, h[wd.ragged(first[:-1], size)], np.append(0, np.cumsum(size))

    def shingles(share: int):
        """Shingles of one of ``PASSES`` equal shares of the hashes."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                h = once(batch)[1]
                h = h[(h & U64(PASSES - 1)) == U64(share)]
                yield pa.RecordBatch.from_arrays([pa.array(wd.i64(h))], names=["sh"])
        return run

    named = known.select("name", "h")
    counted = [tables.put(named.mapInArrow(shingles(share), "sh long").groupBy("sh").count()
                          .where(F.col("count") >= LEVELS[0])) for share in range(PASSES)]
    counts = reduce(DataFrame.unionByName, counted)
    levels = [build(counts.where(F.col("count") >= c), "sh") for c in LEVELS]
    tables.drop(*counted)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, h, first = once(batch)
            token, doc = prefixes(h, first, levels, num, den)
            # a document's shingles under its own size range and, if need be, the one below
            d, c = sizes.registrations(np.diff(first))
            begin = np.searchsorted(doc, d)
            count = np.searchsorted(doc, d, "right") - begin
            at = wd.ragged(begin, count)
            c = np.repeat(c, count).astype(U64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(wd.i64(wd.mix(token[at] + c * U64(0x9E3779B97F4A7C15)))),
                 pa.array(wd.i64(names[doc[at]]))], names=["sig", "name"])

    sigs = tables.put(named.mapInArrow(sign, "sig long, name long"))
    shared = tables.put(sigs.groupBy("sig").agg(
        F.min("name").alias("lead"), F.max("name").alias("last")).where("lead <> last")
        .select("sig", "lead"))
    edges = sigs.join(shared, "sig").where("name <> lead").select(
        F.col("lead").alias("u"), F.col("name").alias("v"))
    groups = components(tables, tables.put(edges.distinct()))

    member = tables.put(groups.join(classes, groups["node"] == classes["name"]).select(
        "component", "name", classes["node"].alias("node"), "copies", "size"))
    parts = [F.greatest(F.ceil(F.count_if(who) / block_docs),
                        F.ceil(F.coalesce(F.sum(F.when(who, F.col("size"))), F.lit(0)) / block_shingles))
             for who in (~F.col("visitor"), F.col("visitor"))]
    wide = member.groupBy("component").agg(F.greatest(
        F.ceil(F.count("*") / block_docs), F.ceil(F.sum("size") / block_shingles)).alias("parts"))
    wide = tables.put(wide.where("parts > 1").select("component"))
    cut = member.join(wide, "component", "left_semi").drop("component")
    calls = tables.put(homes(sigs.join(shared.select("sig"), "sig", "left_semi")
                             .join(cut.select("name"), "name", "left_semi").distinct()), sigs, shared)
    placed = tables.put(member.join(wide, "component", "left_anti").withColumn("visitor", F.lit(False))
                        .unionByName(cut.join(calls, "name").withColumnRenamed("home", "component")),
                        member, wide, calls)
    # residents are dealt into the first blocks of a home, visitors into those behind
    plan = placed.groupBy("component").agg(*[n.alias(c) for n, c in zip(parts, ("own", "guests"))]
                                           ).where("own > 0")
    n = F.when(F.col("visitor"), F.col("guests")).otherwise(F.col("own"))
    block = F.pmod(F.xxhash64("name"), n) + F.when(F.col("visitor"), F.col("own")).otherwise(F.lit(0))
    meets = F.when(F.col("visitor"), F.col("own")).otherwise(F.col("own") + F.col("guests"))
    dealt = placed.join(plan, "component").select(
        "component", "name", "node", "copies", block.alias("block"),
        F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)).alias("other"))
    dealt = tables.put(dealt.select(
        "component", "name", "node", "copies", F.least("block", "other").alias("i"),
        F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).alias("side")),
        placed)

    ids = dealt.select("name", F.col("node").alias("doc_id")).distinct()
    sets = known.join(ids, ["name", "doc_id"], "left_semi").select("name", "h").dropDuplicates(["name"])
    found = tables.put(
        dealt.join(sets, "name")
        .groupBy("component", "i", "j")
        .applyInPandas(_search(num, den), "node long, other long, links long"), dealt)
    linked = components(tables, found.select(F.col("node").alias("u"), F.col("other").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    classes_out = (classes.join(linked, "node", "left").join(links, "node", "left")
                   .select("name", F.coalesce("component", "node").alias("component"),
                           (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links")))
    out = rows.drop("h").join(classes_out, "name", "left")
    own = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    return out.select(
        "doc_id", "n_shingles",
        F.when(own, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(own, F.col("links")).otherwise(F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame, n: int, num: int, den: int, lower: bool = True,
             id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, with all their columns, without the near copies of a smaller id.

    One row of each component stays: the one with the smallest id (one of them, if the row
    is repeated).  Rows that share an id but not their text are told apart, each decided by
    its own text.  Rows without words or with a null id stay."""
    tables = Tables(docs.sparkSession, "keep-one")
    # the whole row as one value: no column name can clash
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                        F.col(f"`{id_col}`").cast("long").alias("id"),
                        F.col(f"`{text_col}`").cast("string").alias("text"))
    again = tables.put(named.where("id IS NOT NULL").groupBy("id").count().where("count > 1")
                       .select(F.col("id").alias("again")))
    if not again.limit(1).count():
        found = near_duplicates(named, n, num, den, lower, "id")
        gone = tables.put(found.where("component_id < doc_id").select(
            F.col("doc_id").alias("id")).distinct())
        return named.join(gone, "id", "left_anti").select("row.*")
    # repeated ids: rows named by id and text, so copies of one row share a name
    named = named.join(again, named["id"] == again["again"], "left").withColumn(
        "key", F.when(F.col("again").isNotNull(), F.xxhash64("id", "text")).otherwise(F.col("id")))
    found = tables.put(near_duplicates(named, n, num, den, lower, "key")
                       .where("doc_id IS NOT NULL AND n_shingles > 0")
                       .select(F.col("doc_id").alias("key"), "component_id").distinct())
    member = found.join(named.select("key", "id").distinct(), "key").select(
        "key", "component_id", F.struct("id", "key").alias("rank"))
    kept = member.groupBy("component_id").agg(F.min("rank").alias("first"))
    gone = tables.put(member.join(kept, "component_id").where("rank <> first").select("key"))
    left = named.join(gone, "key", "left_anti").join(
        found.select("key", F.lit(True).alias("worded")), "key", "left")
    copies = F.col("again").isNotNull() & F.col("worded").isNotNull()
    return left.where(~copies).select("row.*").unionByName(
        left.where(copies).dropDuplicates(["key"]).select("row.*"))
