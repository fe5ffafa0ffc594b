"""Ranked lexical search, collocations and exact top-k search against brute force."""

import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import collocations, lexical, pivots

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_rank(docs, items, k):
    """[(item, rank, doc, score)]"""
    tf = [(d, Counter(TERM.findall(t.translate(LOW)))) for d, t in docs if t is not None]
    tf = [(d, c) for d, c in tf if c]
    n, total = len(tf), sum(sum(c.values()) for _, c in tf)
    df = Counter(w for _, c in tf for w in c)
    wanted = defaultdict(set)
    for item, text in items:
        if item is not None and text is not None:
            wanted[item] |= set(TERM.findall(text.translate(LOW)))
    out = []
    for item, terms in wanted.items():
        scored = []
        for d, c in tf:
            m = 100 - 90 + (90 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1)))
                    * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m)) for w in terms if w in c)
            if s > 0 and d is not None:
                scored.append((-s, d))
        out += [(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.fixture(scope="module")
def items(corpus):
    texts = [t for _, t in corpus if t and len(t.split()) > 15]
    out = [(i, " ".join(texts[i].split()[3:20]).upper()) for i in range(12)]
    return out + [(20, ""), (21, None), (22, "nowhereatall"), (23, "the of and"), (None, "the w1"),
                  (24, "w1 w2"), (24, "w3"), (25, "über à " * 40)]


@pytest.mark.parametrize("block_items,first", [(256, 32), (4, 1)])
def test_rank_equals_brute_force(spark, documents, corpus, items, block_items, first):
    bench = spark.createDataFrame([(i, t, "x", 1.0) for i, t in items],
                                  "item_id long, text string, doc_id string, score double")
    data = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = rows(lexical.rank(documents, bench, 10, block_items=block_items, first=first),
               "item_id", "rank", "doc_id", "score")
    assert got == brute_rank(data, items, 10)


def test_bounds_are_never_below_the_score():
    """Any term frequencies and lengths, far fuller signatures than in use."""
    rng = np.random.default_rng(1)
    term = rng.integers(1, 2**63, 300, dtype=np.uint64)
    signer, tfs, lens = lexical.Signer(), [], []
    levels = np.array(lexical.LEVELS)
    for i in range(40):
        tf = np.where(rng.random(300) < 0.3, rng.integers(1, 200, 300), 0)
        held = np.flatnonzero(tf)
        entries = np.searchsorted(levels, tf[held], side="right")
        level = np.concatenate([np.arange(e) for e in entries])
        assert signer.add(i, int(tf.sum()), np.repeat(term[held], entries), level) is None
        tfs.append(tf)
        lens.append(tf.sum())
    weights = rng.integers(0, 9000, 300).astype(float)
    asked = lexical.Asked(np.arange(5), term, weights,
                          [np.sort(rng.permutation(300)[:60]) for _ in range(5)], 40, int(sum(lens)))
    seen = 0
    for _, width, _, ids, n, sig in signer.rest():
        ids, n = np.frombuffer(ids, np.int64), np.frombuffer(n, np.int64)
        bound = asked.bounds(width, n, sig)
        m = lexical.damping(n, asked.docs, asked.terms)
        for item, own in enumerate(asked.own):
            for j, d in enumerate(ids):
                tf = tfs[d][own]
                score = int((weights[own].astype(np.int64) * np.where(
                    tf > 0, lexical.gain(np.maximum(tf, 1), m[j]), 0)).sum())
                assert score <= bound[item, j] <= 1.6 * score + 40000000
                seen += 1
    assert seen == 200


def test_rank_long_text_ties_and_empty(spark):
    long = "needle " + " ".join(f"t{i}" for i in range(60000)) + " needle " * 50
    docs = [(i, "needle in hay") for i in range(30, 0, -1)] + [(100, long), (101, "hay hay")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Needle t5"), (8, "hay")], "item_id long, text string")
    got = rows(lexical.rank(frame, bench, 10), "item_id", "rank", "doc_id", "score")
    assert got == brute_rank(docs, [(7, "Needle t5"), (8, "hay")], 10)
    assert [r[2] for r in got if r[0] == 7][:1] == [100]
    for a, b in ((frame.limit(0), bench), (frame, bench.limit(0)),
                 (frame.withColumn("text", F.lit(None).cast("string")), bench)):
        out = lexical.rank(a, b, 10)
        assert out.collect() == [] and out.columns == ["item_id", "rank", "doc_id", "score"]


# ---------------------------------------------------------------------------- collocations

def brute_mine(docs, least, cover, top):
    f = defaultdict(Counter)
    n = Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i:i + size])] += 1
    out = []
    for lang, c in f.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        dropped = set()
        for p, a in cand.items():
            if len(p) == 3:
                dropped |= {q for q in (p[:2], p[1:]) if 100 * a >= cover * cand[q]}
        best = []
        for p, a in cand.items():
            if p in dropped:
                continue
            s, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            best.append((-s, -a, " ".join(p).encode(), p, c[p[:k]], c[p[k:]]))
        for i, (s, a, _, p, left, right) in enumerate(sorted(best)[:top]):
            out.append((lang, i + 1, " ".join(p), -a, left, right, n[lang], -s))
    return sorted(out)


COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_mine_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = ["The", "of", "à", "Über", "new", "york", "city", "x\x00y", "z z"] + list("abcdefg")
    docs = []
    for i in range(300):
        words = []
        while len(words) < rng.randint(0, 60):
            words += rng.choice([["new", "york"], ["New", "York", "city"], ["a\tb"], ["of the."],
                                 [rng.choice(vocab)], [rng.choice(vocab)], ["a", "a", "a"],
                                 [rng.choice(",;:!?\n\r\x0b\x0c")]])
        docs.append((rng.choice(["en", "en", "de", None, "", "a b"]), " ".join(words)))
    docs += [("en", None), ("en", ""), ("fr", "only once here"), docs[0], docs[0]]
    docs.append(("de", "new york " * 8000))
    frame = spark.createDataFrame([(a, b, 1, 2) for a, b in docs],
                                  "lang string, text string, f int, w1 int").repartition(5)
    for least, cover, top in ((10, 50, 2000), (2, 80, 7)):
        got = rows(collocations.mine(frame, least, cover, top), *COLS)
        assert got == brute_mine(docs, least, cover, top)
    for empty in (frame.limit(0), frame.where("lang = 'fr'")):
        out = collocations.mine(empty)
        assert out.collect() == [] and out.columns == COLS


def test_scores_beyond_64_bits(spark):
    big = 10 ** 12
    row = spark.createDataFrame([(big, big + 7, big + 9)], "a long, l long, r long").select(
        collocations._score("a", "l", "r").alias("s")).first()
    assert row["s"] == 1000000 * big * big // ((big + 7) * (big + 9))


# ---------------------------------------------------------------------------- exact top-k

def brute_top(vectors, k, asks):
    ints = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in vectors]
    out = []
    for i, q in ints:
        if asks(i):
            best = sorted((-sum(a * b for a, b in zip(q, v)), j) for j, v in ints if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best[:k])]
    return sorted(out)


def check_top(spark, vectors, k=5, step=5, **options):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in vectors],
                                  "vec_id long, embedding array<double>, pivot int, v string")
    return rows(pivots.search(frame, k, F.col("vec_id") % step == 0, **options),
                "query_id", "rank", "vec_id", "score")


@pytest.mark.parametrize("options", [{}, {"first_rows": 20, "query_block": 40}])
def test_top_equals_brute_force(spark, options):
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 8)) * 4
    x = np.concatenate([centre[rng.integers(0, 12, 600)] + rng.standard_normal((600, 8)) * 0.1,
                        rng.standard_normal((150, 8)) * 30, np.zeros((3, 8)),
                        np.repeat(rng.standard_normal((1, 8)), 40, axis=0)])
    vectors = [(int(i), v.tolist()) for i, v in zip(rng.permutation(5000), x)]
    stats = {}
    assert check_top(spark, vectors, stats=stats, **options) == brute_top(
        vectors, 5, lambda i: i % 5 == 0)
    assert stats["passes"] >= 1


def test_top_rings_left_unread_on_clusters():
    """Close clusters: the bounds leave most rings unread."""
    rng = np.random.default_rng(4)
    centre = rng.standard_normal((20, 16)) * 2000
    x = np.rint(centre[np.arange(4000) % 20] + rng.standard_normal((4000, 16)) * 3)
    top = float((x * x).sum(1).max())
    pivot = pivots.choose_pivots(x[:1000], top)
    far = pivots.distances(pivots.lift(x, top), pivot)
    own, dist = far.argmin(1), far.min(1)
    keys = sorted(set(own.tolist()))
    lo, hi = (np.array([f(dist[own == p]) for p in keys]) for f in (np.min, np.max))
    q = np.column_stack([x[:50], np.zeros(50)])
    bound = pivots.lower_bounds(pivots.distances(q, pivot), np.array(keys), lo, hi)
    true = np.sqrt(np.maximum((x[:50] ** 2).sum(1)[:, None] + top - 2 * x[:50] @ x.T, 0))
    for j, p in enumerate(keys):
        assert (true[:, own == p] >= bound[:, [j]] * (1 - 1e-9) - 1e-3).all()
    reach = np.partition(true, 5, axis=1)[:, 5]
    assert (bound <= reach[:, None]).mean() < 0.6


def test_top_odd_rows(spark):
    good = [(5, [1.0, 2.0]), (10, [0.5, -1.0]), (11, [0.0, 0.0]), (12, [3.0, 1.0])]
    odd = [(15, None), (20, [1.0, None]), (25, [float("nan"), 1.0]), (30, [float("inf"), 1.0]),
           (35, [1.0]), (40, []), (None, [9.0, 9.0])]
    assert check_top(spark, good + odd) == brute_top(good, 5, lambda i: i % 5 == 0)
    # a repeated id counts once, with its smallest vector
    again = good + [(5, [1.0, 2.0])] * 30 + [(12, [2.0, 9.0]), (12, [4.0, 0.0])]
    want = brute_top([(5, [1.0, 2.0]), (10, [0.5, -1.0]), (11, [0.0, 0.0]), (12, [2.0, 9.0])],
                     5, lambda i: i % 5 == 0)
    assert check_top(spark, again) == want
    assert check_top(spark, good, step=1000) == []
    assert check_top(spark, []) == []
    assert check_top(spark, odd[:2]) == []
    wide = [(5 * i, [float(x) for x in v]) for i, v in enumerate(
        itertools.product([1e6, -3e5, 12345.678], repeat=3))]
    assert check_top(spark, wide) == brute_top(wide, 5, lambda i: True)
