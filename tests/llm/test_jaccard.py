import random
import re
from itertools import combinations

import numpy as np
import pytest

from scoreline.llm import jaccard


def sets(rows, n, lower):
    out = {}
    for i, t in rows:
        t = t or ""
        if lower:
            t = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        out[i] = (frozenset(tuple(w[k:k + n]) for k in range(len(w) - n + 1)) if len(w) >= n
                  else frozenset([tuple(w)] if w else []))
    return out


def brute(rows, n, num, den, lower):
    s = sets(rows, n, lower)
    up = {i: i for i in s}
    links = dict.fromkeys(s, 0)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in combinations(sorted(s), 2):
        both = len(s[a] & s[b])
        if s[a] and s[b] and den * both >= num * (len(s[a]) + len(s[b]) - both):
            links[a] += 1
            links[b] += 1
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s[i]), root(i), links[i]) for i in s}


@pytest.mark.parametrize("n, num, den, block", [(3, 90, 100, 1024), (5, 80, 100, 2), (2, 60, 100, 3)])
def test_equals_brute_force(spark, corpus, n, num, den, block):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in jaccard.near_duplicates(
        df, n, num, den, lower=True, block_docs=block).collect()}
    assert got == brute(corpus, n, num, den, True)


def test_chains_of_shared_passages(spark, block=6):
    """Texts that hang together by common passages, near copies in between, far ends foreign."""
    rng = random.Random(5)
    passages = [[f"p{i}w{k}" for k in range(8)] for i in range(12)]
    rows = []
    for i in range(36):
        words = passages[i % 12] + passages[(i + 1) % 12] + [f"d{i // 3}x{k}" for k in range(6)]
        if i % 3:
            words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows += [(100 + i, rows[7][1] + f" tail{i}") for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in jaccard.near_duplicates(
        df, 3, 60, 100, lower=True, block_docs=block).collect()}
    assert got == brute(rows, 3, 60, 100, True)


def test_homes_let_every_pair_meet_once(spark):
    rng = random.Random(8)
    lists = {(s, rng.randrange(40)) for s in range(25) for _ in range(rng.randint(2, 12))}
    got = jaccard.homes(spark.createDataFrame(sorted(lists), "sig long, name long")).collect()
    home = {r.name: r.home for r in got if not r.visitor}
    visits = {(r.name, r.home) for r in got if r.visitor}
    assert sorted(home) == sorted({n for _, n in lists}) and len(got) == len(home) + len(visits)
    assert all((home[n], n) in lists for n in home)
    for a, b in combinations(sorted(home), 2):
        met = (home[a] == home[b]) + ((a, home[b]) in visits) + ((b, home[a]) in visits)
        assert met <= 1
        if any((s, a) in lists and (s, b) in lists for s in range(25)):
            assert met == 1


def test_null_ids_repeats_and_clashing_columns(spark, documents, corpus):
    got = jaccard.near_duplicates(documents, 3, 90, 100).collect()
    assert len(got) == len(corpus) + 2
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    first = corpus[0][0]
    assert len({tuple(r) for r in got if r.doc_id == first}) == 1
    empty = [r for r in got if r.n_shingles == 0]
    assert len(empty) == 4 and all(r.component_id == r.doc_id and r.n_links == 0 for r in empty)
    assert jaccard.near_duplicates(documents.where("false"), 3, 90, 100).collect() == []


def test_keep_one_keeps_one_row_per_group(spark, documents, corpus):
    want = {i for i, v in brute(corpus, 5, 80, 100, True).items() if v[1] == i}
    got = jaccard.keep_one(documents, 5, 80, 100)
    assert got.columns == documents.columns
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_keep_one_tells_rows_of_one_id_apart(spark):
    text = {c: " ".join(f"{c}{k}" for k in range(20)) for c in "abcd"}
    near = text["a"].replace("a19", "other")
    rows = [(3, text["a"]), (5, near), (5, text["b"]), (5, ""), (5, ""), (5, text["b"]),
            (7, text["c"]), (8, text["c"]), (9, text["d"]), (9, text["b"]), (None, text["b"])]
    for use in (rows, rows[::-1]):
        df = spark.createDataFrame(use, "doc_id long, text string")
        got = sorted(((r.doc_id or 0), r.text) for r in jaccard.keep_one(df, 5, 80, 100).collect())
        assert got == sorted([(0, text["b"]), (3, text["a"]), (5, text["b"]), (5, ""), (5, ""),
                              (7, text["c"]), (9, text["d"])])


def test_divide_skip_counts_like_merging():
    rng = np.random.default_rng(0)
    base = rng.choice(10_000, 300, replace=False)
    group = []
    for _ in range(60):
        s = base.copy()
        s[rng.choice(300, rng.integers(0, 30), replace=False)] = rng.integers(10_000, 99_999)
        group.append(np.unique(s))
    found = jaccard.Group(group, 90, 100)
    for r in range(60):
        want = [s for s in range(60) if s != r and 100 * len(np.intersect1d(group[r], group[s]))
                >= 90 * len(np.union1d(group[r], group[s]))]
        assert found.links(r, np.ones(60, dtype=bool)).tolist() == want
    cand = np.arange(10)
    tokens = found.tokens[0]
    assert (found._probe(tokens, cand) == found._merge(tokens, 60)[cand]).all()
