import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from scoreline.llm import recompression as rc
from scoreline.llm import words as wd


def brute(rows, size):
    w = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(w):
        for k in range(len(w[i]) - size + 1):
            first.setdefault(tuple(w[i][k:k + size]), i)
    out = {}
    for i, x in w.items():
        gone = [False] * len(x)
        for k in range(len(x) - size + 1):
            if first[tuple(x[k:k + size])] < i:
                gone[k:k + size] = [True] * size
        kept = " ".join(a for a, g in zip(x, gone) if not g)
        out[i] = (len(x), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("size, rounds", [(13, 3), (5, 1), (20, 4)])
def test_equals_brute_force(spark, corpus, size, rounds):
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in rc.remove_repeats(df, size, rounds).collect()}
    assert got == brute(corpus, size)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("aab"), max_size=40), min_size=1, max_size=5),
       st.integers(2, 15), st.integers(0, 4))
def test_equal_windows_have_equal_keys(texts, size, rounds):
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(t) for t in texts])], names=["text"])
    (_, buf, offs), = wd.blocks(batch)
    key, whole, _, _ = rc.window_keys(wd.Words(buf, offs), size, rounds)
    seen = {}
    for k, w in zip(key.tolist(), whole.tolist()):
        assert seen.setdefault(w, k) == k


def test_null_ids_repeats_and_empty_table(spark, documents, corpus):
    got = rc.remove_repeats(documents).collect()
    want = brute(corpus, 13)
    assert len(got) == len(corpus) + 2
    for r in got:
        if r.doc_id is not None:
            assert tuple(r[1:]) == want[r.doc_id]
        else:
            assert r.n_removed == 0
    assert rc.remove_repeats(documents.where("false")).collect() == []


def test_runs_and_pairs_shrink_a_text():
    batch = pa.RecordBatch.from_arrays([pa.array(["a a a b c d e f g h " * 20])], names=["text"])
    (_, buf, offs), = wd.blocks(batch)
    sizes = [len(s) for s in rc.levels(wd.Words(buf, offs), 3)]
    assert sizes[0] == 160 and sizes == sorted(sizes, reverse=True) and sizes[-1] < sizes[0]
    assert np.unique(rc.levels(wd.Words(buf, offs), 3)[-1].name).size < 40


def test_repeated_ids_are_judged_by_their_own_text(spark):
    def words(a, n):
        return " ".join(f"w{a + i}" for i in range(n))

    long = words(0, 200)
    rows = [(1, long), (5, long + " tail"), (5, "short text only"), (5, "short text only"),
            (2, words(1000, 100)), (9, words(1000, 40) + " x " + words(50, 30)), (9, long)]
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in rows],
                               "doc_id long, text string, row int, key string")
    got = sorted(tuple(r) for r in rc.remove_repeats(df).collect())

    def result(i, t, gone):
        w = t.split()
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        return i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()

    want = [result(1, long, ()), result(5, long + " tail", range(200)),
            result(5, "short text only", ()), result(5, "short text only", ()),
            result(2, words(1000, 100), ()),
            result(9, rows[5][1], {*range(40), *range(41, 71)}), result(9, long, range(200))]
    assert got == sorted(want)


def test_a_very_long_text(spark):
    body = " ".join(f"w{i % 7919}" for i in range(120000))
    rows = [(1, body), (2, "head " + body[:400000]), (3, "a " * 100000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r[0]: tuple(r[1:]) for r in rc.remove_repeats(df).collect()}
    assert got == brute(rows, 13)
