"""Classifiers, decontamination, vector search, components and the pipeline."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.llm import decontaminate, neighbours, quality, tables, toxicity, words
from tests.conftest import SF_CHECK


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(11)
    words = ["river", "stone", "garden", "window", "quiet", "paper", "morning", "travel", "music"]
    rows, labels = [], []
    for i in range(400):
        w = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        toxic, bad = i % 4 == 0, i % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "idiotic", "worthless"]))
        text = " ".join(w)
        if bad:
            text = " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, f"host{i % 3}" if i % 7 else None, "en"))
        labels.append((i, 0 if bad else 1, int(toxic)))
    docs = spark.createDataFrame(rows + [(900, None, "host1", None), (None, "", None, None)],
                                 "doc_id long, text string, source string, lang string").cache()
    return docs, spark.createDataFrame(
        labels + [(5000, 1, 1), (None, 1, 1), (7, None, None)],
        "doc_id long, quality int, toxic int").cache()


def test_toxicity_learns_and_scores_every_row(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels, where=F.col("doc_id") % 2 == 0)
    got = toxicity.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.doc_id is not None and r.doc_id % 2 == 1 and r.doc_id < 900]
    assert all(r.predicted == 0 for r in held)          # toxic ones are all even: no false alarm
    seen = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in seen]) > 0.95
    assert toxicity.score(docs.where("false"), model).collect() == []


def test_toxicity_finds_held_out_rows(labelled):
    """Every third id is never learned from; a third of the toxic rows are among them."""
    docs, labels = labelled
    model = toxicity.train(docs, labels, where=F.col("doc_id") % 3 != 0)
    held = [r for r in toxicity.score(docs, model).collect()
            if r.doc_id is not None and r.doc_id % 3 == 0 and r.doc_id < 400]
    toxic = [r.predicted for r in held if r.doc_id % 4 == 0]
    clean = [r.predicted for r in held if r.doc_id % 4]
    assert len(toxic) >= 30 and np.mean(toxic) > 0.9 and np.mean(clean) < 0.05


def test_toxicity_without_labels(labelled):
    docs, labels = labelled
    model = toxicity.train(docs, labels.where("false"))
    assert {r.predicted for r in toxicity.score(docs, model).collect()} <= {0, 1}


def test_toxicity_sample_is_bounded(labelled):
    _, labels = labelled
    got = toxicity.sample_ids(labels, "toxic", 10, 20).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in got} == {1: 10, 0: 20}


def test_quality_combines_evidence_and_sites(labelled):
    docs, labels = labelled
    model = quality.train(docs, labels)
    got = quality.assess(docs, model, docs["source"], docs["lang"]).collect()
    assert len(got) == docs.count()
    scored = [r for r in got if r.doc_id is not None and r.doc_id < 900]
    assert np.mean([r.keep == (r.doc_id % 5 != 0) for r in scored]) > 0.97
    assert all(r.score is not None and 0 <= r.score <= 1 for r in got)
    kept = quality.keep_good(docs, model, docs["source"], docs["lang"])
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.keep for r in got)
    assert quality.assess(docs.where("false"), model, docs["source"], docs["lang"]).count() == 0


def test_quality_decides_alike_at_every_cap(spark):
    rng = np.random.default_rng(6)
    rows, labels = [], []
    for i in range(7000):
        good = i % 7 > 0
        up = rng.random(30) < (0.3 if good else 0.45)
        rows.append((i, " ".join("WORD" if u else "word" for u in up), "host", "en"))
        labels.append((i, int(good)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int")

    def assessed(**caps):
        model = quality.train(docs, marks, **caps)
        return {r.doc_id: r for r in quality.assess(docs, model, docs["source"], docs["lang"]).collect()}
    whole = assessed()
    for caps in ({"max_good": 1000}, {"max_good": 800, "max_bad": 800}):
        got = assessed(**caps)
        assert np.mean([got[i].keep == r.keep for i, r in whole.items()]) > 0.97
        assert abs(np.mean([got[i].p - r.p for i, r in whole.items()])) < 0.02


def test_sparse_sites_shrink_to_their_prior(spark):
    rows = [("a", "x", 0.9)] * 200 + [("a", "y", 0.1)] + [("b", "x", 0.2)] * 200 + [("c", "x", 0.1)]
    scored = spark.createDataFrame(rows, "host string, path string, p double")
    t = tables.Tables(spark, "test")
    rates = {(r.host, r.path): r for r in quality.site_rates(t, scored).collect()}
    mu = sum(r[2] for r in rows) / len(rows)
    assert abs(rates["a", "x"].mu - mu) < 1e-9
    # a host with one document moves less from the global rate than its own rate says
    assert abs(rates["c", "x"].host_rate - mu) < abs(0.1 - mu)
    assert rates["a", "x"].host_rate > mu > rates["b", "x"].host_rate
    assert rates["a", "y"].n == 1 and rates["a", "y"].path_m >= 0


def overlap(a, b, length, share):
    best = 0
    for q in range(-len(a), len(b)):
        lo, hi = max(0, -q), min(len(a), len(b) - q)
        same = [a[j] == b[j + q] for j in range(lo, hi)]
        need = min(length, len(a))
        for k in range(len(same) - need + 1):
            if need and sum(same[k:k + need]) >= share * need:
                best = max(best, need)
    return best


def test_decontamination_finds_substituted_passages(spark):
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(500)]
    items = [[rng.choice(vocab) for _ in range(rng.choice([3, 6, 9, 14, 30]))] for _ in range(20)]
    docs = []
    for i in range(120):
        w = [rng.choice(vocab) for _ in range(rng.randint(0, 80))]
        if i % 2:
            x = list(rng.choice(items))
            for _ in range(rng.choice([0, 0, 1, 2])):
                if len(x) > 13:
                    x[rng.randrange(len(x))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = x
        docs.append((i, " ".join(w)))
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)]
                                  + [(77, None), (78, ""), (None, "v1 v2")], "item_id long, text string")
    df = spark.createDataFrame(docs + [(900, None), (None, " ".join(items[-1])), docs[1]],
                               "doc_id long, text string")
    got = {(r.row, r.item_id) for r in decontaminate.overlaps(df, bench).collect()}
    want = set()
    for i, t in docs:
        for k, x in enumerate(items):
            share = 1.0 if len(x) < decontaminate.SHORTEST else decontaminate.IDENTITY
            if t and overlap(x, t.split(), decontaminate.LENGTH, share):
                want.add((i, k))
    assert got <= want
    # seeds tolerate substitutions at fixed places only: nearly all substituted passages
    assert len(got) >= 0.97 * len(want)
    exact = {(i, k) for i, t in docs for k, x in enumerate(items)
             if f" {' '.join(x)} " in f" {t} "}
    assert exact <= got
    kept = decontaminate.remove_contaminated(df, bench)
    bad = {i for i, _ in got}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(
        i for i in [*range(120), 900] if i not in bad)
    assert decontaminate.overlaps(df.where("false"), bench).collect() == []
    assert decontaminate.overlaps(df, bench.where("false")).collect() == []


def test_decontamination_ignores_case_and_edge_punctuation(spark):
    items = ["La éai éonleeau pour an éonqueê aivi ai éenaitreoiaux Straße ὀδός dans le fond noir",
             "don't stop at the third sign, turn left (by the old mill) and walk on", "forty two"]
    upper, marked = items[0].upper(), "«" + items[1].replace(" ", "… — “") + "”!"
    docs = ["vor " + upper + " NACH", "so: " + marked + " indeed", "the answer is **Forty-** TWO.",
            "the answer is forty-two", "-- ... !", "", items[0].replace(" ", " , ")]
    bench = spark.createDataFrame([*enumerate(items), (7, "?!"), (8, "")], "item_id long, text string")
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {(r.row, r.item_id): (r.n_words, r.n_equal) for r in decontaminate.overlaps(df, bench).collect()}
    n = [len(x.split()) for x in items]
    assert got == {(0, 0): (n[0], n[0]), (1, 1): (n[1], n[1]), (2, 2): (2, 2), (6, 0): (n[0], n[0])}
    kept = decontaminate.remove_contaminated(df, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]


def test_bare_answers_remove_only_equal_texts(spark):
    bench = spark.createDataFrame([(0, "Paris"), (1, "forty two"), (2, "one two three")],
                                  "item_id long, text string")
    docs = spark.createDataFrame(
        [(0, "a trip to Paris in May"), (1, "PARIS."), (2, "the number is forty two"),
         (3, "Forty two!"), (4, "count one two three"), (5, "Paris forty two"), (None, "Paris")],
        "doc_id long, text string")
    got = {(r.row, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()}
    assert got == {(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (5, 0), (5, 1)}
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [0, 2, 5, None]


def changes(n):
    """Every pattern of as many changed places as the rule allows in n words."""
    return list(combinations(range(n), n - math.ceil(decontaminate.IDENTITY * n)))


def test_masks_leave_a_place_in_every_pattern():
    assert max(decontaminate.MASKS) == decontaminate.LENGTH
    for n in range(decontaminate.SHORTEST, decontaminate.LENGTH + 1):
        places = [{p + k for k, bit in enumerate(mask) if bit == "1"}
                  for mask, _ in decontaminate.chosen(n) for p in range(n - len(mask) + 1)]
        for bad in changes(n):
            assert any(place.isdisjoint(bad) for place in places), (n, bad)


def test_decontamination_finds_every_allowed_pattern(spark):
    items = {n: [f"i{n}x{k}" for k in range(n)] for n in (8, 9, 10, 11, 12, 13, 14, 16, 20, 40)}
    rng, docs, want = random.Random(8), [], set()

    def add(n, bad):
        x = [f"c{k}" if k in bad else w for k, w in enumerate(items[n])]
        if overlap(items[n], x, decontaminate.LENGTH, decontaminate.IDENTITY):
            want.add((len(docs), n))
        docs.append((len(docs), " ".join(["before", "it", *x, "after"])))
    for n in (8, 12, 13):
        for bad in changes(n):
            add(n, bad)
            if n == 8:
                add(n, [*bad, next(k for k in range(n) if k not in bad)])     # one too many
    for n in items:
        for _ in range(20):
            add(n, rng.sample(range(n), n // 4))
        add(n, range(3, n, 4))
    bench = spark.createDataFrame([(n, " ".join(x)) for n, x in items.items()],
                                  "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {(r.row, r.item_id) for r in decontaminate.overlaps(df, bench).collect()} == want
    assert len(want) < len(docs)


def test_bare_words():
    texts = ["«Ça» va, don’t… (x-y) — 'q' _a_ 漢字。", "!?", "", "plain", "＂é＂ 😀 a."]
    raw = [t.encode() for t in texts]
    buf = np.frombuffer(b"".join(raw), dtype=np.uint8)
    w = words.BareWords(buf, np.append(0, np.cumsum([len(x) for x in raw])))
    got = [buf[a:b].tobytes().decode() for a, b in zip(w.starts, w.ends)]
    assert got == ["Ça", "va", "don’t", "x-y", "q", "a", "漢字", "plain", "é", "😀", "a"]
    assert w.counts.tolist() == [7, 0, 0, 1, 3]
    assert w.hash[0] == words.word_hash("Ça")[0]


def exact_neighbours(rows, k):
    ids = np.array([r[0] for r in rows])
    v = np.array([r[1] for r in rows], dtype=float)
    out = {}
    for i in ids[ids % 100 == 0]:
        d = np.sqrt(((v - v[ids == i][0]) ** 2).sum(1))
        out[int(i)] = [int(ids[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def run_search(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in neighbours.search(df, 10, F.col("vec_id") % 100 == 0, **kw).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: [v for _, v, _ in sorted(x)] for q, x in got.items()}


def clusters(n, dim=16, centres=40, spread=0.15, seed=4):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, dim))
    return c, [(i, (c[i % centres] + spread * rng.standard_normal(dim)).tolist()) for i in range(n)]


@pytest.mark.parametrize("options", [
    {"sample": 4000}, {"sample": 800, "leaf_rows": 32, "query_block": 16}])
def test_search_visits_few_rows_of_clusters(spark, options):
    """Routed for real: recall with less than a quarter of the rows read; one level of parts,
    and parts cut once more in tables larger than the sample."""
    _, rows = clusters(4000)
    want, stats = exact_neighbours(rows, 10), {}
    got = run_search(spark, rows, stats=stats, **options)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    recall = np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want])
    assert recall >= 0.9
    assert stats["share"] < 0.25 and stats["leaves"] >= 32 and stats["visits"] < stats["leaves"] / 4


def test_search_hot_vectors(spark):
    centres, rows = clusters(3000, centres=20, spread=0.3)
    rows = [(i, centres[0].tolist() if i % 3 == 0 else v) for i, v in rows]
    want = exact_neighbours(rows, 10)
    got = run_search(spark, rows, sample=1500)
    assert got.keys() == want.keys() and all(len(x) == 10 for x in got.values())
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9
    # ties among a thousand equal vectors go to the smaller ids
    hot = [q for q in want if q % 3 == 0]
    assert all(got[q] == want[q] for q in hot)


def test_search_repeated_ids(spark):
    """A row repeated more than k times takes one place; clashing column names pass by."""
    rng = np.random.default_rng(9)
    rows = [(0, [0.0, 0.1, 0.0])] + [(3, [0.01, 0.1, 0.0])] * 30 + [(3, [0.2, 0.1, 0.0])]
    rows += [(i, rng.standard_normal(3).tolist()) for i in range(4, 99)]
    want = exact_neighbours([rows[0], rows[1], *rows[32:]], 10)
    assert run_search(spark, rows, target=1.0) == want
    df = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in rows],
                               "vec_id long, embedding array<double>, part int, leaf int, score double")
    assert neighbours.search(df, 10, F.col("vec_id") % 100 == 0, target=1.0).count() == 10


def test_search_skips_unusable_vectors(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [1.0, nan]),
            (5, [1.0, None]), (6, [float("inf"), 1.0]), (7, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]),
            (100, [0.9, 0.0]), (1, [1.0, 0.1])]
    assert run_search(spark, rows) == {0: [100, 1], 100: [0, 1]}
    assert run_search(spark, rows[2:4]) == {}
    assert run_search(spark, []) == {}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)]
    edges += [(i, i + 1) for i in range(1000, 1100)] + [(2000, i) for i in range(2001, 2100)]
    got = dict(map(tuple, tables.components(tables.Tables(spark, "test"), spark.createDataFrame(
        edges, "u long, v long")).collect()))
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: root(x) for x in linked}


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    docs = spark.read.parquet(f"{SF_CHECK}/documents.parquet")
    t = tables.Tables(spark, "test")
    assert [n for n, _ in cp.STAGES][-1] == "packing" and len(cp.STAGES) == 5
    for name, stage in cp.STAGES:
        out = t.put(stage(spark, docs, SF_CHECK))
        if name == "packing":
            assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {
                r.doc_id for r in docs.select("doc_id").collect()}
        else:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert 0 < out.count() <= docs.count()
        docs = out
