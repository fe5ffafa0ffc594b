"""Every operator and stage on empty tables, nulls, clashing names and long texts."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreline.llm import decontaminate, jaccard, licenses, pii, quality, toxicity, wordpiece
from scoreline.llm.queries import tokenizer_path

CLASH = ["_bad", "_gone", "_again", "_key", "_id", "_word", "_text", "_pii", "_spans", "_old", "_row",
         "row", "key", "id", "spans", "masked", "segments", "component_id", "score", "p", "host",
         "path", "name", "item", "words", "keep", "features", "predicted", "n_words", "labels"]


def tuples(df):
    """Sorted rows; floating sums may differ in their last bits."""
    return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r)
                   for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    vocab = [f"word{i}" for i in range(200)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(20, 60))) for _ in range(60)]
    out[5] = out[4] + " more"
    out[6] = "write to a.b@example.org or +49 30 1234567 " + out[6]
    out[8] = "you worthless scumbag " + out[8]
    return [(i, t, f"src{i % 2}", "en", len(t)) for i, t in enumerate(out)] + [
        (100, None, None, None, None), (101, "", "src0", "en", 0), (None, out[4], "src1", None, 3),
        (3, out[3], "src1", "en", len(out[3]))]


@pytest.fixture()
def plain(spark, texts):
    return spark.createDataFrame(
        texts, "doc_id long, text string, source string, lang string, n_chars long")


@pytest.fixture()
def clashing(plain):
    return plain.select("*", *[F.lit(f"v{i}").alias(c) for i, c in enumerate(CLASH)])


@pytest.fixture()
def bench(spark, texts):
    return spark.createDataFrame([(1, texts[7][1]), (2, None), (None, "a b c"), (3, "")],
                                 "item_id long, text string")


@pytest.fixture()
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i == 8 or i % 20 == 1)) for i in range(60)],
                                 "doc_id long, quality int, toxic int")


def stages(labels, bench):
    def good(df):
        return quality.keep_good(df, quality.train(df, labels), df["source"], df["lang"])

    return [good, lambda df: jaccard.keep_one(df, 5, 80, 100),
            lambda df: decontaminate.remove_contaminated(df, bench), pii.mask]


def test_stages_keep_clashing_columns(plain, clashing, labels, bench):
    for stage in stages(labels, bench):
        got, want = stage(clashing), stage(plain)
        assert got.columns == clashing.columns
        assert tuples(got.select(plain.columns)) == tuples(want.select(plain.columns))
        assert all(r[c] == f"v{i}" for r in got.limit(3).collect() for i, c in enumerate(CLASH))


def test_stages_decide_nulls_and_empty_texts(plain, labels, bench):
    _, unique, clean, masked = (s(plain) for s in stages(labels, bench))
    ids = {r[0] for r in unique.select("doc_id").collect()}
    assert ids >= {100, 101, None, 4} and 5 not in ids and unique.count() == plain.count() - 2
    ids = {r[0] for r in clean.select("doc_id").collect()}
    assert ids >= {100, 101, None} and 7 not in ids
    got = {r.doc_id: r for r in masked.collect()}
    assert got[100].text is None and got[101].text == ""
    assert got[6].text.startswith("write to [EMAIL] or [PHONE] ")
    sized = {r.doc_id: r for r in pii.mask(plain, size_col="n_chars").collect()}
    assert sized[6].n_chars == len(sized[6].text) and sized[100].n_chars is None


def test_empty_tables(plain, labels, bench):
    empty = plain.where("false")
    for stage in stages(labels, bench):
        assert stage(empty).collect() == [] and stage(empty).columns == plain.columns
    assert wordpiece.token_counts(empty, tokenizer_path()).collect() == []
    assert licenses.scan(empty).collect() == []
    assert quality.assess(empty, quality.train(plain, labels), F.col("source"), F.col("lang")).count() == 0
    assert toxicity.score(empty, toxicity.train(plain, labels)).collect() == []
    assert decontaminate.remove_contaminated(plain, bench.where("false")).count() == plain.count()


def test_queries_ignore_clashing_columns(plain, clashing, labels, bench):
    model = quality.train(plain, labels)
    for df in (plain, clashing):
        assert quality.assess(df, quality.train(df, labels), df["source"], df["lang"]).count() == 64
    assert tuples(quality.assess(clashing, model, clashing["source"], clashing["lang"])) == tuples(
        quality.assess(plain, model, plain["source"], plain["lang"]))
    toxic = toxicity.train(plain, labels)
    assert tuples(toxicity.score(clashing, toxic)) == tuples(toxicity.score(plain, toxic))
    assert tuples(decontaminate.overlaps(clashing, bench)) == tuples(decontaminate.overlaps(plain, bench))


def test_many_matches_and_overlaps_in_a_long_text(spark):
    import re
    text = "".join(f"ü{i}: a{i}@mail.org, +49 30 {1000000 + i}; " for i in range(3000))
    kinds = {"EMAIL": r"a\d+@mail\.org", "PHONE": r"\+49 30 \d+"}
    want = text
    for kind, pattern in kinds.items():
        want = re.sub(pattern, f"[{kind}]", want)
    rows = [(1, text), (2, "x@y.org"), (3, "+4111111111111111 tail"), (4, "q" * 5000 + " a@b.cc")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.mask(df).collect()}
    assert got[1] == want and got[2] == "[EMAIL]" and got[4] == "q" * 5000 + " [EMAIL]"
    assert "1" not in got[3] and got[3].endswith(" tail")
    spans = {r.doc_id: r.pii for r in pii.find(df).collect()}
    for s in spans[1]:
        assert re.fullmatch(kinds[s.kind.upper()], text[s.start:s.end])
    assert len(spans[1]) == 6000


def test_pipeline_on_small_tables(spark, plain, labels, bench, tmp_path):
    plain.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = plain
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == plain.columns or name == "packing"
        docs = out
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert tuples(run.select("doc_id", "start", "length", "ids_crc32")) == tuples(
        docs.select("doc_id", "start", "length", "ids_crc32"))
