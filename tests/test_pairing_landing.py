"""Pairing side rows, unpaired output, zero padding, incremental landing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.operators import pairing
from scoreline.plans import evaluate
from scoreline.sources import landing, tables
from scoreline.sources.scratch import Tables

TG = "game_id long, game_date date, season int, team_id long, is_home int, pts long"


def test_duplicate_sides_go_to_unpaired(spark):
    rows = [(1, None, 1, 10, 1, 100), (1, None, 1, 20, 0, 90),     # good
            (2, None, 1, 10, 1, 100), (2, None, 1, 20, 1, 90),     # two home rows
            (2, None, 1, 30, 0, 90),
            (3, None, 1, 40, 1, 100),                              # no away row
            (4, None, 1, 50, 1, 95), (4, None, 1, 50, 0, 99)]      # same team twice
    tg = spark.createDataFrame(rows, TG)
    paired = pairing.pair_sides(tg).collect()
    assert [(r.game_id, r.home_team_id, r.away_team_id, r.home_win) for r in paired] == \
        [(1, 10, 20, 1)]
    un = sorted(r.game_id for r in pairing.unpaired_rows(tg).collect())
    assert un == [2, 2, 2, 3, 4, 4]


def test_zfill_keeps_long_ids(spark):
    df = spark.createDataFrame([(22300061,), (12345678901,)], "g long")
    got = [r[0] for r in df.select(pairing.zfill_id(F.col("g"))).collect()]
    assert got == ["0022300061", "12345678901"]


def test_land_new_is_idempotent(spark, scratch):
    path = f"{scratch}/pbp"
    batch = spark.createDataFrame([(1, "a", 2020), (1, "b", 2020), (2, "c", 2021)],
                                  "game_id long, ev string, season int")
    assert landing.land_new(spark, batch, path, "game_id", ["season"]) == 3
    assert landing.land_new(spark, batch, path, "game_id", ["season"]) == 0
    more = batch.unionByName(spark.createDataFrame([(3, "d", 2021)], batch.schema))
    assert landing.land_new(spark, more, path, "game_id", ["season"]) == 1
    back = spark.read.parquet(path)
    assert back.count() == 4
    assert back.filter("season = 2021").inputFiles()
    assert landing.table_exists(spark, path)
    assert not landing.table_exists(spark, f"{scratch}/missing")


def test_read_sql_bound_parameter(spark):
    spark.createDataFrame([(1, 2020), (2, 2021)], "game_id long, season int") \
        .createOrReplaceTempView("g_param")
    got = landing.read_sql(spark, "SELECT game_id FROM g_param WHERE season = :s", s=2021)
    assert [r[0] for r in got.collect()] == [2]


def test_declared_schema_is_required(spark):
    import pytest

    bad = spark.createDataFrame([(1, "2024-01-01")], "GAME_ID long, GAME_DATE string")
    with pytest.raises(ValueError, match="missing columns"):
        pairing.clean_game_log(bad)


def test_season_directories_prune(spark, scratch):
    from scoreline.registry import fx
    path = f"{scratch}/log"
    n = landing.write_table(fx.fx_game_log(spark, "/root/testdata/sf0.01"), path, "replace", ["SEASON"])
    df = spark.read.parquet(path)
    assert df.count() == n
    one = df.filter(F.col("SEASON") == "2021-22")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(SEASON" in plan and "2021-22" in plan
    assert one.count() == df.filter(F.col("GAME_DATE").between("2021-01-01", "2099-01-01")
                                    & (F.col("SEASON") == "2021-22")).count()
    with __import__("pytest").raises(Exception):
        landing.write_table(df, path, "fail")


def test_trial_cap_takes_first_ids_in_date_order(spark):
    from scoreline.registry import limit_ids
    df = spark.createDataFrame([(5, "2024-01-02"), (3, "2024-01-01"), (9, "2024-01-01"), (1, "2024-01-03")],
                               "game_id long, game_date string")
    assert [r.game_id for r in limit_ids(df, 2).collect()] == [3, 9]
    assert limit_ids(df, 0).count() == 4


def test_profile_approximate_keys(spark):
    from scoreline.operators import profile
    df = spark.range(100000).withColumn("k", F.col("id") % 5000)
    exact = profile.table_profile(df, "t", "k").first()
    approx = profile.table_profile(df, "t", "k", exact=False).first()
    assert exact.n_keys == 5000 and abs(approx.n_keys - 5000) <= 150


def test_labels_of_both_sides(spark):
    rows = [(1, None, 1, 10, 1, 100, "AAA"), (1, None, 1, 20, 0, 90, "BBB"),
            (2, None, 1, 30, 1, 80, None), (2, None, 1, 10, 0, 80, "AAA")]
    paired = pairing.pair_sides(spark.createDataFrame(rows, TG + ", team string"), labels=("team",))
    assert sorted((r.game_id, r.home_team, r.away_team, r.home_win) for r in paired.collect()) == [
        (1, "AAA", "BBB", 1), (2, None, "AAA", 0)]


def test_prune_declared_columns(spark, scratch):
    wide = spark.createDataFrame([(1, "x", 3, "y")], "season int, extra string, game_id int, team string")
    schema = tables._schema(("game_id", tables._L), ("season", tables._I), ("period", tables._I))
    with pytest.raises(ValueError, match="period"):
        tables.prune(wide, schema)
    wide.write.parquet(f"{scratch}/wide")
    got = tables.prune(spark.read.parquet(f"{scratch}/wide"), schema, optional=("period",))
    assert got.dtypes == [("game_id", "bigint"), ("season", "int")] and got.first() == (3, 1)
    plan = got._jdf.queryExecution().toString()
    assert "ReadSchema: struct<season:int,game_id:int>" in plan


def test_run_folder_is_deleted_by_close(spark):
    run = Tables(spark, "closing")
    first = run.put(spark.range(3).toDF("x"))
    second = run.put(first.where("x > 0"), first)
    root = run.root.removeprefix("file:")
    assert second.count() == 2 and sorted(os.listdir(root)) == ["2"]
    run.close()
    assert not os.path.exists(root)


@pytest.mark.parametrize("n_bins", [2, 4, 10])
def test_quantile_edges_equal_linear_interpolation(spark, n_bins):
    rng = np.random.default_rng(4)
    some = {"many": rng.random(997), "ties": rng.integers(0, 5, 300) / 4.0, "one": np.array([0.25]),
            "two": np.array([0.1, 0.7])}
    rows = [(m, int(rng.random() < 0.5), float(p)) for m, ps in some.items() for p in ps]
    counts = evaluate.score_counts(spark.createDataFrame(rows, "model string, y int, p double"), "model")
    got = evaluate.quantile_edges(counts, n_bins=n_bins).collect()
    assert len(got) == len(some) * (n_bins - 1)
    for m, ps in some.items():
        edges = sorted(r.edge for r in got if r.model == m)
        want = np.quantile(ps, [i / n_bins for i in range(1, n_bins)])
        assert np.allclose(edges, want, rtol=0, atol=1e-12)
