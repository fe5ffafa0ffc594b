"""Ratings: parallel chunks against a sequential replay, types of ids and seasons, pools."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scoreline.operators import rating
from scoreline.sources import fixtures as fx
from tests.conftest import SF_CHECK


def replay(rows):
    """Plain sequential walk: (id, date, season, home, away, win) -> id: both pre-game ratings."""
    dev, season, out = {}, None, {}
    for gid, _, s, h, a, win in sorted(rows, key=lambda r: (r[1], r[0])):
        if s != season:
            dev, season = {t: 0.75 * v for t, v in dev.items()}, s
        x, y = dev.get(h, 0.0), dev.get(a, 0.0)
        expect = 1 / (1 + 10 ** ((y - x - 60) / 400))
        out[gid] = (1500 + x, 1500 + y, expect)
        dev[h], dev[a] = x + 20 * (win - expect), y - 20 * (win - expect)
    return out


def rows_of(games):
    return [tuple(r) for r in games.select("game_id", "game_date", "season", "home_team_id",
                                           "away_team_id", "home_win").collect()]


@pytest.mark.parametrize("chunk_games", [rating.CHUNK_GAMES, 300])
def test_chunks_equal_replay(spark, chunk_games):
    games = fx.fx_games(spark, SF_CHECK)
    want = replay(rows_of(games))
    got = rating.elo_ratings(games, chunk_games=chunk_games).collect()
    assert len(got) == len(want)
    for r in got:
        h, a, e = want[r.game_id]
        assert math.isclose(r.home_elo, h, abs_tol=1e-7) and math.isclose(r.away_elo, a, abs_tol=1e-7)
        assert math.isclose(r.elo_exp_home, e, abs_tol=1e-9)
        assert math.isclose(r.elo_diff, h + 60 - a, abs_tol=1e-7)


def test_text_ids_and_seasons(spark):
    games = fx.fx_games(spark, SF_CHECK).filter(F.col("season") <= 2021)
    text = games.withColumns({
        "season": fx.season_text("season"), "game_id": F.lpad(F.col("game_id").cast("string"), 10, "0"),
        "home_team_id": F.concat(F.lit("T"), F.col("home_team_id").cast("string")),
        "away_team_id": F.concat(F.lit("T"), F.col("away_team_id").cast("string"))})
    a = {r.game_id: r.home_elo for r in rating.elo_ratings(games).collect()}
    b = {int(r.game_id): r.home_elo for r in rating.elo_ratings(text).collect()}
    assert a == b


def test_teams_that_play_twice_a_day(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        h, a = rng.choice(6, 2, replace=False).tolist()
        rows.append((i, f"2024-{1 + i // 60:02d}-{1 + i // 10 % 6:02d}", 2024 + i // 150, h, a,
                     int(rng.integers(0, 2))))
    games = spark.createDataFrame(rows, "game_id long, game_date string, season int, home_team_id "
                                        "long, away_team_id long, home_win int").withColumn(
        "game_date", F.to_date("game_date"))
    want = replay(rows_of(games))
    for r in rating.elo_ratings(games, chunk_games=25).collect():
        assert math.isclose(r.home_elo, want[r.game_id][0], abs_tol=1e-7)


@pytest.mark.parametrize("regress", [0.75, 0.4])
def test_sweeps_equal_replay(spark, regress):
    """The Python-free form: same ratings, and no Python node in its plan."""
    games = fx.fx_games(spark, SF_CHECK).where("season <= 2022")
    stats = {}
    out = rating.elo_relaxed(games, regress=regress, stats=stats)
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan
    want = {r.game_id: r for r in rating.elo_ratings(games, regress=regress).collect()}
    got = out.collect()
    assert len(got) == len(want) and stats["sweeps"] < 40
    for r in got:
        for c in ("home_elo", "away_elo", "elo_diff"):
            assert math.isclose(r[c], want[r.game_id][c], abs_tol=1e-6)
        assert math.isclose(r.elo_exp_home, want[r.game_id].elo_exp_home, abs_tol=1e-8)


@pytest.mark.parametrize("chunk_games", [rating.FOLD_GAMES, 700])
def test_folds_over_chunks_equal_replay(spark, chunk_games):
    """Rounds of the Python-free form follow the chunks, not the length of the history."""
    games = fx.fx_games(spark, SF_CHECK)
    want, stats = replay(rows_of(games)), {}
    got = rating.elo_relaxed(games, chunk_games=chunk_games, stats=stats).collect()
    assert len(got) == len(want) and stats["sweeps"] <= -(-len(want) // chunk_games)
    for r in got:
        h, a, e = want[r.game_id]
        assert math.isclose(r.home_elo, h, abs_tol=1e-6) and math.isclose(r.away_elo, a, abs_tol=1e-6)
        assert math.isclose(r.elo_exp_home, e, abs_tol=1e-8)


def test_only_moved_chunks_are_played_again(spark):
    games = fx.fx_games(spark, SF_CHECK)
    one, many = {}, {}
    rating.elo_ratings(games, stats=one)
    rating.elo_ratings(games, chunk_games=600, stats=many)
    assert one == {"rounds": 0, "chunks_played": 0}       # a history that fits a chunk
    chunks = -(-games.count() // 600)
    assert many["rounds"] <= chunks and many["chunks_played"] < many["rounds"] * chunks


def test_dates_beyond_python(spark):
    """A long calendar (6 games a day, 18 million games) passes the year 9999."""
    games = fx.fx_games(spark, SF_CHECK).where("season <= 2021")
    late = games.withColumn("game_date", F.date_add("game_date", 3_000_000))
    want = {r.game_id: r.home_elo for r in rating.elo_ratings(games).collect()}
    for form in (rating.elo_ratings, rating.elo_relaxed):
        got = {r.game_id: r.home_elo for r in form(late).collect()}
        assert got.keys() == want.keys()
        assert all(math.isclose(got[i], want[i], abs_tol=1e-6) for i in want)


def test_independent_pools(spark):
    games = fx.fx_games(spark, SF_CHECK).filter(F.col("season") == 2020)
    two = games.withColumn("league", F.lit("a")).unionByName(
        games.withColumn("league", F.lit("b")).withColumn("game_id", F.col("game_id") + 100000))
    one = {r.game_id: r.elo_exp_home for r in rating.elo_ratings(games).collect()}
    got = {r.game_id: r.elo_exp_home for r in rating.elo_ratings(two, pool="league").collect()}
    assert len(got) == 2 * len(one)
    for g, v in one.items():
        assert got[g] == v and got[g + 100000] == v


def test_no_games(spark):
    none = fx.fx_games(spark, SF_CHECK).where("false")
    assert rating.elo_ratings(none).collect() == []
    assert rating.elo_relaxed(none).collect() == []
