"""Line tools, ledger, sequences, backtest and walk-forward on small inputs."""

import datetime as dt
import json
import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from scoreline.operators import ledger, lines, prices, sequence
from scoreline.plans import backtest
from scoreline.sources import fixtures as fx
from tests.conftest import SF_CHECK

SNAP = ("snapshot_id long, game_id long, book string, market string, side string, "
        "american_odds int, captured_at timestamp_ntz")


def ts(d, h=0):
    return dt.datetime(2024, 1, d, h)


def test_closing_line_is_strictly_before_tip(spark):
    rows = [(1, 1, "b", "h2h", "HOME", -110, ts(1)), (2, 1, "b", "h2h", "HOME", -120, ts(2)),
            (3, 1, "b", "h2h", "HOME", -130, ts(3))]     # at tip-off: excluded
    snaps = spark.createDataFrame(rows, SNAP)
    tips = spark.createDataFrame([(1, ts(3))], "game_id long, tip_ts timestamp_ntz")
    c = lines.closing_line(snaps, tips).first()
    assert c.closing_odds == -120 and c.closing_at == ts(2)
    m = lines.line_movement(snaps, tips).first()
    assert (m.open_odds, m.close_odds, m.n_snapshots, m.n_changes) == (-110, -120, 2, 1)


def test_line_shopping_best_and_median(spark):
    rows = [(1, "a", "h2h", "HOME", 150), (1, "b", "h2h", "HOME", 120), (1, "c", "h2h", "HOME", -110)]
    cur = spark.createDataFrame(rows, "game_id long, book string, market string, side string, "
                                      "american_odds int")
    out = {r.book: r for r in lines.line_shopping(cur).collect()}
    assert out["a"].is_best and not out["b"].is_best
    assert math.isclose(out["a"].median_decimal, 2.2) and math.isclose(out["a"].save_pct, 2.5 / 2.2 - 1)


def test_ledger_settles_and_skips_open_bets(spark):
    rows = [(1, 7, ts(1), 10, 150, 1), (2, 7, ts(2), 10, -200, 0), (3, 7, ts(3), 5, 100, None)]
    bets = spark.createDataFrame(rows, "bet_id long, user_id long, placed_at timestamp_ntz, "
                                       "stake long, odds_taken int, won int")
    out = {r.bet_id: r for r in ledger.ledger(bets).collect()}
    assert out[1].profit == 15.0 and out[2].profit == -10.0 and out[3].profit is None
    assert out[3].cum_profit == 5.0 and out[3].cum_staked == 20.0
    assert math.isclose(out[3].running_roi, 0.25)
    s = ledger.ledger_summary(bets).first()
    assert (s.n_bets, s.n_settled, s.n_won, s.staked) == (3, 2, 1, 20)
    assert math.isclose(s.hit_rate, 0.5)


def test_bucketed_sequences_equal_plain(spark):
    bets = fx.fx_bets(spark, SF_CHECK).withColumn("v", F.col("stake").cast("double"))
    day = F.to_date("placed_at")
    order = ["placed_at", "bet_id"]
    w = (Window.partitionBy("user_id").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    a = bets.withColumn("cum", F.sum("v").over(w))
    b = sequence.running_sum(bets, ["user_id"], order, {"cum": "v"}, day)
    assert sorted(a.select("bet_id", "cum").collect()) == sorted(b.select("bet_id", "cum").collect())
    snaps = fx.fx_odds_snapshots(spark, SF_CHECK)
    keys, o = list(prices.LINE_KEYS), ["captured_at", "snapshot_id"]
    d = F.to_date("captured_at")
    c = snaps.withColumn("prev", F.lag("american_odds").over(Window.partitionBy(*keys).orderBy(*o)))
    e = sequence.previous_value(snaps, keys, o, "american_odds", "prev", d)
    assert sorted(c.select("snapshot_id", "prev").collect()) == \
        sorted(e.select("snapshot_id", "prev").collect())


def test_backtest_bets_rule(spark):
    lines_ = spark.createDataFrame(
        [(1, "b", "h2h", "HOME", 150, 120), (1, "b", "h2h", "AWAY", -170, -150)],
        "game_id long, book string, market string, side string, open_odds int, close_odds int")
    games = spark.createDataFrame([(1, 0.5, 1)], "game_id long, p_home double, home_win int")
    bets = backtest.backtest_bets(lines_, games).collect()
    assert len(bets) == 1 and bets[0].side == "HOME" and bets[0].won
    assert math.isclose(bets[0].profit, bets[0].stake * 1.5)
    assert bets[0].clv > 0


def test_walk_forward_folds_are_later_seasons(spark):
    from scoreline.operators.rating import elo_ratings
    g = fx.fx_games(spark, SF_CHECK)
    s = g.join(elo_ratings(g), "game_id").select(
        "season", "game_date", F.col("home_win").alias("y"), F.col("elo_exp_home").alias("p"))
    out = backtest.walk_forward(s).collect()
    assert sorted({r.fold for r in out}) == [2021, 2022, 2023, 2024]
    assert {r.model for r in out} == {"raw", "binned"}


def test_payload_flatten_rules(spark):
    doc = {"home_team": "H", "away_team": "A", "commence_time": "2024-01-01",
           "bookmakers": [
               {"title": "one", "markets": [
                   {"key": "h2h", "outcomes": [{"name": "H", "price": -110}, {"name": "A", "price": 100},
                                               {"name": "H", "price": -120}]},
                   {"key": "spreads", "outcomes": [{"name": "A", "price": 999}]}]},
               {"title": "two", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 130}]}]},
               {"title": "three", "markets": [
                   {"key": "h2h", "outcomes": [{"name": "H", "price": 101}]},
                   {"key": "h2h", "outcomes": [{"name": "A", "price": -105}]}]}]}
    raw = spark.createDataFrame([(json.dumps(doc),)], "payload string")
    out = {r.book: r for r in prices.flatten_payload(raw).collect()}
    assert set(out) == {"one", "three"}
    assert (out["one"].home_odds, out["one"].away_odds) == (-120, 100)
    assert (out["three"].home_odds, out["three"].away_odds) == (101, -105)
    empty = {"home_team": "H", "away_team": "A", "bookmakers": [
        {"title": "x", "markets": [{"key": "h2h", "outcomes": [{"name": "A", "price": 100}]}]}]}
    assert prices.flatten_payload(spark.createDataFrame([(json.dumps(empty),)], "payload string")).count() == 0


def test_bursts_match_session_windows(spark):
    snaps = fx.fx_odds_snapshots(spark, SF_CHECK)
    mine = lines.move_bursts(snaps).select(*prices.LINE_KEYS, "burst_start", "burst_end", "n_snapshots")
    ref = snaps.groupBy(F.session_window("captured_at", "6 hours").alias("s"), *prices.LINE_KEYS) \
        .agg(F.count(F.lit(1)).alias("n_snapshots")) \
        .select(*prices.LINE_KEYS, F.col("s.start").cast("timestamp_ntz").alias("burst_start"),
                F.col("s.end").cast("timestamp_ntz").alias("burst_end"), "n_snapshots")
    assert sorted(mine.collect()) == sorted(ref.collect())
    one = lines.move_bursts(snaps, bucket=F.lit(0)).select(
        *prices.LINE_KEYS, "burst_start", "burst_end", "n_snapshots")
    assert sorted(one.collect()) == sorted(mine.collect())


def test_clv_keeps_markets_apart(spark):
    bets = spark.createDataFrame([(1, 7, 1, "b", "h2h", "HOME", 120)],
                                 "bet_id long, user_id long, game_id long, book string, "
                                 "market string, side string, odds_taken int")
    closing = spark.createDataFrame([(1, "b", "h2h", "HOME", -110), (1, "b", "totals", "HOME", 250)],
                                    "game_id long, book string, market string, side string, "
                                    "closing_odds int")
    got = lines.clv_records(bets, closing).collect()
    assert [r.closing_odds for r in got] == [-110]


def test_win_probability_prices_only_the_win_market(spark):
    from scoreline.plans import board
    scored = spark.createDataFrame([(1, 10, 20, 0.5)], "game_id long, home_team_id long, "
                                                       "away_team_id long, p_home double")
    two = spark.createDataFrame([(1, "x", "h2h", -105, -105), (1, "x", "totals", 250, -300)],
                                "game_id long, book string, market string, home_odds int, away_odds int")
    codes = spark.createDataFrame([(10, "H"), (20, "A")], "team_id long, code string")
    assert board.board(scored, two, codes).first().odds == -105
    oc = spark.createDataFrame([(1, "x", "totals", "HOME", 250, 250), (1, "x", "h2h", "HOME", 110, 100)],
                               "game_id long, book string, market string, side string, "
                               "open_odds int, close_odds int")
    games = spark.createDataFrame([(1, 0.5, 1)], "game_id long, p_home double, home_win int")
    assert [b.market for b in backtest.backtest_bets(oc, games).collect()] == ["h2h"]


def test_best_side_tie_break_order(spark):
    two = "game_id long, book string, home_odds int, away_odds int, p_home double"
    # p = 0.5 and +100 on both sides: EV 0 everywhere -> HOME wins over AWAY
    a = prices.best_side(spark.createDataFrame([(1, "x", 100, 100, 0.5)], two)).first()
    assert a.pick == "HOME" and a.book == "x"
    # equal EV at two books for HOME -> book name descending
    b = prices.best_side(spark.createDataFrame(
        [(1, "alpha", 150, -300, 0.5), (1, "zeta", 150, -300, 0.5)], two)).first()
    assert (b.pick, b.book) == ("HOME", "zeta")
    # the higher EV wins regardless of side or book
    c = prices.best_side(spark.createDataFrame(
        [(1, "alpha", -200, 180, 0.5), (1, "zeta", -150, 120, 0.5)], two)).first()
    assert (c.pick, c.book, c.odds) == ("AWAY", "alpha", 180)
    assert math.isclose(c.ev, 0.5 * 1.8 - 0.5) and math.isclose(c.kelly_stake, 0.05)
