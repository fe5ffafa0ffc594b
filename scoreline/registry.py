"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads whole base tables through the fixture views and runs one
operator (or plan) from the library; output column names equal those of the
matching statement in ``scoreline.oracle``.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.functions import odds as fo
from scoreline.operators import events, form, ledger, lines, pairing, prices, profile, rating
from scoreline.plans import backtest, board, evaluate, features, model
from scoreline.sources import fixtures as fx
from scoreline.sources import landing
from scoreline.sources import tables
from scoreline.sources.tables import load
from scoreline.streaming import late, live, odds_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def team_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.explode_sides(fx.fx_games(spark, sf_dir))


def team_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return form.team_form(team_long(spark, sf_dir)).select(*form.FORM_COLUMNS)


@register("rolling_prior_form")
def q_rolling_prior_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_form(spark, sf_dir).select(
        "game_id", "team_id", "is_home", "games_played", "roll_pts_for",
        "roll_pts_against", "roll_net_rating", "roll_win_rate")


@register("rest_and_b2b")
def q_rest_and_b2b(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_form(spark, sf_dir).select("game_id", "team_id", "rest_days", "b2b")


@register("explode_sides")
def q_explode_sides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return team_long(spark, sf_dir)


@register("pair_home_away")
def q_pair_home_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_sides(fx.fx_team_games(spark, sf_dir))


@register("unpaired_rows")
def q_unpaired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.unpaired_rows(fx.fx_team_games(spark, sf_dir))


SEASON_PARAM = 2020  # bound parameter of the season query (first season of the fixture)


@register("season_ids")
def q_season_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Game ids of one season in date order, zero-padded, by SQL text with a bound
    parameter (no row cap: ``limit_ids`` with 0 keeps all)."""
    df = landing.read_sql(
        spark, "SELECT game_id, game_date FROM {games} WHERE season = :s",
        {"games": fx.fx_games(spark, sf_dir)}, s=SEASON_PARAM)
    return limit_ids(df, 0).select(pairing.zfill_id(F.col("game_id")).alias("game_id"),
                                   "game_date")


def limit_ids(df: DataFrame, n: int, date: str = "game_date", key: str = "game_id") -> DataFrame:
    """First ``n`` ids in (date, id) order; 0 keeps all (trial-run cap)."""
    return df.orderBy(date, key).limit(n) if n else df


@register("table_profile")
def q_table_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.table_profile(fx.fx_pbp(spark, sf_dir), "pbp", "game_id").unionByName(
        profile.table_profile(fx.fx_games(spark, sf_dir), "games", "game_id", "game_date"))


@register("form_summary")
def q_form_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.describe_columns(team_form(spark, sf_dir), [
        "games_played", "roll_pts_for", "roll_pts_against", "roll_net_rating",
        "roll_win_rate", "rest_days", "b2b"])


@register("new_ids")
def q_new_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Games whose play-by-play is not landed yet (landed = games present in fx_pbp)."""
    wanted = fx.fx_games(spark, sf_dir).select(pairing.zfill_id(F.col("game_id")).alias("game_id"))
    landed = fx.fx_pbp(spark, sf_dir).select(pairing.zfill_id(F.col("game_id")).alias("game_id"))
    return pairing.new_ids(wanted, landed)


def scored_pbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.running_score(fx.fx_pbp(spark, sf_dir))


@register("running_score")
def q_running_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_pbp(spark, sf_dir).select(
        "game_id", "action_number", "home_score", "away_score", "margin", "sign")


@register("lead_changes")
def q_lead_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.lead_changes(scored_pbp(spark, sf_dir))


@register("contest_rollup")
def q_contest_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.contest_rollup(scored_pbp(spark, sf_dir))


@register("side_rollup")
def q_side_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.side_rollup(fx.fx_pbp(spark, sf_dir))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round double columns: sums of doubles differ in the last bit between engines."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c)
                       for c, t in df.dtypes])


def market_fair(spark: SparkSession, sf_dir: str) -> DataFrame:
    snaps = fx.fx_odds_snapshots(spark, sf_dir)
    return prices.devig(prices.two_way(prices.latest_lines(snaps)))


def market_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prices.consensus(market_fair(spark, sf_dir))


@register("devig_market")
def q_devig_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market_fair(spark, sf_dir))


@register("odds_columns")
def q_odds_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every snapshot priced against the market consensus of its game."""
    snaps = fx.fx_odds_snapshots(spark, sf_dir)
    cons = market_consensus(spark, sf_dir).select("game_id", "market", "p_home")
    df = snaps.join(cons, ["game_id", "market"]).withColumn("p", prices.side_prob())
    return rounded(prices.price_columns(df).select(
        "snapshot_id", "game_id", "book", "side", "american_odds", "p", "decimal_odds",
        "implied", "edge", "ev", "kelly", "stake_frac"))


@register("best_side")
def q_best_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(prices.best_side(prices.with_consensus(market_fair(spark, sf_dir)),
                                    keys=("game_id", "market")))


FAIR_PRICE_VIG = 0.045  # fixed value: margin shaded into a fair price


@register("prob_to_odds")
def q_prob_to_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    cons = market_consensus(spark, sf_dir)
    p = F.col("p_home")
    return cons.select("game_id", "market", F.round(p, 6).alias("p_home"),
                       fo.prob_to_american(p, FAIR_PRICE_VIG).alias("home_price"),
                       fo.prob_to_american(1.0 - p, FAIR_PRICE_VIG).alias("away_price"))


@register("odds_payload_flatten")
def q_odds_payload_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots -> nested JSON per (game, day) -> flat two-way book rows."""
    tips = fx.fx_tipoffs(spark, sf_dir).select(
        "game_id", F.date_format("tip_date", "yyyy-MM-dd").alias("commence_time"))
    docs = prices.build_payload(fx.fx_odds_snapshots(spark, sf_dir), tips,
                                F.to_date("captured_at"))
    return prices.flatten_payload(docs, keep=("game_id", "poll_day"))


@register("elo_by_pool")
def q_elo_by_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rating.elo_ratings(fx.fx_games(spark, sf_dir)))


@register("elo_relaxed")
def q_elo_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ratings by sweeps of windows, without Python."""
    return rounded(rating.elo_relaxed(fx.fx_games(spark, sf_dir)))


@register("elo_pools")
def q_elo_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings of three leagues (games between teams of one class), each a pool of its own."""
    games = fx.fx_games(spark, sf_dir).where("home_team_id % 3 = away_team_id % 3")
    return rounded(rating.elo_ratings(
        games.withColumn("league", F.concat(F.lit("L"), F.col("home_team_id") % 3)), pool="league"))


def games_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired games (one row per game) materialised once for plans that read them in
    several branches (form, ratings, matchups), instead of re-pairing per branch."""
    return fx.fx_games(spark, sf_dir).checkpoint()


def game_elo(spark: SparkSession, sf_dir: str, games: DataFrame | None = None) -> DataFrame:
    """Pre-game ratings (one row per game), materialised once: several branches of a
    plan read them, and the replay is a Python stage that should not run per branch."""
    g = games if games is not None else fx.fx_games(spark, sf_dir)
    return rating.elo_ratings(g).checkpoint()


def full_form(spark: SparkSession, sf_dir: str, games: DataFrame | None = None) -> DataFrame:
    g = games if games is not None else fx.fx_games(spark, sf_dir)
    return form.team_form(pairing.explode_sides(g))


class Inputs(NamedTuple):
    """Paired games, their form rows and their ratings, each materialised once: the feature frame
    and the latest form read the same tables."""

    games: DataFrame
    form: DataFrame
    elo: DataFrame


def model_inputs(spark: SparkSession, sf_dir: str) -> Inputs:
    g = games_shared(spark, sf_dir)
    rows = full_form(spark, sf_dir, g).select("game_date", *form.FORM_COLUMNS).checkpoint()
    return Inputs(g, rows, game_elo(spark, sf_dir, g))


def features_of(spark: SparkSession, sf_dir: str, inputs: Inputs | None = None) -> DataFrame:
    if inputs is not None:
        return features.feature_frame(*inputs)
    g = games_shared(spark, sf_dir)
    return features.feature_frame(g, full_form(spark, sf_dir, g), game_elo(spark, sf_dir, g))


def split_of(spark: SparkSession, sf_dir: str, inputs: Inputs | None = None) -> DataFrame:
    """The feature frame cut by position; materialised before the cut, which reads it in two branches."""
    return features.time_split(features_of(spark, sf_dir, inputs).checkpoint())


@register("feature_frame")
def q_feature_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(features_of(spark, sf_dir))


@register("latest_form")
def q_latest_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(latest_of(spark, sf_dir))


@register("time_split")
def q_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_of(spark, sf_dir).select(
        "game_id", "game_date", "pos", "split")


def scored_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, y, p): document scores, and the rating expectation on the held-out games."""
    docs = fx.fx_scores(spark, sf_dir).select(F.lit("doc_score").alias("model"), "y", "p")
    test = split_of(spark, sf_dir).filter(F.col("split") == "test")
    elo = test.select(F.lit("elo_baseline").alias("model"), F.col("home_win").alias("y"),
                      F.col("elo_exp_home").alias("p"))
    # (model, y, p) feeds the metric, AUC and quantile branches: materialise once
    return docs.unionByName(elo).checkpoint()


@register("prob_metrics")
def q_prob_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.prob_metrics(scored_long(spark, sf_dir))


@register("calibration_bins")
def q_calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.calibration_bins(scored_long(spark, sf_dir)))


@register("isotonic_calibrate")
def q_isotonic_calibrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.fx_scores(spark, sf_dir)
    return rounded(evaluate.isotonic_calibrate(s, s).select("doc_id", "y", "p", "p_cal"))


def fitted_model(spark: SparkSession, sf_dir: str, inputs: Inputs | None = None):
    """Model and split of this input (fitted by each query that needs it)."""
    split = split_of(spark, sf_dir, inputs).checkpoint()
    return model.fit(split), split


@register("model_metrics")
def q_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out metrics of the rating, the raw trees and the calibrated trees."""
    m, split = fitted_model(spark, sf_dir)
    return model.heldout_metrics(model.heldout_predictions(m, split))


@register("model_gate")
def q_model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold for the fitted model: more than one tree, and a calibrated held-out log
    loss below that of the base rate and no worse than the rating's."""
    m, split = fitted_model(spark, sf_dir)
    preds = model.heldout_predictions(m, split)
    base = split.filter("split <> 'test'").agg(F.avg("home_win").alias("p0"))
    rate = base.first()["p0"]
    loss = model.heldout_metrics(preds).groupBy().pivot(
        "model", ["elo_baseline", "gbt_calibrated"]).agg(F.first("log_loss"))
    constant = preds.agg(F.count(F.lit(1)).alias("n"), F.avg(
        -F.col("home_win") * F.log(F.lit(rate)) - (1 - F.col("home_win")) * F.log(F.lit(1 - rate)))
        .alias("c"))
    row, const = loss.first(), constant.first()
    return spark.range(1).select(
        F.lit(const["n"]).cast("bigint").alias("n_test"),
        F.lit(len(m.trees.trees) > 1).alias("more_than_one_tree"),
        F.lit(row["gbt_calibrated"] < const["c"]).alias("beats_base_rate"),
        F.lit(row["gbt_calibrated"] <= row["elo_baseline"]).alias("matches_rating"))


@register("landed_increment")
def q_landed_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resumable landing: half of the seasons, then all games, then all again (a no-op)."""
    games = fx.fx_games(spark, sf_dir)
    path = f"{odds_stream.stream_dir(spark)}/games"
    first = landing.land_new(spark, games.filter(F.col("season") % 2 == 0), path, "game_id")
    second = landing.land_new(spark, games, path, "game_id")
    third = landing.land_new(spark, games, path, "game_id")
    back = spark.read.parquet(path)
    return back.groupBy("season").agg(F.count(F.lit(1)).alias("n_games")).select(
        "season", "n_games", *[F.lit(n).cast("bigint").alias(name) for n, name in (
            (first, "first_run"), (second, "second_run"), (third, "third_run"))])


TRIAL_IDS = 25       # trial-run cap of the capped id list


@register("trial_ids")
def q_trial_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial run: the first ids in (date, id) order up to the cap."""
    return limit_ids(fx.fx_games(spark, sf_dir).select("game_id", "game_date"), TRIAL_IDS)


@register("metrics_document")
def q_metrics_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics written as a JSON document per model and read back."""
    metrics = evaluate.prob_metrics(scored_long(spark, sf_dir))
    path = f"{odds_stream.stream_dir(spark)}/metrics"
    metrics.write.json(path)
    return spark.read.schema(metrics.schema).json(path)


@register("gbt_fit_score")
def q_gbt_fit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out predictions of the calibrated trees (rows-only check; quality in tests)."""
    m, split = fitted_model(spark, sf_dir)
    return model.heldout_predictions(m, split)


@register("model_importances")
def q_model_importances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feature's importance from the model written and read back: all features, shares of
    one, and the rating the most important one."""
    m, _ = fitted_model(spark, sf_dir)
    path = f"{odds_stream.stream_dir(spark)}/model"
    model.save(m, path, spark)
    imp = model.load(spark, path).importances(spark)
    top = imp.orderBy(F.desc("importance")).first()["feature"]
    total = imp.agg(F.sum("importance")).first()[0]
    return imp.select("feature", F.lit(top.startswith("elo")).alias("rating_first"),
                      F.lit(abs(total - 1) < 0.01).alias("shares_of_one"))


@register("heldout_outcomes")
def q_heldout_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of the held-out predictions: ids, outcome, rating probability, and
    that the model's probabilities lie strictly between 0 and 1."""
    m, split = fitted_model(spark, sf_dir)
    inside = (F.col("model_prob") > 0) & (F.col("model_prob") < 1) & (F.col("raw_prob") > 0)
    return rounded(model.heldout_predictions(m, split).select(
        "game_id", "game_date", "home_team_id", "away_team_id", "home_win", "elo_prob",
        inside.alias("is_probability")))


def upcoming(spark: SparkSession, sf_dir: str, games: DataFrame | None = None) -> DataFrame:
    """Priced games with their two teams (tip-off table x games)."""
    g = games if games is not None else fx.fx_games(spark, sf_dir)
    return fx.fx_tipoffs(spark, sf_dir).join(
        g.select("game_id", "home_team_id", "away_team_id"), "game_id")


def latest_of(spark: SparkSession, sf_dir: str, games: DataFrame | None = None,
              inputs: Inputs | None = None) -> DataFrame:
    if inputs is not None:
        return features.latest_form(inputs.form, inputs.games, inputs.elo)
    g = games if games is not None else games_shared(spark, sf_dir)
    return features.latest_form(full_form(spark, sf_dir, g), g, game_elo(spark, sf_dir, g))


@register("score_matchups")
def q_score_matchups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Future matchups scored by the calibrated trees from latest form and ratings."""
    inputs = model_inputs(spark, sf_dir)
    m, _ = fitted_model(spark, sf_dir, inputs)
    x = features.matchup_features(upcoming(spark, sf_dir, inputs.games), latest_of(spark, sf_dir, inputs=inputs))
    return model.score(m, x).select("game_id", "home_team_id", "away_team_id",
                                    "elo_exp_home", "raw_prob", "model_prob")


def team_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimension: team id -> display code (teams without a code are unknown)."""
    return load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("team_id"), F.col("n_name").alias("code"))


def rating_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = games_shared(spark, sf_dir)
    scored = features.matchup_features(upcoming(spark, sf_dir, g), latest_of(spark, sf_dir, g)) \
        .select("game_id", "home_team_id", "away_team_id", F.col("elo_exp_home").alias("p_home"))
    lines = prices.two_way(prices.latest_lines(fx.fx_odds_snapshots(spark, sf_dir)))
    return board.board(scored, lines, team_lookup(spark, sf_dir))


@register("board")
def q_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(rating_board(spark, sf_dir))


@register("board_kpis")
def q_board_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(board.board_kpis(rating_board(spark, sf_dir)))


def heldout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out games with the rating probability as the model and a market that ignores
    home advantage."""
    test = split_of(spark, sf_dir).filter(F.col("split") == "test")
    return test.select("game_id", "game_date", "home_team_id", "away_team_id", "home_win",
                       F.col("elo_exp_home").alias("p_model"),
                       fo.elo_expected(F.col("elo_diff") - rating.HOME_ADV, F.lit(0.0))
                       .alias("p_market"))


@register("seeded_sample")
def q_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(board.seeded_sample(heldout(spark, sf_dir), "game_id"))


@register("heldout_board")
def q_heldout_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(board.heldout_board(heldout(spark, sf_dir), "p_model", "p_market"))


def tipoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.fx_tipoffs(spark, sf_dir).withColumn("tip_ts", F.col("tip_date").cast("timestamp_ntz"))


def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.closing_line(fx.fx_odds_snapshots(spark, sf_dir), tipoffs(spark, sf_dir))


@register("closing_line")
def q_closing_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closing(spark, sf_dir)


@register("line_movement")
def q_line_movement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(lines.line_movement(fx.fx_odds_snapshots(spark, sf_dir), tipoffs(spark, sf_dir)))


@register("line_shopping")
def q_line_shopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    current = prices.latest_lines(fx.fx_odds_snapshots(spark, sf_dir)).drop("captured_at")
    return rounded(lines.line_shopping(current))


@register("clv_records")
def q_clv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    bets = fx.fx_bets(spark, sf_dir).select("bet_id", "user_id", "game_id", "book", "market",
                                            "side", "odds_taken")
    return rounded(lines.clv_records(bets, closing(spark, sf_dir)))


@register("bet_ledger")
def q_bet_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger.ledger(fx.fx_bets(spark, sf_dir)).select(
        "bet_id", "user_id", "placed_at", "stake", "odds_taken", "won", "profit",
        "cum_profit", "cum_staked", "running_roi"))


@register("ledger_summary")
def q_ledger_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ledger.ledger_summary(fx.fx_bets(spark, sf_dir)))


@register("backtest")
def q_backtest(spark: SparkSession, sf_dir: str) -> DataFrame:
    oc = backtest.open_close(fx.fx_odds_snapshots(spark, sf_dir), tipoffs(spark, sf_dir))
    games = games_shared(spark, sf_dir)
    g = games.join(game_elo(spark, sf_dir, games), "game_id") \
        .withColumnRenamed("elo_exp_home", "p_home")
    return rounded(backtest.backtest_summary(backtest.backtest_bets(oc, g)))


@register("walk_forward")
def q_walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    games = games_shared(spark, sf_dir)
    g = games.join(game_elo(spark, sf_dir, games), "game_id").select(
        "season", "game_date", F.col("home_win").alias("y"), F.col("elo_exp_home").alias("p"))
    return backtest.walk_forward(g.checkpoint())


@register("schedule_context")
def q_schedule_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = pairing.explode_sides(fx.fx_games(spark, sf_dir), with_opponent=True)
    return rounded(form.schedule_context(long).select(
        "game_id", "team_id", "opp_id", "short_pts_for", "short_win_rate", "games_in_4_days",
        "three_in_four", "venue_pts_for", "venue_win_rate", "h2h_games", "h2h_win_rate"))


def staged_snapshots(spark: SparkSession, sf_dir: str, base: str) -> str:
    """Land the snapshot table as files for the stream, plus a re-delivered copy of the
    first day (an at-least-once feed), under the run's shared folder."""
    snaps = fx.fx_odds_snapshots(spark, sf_dir)
    first_day = snaps.agg(F.min(F.to_date("captured_at"))).first()[0]
    redelivered = snaps.filter(F.to_date("captured_at") == F.lit(first_day))
    path = f"{base}/input"
    snaps.unionByName(redelivered).write.mode("overwrite").parquet(path)
    return path


def _streamed(spark: SparkSession, sf_dir: str, build, keys) -> DataFrame:
    base = odds_stream.stream_dir(spark)
    src = odds_stream.snapshot_stream(spark, staged_snapshots(spark, sf_dir, base))
    odds_stream.run_to_log(build(src), f"{base}/log", f"{base}/checkpoint")
    return odds_stream.compact(spark, f"{base}/log", keys)


@register("odds_stream")
def q_odds_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest price per line from the deduplicated snapshot stream."""
    out = _streamed(spark, sf_dir, odds_stream.latest_prices, list(prices.LINE_KEYS))
    return out.withColumn("captured_at", F.col("captured_at").cast("timestamp_ntz"))


@register("odds_stream_closing")
def q_odds_stream_closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tips = tipoffs(spark, sf_dir)
    out = _streamed(spark, sf_dir, lambda s: odds_stream.closing_prices(s, tips),
                    list(prices.LINE_KEYS))
    return out.withColumn("closing_at", F.col("closing_at").cast("timestamp_ntz"))


@register("odds_stream_candles")
def q_odds_stream_candles(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _streamed(spark, sf_dir, odds_stream.daily_candles, ["w", *prices.LINE_KEYS])
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"),
                      *prices.LINE_KEYS, "open_odds", "close_odds", "high_odds", "low_odds",
                      "n_snapshots")


@register("elo_blocked")
def q_elo_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with the season written as text ("2020-21"), as the raw log has it."""
    games = fx.fx_games(spark, sf_dir)
    return rounded(rating.elo_ratings(games.withColumn("season", fx.season_text("season"))))


@register("game_log_clean")
def q_game_log_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.clean_game_log(fx.fx_game_log(spark, sf_dir))


@register("log_to_games")
def q_log_to_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw log -> clean -> one row per game, the codes of both teams kept."""
    clean = pairing.clean_game_log(fx.fx_game_log(spark, sf_dir))
    return pairing.pair_sides(clean, labels=("team",))


@register("pruned_events")
def q_pruned_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide play-by-play feed (columns nobody declared, one declared column absent) cut to
    the declared schema."""
    wide = (fx.fx_pbp(spark, sf_dir).drop("team_code")
            .withColumns({"raw": F.col("score_home"), "period_text": F.col("period").cast("string")}))
    return tables.prune(wide, tables.PBP, optional=("team_code",))


@register("odds_stream_close_emit")
def q_odds_stream_close_emit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing lines emitted once per line by an event-time timer at tip-off."""
    base = odds_stream.stream_dir(spark)
    src = odds_stream.snapshot_stream(spark, staged_snapshots(spark, sf_dir, base))
    odds_stream.run_append(odds_stream.closing_emitter(src, tipoffs(spark, sf_dir)),
                           f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(
        *prices.LINE_KEYS, "closing_odds", F.col("closing_at").cast("timestamp_ntz").alias("closing_at"))


@register("move_bursts")
def q_move_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.move_bursts(fx.fx_odds_snapshots(spark, sf_dir))


@register("land_game_log")
def q_land_game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Land the raw multi-season game log as one Parquet table under real season=...
    directories (replace mode, row count from the write), read it back."""
    path = f"{odds_stream.stream_dir(spark)}/raw_game_log"
    written = landing.write_table(fx.fx_game_log(spark, sf_dir), path, "replace", ["SEASON"])
    back = spark.read.schema(tables.RAW_GAME_LOG).parquet(path)
    return back.withColumn("rows_written", F.lit(written).cast("bigint"))


ARRIVALS, MAX_FILES = 30, 3      # files of a feed, and files of a micro-batch


def arriving_in_order(spark: SparkSession, sf_dir: str, base: str, files: int = 12) -> str:
    """Snapshot files landed one after the other in event-time order, the first one again at
    the end (an at-least-once feed)."""
    snaps = fx.fx_odds_snapshots(spark, sf_dir).checkpoint()
    days = [r[0] for r in snaps.select(F.to_date("captured_at").alias("d")).distinct()
            .orderBy("d").collect()]                      # calendar days
    step = -(-len(days) // files)
    parts = [days[i:i + step] for i in range(0, len(days), step)]
    path = f"{base}/input"
    for part in [*parts, parts[0]]:
        # one file, but read and filtered by all tasks
        snaps.where(F.to_date("captured_at").isin(part)).repartition(1).write.mode("append").parquet(path)
    return path


@register("odds_stream_late")
def q_odds_stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily candles of a feed whose files arrive shuffled and partly twice: late rows go to a
    side table and correct their keys; ``n_accounted`` counts streamed and late snapshots."""
    base = odds_stream.stream_dir(spark)
    snaps = fx.fx_odds_snapshots(spark, sf_dir)
    snaps.repartition(ARRIVALS, F.xxhash64("snapshot_id")).write.parquet(f"{base}/input")
    snaps.where(F.col("snapshot_id") % 10 == 0).coalesce(1).write.mode("append").parquet(f"{base}/input")
    schema = tables.ODDS_SNAPSHOTS
    late.split_late(spark, f"{base}/input", base, schema, MAX_FILES)
    stream = odds_stream.snapshot_stream(spark, late.on_time_path(base), MAX_FILES)
    odds_stream.run_to_log(odds_stream.daily_candles(stream), f"{base}/log", f"{base}/checkpoint")
    keys = ["w", *prices.LINE_KEYS]
    streamed = odds_stream.compact(spark, f"{base}/log", keys)

    def typed(df: DataFrame) -> DataFrame:
        return df.withColumn("captured_at", F.col("captured_at").cast("timestamp"))

    out = late.corrected(
        spark, base, streamed, schema, lambda df: odds_stream.daily_candles(typed(df)), keys,
        lambda df: df.withColumn("w", F.window(F.col("captured_at").cast("timestamp"),
                                               odds_stream.CANDLE_WIDTH)))
    counted = streamed.agg(F.sum("n_snapshots")).first()[0] + late.late_rows(spark, base, schema).count()
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *prices.LINE_KEYS,
                      "open_odds", "close_odds", "high_odds", "low_odds", "n_snapshots",
                      F.lit(counted).cast("bigint").alias("n_accounted"))


@register("odds_stream_live")
def q_odds_stream_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current price per line over at least ten micro-batches, with the state left after the
    last tip-off (none)."""
    base = odds_stream.stream_dir(spark)
    stream = odds_stream.snapshot_stream(spark, arriving_in_order(spark, sf_dir, base), 1)
    with live.rocksdb(spark):
        odds_stream.run_to_log(live.open_lines(stream, tipoffs(spark, sf_dir)), f"{base}/log",
                               f"{base}/checkpoint")
    left = live.state_rows(spark, f"{base}/checkpoint")
    batches = spark.read.parquet(f"{base}/log").select("_batch").distinct().count()
    out = odds_stream.compact(spark, f"{base}/log", list(prices.LINE_KEYS))
    return out.select(*prices.LINE_KEYS, "american_odds",
                      F.col("captured_at").cast("timestamp_ntz").alias("captured_at"),
                      F.lit(left).cast("bigint").alias("state_rows"),
                      F.lit(batches >= 8).alias("many_batches"))


@register("odds_stream_bursts")
def q_odds_stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of activity per line, emitted once their end has passed the watermark."""
    base = odds_stream.stream_dir(spark)
    stream = odds_stream.snapshot_stream(spark, arriving_in_order(spark, sf_dir, base), 1)
    odds_stream.run_append(odds_stream.move_bursts(stream), f"{base}/out", f"{base}/checkpoint")
    return spark.read.parquet(f"{base}/out").select(
        *prices.LINE_KEYS, F.col("s.start").cast("timestamp_ntz").alias("burst_start"),
        F.col("s.end").cast("timestamp_ntz").alias("burst_end"), "n_snapshots", "open_odds", "close_odds")


def placed_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bets with a time of their own: some hours after the snapshot that they took."""
    snaps = fx.fx_odds_snapshots(spark, sf_dir).select(
        F.col("snapshot_id").alias("bet_id"), "captured_at")
    return fx.fx_bets(spark, sf_dir).join(snaps, "bet_id").select(
        "bet_id", "game_id", "book", "market", "side", "odds_taken", (F.col("captured_at") + F.make_dt_interval(
            hours=(F.col("user_id") % 200).cast("int"))).alias("placed_ts"))


@register("market_at_bet")
def q_market_at_bet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bet with the price of its line at the moment it was placed."""
    out = lines.market_at(placed_bets(spark, sf_dir), fx.fx_odds_snapshots(spark, sf_dir), "placed_ts")
    return rounded(out.select("bet_id", "placed_ts", "odds_taken", "market_odds", "market_at", "market_prob"))


@register("market_before_game")
def q_market_before_game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Market feature per priced game: mean implied home probability over books strictly before
    its tip-off (each game at its own time), and the number of books."""
    snaps = fx.fx_odds_snapshots(spark, sf_dir).where("market = 'h2h' AND side = 'HOME'")
    asks = tipoffs(spark, sf_dir).join(snaps.select("game_id", "book").distinct(), "game_id")
    at = lines.market_at(asks.select("game_id", "book", "tip_ts"), snaps, "tip_ts", ("game_id", "book"),
                         strict=True)
    return rounded(at.groupBy("game_id").agg(F.avg("market_prob").alias("market_prob"),
                                             F.count("market_prob").alias("n_books")))


@register("rounded_outputs")
def q_rounded_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Output rounding on every snapshot: implied probability and shares to three digits, a stake
    to four, by the exact binary value with ties to even."""
    n = F.col("snapshot_id").cast("double")
    return fx.fx_odds_snapshots(spark, sf_dir).select(
        "snapshot_id",
        fo.round_half_even(fo.american_to_implied("american_odds"), 3).alias("implied"),
        fo.round_half_even(n % 2001 / 2000.0, 3).alias("share"),
        fo.round_half_even((n % 257 - 128) / 16.0, 3).alias("sixteenth"),
        fo.round_half_even(n % 20001 / 20000.0, 4).alias("stake"))


@register("landed_recovered")
def q_landed_recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landing that dies after each of its steps and is repeated: every game lands once."""
    games = fx.fx_games(spark, sf_dir).checkpoint()
    path = f"{odds_stream.stream_dir(spark)}/games"
    deaths = 0
    for run, dies_after in (("run-1", "data"), ("run-2", "keys"), ("run-3", "manifest")):
        part = games.where(F.col("season") % 3 <= int(run[-1]) - 1)

        def die(name: str, at: str = dies_after) -> None:
            if name == at:
                raise InterruptedError(name)

        try:
            landing.land_run(spark, part, path, "game_id", run, die)
        except InterruptedError:
            deaths += 1
        landing.land_run(spark, part, path, "game_id", run)
    back = landing.read_landed(spark, path, games.schema)
    return back.groupBy("season").agg(
        F.count(F.lit(1)).alias("n_games"), F.countDistinct("game_id").alias("n_ids")).withColumn(
        "deaths", F.lit(deaths))


@register("walk_forward_fit")
def q_walk_forward_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics per fold season of a model fitted on all earlier seasons (rows-only; the refit by
    brute force is a test)."""
    return backtest.walk_forward_fit(features_of(spark, sf_dir).checkpoint(), features.FEATURES)


@register("walk_forward_folds")
def q_walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that each fold's model was fitted and judged on, and whether all fits converged."""
    _, fit = backtest.fit_folds(features_of(spark, sf_dir).checkpoint(), features.FEATURES)
    return backtest.fold_sizes(fit).withColumn(
        "converged", F.lit(fit["converged"] == fit["weights"].shape[1]))


def model_boards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The live board and the held-out sample, both scored by the calibrated trees."""
    inputs = model_inputs(spark, sf_dir)
    m, split = fitted_model(spark, sf_dir, inputs)
    x = features.matchup_features(upcoming(spark, sf_dir, inputs.games), latest_of(spark, sf_dir, inputs=inputs))
    scored = model.score(m, x).select("game_id", "home_team_id", "away_team_id",
                                      F.col("model_prob").alias("p_home"))
    two_way = prices.two_way(prices.latest_lines(fx.fx_odds_snapshots(spark, sf_dir)))
    live_board = board.board(scored, two_way, team_lookup(spark, sf_dir))
    test = split.filter(F.col("split") == "test")
    preds = model.score(m, test).withColumn("p_market", fo.elo_expected(
        F.col("elo_diff") - rating.HOME_ADV, F.lit(0.0)))
    return live_board, board.heldout_board(preds, "model_prob", "p_market")


def _consistent() -> Column:
    """A board row's figures follow from its own probability and price."""
    close = (F.abs(F.col("implied") - fo.american_to_implied("odds")) < 1e-9) \
        & (F.abs(F.col("edge") - (F.col("p_model") - F.col("implied"))) < 1e-9) \
        & (F.abs(F.col("ev") - fo.expected_value("p_model", "odds")) < 1e-9)
    side = F.when(F.col("pick") == "HOME", F.col("p_home")).otherwise(1.0 - F.col("p_home"))
    return close & (F.abs(F.col("p_model") - side) < 1e-9) & F.col("p_home").between(0, 1)


@register("model_board")
def q_model_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Board scored by the calibrated trees, handed out rounded (rows-only)."""
    live_board, sample = model_boards(spark, sf_dir)
    return board.rounded_board(board.live_or_sample(live_board, sample)).select(
        "game_id", "matchup", "p_home", "source", "pick", "book", "odds", "p_model", "implied", "edge",
        "ev", "kelly_stake", "result")


@register("model_board_check")
def q_model_board_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can check of the model's boards: games, matchups and source of the live board, and
    of the sample that stands in when no game is priced; figures follow from each row's own
    probability and price."""
    live_board, sample = model_boards(spark, sf_dir)
    live_board, sample = live_board.checkpoint(), sample.checkpoint()
    shown = board.live_or_sample(live_board, sample).withColumn("case_", F.lit("priced"))
    spare = board.live_or_sample(live_board.where("false"), sample).withColumn("case_", F.lit("empty"))
    out = shown.unionByName(spare)
    return out.select("case_", "game_id", "matchup", "source", "result", _consistent().alias("consistent"))
