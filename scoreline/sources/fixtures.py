"""Fixture views: shape the driver's base tables into the contest schemas.

Each builder reads whole base tables and derives the domain table with column
expressions; ``scoreline.oracle`` holds the same views as SQL text for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreline.operators.pairing import pair_sides
from scoreline.operators.sequence import running_sum
from scoreline.sources.tables import load

# fixed values: the fixture definitions
SEASON_ORIGIN = "2020-10-20"
GAMES_PER_DAY = 6
GAMES_PER_SEASON = 1000
N_TEAMS = 30
TOTALS_EVERY = 5     # one in so many line blocks prices the total, not the winner
TEAM_STEP = 3        # points that a team's strength class (0..9) adds to its score


def fx_team_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> team x game rows: two consecutive events are the two sides of a game."""
    ev = load(spark, sf_dir, "events")
    game_id = F.floor(F.col("event_id") / 2).cast("bigint")
    return ev.select(
        game_id.alias("game_id"),
        F.date_add(F.lit(SEASON_ORIGIN).cast("date"),
                   F.floor(game_id / GAMES_PER_DAY).cast("int")).alias("game_date"),
        (F.lit(2020) + F.floor(game_id / GAMES_PER_SEASON)).cast("int").alias("season"),
        (F.col("user_id") % N_TEAMS).cast("bigint").alias("team_id"),
        (1 - F.col("event_id") % 2).cast("int").alias("is_home"),
        (80 + F.floor(F.col("value")) % 60
         + TEAM_STEP * (F.col("user_id") % N_TEAMS % 10)).cast("bigint").alias("pts"),
    )


def fx_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired games (home and away side of distinct teams)."""
    return pair_sides(fx_team_games(spark, sf_dir))


def fx_pbp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> play-by-play: one game per user, running score text on made shots."""
    ev = load(spark, sf_dir, "events")
    et = F.col("event_type")
    x = ev.select(
        F.col("user_id").alias("game_id"),
        F.col("event_id").alias("action_number"),
        (1 + F.floor((F.dayofmonth("ts") - 1) / (6 + F.col("user_id") % 3))).cast("int")
        .alias("period"),
        F.when(et.isin("purchase", "signup"), "HOM").when(et.isin("click", "view"), "AWY")
        .otherwise("").alias("team_code"),
        F.when(et == "error", 0).otherwise(1).alias("is_field_goal"),
        F.when(et == "error", F.lit(None).cast("string"))
        .when(F.col("value") < 50, "Made").otherwise("Missed").alias("shot_result"),
        F.when(et == "error", 0).when(F.col("event_id") % 3 == 0, 3).otherwise(2)
        .alias("shot_value"),
    )
    made = F.col("shot_result") == "Made"

    def points(code: str):
        return F.when((F.col("team_code") == code) & made, F.col("shot_value")).otherwise(0)

    s = running_sum(x.withColumns({"_h": points("HOM"), "_a": points("AWY")}), ["game_id"],
                    ["action_number"], {"_hs": "_h", "_as": "_a"},
                    F.floor(F.col("action_number") / 1_000_000))
    return s.select(*x.columns, *[
        F.when(made, F.col(c).cast("string")).otherwise(F.lit("")).alias(name)
        for c, name in (("_hs", "score_home"), ("_as", "score_away"))])


def fx_odds_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events -> append-only price snapshots (game, book, market, side, odds, time)."""
    ev = load(spark, sf_dir, "events")
    eid = F.col("event_id")
    fv = F.floor(F.col("value"))
    return ev.select(
        eid.alias("snapshot_id"),
        F.col("user_id").alias("game_id"),
        F.when(eid % 4 == 0, "book_a").when(eid % 4 == 1, "book_b")
        .when(eid % 4 == 2, "book_c").otherwise("book_d").alias("book"),
        F.when(F.floor(eid / 8) % TOTALS_EVERY == 0, "totals").otherwise("h2h").alias("market"),
        F.when(F.floor(eid / 4) % 2 == 0, "HOME").otherwise("AWAY").alias("side"),
        F.when(fv % 2 == 0, (100 + fv).cast("int")).otherwise((-100 - fv).cast("int"))
        .alias("american_odds"),
        F.col("ts").alias("captured_at"),
    )


def fx_tipoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tip-off date per game: first snapshot day plus 15..24 days."""
    ev = load(spark, sf_dir, "events")
    return ev.groupBy(F.col("user_id").alias("game_id")).agg(
        F.date_add(F.min("ts").cast("date"), (15 + F.col("user_id") % 10).cast("int"))
        .alias("tip_date"))


def fx_bets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders x snapshots -> bets (user, game, book, side, price taken, stake, outcome)."""
    o = load(spark, sf_dir, "orders")
    b = fx_odds_snapshots(spark, sf_dir)
    return o.join(b, o.o_orderkey == b.snapshot_id).select(
        F.col("o_orderkey").alias("bet_id"),
        F.col("o_custkey").alias("user_id"),
        "game_id", "book", "market", "side",
        F.col("american_odds").alias("odds_taken"),
        (1 + F.floor(F.col("o_totalprice") / 10000)).cast("bigint").alias("stake"),
        F.col("o_orderdate").alias("placed_at"),
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 0)
        .alias("won"),
    )


def fx_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels x documents -> binary outcome with a weakly informative probability."""
    lab = load(spark, sf_dir, "labels")
    doc = load(spark, sf_dir, "documents").select("doc_id", "n_chars")
    z = -(F.col("n_chars").cast("double") - 1500.0) / 1500.0
    return lab.join(doc, "doc_id").select(
        "doc_id", F.col("quality").alias("y"),
        F.round(1.0 / (1.0 + F.exp(z)), 4).alias("p"))


def season_text(season: str) -> Column:
    """2020 -> "2020-21"."""
    return F.concat(F.col(season).cast("string"), F.lit("-"),
                    F.lpad(((F.col(season) + 1) % 100).cast("string"), 2, "0"))


def fx_game_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired games -> the raw team game log shape: codes from the nation table
    (``T<id>`` for teams without one), "A vs. B" for the home row and "A @ B" for the
    away row, WL missing on a tied score, season text like "2020-21"."""
    g = fx_games(spark, sf_dir)
    nat = load(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("_k"), F.col("n_name").alias("_code"))

    def code(team_col: str, alias: str) -> DataFrame:
        return nat.select(F.col("_k").alias(team_col), F.col("_code").alias(alias))

    g = (g.join(code("home_team_id", "_hc"), "home_team_id", "left")
          .join(code("away_team_id", "_ac"), "away_team_id", "left")
          .withColumn("_hc", F.coalesce("_hc", F.concat(F.lit("T"), F.col("home_team_id").cast("string"))))
          .withColumn("_ac", F.coalesce("_ac", F.concat(F.lit("T"), F.col("away_team_id").cast("string")))))

    def wl(mine: str, theirs: str):
        return F.when(F.col(mine) > F.col(theirs), "W").when(F.col(mine) < F.col(theirs), "L")

    home = F.struct(F.col("home_team_id").alias("TEAM_ID"), F.col("_hc").alias("TEAM_ABBREVIATION"),
                    F.concat_ws(" vs. ", "_hc", "_ac").alias("MATCHUP"),
                    wl("home_pts", "away_pts").alias("WL"), F.col("home_pts").alias("PTS"))
    away = F.struct(F.col("away_team_id").alias("TEAM_ID"), F.col("_ac").alias("TEAM_ABBREVIATION"),
                    F.concat_ws(" @ ", "_ac", "_hc").alias("MATCHUP"),
                    wl("away_pts", "home_pts").alias("WL"), F.col("away_pts").alias("PTS"))
    return g.select(F.col("game_id").alias("GAME_ID"),
                    F.date_format("game_date", "yyyy-MM-dd").alias("GAME_DATE"),
                    season_text("season").alias("SEASON"), F.inline(F.array(home, away)))
