"""Pair the two side rows of a contest, split a contest back into sides, anti-join landing.

``pair_sides`` is a single aggregation on the contest key (partial aggregation
map-side, one shuffle of partial rows) instead of a self-join: a self-join would
multiply a contest that has two home rows, the aggregate counts them and routes
the contest to ``unpaired_rows`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.sources.tables import RAW_GAME_LOG, TEAM_GAMES, require


def _side_counts(team_games: DataFrame, game: str, side: str, team: str) -> DataFrame:
    return team_games.groupBy(game).agg(
        F.count_if(F.col(side) == 1).alias("_n_home"),
        F.count_if(F.col(side) == 0).alias("_n_away"),
        F.min(team).alias("_team_lo"),
        F.max(team).alias("_team_hi"),
    )


def _is_valid_pair() -> Column:
    return ((F.col("_n_home") == 1) & (F.col("_n_away") == 1)
            & (F.col("_team_lo") != F.col("_team_hi")))


def pair_sides(team_games: DataFrame, game: str = "game_id", side: str = "is_home",
               team: str = "team_id", score: str = "pts",
               carry: tuple[str, ...] = ("game_date", "season"),
               labels: tuple[str, ...] = ()) -> DataFrame:
    """team x game rows -> one row per game with home_* and away_* columns.

    Kept: games with exactly one home row and one away row of two different teams.
    ``home_win`` = home score > away score (0 on a tie, as a strict comparison).
    ``carry`` columns are taken from the home row, ``labels`` (such as the team's code) from
    both rows.
    """
    if (game, side, team, score) == ("game_id", "is_home", "team_id", "pts"):
        require(team_games, TEAM_GAMES)
    home = F.struct(*[F.col(c) for c in (team, score, *labels, *carry)])
    away = F.struct(*[F.col(c) for c in (team, score, *labels)])
    paired = team_games.groupBy(game).agg(
        F.count_if(F.col(side) == 1).alias("_n_home"),
        F.count_if(F.col(side) == 0).alias("_n_away"),
        F.min(team).alias("_team_lo"),
        F.max(team).alias("_team_hi"),
        F.max(F.when(F.col(side) == 1, home)).alias("_h"),
        F.max(F.when(F.col(side) == 0, away)).alias("_a"),
    ).filter(_is_valid_pair())
    return paired.select(
        F.col(game),
        *[F.col(f"_h.{c}").alias(c) for c in carry],
        F.col(f"_h.{team}").alias(f"home_{team}"),
        F.col(f"_h.{score}").alias(f"home_{score}"),
        F.col(f"_a.{team}").alias(f"away_{team}"),
        F.col(f"_a.{score}").alias(f"away_{score}"),
        (F.col(f"_h.{score}") > F.col(f"_a.{score}")).cast("int").alias("home_win"),
        *[F.col(f"{row}.{c}").alias(f"{side_name}_{c}")
          for c in labels for row, side_name in (("_h", "home"), ("_a", "away"))],
    )


def unpaired_rows(team_games: DataFrame, game: str = "game_id", side: str = "is_home",
                  team: str = "team_id") -> DataFrame:
    """Side output of ``pair_sides``: every team row of a game that did not pair.

    A game is rejected when it lacks a side, has a side twice, or has the same team
    on both sides.  Semi-join back to the rows: AQE splits a skewed game key.
    """
    bad = _side_counts(team_games, game, side, team).filter(~_is_valid_pair()).select(game)
    return team_games.join(bad, on=game, how="left_semi")


def explode_sides(games: DataFrame, game: str = "game_id",
                  carry: tuple[str, ...] = ("game_date", "season"),
                  with_opponent: bool = False) -> DataFrame:
    """One game row -> a home row and an away row, for/against swapped; one scan.

    Output: game, carry..., team_id, is_home, pts_for, pts_against, win
    (away ``win`` = 1 - home_win, as in the long form of the paired table),
    plus ``opp_id`` when ``with_opponent``.
    """
    opp_h = [F.col("away_team_id").alias("opp_id")] if with_opponent else []
    opp_a = [F.col("home_team_id").alias("opp_id")] if with_opponent else []
    home = F.struct(F.col("home_team_id").alias("team_id"), F.lit(1).alias("is_home"),
                    F.col("home_pts").alias("pts_for"), F.col("away_pts").alias("pts_against"),
                    F.col("home_win").alias("win"), *opp_h)
    away = F.struct(F.col("away_team_id").alias("team_id"), F.lit(0).alias("is_home"),
                    F.col("away_pts").alias("pts_for"), F.col("home_pts").alias("pts_against"),
                    (1 - F.col("home_win")).alias("win"), *opp_a)
    return games.select(game, *carry, F.inline(F.array(home, away)))


def zfill_id(c: Column, width: int = 10) -> Column:
    """Zero-pad an id to ``width``; a longer id is kept whole (``lpad`` would cut it)."""
    s = c.cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def new_ids(wanted: DataFrame, landed: DataFrame, key: str = "game_id") -> DataFrame:
    """Ids still to land: wanted minus those already landed (anti join, no driver set)."""
    return wanted.join(landed.select(key).distinct(), on=key, how="left_anti")


def clean_game_log(raw: DataFrame) -> DataFrame:
    """Raw game log (upper-case source columns) -> team x game rows.

    ``is_home``: the matchup text contains "vs." as a regular expression (so "." is
    any character, as in the source's regex contains); ``win``: WL == "W", where a
    missing WL counts as 0, not null.
    """
    require(raw, RAW_GAME_LOG)
    return raw.select(
        F.col("GAME_ID").alias("game_id"),
        F.to_date("GAME_DATE").alias("game_date"),
        F.col("SEASON").alias("season"),
        F.col("TEAM_ID").alias("team_id"),
        F.col("TEAM_ABBREVIATION").alias("team"),
        F.col("MATCHUP").rlike("vs.").cast("int").alias("is_home"),
        F.col("PTS").alias("pts"),
        F.coalesce(F.col("WL") == "W", F.lit(False)).cast("int").alias("win"))
