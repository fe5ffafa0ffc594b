"""Model inputs: feature frame, latest form per team, positional time split.

``feature_frame`` joins games, both sides' pre-game form and the game rating on
one key: the two form rows of a game are pivoted into one row by a conditional
aggregate on game_id, so the games, form and rating inputs are all hash
partitioned by game_id and the joins add no further exchange.

``time_split`` cuts the frame by position in (date, id) order without a
single-partition window: per-bucket counts (one row per bucket of the order key)
give each bucket its starting offset, and a row's position is that offset plus
its rank inside the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scoreline.functions.odds import elo_expected
from scoreline.operators.form import latest_per_key
from scoreline.operators.rating import BASE, HOME_ADV

# fixed values: names and order of the model's inputs
FEATURES = ["diff_pts_for", "diff_pts_against", "diff_net", "diff_win_rate",
            "home_rest", "away_rest", "home_b2b", "away_b2b", "elo_diff", "elo_exp_home"]
TARGET = "home_win"
FORM_VALUES = ["roll_pts_for", "roll_pts_against", "roll_net_rating", "roll_win_rate",
               "rest_days", "b2b"]

# fixed values: split fractions of the time-ordered hold-out
TRAIN_FRAC = 0.70
VALID_FRAC = 0.15


def form_by_game(form: DataFrame) -> DataFrame:
    """team x game form rows -> one row per game with h_* and a_* columns."""
    aggs = []
    for prefix, flag in (("h", 1), ("a", 0)):
        aggs.append(F.max(F.when(F.col("is_home") == flag, F.col("team_id"))).alias(f"{prefix}_team_id"))
        aggs += [F.max(F.when(F.col("is_home") == flag, F.struct(*FORM_VALUES)))
                 .alias(f"_{prefix}")]
    g = form.groupBy("game_id").agg(*aggs)
    return g.select("game_id", "h_team_id", "a_team_id",
                    *[F.col(f"_h.{c}").alias(f"h_{c}") for c in FORM_VALUES],
                    *[F.col(f"_a.{c}").alias(f"a_{c}") for c in FORM_VALUES])


def feature_frame(games: DataFrame, form: DataFrame, elo: DataFrame) -> DataFrame:
    """games + home form + away form + ratings -> features and target; rows with a null
    feature (a team's first game) are dropped."""
    f = form_by_game(form)
    df = (games.join(f, on=[games.game_id == f.game_id,
                            games.home_team_id == f.h_team_id,
                            games.away_team_id == f.a_team_id])
               .drop(f.game_id)
               .join(elo.select("game_id", "elo_diff", "elo_exp_home"), "game_id"))
    df = df.select(
        "game_id", "game_date", "season", "home_team_id", "away_team_id", TARGET,
        (F.col("h_roll_pts_for") - F.col("a_roll_pts_for")).alias("diff_pts_for"),
        (F.col("h_roll_pts_against") - F.col("a_roll_pts_against")).alias("diff_pts_against"),
        (F.col("h_roll_net_rating") - F.col("a_roll_net_rating")).alias("diff_net"),
        (F.col("h_roll_win_rate") - F.col("a_roll_win_rate")).alias("diff_win_rate"),
        F.col("h_rest_days").alias("home_rest"), F.col("a_rest_days").alias("away_rest"),
        F.col("h_b2b").alias("home_b2b"), F.col("a_b2b").alias("away_b2b"),
        "elo_diff", "elo_exp_home")
    return df.dropna(subset=FEATURES + [TARGET])


def latest_form(form: DataFrame, games: DataFrame, elo: DataFrame,
                base: float = BASE) -> DataFrame:
    """Per team: form of its last game (pre-game values) and its last pre-game rating
    (base when the team has no rated game).  Teams without form get no row."""
    lf = latest_per_key(form, "team_id", ["game_date", "game_id"],
                        ["roll_pts_for", "roll_pts_against", "roll_net_rating", "roll_win_rate"])
    ge = games.select("game_id", "game_date", "home_team_id", "away_team_id").join(
        elo.select("game_id", "home_elo", "away_elo"), "game_id")
    sides = ge.select("game_id", "game_date", F.inline(F.array(
        F.struct(F.col("home_team_id").alias("team_id"), F.col("home_elo").alias("elo")),
        F.struct(F.col("away_team_id").alias("team_id"), F.col("away_elo").alias("elo")))))
    le = latest_per_key(sides, "team_id", ["game_date", "game_id"], ["elo"])
    return (lf.join(le, "team_id", "left")
              .withColumn("elo", F.coalesce(F.col("elo"), F.lit(base))))


def positions(df: DataFrame, order: Sequence[str], bucket_width: int = 4096) -> DataFrame:
    """Add ``pos``: 0-based rank of each row in the global ``order`` (date, unique id), and
    ``n_rows``.

    Three levels: offsets of the dates (a running sum over one row per calendar day, the
    only window without a partition), offsets of the id ranges inside a date, and the rank
    inside a (date, id range).  Ids may be numbers, dense or hashed, or text (then a date is
    one range)."""
    day, last = order[0], order[-1]
    number = df.schema[last].dataType.typeName() in ("byte", "short", "integer", "long")
    width = F.floor(F.col(last) / bucket_width) if number else F.lit(0)
    b = df.select("*", F.col(day).alias("_day"), width.alias("_range"))
    ranges = b.groupBy("_day", "_range").agg(F.count(F.lit(1)).alias("_n"))
    days = ranges.groupBy("_day").agg(F.sum("_n").alias("_dn"))
    days = days.select("_day", F.coalesce(F.sum("_dn").over(
        Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_dn").over(Window.partitionBy()).alias("n_rows"))
    inside = F.coalesce(F.sum("_n").over(Window.partitionBy("_day").orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    offsets = ranges.select("_day", "_range", inside.alias("_in")).join(
        F.broadcast(days), "_day")                       # one row per calendar day: bounded
    rank = F.row_number().over(Window.partitionBy("_day", "_range").orderBy(*order)) - 1
    return (b.withColumn("_rank", rank).join(offsets, ["_day", "_range"])
             .withColumn("pos", (F.col("_before") + F.col("_in") + F.col("_rank")).cast("bigint"))
             .drop("_day", "_range", "_before", "_in", "_rank"))


def time_split(frame: DataFrame, order: Sequence[str] = ("game_date", "game_id"),
               train_frac: float = TRAIN_FRAC, valid_frac: float = VALID_FRAC) -> DataFrame:
    """Positional split: first floor(train_frac*n) rows train, up to
    floor((train_frac+valid_frac)*n) validation, the rest test (a boundary may cut a date)."""
    p = positions(frame, order)
    n = F.col("n_rows").cast("double")
    i_tr = F.floor(n * F.lit(train_frac))
    i_va = F.floor(n * F.lit(train_frac + valid_frac))
    return p.withColumn("split", F.when(F.col("pos") < i_tr, "train")
                        .when(F.col("pos") < i_va, "valid").otherwise("test")).drop("n_rows")


def matchup_features(matchups: DataFrame, latest: DataFrame, home_rest: int = 2,
                     away_rest: int = 2, home_adv: float = HOME_ADV) -> DataFrame:
    """Future matchups (home_team_id, away_team_id) -> the model's 10 features from the
    latest form and rating of both teams; rest defaults to 2 days each."""
    h = latest.select(*[F.col(c).alias(f"h_{c}") for c in latest.columns])
    a = latest.select(*[F.col(c).alias(f"a_{c}") for c in latest.columns])
    m = (matchups.join(h, matchups.home_team_id == h.h_team_id)
                 .join(a, matchups.away_team_id == a.a_team_id))
    return m.select(
        *matchups.columns,
        (F.col("h_roll_pts_for") - F.col("a_roll_pts_for")).alias("diff_pts_for"),
        (F.col("h_roll_pts_against") - F.col("a_roll_pts_against")).alias("diff_pts_against"),
        (F.col("h_roll_net_rating") - F.col("a_roll_net_rating")).alias("diff_net"),
        (F.col("h_roll_win_rate") - F.col("a_roll_win_rate")).alias("diff_win_rate"),
        F.lit(home_rest).alias("home_rest"), F.lit(away_rest).alias("away_rest"),
        F.lit(int(home_rest == 1)).alias("home_b2b"), F.lit(int(away_rest == 1)).alias("away_b2b"),
        ((F.col("h_elo") + F.lit(home_adv)) - F.col("a_elo")).alias("elo_diff"),
        elo_expected(F.col("h_elo") + F.lit(home_adv), F.col("a_elo")).alias("elo_exp_home"))
