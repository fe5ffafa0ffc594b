"""The board: matchups scored against the best price across books.

``board``          known teams only, home probability, best side over all books,
                   label, display text, ordered by EV.
``board_kpis``     games on the board, +EV count, best edge (one aggregate).
``heldout_board``  held-out games priced by a supplied market probability shaded
                   with a margin, with the actual result.
``seeded_sample``  top-n rows by a stable hash of (seed, id): the same rows in
                   every engine and at every partitioning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.functions import odds as fo
from scoreline.operators.prices import WIN_MARKET, best_side

SAMPLE_SEED = 7      # fixed value: seed of the sample board
SAMPLE_SIZE = 8      # fixed value: games on the sample board
SAMPLE_VIG = 0.045   # fixed value: margin shaded into sample prices


def label_teams(df: DataFrame, lookup: DataFrame, key: str = "team_id",
                code: str = "code") -> DataFrame:
    """Attach home/away codes; a game with an unknown side is dropped (inner lookups)."""
    h = lookup.select(F.col(key).alias("home_team_id"), F.col(code).alias("home_code"))
    a = lookup.select(F.col(key).alias("away_team_id"), F.col(code).alias("away_code"))
    return df.join(h, "home_team_id").join(a, "away_team_id")


ROUNDED = {"p_home": 3, "p_model": 3, "implied": 3, "edge": 3, "ev": 3, "kelly_stake": 4}


def rounded_board(b: DataFrame) -> DataFrame:
    """The board as it is handed out: three digits, the stake four, ties to even."""
    return b.withColumns({c: fo.round_half_even(c, n) for c, n in ROUNDED.items() if c in b.columns})


def live_or_sample(live: DataFrame, sample: DataFrame) -> DataFrame:
    """The live board, or the held-out sample where no game is priced (same columns; the live
    board has no result)."""
    if live.limit(1).count():
        return live.withColumn("result", F.lit(None).cast("string")).select(sample.columns)
    return sample


def display_columns(df: DataFrame) -> DataFrame:
    return df.select("*", fo.fmt_pct("p_home").alias("p_home_pct"),
                     fo.fmt_pct("edge").alias("edge_pct"),
                     fo.fmt_signed("ev").alias("ev_unit"),
                     F.concat(fo.fmt_pct("kelly_stake"), F.lit(" of bankroll")).alias("stake_text"))


def board(scored: DataFrame, two_way_lines: DataFrame, lookup: DataFrame,
          source: str = "live") -> DataFrame:
    """``scored``: game_id, home_team_id, away_team_id, p_home.  ``two_way_lines``:
    game_id, book, market, home_odds, away_odds; only the win market is priced.  One row
    per game with a known matchup."""
    g = label_teams(scored, lookup)
    lines = two_way_lines.where(F.col("market") == WIN_MARKET)
    best = best_side(lines.join(g.select("game_id", "p_home"), "game_id"))
    out = g.join(best, "game_id").select(
        "game_id", F.concat_ws(" @ ", "away_code", "home_code").alias("matchup"),
        "p_home", F.lit(source).alias("source"), "pick", "book", "odds", "p_model",
        "implied", "edge", "ev", "kelly_stake")
    return display_columns(out).orderBy(F.desc("ev"), "game_id")


def board_kpis(b: DataFrame) -> DataFrame:
    return b.agg(F.count(F.lit(1)).alias("n_games"),
                 F.count_if(F.col("ev") > 0).alias("n_value"),
                 F.max("edge").alias("best_edge"))


def seeded_sample(df: DataFrame, key: str, n: int = SAMPLE_SIZE,
                  seed: int = SAMPLE_SEED) -> DataFrame:
    """min(n, rows) rows, chosen by md5(seed || id) (top-n, bounded by n per task)."""
    h = F.md5(F.concat(F.lit(str(seed)), F.col(key).cast("string")))
    return df.withColumn("_h", h).orderBy("_h").limit(n).drop("_h")


def heldout_board(preds: DataFrame, p_model: str, p_market: str,
                  n: int = SAMPLE_SIZE, vig: float = SAMPLE_VIG) -> DataFrame:
    """Sample of held-out games, one book priced from ``p_market`` with ``vig``, the
    model's best side against it, and the actual result."""
    s = seeded_sample(preds, "game_id", n)
    lines = s.select("game_id", F.lit("SampleBook").alias("book"),
                     fo.prob_to_american(F.col(p_market), vig).alias("home_odds"),
                     fo.prob_to_american(1.0 - F.col(p_market), vig).alias("away_odds"),
                     F.col(p_model).alias("p_home"))
    best = best_side(lines)
    base = s.select("game_id", "home_team_id", "away_team_id", "home_win",
                    F.col(p_model).alias("p_home"))
    out = base.join(best, "game_id").select(
        "game_id",
        F.concat_ws(" @ ", F.col("away_team_id").cast("string"),
                    F.col("home_team_id").cast("string")).alias("matchup"),
        "p_home", F.lit("sample").alias("source"),
        F.when(F.col("home_win") == 1, "HOME win").otherwise("AWAY win").alias("result"),
        "pick", "book", "odds", "p_model", "implied", "edge", "ev", "kelly_stake")
    return display_columns(out).orderBy(F.desc("ev"), "game_id")
