"""Line tools over price snapshots: closing line, movement, shopping, CLV.

All "as of" lookups are equi-joins on the line key plus a time filter, reduced
by ``max_by``/``min_by`` partial aggregates; no row-by-row search.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreline.functions import odds as fo
from scoreline.operators.prices import LINE_KEYS
from scoreline.operators.sequence import as_of, previous_value, running_sum


def closing_line(snaps: DataFrame, tipoffs: DataFrame, tip: str = "tip_ts",
                 keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Last snapshot strictly before tip-off per line key (game, book, market, side)."""
    s = snaps.join(tipoffs.select("game_id", tip), "game_id").filter(F.col("captured_at") < F.col(tip))
    order = F.struct("captured_at", "snapshot_id")
    return s.groupBy(*keys).agg(F.max_by("american_odds", order).alias("closing_odds"),
                                F.max("captured_at").alias("closing_at"))


def line_movement(snaps: DataFrame, tipoffs: DataFrame, tip: str = "tip_ts",
                  keys: Sequence[str] = LINE_KEYS, bucket: Column | None = None) -> DataFrame:
    """Per line: opening and closing (pre-tip) price, snapshots, price changes between
    consecutive snapshots, and the move in implied probability open -> close."""
    keys = list(keys)
    bucket = bucket if bucket is not None else F.to_date("captured_at")
    s = snaps.join(tipoffs.select("game_id", tip), "game_id").filter(F.col("captured_at") < F.col(tip))
    s = previous_value(s, keys, ["captured_at", "snapshot_id"], "american_odds", "_prev", bucket)
    order = F.struct("captured_at", "snapshot_id")
    agg = s.groupBy(*keys).agg(
        F.min_by("american_odds", order).alias("open_odds"),
        F.max_by("american_odds", order).alias("close_odds"),
        F.count(F.lit(1)).alias("n_snapshots"),
        F.count_if(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("american_odds")))
        .alias("n_changes"))
    return agg.select("*", fo.american_to_implied("open_odds").alias("implied_open"),
                      fo.american_to_implied("close_odds").alias("implied_close"),
                      (fo.american_to_implied("close_odds") - fo.american_to_implied("open_odds"))
                      .alias("implied_move"))


def line_shopping(lines: DataFrame, keys: Sequence[str] = ("game_id", "market", "side"),
                  price: str = "american_odds") -> DataFrame:
    """Every book's current price per (game, market, side), the best one flagged.

    ``save_pct`` (our definition; the specification names the figure without a
    formula) = best decimal price / median decimal price over books - 1.
    """
    keys = list(keys)
    d = lines.withColumn("decimal_odds", fo.american_to_decimal(price))
    stats = d.groupBy(*keys).agg(F.max("decimal_odds").alias("best_decimal"),
                                 F.median("decimal_odds").alias("median_decimal"),
                                 F.count(F.lit(1)).alias("n_books"))
    return (d.join(stats, keys)
             .withColumn("is_best", F.col("decimal_odds") == F.col("best_decimal"))
             .withColumn("save_pct", F.col("best_decimal") / F.col("median_decimal") - 1.0))


def clv_records(bets: DataFrame, closing: DataFrame,
                keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Bets with the closing price of their line and closing-line value
    (positive = the taken price implied less than the close)."""
    c = closing.select(*keys, "closing_odds")
    return (bets.join(c, list(keys), "left")
                .withColumn("clv", fo.clv("odds_taken", "closing_odds"))
                .withColumn("beat_close", F.col("clv") > 0))


BURST_GAP_HOURS = 6   # a new burst starts after this much quiet time on a line


def move_bursts(snaps: DataFrame, keys: Sequence[str] = LINE_KEYS,
                gap_hours: int = BURST_GAP_HOURS, bucket: Column | None = None) -> DataFrame:
    """Sessions of activity per line: consecutive snapshots less than ``gap_hours``
    apart belong to one burst; a burst ends ``gap_hours`` after its last snapshot
    (the session-window convention).  Built from a previous-value and a running sum
    per line, both bounded for hot lines."""
    keys = list(keys)
    bucket = bucket if bucket is not None else F.to_date("captured_at")
    order = ["captured_at", "snapshot_id"]
    s = previous_value(snaps, keys, order, "captured_at", "_prev", bucket)
    gap = F.expr(f"INTERVAL {int(gap_hours)} HOURS")
    s = s.withColumn("_new", (F.col("_prev").isNull()
                              | (F.col("captured_at") >= F.col("_prev") + gap)).cast("int"))
    s = running_sum(s, keys, order, {"burst_no": "_new"}, bucket)
    o = F.struct(*order)
    return s.groupBy(*keys, "burst_no").agg(
        F.min("captured_at").alias("burst_start"),
        (F.max("captured_at") + gap).alias("burst_end"),
        F.count(F.lit(1)).alias("n_snapshots"),
        F.min_by("american_odds", o).alias("open_odds"),
        F.max_by("american_odds", o).alias("close_odds"))


def market_at(left: DataFrame, snaps: DataFrame, time: str, keys: Sequence[str] = LINE_KEYS,
              strict: bool = False) -> DataFrame:
    """``left`` with the market's price at its own time: market_odds, market_at (when that price
    was captured) and market_prob (implied), null where the line had no price yet."""
    right = snaps.select(*keys, "snapshot_id", F.col("american_odds").alias("market_odds"),
                         F.col("captured_at").alias("market_at"))
    out = as_of(left, right, list(keys), time, "market_at", ["market_odds", "market_at"],
                F.to_date("at"), ["snapshot_id"], strict)
    return out.withColumn("market_prob", fo.american_to_implied("market_odds"))
