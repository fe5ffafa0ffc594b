"""Bet ledger: settled profit per bet, running bankroll and ROI per user, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.functions import odds as fo
from scoreline.operators.sequence import running_sum


def settle(bets: DataFrame, won: str = "won", stake: str = "stake",
           price: str = "odds_taken") -> DataFrame:
    """profit = stake * (decimal - 1) when won, -stake when lost, null while open."""
    dec = fo.american_to_decimal(price)
    return bets.withColumn(
        "profit", F.when(F.col(won) == 1, F.col(stake) * (dec - 1.0))
        .when(F.col(won) == 0, -F.col(stake).cast("double")))


def ledger(bets: DataFrame, user: str = "user_id",
           order: tuple[str, ...] = ("placed_at", "bet_id")) -> DataFrame:
    """Per bet, in placement order per user: profit, running profit (bankroll curve),
    running settled stake and running ROI.  Open bets add nothing."""
    s = settle(bets).withColumn(
        "_settled_stake", F.when(F.col("profit").isNotNull(), F.col("stake").cast("double")))
    day = F.to_date(order[0])
    s = running_sum(s, [user], order, {"cum_profit": "profit", "cum_staked": "_settled_stake"}, day)
    return (s.withColumn("running_roi", F.try_divide(F.col("cum_profit"), F.col("cum_staked")))
             .drop("_settled_stake"))


def ledger_summary(bets: DataFrame, user: str = "user_id") -> DataFrame:
    """Per user: bets, settled, won, hit rate, settled stake, profit, ROI."""
    s = settle(bets)
    settled = F.col("profit").isNotNull()
    return s.groupBy(user).agg(
        F.count(F.lit(1)).alias("n_bets"),
        F.count_if(settled).alias("n_settled"),
        F.count_if(F.col("won") == 1).alias("n_won"),
        F.sum(F.when(settled, F.col("stake"))).alias("staked"),
        F.sum("profit").alias("profit"),
    ).select("*", F.try_divide(F.col("n_won"), F.col("n_settled")).alias("hit_rate"),
             F.try_divide(F.col("profit"), F.col("staked")).alias("roi"))
