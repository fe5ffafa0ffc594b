"""Market operators over append-only price snapshots.

Every "latest price per key" is a ``max_by(price, (captured_at, snapshot_id))``
partial aggregate, so a hot game or book is reduced map-side before the shuffle.
Two-way lines pair the HOME and AWAY side of one (game, book, market) by
conditional aggregation in the same shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.functions import odds as fo

LINE_KEYS = ("game_id", "book", "market", "side")


def latest_lines(snaps: DataFrame, keys: Sequence[str] = LINE_KEYS,
                 ts: str = "captured_at", tiebreak: str = "snapshot_id",
                 price: str = "american_odds", before: Column | None = None) -> DataFrame:
    """Latest price per key (optionally only snapshots satisfying ``before``)."""
    s = snaps.filter(before) if before is not None else snaps
    return s.groupBy(*keys).agg(
        F.max_by(F.col(price), F.struct(F.col(ts), F.col(tiebreak))).alias(price),
        F.max(ts).alias(ts))


def two_way(lines: DataFrame, keys: Sequence[str] = ("game_id", "book", "market"),
            side: str = "side", price: str = "american_odds") -> DataFrame:
    """(key, side) lines -> one row per key with both prices; keys missing a side drop out."""
    return (lines.groupBy(*keys).agg(
                F.max(F.when(F.col(side) == "HOME", F.col(price))).alias("home_odds"),
                F.max(F.when(F.col(side) == "AWAY", F.col(price))).alias("away_odds"))
            .filter(F.col("home_odds").isNotNull() & F.col("away_odds").isNotNull()))


def devig(two: DataFrame) -> DataFrame:
    """Implied probabilities of both sides, overround, and the fair (no-vig) split."""
    ih, ia = fo.american_to_implied("home_odds"), fo.american_to_implied("away_odds")
    return two.select("*", ih.alias("implied_home"), ia.alias("implied_away"),
                      (ih + ia).alias("overround"),
                      fo.devig_share(ih, ia).alias("fair_home"),
                      fo.devig_share(ia, ih).alias("fair_away"))


def consensus(fair: DataFrame, keys: Sequence[str] = ("game_id", "market")) -> DataFrame:
    """Market consensus: mean fair home probability over books, per game and market."""
    return fair.groupBy(*keys).agg(F.avg("fair_home").alias("p_home"),
                                   F.count(F.lit(1)).alias("n_books"))


def with_consensus(fair: DataFrame, keys: Sequence[str] = ("game_id", "market")) -> DataFrame:
    """Attach the consensus ``p_home`` to every book row without a self-join: a window
    over (game, market), whose size is the number of books."""
    return fair.withColumn("p_home", F.avg("fair_home").over(Window.partitionBy(*keys)))


def price_columns(df: DataFrame, p: str = "p", price: str = "american_odds",
                  mult: float = fo.KELLY_FRACTION, cap: float = fo.MAX_STAKE_FRAC) -> DataFrame:
    """Decimal, implied, edge, EV per unit, Kelly fraction and capped stake per row."""
    return df.select(
        "*",
        fo.american_to_decimal(price).alias("decimal_odds"),
        fo.american_to_implied(price).alias("implied"),
        fo.edge(p, price).alias("edge"),
        fo.expected_value(p, price).alias("ev"),
        fo.kelly_fraction(p, price).alias("kelly"),
        fo.recommended_stake(p, price, mult, cap).alias("stake_frac"))


def side_prob(p_home: str = "p_home", side: str = "side") -> Column:
    return F.when(F.col(side) == "HOME", F.col(p_home)).otherwise(1.0 - F.col(p_home))


WIN_MARKET = "h2h"   # fixed value: the market that a win probability prices


def best_side(two: DataFrame, p_home: str = "p_home",
              keys: Sequence[str] = ("game_id",)) -> DataFrame:
    """Best (EV, side, book, odds, p) over both sides at every book of a game, or of a game
    and market if ``keys`` names both (``p_home`` must belong to the market).

    Lexicographic maximum: higher EV, then HOME over AWAY, then book name
    descending, then higher odds, as a ``max(struct)`` partial aggregate.
    """
    home = F.struct(F.lit("HOME").alias("side"), F.col("home_odds").alias("odds"),
                    F.col(p_home).alias("p"))
    away = F.struct(F.lit("AWAY").alias("side"), F.col("away_odds").alias("odds"),
                    (1.0 - F.col(p_home)).alias("p"))
    cand = two.select(*keys, "book", F.inline(F.array(home, away)))
    cand = cand.withColumn("ev", fo.expected_value("p", "odds"))
    best = cand.groupBy(*keys).agg(
        F.max(F.struct("ev", "side", "book", "odds", "p")).alias("b"))
    return best.select(
        *keys, F.col("b.side").alias("pick"), F.col("b.book").alias("book"),
        F.col("b.odds").alias("odds"), F.col("b.p").alias("p_model"),
        fo.american_to_implied("b.odds").alias("implied"),
        fo.edge("b.p", "b.odds").alias("edge"), F.col("b.ev").alias("ev"),
        fo.recommended_stake("b.p", "b.odds").alias("kelly_stake"))


# ---- nested payload (games -> bookmakers -> markets -> outcomes) ----

OUTCOME = T.StructType([T.StructField("name", T.StringType()),
                        T.StructField("price", T.IntegerType())])
MARKET = T.StructType([T.StructField("key", T.StringType()),
                       T.StructField("outcomes", T.ArrayType(OUTCOME))])
BOOKMAKER = T.StructType([T.StructField("title", T.StringType()),
                          T.StructField("markets", T.ArrayType(MARKET))])
PAYLOAD = T.StructType([T.StructField("home_team", T.StringType()),
                        T.StructField("away_team", T.StringType()),
                        T.StructField("commence_time", T.StringType()),
                        T.StructField("bookmakers", T.ArrayType(BOOKMAKER))])


def flatten_payload(raw: DataFrame, json_col: str = "payload", market: str = "h2h",
                    keep: Sequence[str] = ()) -> DataFrame:
    """JSON game documents -> (home, away, commence, book, home_odds, away_odds).

    Per bookmaker, the outcomes of all ``market`` markets are read in order and a
    later outcome with the same name wins; a book is kept only if it prices both
    teams, and a game without such a book yields no row.  Array work stays inside
    the row (higher-order functions); only bookmakers are exploded.
    """
    g = raw.select(*keep, F.from_json(F.col(json_col), PAYLOAD).alias("g"))
    bk = g.select(*keep, F.col("g.home_team").alias("home"), F.col("g.away_team").alias("away"),
                  F.col("g.commence_time").alias("commence"),
                  F.explode("g.bookmakers").alias("bk"))
    outs = F.flatten(F.transform(F.filter("bk.markets", lambda m: m["key"] == market),
                                 lambda m: m["outcomes"]))

    def last_price(team: Column) -> Column:
        return F.try_element_at(F.filter(outs, lambda o: o["name"] == team), F.lit(-1))["price"]

    return (bk.select(*keep, "home", "away", "commence", F.col("bk.title").alias("book"),
                      last_price(F.col("home")).alias("home_odds"),
                      last_price(F.col("away")).alias("away_odds"))
              .filter(F.col("home_odds").isNotNull() & F.col("away_odds").isNotNull()))


def build_payload(snaps: DataFrame, commence: DataFrame, day: Column) -> DataFrame:
    """Snapshots -> one JSON document per (game, polling day), outcomes in time order.

    Team names are ``H<game>`` and ``A<game>``; used to feed ``flatten_payload``
    with documents derived from the snapshot table.
    """
    s = snaps.withColumn("_day", day)
    name = F.when(F.col("side") == "HOME", F.concat(F.lit("H"), F.col("game_id").cast("string"))
                  ).otherwise(F.concat(F.lit("A"), F.col("game_id").cast("string")))
    per_market = s.groupBy("game_id", "_day", "book", "market").agg(
        F.sort_array(F.collect_list(F.struct("captured_at", "snapshot_id",
                                             name.alias("name"),
                                             F.col("american_odds").alias("price"))))
        .alias("o"))
    per_market = per_market.select(
        "game_id", "_day", "book",
        F.struct(F.col("market").alias("key"),
                 F.transform("o", lambda x: F.struct(x["name"].alias("name"),
                                                     x["price"].alias("price"))).alias("outcomes"))
        .alias("m"))
    per_book = per_market.groupBy("game_id", "_day", "book").agg(
        F.sort_array(F.collect_list("m")).alias("markets"))
    per_game = per_book.groupBy("game_id", "_day").agg(
        F.sort_array(F.collect_list(F.struct(F.col("book").alias("title"), "markets")))
        .alias("bookmakers"))
    doc = per_game.join(commence, "game_id").select(
        "game_id", F.col("_day").alias("poll_day"),
        F.to_json(F.struct(
            F.concat(F.lit("H"), F.col("game_id").cast("string")).alias("home_team"),
            F.concat(F.lit("A"), F.col("game_id").cast("string")).alias("away_team"),
            F.col("commence_time"), "bookmakers")).alias("payload"))
    return doc
