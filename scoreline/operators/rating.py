"""Sequential strength ratings (Elo) on Spark, one path at every size.

Semantics: games count in (date, id) order; at a season change every rating moves toward
the base by ``regress``; a game reads both ratings (unseen team = base), forms the home
side's expectation with the home advantage, and both sides move by K * (result -
expectation), zero-sum.

Two forms.

``elo_ratings`` replays.  The history is cut into chunks: runs of consecutive dates with about
``chunk_games`` games, across seasons.  Given the ratings that teams bring into a chunk, a task
plays the chunk alone, so all chunks of all pools run side by side.  The ratings that teams
take out of a chunk are what they bring into their next one (a window over one row per team and
chunk).  Only chunks whose teams' ratings moved by more than ``tol`` are played again.  The
first chunk is right after one round, the next after two, and so on, so the rounds always end
in the sequential answer; because what a team brings along fades with every game and season, a
few rounds settle any history, and one that fits a chunk needs none.

``elo_relaxed`` needs no Python.  A chunk is one row with its games as an array; a fold with
array functions walks them with the ratings of the chunk's teams as state (blocks of about the
square root of their number, so that a game copies two short blocks, not all ratings).  The
hand-over between chunks is that of ``elo_ratings``.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreline.operators.sequence import fold
from scoreline.sources.scratch import Tables

# fixed values: rating constants
K = 20.0          # update speed
HOME_ADV = 60.0   # rating points added to the home side for the expectation
BASE = 1500.0     # rating of an unseen team
REGRESS = 0.75    # share of the deviation kept across a season change

TOL = 1e-9             # rating points
CHUNK_GAMES = 200_000  # games of one task, about
CHUNK = ["_pool", "_part"]


def season_ordinals(games: DataFrame, pool: str = "_pool") -> DataFrame:
    """Dense rank of seasons by first date within a pool (one row per pool x season)."""
    first = games.groupBy(pool, "season").agg(F.min("game_date").alias("_first"))
    return first.select(pool, "season", F.dense_rank().over(
        Window.partitionBy(pool).orderBy("_first", "season")).alias("_sord"))


def with_chunks(games: DataFrame, chunk_games: int) -> DataFrame:
    """Season ordinal and part; a part holds consecutive dates (a date is never split).

    The windows run over one row per (pool, season) and per (pool, season, date)."""
    g = games.join(season_ordinals(games), on=["_pool", "season"])
    days = g.groupBy("_pool", "_sord", "game_date").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(
        Window.partitionBy("_pool").orderBy("_sord", "game_date")
        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    days = days.select("_pool", "_sord", "game_date",
                       F.floor(before / chunk_games).cast("long").alias("_part"))
    return g.join(days, on=["_pool", "_sord", "game_date"])


class _Chunk:
    """One chunk in a task: games in order, and deviations from the base per team, as they
    stand at the first season of the chunk."""

    def __init__(self, games: pd.DataFrame, start: pd.DataFrame):
        self.games = games.sort_values(["_sord", "game_date", "game_id"], kind="mergesort")
        teams = pd.Index(start["team"])
        self.home = teams.get_indexer(self.games["home_team_id"]).tolist()
        self.away = teams.get_indexer(self.games["away_team_id"]).tolist()
        self.dev = start["x"].tolist()

    def play(self, k: float, home_adv: float, regress: float) -> tuple[list, list, list]:
        """Pre-game deviations of both sides and the home expectation, per game; afterwards
        ``dev`` stands at the last season of the chunk."""
        dev, at_home, at_away, expect = self.dev, [], [], []
        season = None
        for h, a, win, s in zip(self.home, self.away, self.games["home_win"].tolist(),
                                self.games["_sord"].tolist()):
            if s != season:
                if season is not None:
                    dev[:] = [x * regress ** (s - season) for x in dev]
                season = s
            x, y = dev[h], dev[a]
            e = 1.0 / (1.0 + 10.0 ** ((y - x - home_adv) / 400.0))
            at_home.append(x)
            at_away.append(y)
            expect.append(e)
            dev[h], dev[a] = x + k * (win - e), y - k * (win - e)
        return at_home, at_away, expect


def _pooled(games: DataFrame, pool: str | None) -> DataFrame:
    return games.withColumn("_pool", (F.col(pool) if pool else F.lit("")).cast("string"))


def _settled(tables: Tables, start: DataFrame, moved: DataFrame | None,
             played: Callable[[DataFrame, DataFrame], DataFrame], regress: float,
             tol: float) -> tuple[DataFrame, int, int]:
    """Hand ratings from chunk to chunk until no chunk's teams move by more than ``tol``.

    ``start``: a row per chunk and team with ``x``, what the team brings; ``moved``: the chunks to
    play first (none: one chunk holds all); ``played`` gives their rows of ``start`` with
    ``_end``, what the team takes out.  Returns the settled start, rounds and chunks played."""
    own = [c for c in start.columns if c != "x"]
    career = Window.partitionBy("_pool", "team").orderBy("_part")
    brought = F.coalesce(F.lag("_end").over(career) * F.pow(
        F.lit(regress), F.col("_from") - F.lag("_to").over(career)), F.lit(0.0))
    done: DataFrame | None = None              # what teams took out of the chunks last time
    rounds = n_played = 0
    while moved is not None:
        rounds, n_played = rounds + 1, n_played + moved.count()
        out = played(moved, start)
        if done is not None:
            out = out.unionByName(done.join(moved, CHUNK, "left_anti"))
        done = tables.put(out, *([done] if done is not None else []))
        after = tables.put(done.select(*own, F.col("x").alias("_old"), brought.alias("x")), start)
        start = after.drop("_old")
        start._written = after._written
        again = tables.put(after.where(F.abs(F.col("x") - F.col("_old")) > tol)
                           .select(*CHUNK).distinct())
        moved = again if again.limit(1).count() else None
    return start, rounds, n_played


def elo_ratings(games: DataFrame, pool: str | None = None, k: float = K,
                home_adv: float = HOME_ADV, base: float = BASE, regress: float = REGRESS,
                tol: float = TOL, chunk_games: int = CHUNK_GAMES,
                stats: dict | None = None) -> DataFrame:
    """Pre-game ratings per game: home_elo, away_elo, elo_diff, elo_exp_home.

    ``pool`` names a column of independent leagues (none: one pool).  Ids and seasons keep
    their type (numbers or text).  ``stats`` receives the rounds and the chunks played."""
    tables = Tables(games.sparkSession, "rating")
    # a day number orders like its date, and Python's dates end with the year 9999
    day = F.unix_date("game_date") if games.schema["game_date"].dataType == T.DateType() else F.col("game_date")
    g = tables.put(with_chunks(_pooled(games, pool), chunk_games).select(
        *CHUNK, "_sord", "game_id", day.alias("game_date"), "home_team_id", "away_team_id", "home_win"))
    team_type = g.schema["home_team_id"].dataType
    span = g.groupBy(*CHUNK).agg(F.min("_sord").alias("_from"), F.max("_sord").alias("_to"))
    start = tables.put(g.select(*CHUNK, F.explode(F.array("home_team_id", "away_team_id"))
                                .alias("team")).distinct().join(span, CHUNK)
                       .withColumn("x", F.lit(0.0)))
    ends_schema = T.StructType([*[g.schema[c] for c in CHUNK], T.StructField("team", team_type),
                                T.StructField("_from", T.IntegerType()),
                                T.StructField("_to", T.IntegerType()),
                                T.StructField("x", T.DoubleType()),
                                T.StructField("_end", T.DoubleType())])

    def ends(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(left, right)
        chunk.play(k, home_adv, regress)
        return right.assign(_end=chunk.dev)[ends_schema.names]

    def played(moved: DataFrame, start: DataFrame) -> DataFrame:
        return (g.join(moved, CHUNK, "left_semi").groupBy(*CHUNK)
                .cogroup(start.join(moved, CHUNK, "left_semi").groupBy(*CHUNK))
                .applyInPandas(ends, ends_schema))

    chunks = g.select(*CHUNK).distinct() if g.where("_part > 0").limit(1).count() else None
    start, rounds, n_played = _settled(tables, start, chunks, played, regress, tol)
    if stats is not None:
        stats.update(rounds=rounds, chunks_played=n_played)

    out_schema = T.StructType([g.schema["game_id"]] + [
        T.StructField(c, T.DoubleType())
        for c in ("home_elo", "away_elo", "elo_diff", "elo_exp_home")])

    def rated(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        chunk = _Chunk(left, right)
        x, y, expect = (pd.Series(v, dtype=float) for v in chunk.play(k, home_adv, regress))
        return pd.DataFrame({"game_id": chunk.games["game_id"].to_numpy(), "home_elo": base + x,
                             "away_elo": base + y, "elo_diff": x + home_adv - y,
                             "elo_exp_home": expect})

    return g.groupBy(*CHUNK).cogroup(start.groupBy(*CHUNK)).applyInPandas(rated, out_schema)


SWEEP_TOL = 1e-8       # rating points
FOLD_GAMES = 20_000    # games of one chunk's array, about


def elo_relaxed(games: DataFrame, pool: str | None = None, k: float = K,
                home_adv: float = HOME_ADV, base: float = BASE, regress: float = REGRESS,
                tol: float = SWEEP_TOL, chunk_games: int = FOLD_GAMES,
                stats: dict | None = None) -> DataFrame:
    """The same ratings by folds over chunks, with array functions alone (no Python).

    ``stats`` receives the rounds of the hand-over as ``sweeps``, and the chunks played."""
    tables = Tables(games.sparkSession, "relaxed")
    g = tables.put(with_chunks(_pooled(games, pool), chunk_games).select(
        *CHUNK, "_sord", "game_id", "game_date", "home_team_id", "away_team_id",
        F.col("home_win").cast("double").alias("win")))
    span = g.groupBy(*CHUNK).agg(F.min("_sord").alias("_from"), F.max("_sord").alias("_to"))
    # the place of a team in its chunk: a block, and a place in the block
    teams = g.select(*CHUNK, F.explode(F.array("home_team_id", "away_team_id")).alias("team")
                     ).groupBy(*CHUNK).agg(F.array_sort(F.collect_set("team")).alias("teams"))
    width = F.ceil(F.sqrt(F.size("teams"))).cast("int")
    start = tables.put(teams.join(span, CHUNK).select(
        *CHUNK, "_from", "_to", width.alias("width"), F.posexplode("teams").alias("slot", "team")).select(
        *CHUNK, "team", "_from", "_to", F.expr("int(slot div width)").alias("block"),
        (F.col("slot") % F.col("width")).alias("place"), F.lit(0.0).alias("x")))

    def at(side: str) -> DataFrame:
        return start.select(*CHUNK, F.col("team").alias(f"{side}_team_id"),
                            F.struct("block", "place").alias(side))

    packed = tables.put(g.join(at("home"), [*CHUNK, "home_team_id"]).join(at("away"), [*CHUNK, "away_team_id"])
                        .groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct(
                            "_sord", "game_date", "game_id", "win", "home", "away"))).alias("games")), g)

    def brought(start: DataFrame) -> DataFrame:
        blocks = start.groupBy(*CHUNK, "block").agg(F.array_sort(F.collect_list(
            F.struct("place", "x"))).alias("b"))
        return blocks.groupBy(*CHUNK).agg(F.array_sort(F.collect_list(F.struct(
            "block", F.col("b.x").alias("b")))).alias("d")).select(*CHUNK, F.col("d.b").alias("devs"))

    # deviations at the game's season, expectation of the home side, and both sides moved
    here = (f"CASE WHEN x._sord = s.season THEN s.devs ELSE transform(s.devs, b -> transform(b, "
            f"v -> v * pow({regress}D, x._sord - s.season))) END")
    home, away = "d[x.home.block][x.home.place]", "d[x.away.block][x.away.place]"
    move = f"{k}D * (x.win - 1D / (1D + pow(10D, ({away} - {home} - {home_adv}D) / 400D)))"
    moved_by = ("CASE WHEN i = x.home.block AND j = x.home.place THEN v + m "
                "WHEN i = x.away.block AND j = x.away.place THEN v - m ELSE v END")
    step = (f"element_at(transform(array({here}), d -> struct(x._sord AS season, element_at(transform("
            f"array({move}), m -> transform(d, (b, i) -> CASE WHEN i = x.home.block OR i = x.away.block "
            f"THEN transform(b, (v, j) -> {moved_by}) ELSE b END)), 1) AS devs)), 1)")
    first = "struct(games[0]._sord AS season, devs)"
    both = f"element_at(transform(array({here}), d -> struct({home} AS h, {away} AS a)), 1)"

    def played(moved: DataFrame, start: DataFrame) -> DataFrame:
        at_end = packed.join(moved, CHUNK, "left_semi").join(brought(start), CHUNK).select(
            *CHUNK, F.expr(f"aggregate(games, {first}, (s, x) -> {step}, s -> s.devs)").alias("devs"))
        ends = at_end.select(*CHUNK, F.posexplode("devs").alias("block", "b")).select(
            *CHUNK, "block", F.posexplode("b").alias("place", "_end"))
        return start.join(ends, [*CHUNK, "block", "place"]).select(*start.columns, "_end")

    several = packed.where("_part > 0").limit(1).count()
    start, rounds, n_played = _settled(tables, start, packed.select(*CHUNK) if several else None,
                                       played, regress, tol)
    if stats is not None:
        stats.update(sweeps=rounds, chunks_played=n_played)
    rated = packed.join(brought(start), CHUNK).select(F.inline(F.arrays_zip(
        F.col("games.game_id").alias("game_id"),
        F.expr(fold("games", first, step, both, "struct<h:double,a:double>")).alias("r"))))
    x, y = F.col("r.h"), F.col("r.a")
    expect = 1.0 / (1.0 + F.pow(F.lit(10.0), (y - x - home_adv) / 400.0))
    return rated.select("game_id", (x + base).alias("home_elo"), (y + base).alias("away_elo"),
                        (x + home_adv - y).alias("elo_diff"), expect.alias("elo_exp_home"))
