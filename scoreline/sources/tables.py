"""Declared schemas and loaders.

Base tables are read with a declared schema (no inference, fail on a missing
column), so the Parquet scan prunes to the projected columns and pushes filters.
Domain tables (team games, games, events, odds snapshots, bets) have their own
declared schemas; ``require`` checks a frame against one before an operator runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_L, _I, _D, _S = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType()
_TS = T.TimestampNTZType()


def _schema(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields])


BASE_SCHEMAS: dict[str, T.StructType] = {
    "region": _schema(("r_regionkey", _I), ("r_name", _S)),
    "nation": _schema(("n_nationkey", _I), ("n_name", _S), ("n_regionkey", _I)),
    "customer": _schema(("c_custkey", _L), ("c_name", _S), ("c_nationkey", _I),
                        ("c_acctbal", _D), ("c_mktsegment", _S)),
    "supplier": _schema(("s_suppkey", _L), ("s_name", _S), ("s_nationkey", _I), ("s_acctbal", _D)),
    "part": _schema(("p_partkey", _L), ("p_name", _S), ("p_brand", _S), ("p_type", _S),
                    ("p_size", _I), ("p_retailprice", _D)),
    "orders": _schema(("o_orderkey", _L), ("o_custkey", _L), ("o_orderstatus", _S),
                      ("o_totalprice", _D), ("o_orderdate", _TS), ("o_orderpriority", _S)),
    "lineitem": _schema(("l_orderkey", _L), ("l_partkey", _L), ("l_suppkey", _L),
                        ("l_linenumber", _I), ("l_quantity", _D), ("l_extendedprice", _D),
                        ("l_discount", _D), ("l_tax", _D), ("l_returnflag", _S),
                        ("l_linestatus", _S), ("l_shipdate", _TS)),
    "events": _schema(("event_id", _L), ("ts", _TS), ("user_id", _L), ("event_type", _S),
                      ("value", _D), ("props", _S)),
    "documents": _schema(("doc_id", _L), ("text", _S), ("lang", _S), ("source", _S),
                         ("n_chars", _L)),
    "labels": _schema(("doc_id", _L), ("quality", _I), ("toxic", _I)),
    "embeddings": _schema(("vec_id", _L), ("embedding", T.ArrayType(T.FloatType())), ("label", _I)),
    "pages": _schema(("page_id", _L), ("url", _S), ("html", _S)),
    "benchmark": _schema(("item_id", _L), ("text", _S)),
    "conversations": _schema(("conv_id", _L), ("turn", _L), ("role", _S), ("text", _S)),
}

# Domain tables the operators consume (grain in the comment).
TEAM_GAMES = _schema(("game_id", _L), ("game_date", T.DateType()), ("season", _I),
                     ("team_id", _L), ("is_home", _I), ("pts", _L))             # team x game
GAMES = _schema(("game_id", _L), ("game_date", T.DateType()), ("season", _I),
                ("home_team_id", _L), ("home_pts", _L), ("away_team_id", _L),
                ("away_pts", _L), ("home_win", _I))                               # game
PBP = _schema(("game_id", _L), ("action_number", _L), ("period", _I), ("team_code", _S),
              ("is_field_goal", _I), ("shot_result", _S), ("shot_value", _I),
              ("score_home", _S), ("score_away", _S))                             # event
ODDS_SNAPSHOTS = _schema(("snapshot_id", _L), ("game_id", _L), ("book", _S), ("market", _S),
                         ("side", _S), ("american_odds", _I), ("captured_at", _TS))  # snapshot
RAW_GAME_LOG = _schema(("GAME_ID", _L), ("GAME_DATE", _S), ("SEASON", _S), ("TEAM_ID", _L),
                      ("TEAM_ABBREVIATION", _S), ("MATCHUP", _S), ("WL", _S), ("PTS", _L))  # team x game
BETS = _schema(("bet_id", _L), ("user_id", _L), ("game_id", _L), ("book", _S), ("side", _S),
               ("odds_taken", _I), ("stake", _L), ("placed_at", _TS), ("won", _I))  # bet


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one base table with its declared schema."""
    return spark.read.schema(BASE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail early when a column of the declared schema is missing."""
    missing = [f.name for f in schema.fields if f.name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def prune(df: DataFrame, schema: T.StructType, optional: tuple[str, ...] = ()) -> DataFrame:
    """Only the declared columns, in the declared order and types.

    A declared column that is missing is an error, unless it is ``optional``: then it is left
    out.  Being a plain projection, it reaches the scan, so other columns are never read."""
    require(df, T.StructType([f for f in schema.fields if f.name not in optional]))
    return df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
                       for f in schema.fields if f.name in df.columns])
