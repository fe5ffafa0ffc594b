"""Odds snapshots as a stream: dedupe, latest price, pre-tip closing price, daily candles.

Source: a file stream of snapshot Parquet files (a poller or a feed lands them).
Each snapshot id is kept once within the watermark (at-least-once feeds
re-deliver files).  Aggregations run in update mode; every micro-batch appends
its changed rows to a versioned Parquet log through ``foreachBatch`` and
``compact`` reduces the log to the current row per key (``max_by`` over the
batch id, a partial aggregate).  Nothing is held on the driver, state lives in
the checkpoint directory, and a restarted query resumes from its checkpoint.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, GroupedData, SparkSession
from pyspark.sql import functions as F

from scoreline.operators.prices import LINE_KEYS
from scoreline.session import ensure_checkpoint_dir
from scoreline.sources.tables import ODDS_SNAPSHOTS

WATERMARK = "1 day"
CANDLE_WIDTH = "1 day"


def snapshot_stream(spark: SparkSession, path: str, max_files: int | None = None,
                    watermark: str = WATERMARK) -> DataFrame:
    """Read landed snapshot files as a stream, event time ``captured_at``, deduplicated."""
    r = spark.readStream.schema(ODDS_SNAPSHOTS)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    s = r.parquet(path).withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    return (s.withWatermark("captured_at", watermark)
             .dropDuplicatesWithinWatermark(["snapshot_id"]))


def latest_prices(stream: DataFrame, keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    order = F.struct("captured_at", "snapshot_id")
    return stream.groupBy(*keys).agg(F.max_by("american_odds", order).alias("american_odds"),
                                     F.max("captured_at").alias("captured_at"))


def closing_prices(stream: DataFrame, tipoffs: DataFrame,
                   keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Latest price strictly before tip-off (stream-static join with the tip-off table)."""
    tips = tipoffs.select("game_id", F.col("tip_ts").cast("timestamp").alias("_tip"))
    s = stream.join(tips, "game_id").filter(F.col("captured_at") < F.col("_tip"))
    order = F.struct("captured_at", "snapshot_id")
    return s.groupBy(*keys).agg(F.max_by("american_odds", order).alias("closing_odds"),
                                F.max("captured_at").alias("closing_at"))


def daily_candles(stream: DataFrame, keys: Sequence[str] = LINE_KEYS,
                  width: str = CANDLE_WIDTH, slide: str | None = None) -> DataFrame:
    """Event-time windows per line (tumbling, or sliding when ``slide`` is given):
    open, close, high, low, snapshots."""
    order = F.struct("captured_at", "snapshot_id")
    w = F.window("captured_at", width, slide) if slide else F.window("captured_at", width)
    return stream.groupBy(w.alias("w"), *keys).agg(
        F.min_by("american_odds", order).alias("open_odds"),
        F.max_by("american_odds", order).alias("close_odds"),
        F.max("american_odds").alias("high_odds"),
        F.min("american_odds").alias("low_odds"),
        F.count(F.lit(1)).alias("n_snapshots"))


def run_to_log(agg: DataFrame, log_path: str, checkpoint: str) -> None:
    """Run a streaming aggregate over everything available, appending each batch's
    updated rows, tagged with the batch id, to ``log_path``."""
    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(log_path)

    q = (agg.writeStream.outputMode("update").foreachBatch(sink)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def compact(spark: SparkSession, log_path: str, keys: Sequence[str]) -> DataFrame:
    """Current row per key: the version written by the latest batch."""
    log = spark.read.parquet(log_path)
    cols = [c for c in log.columns if c not in (*keys, "_batch")]
    return (log.groupBy(*keys).agg(F.max_by(F.struct(*cols), "_batch").alias("_v"))
               .select(*keys, *[F.col(f"_v.{c}").alias(c) for c in cols]))


def stream_dir(spark: SparkSession) -> str:
    """A fresh folder under the shared checkpoint directory for one streaming run."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{uuid.uuid4().hex}"


# Python state is kept per bucket of games, so that a call works on many lines at once (a call
# costs milliseconds, whatever it is given); a bucket's state is a row per open line
GAME_BUCKETS = 512
STATE_COLUMNS = {"game_id": "long", "book": "string", "market": "string", "side": "string",
                 "odds": "int", "at_us": "long", "snapshot_id": "long", "tip_ms": "long"}
LINES_STATE = ", ".join(f"{c} array<{t}>" for c, t in STATE_COLUMNS.items())
CLOSE_OUT = ("game_id long, book string, market string, side string, closing_odds int, "
             "closing_at timestamp, tip_at timestamp")


def by_bucket(stream: DataFrame, tipoffs: DataFrame, keys: Sequence[str] = LINE_KEYS) -> GroupedData:
    """Snapshots with the tip-off of their game (``tip_at``), grouped by bucket of games."""
    tips = tipoffs.select("game_id", F.col("tip_ts").cast("timestamp").alias("tip_at"))
    rows = stream.join(tips, "game_id").select(
        F.pmod(F.xxhash64("game_id"), F.lit(GAME_BUCKETS)).alias("bucket"), *keys, "american_odds",
        "captured_at", "snapshot_id", "tip_at")
    return rows.groupBy("bucket")


def epoch_us(column: pd.Series) -> pd.Series:
    return column.astype("datetime64[us]").astype("int64")


def latest_lines(held: pd.DataFrame, chunks: Iterator[pd.DataFrame]) -> pd.DataFrame:
    """The row of every line with the latest price before tip-off, of the rows held so far and
    of arriving chunks; ``new``: it is not the held one."""
    held = held.assign(new=False)
    for pdf in chunks:                         # a row per line, whatever the batch brings
        at, tip = epoch_us(pdf["captured_at"]), epoch_us(pdf["tip_at"])
        rows = pd.DataFrame({**{c: pdf[c] for c in LINE_KEYS}, "odds": pdf["american_odds"].astype("Int64"),
                             "at_us": at, "snapshot_id": pdf["snapshot_id"], "tip_ms": tip // 1000,
                             "new": True})[at < tip]
        both = pd.concat([rows, held], ignore_index=True) if len(held) else rows
        held = both.sort_values(["at_us", "snapshot_id"], kind="stable").drop_duplicates(
            list(LINE_KEYS), keep="last")      # a held row stays if the same price comes again
    return held


def held_lines(state: tuple | None) -> pd.DataFrame:
    """Rows of a bucket's state."""
    columns = state if state is not None else [[] for _ in STATE_COLUMNS]
    out = pd.DataFrame({c: list(v) for c, v in zip(STATE_COLUMNS, columns)})
    return out.astype({c: "Int64" if c == "odds" else "int64" for c, t in STATE_COLUMNS.items() if t != "string"})


def as_state(lines: pd.DataFrame) -> tuple:
    return tuple([None if pd.isna(v) else v for v in lines[c].tolist()] if c == "odds" else lines[c].tolist()
                 for c in STATE_COLUMNS)


def _close_games(key, pdfs, state):
    """Keep the latest pre-tip price of every open line of a bucket's games; emit the lines of
    a game once when the event-time watermark passes its tip-off, then drop them."""
    watermark = state.getCurrentWatermarkMs()
    held = held_lines(state.get if state.exists else None)
    lines = latest_lines(held, iter(()) if state.hasTimedOut else pdfs)
    due = (lines["tip_ms"] < watermark) | (lines["new"] & (lines["tip_ms"] <= watermark))
    out, rest = lines[due], lines[~due]
    if len(rest):
        state.update(as_state(rest))
        state.setTimeoutTimestamp(max(int(rest["tip_ms"].min()), watermark))
    elif state.exists:
        state.remove()
    if len(out):
        yield pd.DataFrame({**{c: out[c] for c in LINE_KEYS}, "closing_odds": out["odds"],
                            "closing_at": pd.to_datetime(out["at_us"], unit="us"),
                            "tip_at": pd.to_datetime(out["tip_ms"], unit="ms")})


def closing_emitter(stream: DataFrame, tipoffs: DataFrame,
                    keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Append-mode stream of closing lines, one row per line once the game's tip-off
    has passed the watermark.  State is per bucket of games, holding one row per open line;
    its timer is the bucket's next tip-off."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    return by_bucket(stream, tipoffs, keys).applyInPandasWithState(
        _close_games, CLOSE_OUT, LINES_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_append(df: DataFrame, out_path: str, checkpoint: str) -> None:
    """Run an append-mode stream over everything available into Parquet files."""
    q = (df.writeStream.outputMode("append").format("parquet").option("path", out_path)
           .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def move_bursts(stream: DataFrame, keys: Sequence[str] = LINE_KEYS,
                gap: str = "6 hours") -> DataFrame:
    """Bursts of snapshots per line as event-time session windows (append mode emits a
    burst once the watermark passes its end)."""
    order = F.struct("captured_at", "snapshot_id")
    return stream.groupBy(F.session_window("captured_at", gap).alias("s"), *keys).agg(
        F.count(F.lit(1)).alias("n_snapshots"),
        F.min_by("american_odds", order).alias("open_odds"),
        F.max_by("american_odds", order).alias("close_odds"))
