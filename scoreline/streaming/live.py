"""Current price per line while its game is open, with state that ends at tip-off.

Of each line the state keeps one row, the latest price before tip-off; lines are held by bucket
of games.  A timer at the bucket's next tip-off in event time removes the lines of that game, so
the state holds the lines of open games only, however long the stream runs.  A price that
arrives after tip-off changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scoreline.operators.prices import LINE_KEYS
from scoreline.streaming.odds_stream import LINES_STATE, as_state, by_bucket, held_lines, latest_lines

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "line"
OUT = "game_id long, book string, market string, side string, american_odds int, captured_at timestamp"


class _Lines(StatefulProcessor):
    """Latest prices of a bucket's lines before their tip-off."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getValueState(STATE, f"{LINES_STATE}, timer_ms long")

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        state = self.lines.get() if self.lines.exists() else None
        return held_lines(state[:-1] if state else None), state[-1] if state else None

    def _hold(self, lines: pd.DataFrame, timer: int | None) -> None:
        """``timer``: the one that is set and has not expired."""
        if not len(lines):
            self.lines.clear()
            if timer is not None:
                self.handle.deleteTimer(timer)
            return
        tip = int(lines["tip_ms"].min())
        if tip != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(tip)
        self.lines.update((*as_state(lines), tip))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        lines = latest_lines(held, rows)
        changed = lines[lines["new"]]
        if len(changed):
            # a timer that expires in this batch drops the other lines
            open_ = lines[~lines["new"] | (lines["tip_ms"] > timerValues.getCurrentWatermarkInMs())]
            if len(open_):
                self._hold(open_, timer)
            yield pd.DataFrame({**{c: changed[c] for c in LINE_KEYS}, "american_odds": changed["odds"],
                                "captured_at": pd.to_datetime(changed["at_us"], unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        self._hold(held[held["tip_ms"] > timerValues.getCurrentWatermarkInMs()], None)
        return iter([])

    def close(self) -> None:
        pass


def open_lines(stream: DataFrame, tipoffs: DataFrame, keys: Sequence[str] = LINE_KEYS) -> DataFrame:
    """Changed prices of open lines (update mode).  ``tipoffs``: game_id, tip_ts."""
    return by_bucket(stream, tipoffs, keys).transformWithStateInPandas(
        statefulProcessor=_Lines(), outputStructType=OUT, outputMode="Update", timeMode="EventTime")


@contextmanager
def rocksdb(spark: SparkSession):
    """State store that this kind of state needs, while a query is started."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def state_rows(spark: SparkSession, checkpoint: str) -> int:
    """Lines that are still held after the last batch."""
    held = spark.read.format("statestore").option("stateVarName", STATE).load(checkpoint)
    return held.agg(F.coalesce(F.sum(F.size("value.game_id")), F.lit(0))).first()[0]
