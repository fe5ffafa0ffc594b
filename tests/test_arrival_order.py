"""Streams under shuffled arrival, re-delivery and many micro-batches."""

import datetime as dt

from pyspark.sql import functions as F

from scoreline.operators import prices
from scoreline.sources import fixtures as fx
from scoreline.sources.tables import ODDS_SNAPSHOTS
from scoreline.streaming import late, live
from scoreline.streaming import odds_stream as os_
from tests.conftest import SF_SMALL
from tests.test_streaming_model import SNAP, _land

T0 = dt.datetime(2024, 1, 10)


def hours(n):
    return T0 + dt.timedelta(hours=n)


def test_split_uses_earlier_batches_only(spark, scratch):
    src, base = f"{scratch}/in", f"{scratch}/split"
    row = (1, "b", "h2h", "HOME", 100)
    _land(spark, [(1, *row, hours(0)), (2, *row, hours(-60)), (3, *row, None)], src)
    _land(spark, [(4, *row, hours(72)), (5, *row, hours(-24)), (6, *row, hours(-23))], src)
    _land(spark, [(7, *row, hours(48)), (8, *row, hours(49)), (5, *row, hours(-24)), (6, *row, hours(-23))], src)
    late.split_late(spark, src, base, ODDS_SNAPSHOTS, max_files=1)
    on_time = {r[0] for r in spark.read.parquet(late.on_time_path(base)).select("snapshot_id").collect()}
    # batch 0 has no front; batch 1's is hour -24; batch 2's is hour 48
    assert on_time == {1, 2, 4, 6, 8}
    assert {r.snapshot_id for r in late.late_rows(spark, base, ODDS_SNAPSHOTS).collect()} == {3, 5, 7}
    fronts = {r.batch: r.n_rows for r in late.front(spark, base).collect()}
    assert fronts == {0: 3, 1: 3, 2: 4}


def test_a_repeated_batch_replaces_itself(spark, scratch):
    """The split loses its checkpoint after it wrote its rows: nothing doubles."""
    src, base = f"{scratch}/in", f"{scratch}/split"
    for i in range(4):
        _land(spark, [(10 * i + k, 1, "b", "h2h", "HOME", 100 + k, hours(6 * i)) for k in range(5)], src)
    late.split_late(spark, src, base, ODDS_SNAPSHOTS, max_files=1)
    first = sorted(late.front(spark, base).collect())
    fs = spark._jvm.org.apache.hadoop.fs.Path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/split_checkpoint"), True)
    late.split_late(spark, src, base, ODDS_SNAPSHOTS, max_files=1)
    assert sorted(late.front(spark, base).collect()) == first
    assert spark.read.parquet(late.on_time_path(base)).count() == 20


def test_shuffled_arrival_equals_batch(spark, scratch):
    snaps = fx.fx_odds_snapshots(spark, SF_SMALL)
    src, base = f"{scratch}/in", f"{scratch}/split"
    snaps.repartition(12, F.xxhash64("snapshot_id")).write.parquet(src)
    late.split_late(spark, src, base, ODDS_SNAPSHOTS, max_files=2)
    stream = os_.snapshot_stream(spark, late.on_time_path(base), 2)
    os_.run_to_log(os_.daily_candles(stream), f"{base}/log", f"{base}/ck")
    keys = ["w", *prices.LINE_KEYS]
    streamed = os_.compact(spark, f"{base}/log", keys)
    behind = late.late_rows(spark, base, ODDS_SNAPSHOTS).count()
    assert behind > 0
    assert streamed.agg(F.sum("n_snapshots")).first()[0] + behind == snaps.count()

    def candles(df):
        return os_.daily_candles(df.withColumn("captured_at", F.col("captured_at").cast("timestamp")))

    got = late.corrected(spark, base, streamed, ODDS_SNAPSHOTS, candles, keys, lambda df: df.withColumn(
        "w", F.window(F.col("captured_at").cast("timestamp"), os_.CANDLE_WIDTH)))
    want = candles(snaps)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_state_ends_with_the_game(spark, scratch):
    src = f"{scratch}/in"
    tips = spark.createDataFrame([(1, hours(10)), (2, hours(200))], "game_id long, tip_ts timestamp_ntz")
    _land(spark, [(1, 1, "b", "h2h", "HOME", 100, hours(0)), (2, 2, "b", "h2h", "HOME", -110, hours(1)),
                  (3, 1, "b", "h2h", "HOME", 105, hours(2))], src)
    _land(spark, [(4, 1, "b", "h2h", "HOME", 120, hours(1)), (5, 1, "b", "h2h", "HOME", 130, hours(11))], src)
    _land(spark, [(6, 2, "b", "h2h", "HOME", -120, hours(60))], src)
    stream = os_.snapshot_stream(spark, src, max_files=1)
    with live.rocksdb(spark):
        os_.run_to_log(live.open_lines(stream, tips), f"{scratch}/log", f"{scratch}/ck")
    log = spark.read.parquet(f"{scratch}/log").select("_batch", "game_id", "american_odds").collect()
    # neither the older price of batch 1 nor the one after tip-off changes game 1
    assert sorted(map(tuple, log)) == [(0, 1, 105), (0, 2, -110), (2, 2, -120)]
    assert live.state_rows(spark, f"{scratch}/ck") == 1          # game 2 is still open
    _land(spark, [(7, 2, "b", "h2h", "HOME", -130, hours(300))], src)
    stream = os_.snapshot_stream(spark, src, max_files=1)
    with live.rocksdb(spark):
        os_.run_to_log(live.open_lines(stream, tips), f"{scratch}/log", f"{scratch}/ck")
    assert live.state_rows(spark, f"{scratch}/ck") == 0
    assert spark.read.parquet(f"{scratch}/log").count() == 3


def test_closing_emitter_keeps_a_row_per_line(spark, scratch):
    """Many prices of one line in one batch, older and newer ones in any order."""
    src = f"{scratch}/in"
    tips = spark.createDataFrame([(1, hours(50))], "game_id long, tip_ts timestamp_ntz")
    rows = [(i, 1, f"b{i % 2}", "h2h", "HOME", i, hours(i * 37 % 49)) for i in range(49)]
    _land(spark, rows, src)
    _land(spark, [(900, 1, "b0", "h2h", "HOME", 1, hours(200))], src)
    os_.run_append(os_.closing_emitter(os_.snapshot_stream(spark, src, 1), tips), f"{scratch}/out", f"{scratch}/ck")
    got = {r.book: r.closing_odds for r in spark.read.parquet(f"{scratch}/out").collect()}
    want = {b: max((r for r in rows if r[2] == b), key=lambda r: r[6])[0] for b in ("b0", "b1")}
    assert got == want


def _many_games(spark, src, n=700):
    """Two prices of each of ``n`` games, a day apart, in two files."""
    for day in (0, 1):
        _land(spark, [(day * n + g, g, "b", "h2h", "HOME", 100 + day * (g % 3), hours(24 * day)) for g in range(n)], src)
    return spark.createDataFrame([(g, hours(200 if g % 2 else 30)) for g in range(n)],
                                 "game_id long, tip_ts timestamp_ntz")


def test_open_lines_are_held_by_bucket(spark, scratch):
    """One call of the state function works on a bucket of games, not on one line."""
    n = 700
    tips = _many_games(spark, f"{scratch}/in", n)
    with live.rocksdb(spark):
        os_.run_to_log(live.open_lines(os_.snapshot_stream(spark, f"{scratch}/in", 1), tips),
                       f"{scratch}/log", f"{scratch}/ck")
    assert live.state_rows(spark, f"{scratch}/ck") == n
    held = spark.read.format("statestore").option("stateVarName", live.STATE).load(f"{scratch}/ck")
    assert held.count() <= os_.GAME_BUCKETS < n
    got = os_.compact(spark, f"{scratch}/log", list(os_.LINE_KEYS)).collect()
    assert {r.game_id: r.american_odds for r in got} == {g: 100 + g % 3 for g in range(n)}
    _land(spark, [(5000, 1, "b", "h2h", "HOME", 1, hours(70))], f"{scratch}/in")     # past the even games' tip-off
    with live.rocksdb(spark):
        os_.run_to_log(live.open_lines(os_.snapshot_stream(spark, f"{scratch}/in", 1), tips),
                       f"{scratch}/log", f"{scratch}/ck")
    assert live.state_rows(spark, f"{scratch}/ck") == n // 2


def test_closing_lines_are_held_by_bucket(spark, scratch):
    n = 700
    tips = _many_games(spark, f"{scratch}/in", n)
    _land(spark, [(5000, 1, "b", "h2h", "HOME", 1, hours(70))], f"{scratch}/in")
    os_.run_append(os_.closing_emitter(os_.snapshot_stream(spark, f"{scratch}/in", 1), tips),
                   f"{scratch}/out", f"{scratch}/ck")
    got = spark.read.parquet(f"{scratch}/out").collect()
    assert sorted((r.game_id, r.closing_odds) for r in got) == [(g, 100 + g % 3) for g in range(0, n, 2)]
    held = spark.read.format("statestore").load(f"{scratch}/ck")
    assert held.count() <= os_.GAME_BUCKETS
