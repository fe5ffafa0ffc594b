"""Streaming behaviour (incremental, re-delivery, late data) and the tree model."""

import datetime as dt
import math

from pyspark.sql import functions as F

from scoreline.operators import prices
from scoreline.plans import evaluate, features, model
from scoreline.registry import features_of
from scoreline.sources import fixtures as fx
from scoreline.streaming import odds_stream as os_
from tests.conftest import SF_CHECK, SF_SMALL

SNAP = ("snapshot_id long, game_id long, book string, market string, side string, "
        "american_odds int, captured_at timestamp_ntz")


def _land(spark, rows, path):
    spark.createDataFrame(rows, SNAP).coalesce(1).write.mode("append").parquet(path)


def test_incremental_files_equal_batch(spark, scratch):
    snaps = fx.fx_odds_snapshots(spark, SF_SMALL)
    days = sorted(r[0] for r in snaps.select(F.to_date("captured_at")).distinct().collect())
    src = f"{scratch}/in"
    for d in days[:5]:                       # files land in event-time order
        snaps.filter(F.to_date("captured_at") == d).coalesce(1).write.mode("append").parquet(src)
    stream = os_.snapshot_stream(spark, src, max_files=1)
    os_.run_to_log(os_.latest_prices(stream), f"{scratch}/log", f"{scratch}/ck")
    got = os_.compact(spark, f"{scratch}/log", list(prices.LINE_KEYS))
    want = prices.latest_lines(snaps.filter(F.to_date("captured_at") <= days[4]))
    cols = [*prices.LINE_KEYS, "american_odds"]
    assert sorted(got.select(*cols).collect()) == sorted(want.select(*cols).collect())
    assert spark.read.parquet(f"{scratch}/log").select("_batch").distinct().count() == 5


def test_redelivery_and_late_rows(spark, scratch):
    src = f"{scratch}/in"
    t = dt.datetime(2024, 1, 10)
    _land(spark, [(1, 1, "b", "h2h", "HOME", 100, t), (2, 1, "b", "h2h", "HOME", 110, t + dt.timedelta(hours=1))], src)
    _land(spark, [(1, 1, "b", "h2h", "HOME", 100, t),                               # re-delivered
                  (3, 1, "b", "h2h", "HOME", 120, t + dt.timedelta(days=3))], src)
    _land(spark, [(4, 1, "b", "h2h", "HOME", 999, t - dt.timedelta(days=5))], src)  # beyond watermark
    stream = os_.snapshot_stream(spark, src, max_files=1)
    os_.run_to_log(os_.daily_candles(stream), f"{scratch}/log", f"{scratch}/ck")
    got = os_.compact(spark, f"{scratch}/log", ["w", *prices.LINE_KEYS]).collect()
    by_day = {r.w.start.date(): r for r in got}
    assert by_day[t.date()].n_snapshots == 2           # duplicate id counted once
    assert (t - dt.timedelta(days=5)).date() not in by_day   # late row dropped by the watermark


def test_model_quality_gate_and_roundtrip(spark, scratch):
    split = features.time_split(features_of(spark, SF_CHECK)).checkpoint()
    m = model.fit(split)
    preds = model.heldout_predictions(m, split)
    n_test = split.filter("split = 'test'").count()
    assert preds.count() == n_test
    assert preds.filter((F.col("model_prob") < 0) | (F.col("model_prob") > 1)).count() == 0
    mets = model.heldout_metrics(preds)
    assert evaluate.metric_gate(mets, "gbt_calibrated", "elo_baseline")
    imp = m.importances(spark).collect()
    assert len(imp) == 10 and math.isclose(sum(r.importance for r in imp), 1.0, abs_tol=1e-3)
    model.save(m, f"{scratch}/m", spark)
    back = model.load(spark, f"{scratch}/m")
    a = sorted(model.score(m, split.filter("split = 'test'")).select("game_id", "model_prob").collect())
    b = sorted(model.score(back, split.filter("split = 'test'")).select("game_id", "model_prob").collect())
    assert a == b


def test_time_split_fractions(spark):
    split = features.time_split(features_of(spark, SF_CHECK))
    counts = {r.split: r["count"] for r in split.groupBy("split").count().collect()}
    n = sum(counts.values())
    assert counts["train"] == int(n * 0.7)
    assert counts["train"] + counts["valid"] == int(n * 0.85)
    last_train = split.filter("split = 'train'").agg(F.max("pos")).first()[0]
    first_test = split.filter("split = 'test'").agg(F.min("pos")).first()[0]
    assert last_train < first_test


def test_closing_emitted_once_after_tip(spark, scratch):
    src = f"{scratch}/in"
    t0 = dt.datetime(2024, 1, 1)
    rows1 = [(1, 1, "b", "h2h", "HOME", 100, t0), (2, 1, "b", "h2h", "HOME", 110, t0 + dt.timedelta(days=1)),
             (3, 2, "b", "h2h", "HOME", 130, t0 + dt.timedelta(days=1))]
    rows2 = [(4, 1, "b", "h2h", "HOME", 120, t0 + dt.timedelta(days=2, hours=1)),   # after tip of game 1
             (5, 2, "b", "h2h", "HOME", 140, t0 + dt.timedelta(days=6))]           # advances the watermark
    _land(spark, rows1, src)
    _land(spark, rows2, src)
    tips = spark.createDataFrame([(1, dt.datetime(2024, 1, 3)), (2, dt.datetime(2024, 1, 20))],
                                 "game_id long, tip_ts timestamp_ntz")
    stream = os_.snapshot_stream(spark, src, max_files=1)
    os_.run_append(os_.closing_emitter(stream, tips), f"{scratch}/out", f"{scratch}/ck")
    got = spark.read.parquet(f"{scratch}/out").collect()
    assert [(r.game_id, r.closing_odds) for r in got] == [(1, 110)]   # game 2 not yet tipped off


def test_stream_bursts_emit_closed_sessions(spark, scratch):
    src = f"{scratch}/in"
    t0 = dt.datetime(2024, 1, 1)
    h = dt.timedelta(hours=1)
    _land(spark, [(1, 1, "b", "h2h", "HOME", 100, t0), (2, 1, "b", "h2h", "HOME", 105, t0 + 2 * h)], src)
    _land(spark, [(3, 1, "b", "h2h", "HOME", 120, t0 + 20 * h)], src)
    _land(spark, [(4, 1, "b", "h2h", "HOME", 130, t0 + 80 * h)], src)   # moves the watermark on
    stream = os_.snapshot_stream(spark, src, max_files=1)
    os_.run_append(os_.move_bursts(stream), f"{scratch}/out", f"{scratch}/ck")
    got = sorted((r.s.start, r.n_snapshots, r.open_odds, r.close_odds)
                 for r in spark.read.parquet(f"{scratch}/out").collect())
    assert [(n, o, c) for _, n, o, c in got] == [(2, 100, 105), (1, 120, 120)]


def test_sliding_candles_match_batch(spark, scratch):
    snaps = fx.fx_odds_snapshots(spark, SF_SMALL)
    src = f"{scratch}/in"
    snaps.write.parquet(src)
    stream = os_.snapshot_stream(spark, src)
    os_.run_to_log(os_.daily_candles(stream, width="1 day", slide="12 hours"),
                   f"{scratch}/log", f"{scratch}/ck")
    keys = ["w", *prices.LINE_KEYS]
    got = os_.compact(spark, f"{scratch}/log", keys).select(
        F.col("w.start").alias("s"), *prices.LINE_KEYS, "n_snapshots", "close_odds")
    b = snaps.withColumn("captured_at", F.col("captured_at").cast("timestamp"))
    want = os_.daily_candles(b, width="1 day", slide="12 hours").select(
        F.col("w.start").alias("s"), *prices.LINE_KEYS, "n_snapshots", "close_odds")
    assert sorted(got.collect()) == sorted(want.collect())
    assert got.count() > snaps.select(F.to_date("captured_at")).distinct().count()
