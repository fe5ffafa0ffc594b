"""Shared folder, shipping, SQL over frames, written tables, positions with hashed ids."""

import os
import subprocess
import sys
import types

import pytest
from pyspark.sql import functions as F

from scoreline import session
from scoreline.plans import features
from scoreline.plans.boost import best_length
from scoreline.sources import landing
from scoreline.sources.scratch import Tables


def test_shared_folder_is_required_on_a_cluster():
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        conf = types.SimpleNamespace(get=lambda key, default=None: default)
        sc = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None, getConf=lambda: conf)
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.ensure_checkpoint_dir(types.SimpleNamespace(sparkContext=sc))


def test_shuffle_width_has_no_default_cap():
    wide = session.scale_settings(100 << 40, 8000)
    assert int(wide["spark.sql.shuffle.partitions"]) == (100 << 40) // (256 << 20)
    few = session.scale_settings(100 << 40, 8000, max_partitions=1000)
    assert few["spark.sql.shuffle.partitions"] == "1000"


def test_workers_without_the_path_get_the_package(tmp_path):
    """A driver that loads the entry module by file, with nothing on PYTHONPATH."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import importlib.util
spec = importlib.util.spec_from_file_location('entry', {root + '/__spark_entry__.py'!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from scoreline.session import get_spark
spark = get_spark('local[2]', shuffle_partitions=2)
print('rows', m.queries()['elo_by_pool'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True,
                         text=True, timeout=200)
    assert "rows " in out.stdout, out.stderr[-2000:]


def test_sql_over_frames_leaves_no_view(spark):
    df = spark.createDataFrame([(1, 2020), (2, 2021)], "game_id long, season int")
    got = landing.read_sql(spark, "SELECT game_id FROM {g} WHERE season = :s", {"g": df}, s=2021)
    assert [r.game_id for r in got.collect()] == [2]
    assert "g" not in [t.name for t in spark.catalog.listTables()]


def test_unreadable_data_is_not_absence(spark, scratch):
    os.makedirs(f"{scratch}/broken")
    with open(f"{scratch}/broken/part-0.parquet", "w") as f:
        f.write("not parquet")
    with pytest.raises(Exception):
        landing.table_exists(spark, f"{scratch}/broken")
    assert not landing.table_exists(spark, f"{scratch}/absent")


def test_written_tables_are_deleted_with_their_successor(spark):
    t = Tables(spark, "test")
    a = t.put(spark.range(10))
    b = t.put(a.where("id > 4"), a)
    folder = b._written.removeprefix("file:")
    assert b.count() == 5 and os.path.isdir(folder) and not os.path.isdir(a._written.removeprefix("file:"))


@pytest.mark.parametrize("key", ["id", "xxhash64(id)", "lpad(id, 12, '0')"])
def test_positions_with_dense_hashed_and_text_ids(spark, key):
    df = spark.range(5000).select(F.expr(f"{key} AS k"), F.expr("date_add(date'2024-01-01', int(id % 7)) AS d"))
    got = features.positions(df, ["d", "k"], bucket_width=64)
    rows = sorted(((r.d, r.k), r.pos) for r in got.collect())
    assert [p for _, p in rows] == list(range(5000))
    assert got.select("n_rows").distinct().collect()[0][0] == 5000
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SinglePartition") <= 2      # the table of calendar days alone


def test_best_length_waits_for_patience():
    assert best_length([3.0, 2.0, 2.5, 2.4, 1.0], patience=2) == (2, True)
    assert best_length([3.0, 2.0, 2.5, 2.4, 1.0], patience=5) == (5, False)
