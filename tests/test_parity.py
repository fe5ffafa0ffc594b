"""Every registered query against its DuckDB statement at sf0.01 (the driver's gate)."""

import pytest

import __spark_entry__ as ent
from tests.conftest import SF_CHECK
from tests.parity import compare, duck

KEYS = sorted(ent.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF_CHECK)


DUCK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string",
              "DATE": "date", "TIMESTAMP": "timestamp_ntz", "BOOLEAN": "boolean"}


@pytest.mark.parametrize("key", KEYS)
def test_matches_sql(spark, con, key):
    sdf = ent.queries()[key](spark, SF_CHECK)
    rel = con.sql(ent.oracle_sql()[key])
    spark_types = {f.name: f.dataType.simpleString() for f in sdf.schema.fields}
    sql_types = {n: DUCK_TYPES.get(str(t), str(t)) for n, t in zip(rel.columns, rel.types)}
    assert spark_types == sql_types
    res = compare(sdf.toPandas(), rel.df())
    assert res["match"], res
    assert res["hash_match"], res


def test_every_key_has_a_callable():
    assert set(ent.oracle_sql()) <= set(ent.queries())


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert "roll_pts_for" in df.columns


def test_docs_list_every_key():
    import pathlib
    root = pathlib.Path(__file__).resolve().parents[1]
    coverage = (root / "COVERAGE.md").read_text()
    readme = (root / "README.md").read_text()
    missing = [k for k in ent.queries() if f"`{k}`" not in coverage or f"`{k}`" not in readme]
    assert not missing, missing
