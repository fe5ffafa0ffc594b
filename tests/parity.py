"""Compare a registered Spark query with its DuckDB statement.

Same shape as the driver's gate: column names (sorted), row count, and an
order-insensitive comparison of values.  Floats are compared with a relative
tolerance and, separately, as a hash after rounding to 6 digits.

    python -m tests.parity [sf_dir] [key ...]
"""

from __future__ import annotations

import hashlib
import math
import sys
import time

import duckdb
import pandas as pd

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None or v is pd.NaT or (not isinstance(v, (list, tuple, str)) and
                                    not hasattr(v, "__len__") and pd.isna(v)):
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        # a nullable integer column arrives as float64 from one engine, Int64 from the other
        return int(v) if v.is_integer() and abs(v) < 2**53 else v
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    if isinstance(v, bool):
        return v
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def _rows(df: pd.DataFrame, cols: list[str]) -> list[tuple]:
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        out.append(tuple(_norm(v) for v in rec))
    return out


def _key(row):
    return tuple((0, "") if v is None else
                 (1, round(v, 6)) if isinstance(v, float) else (2, str(v)) for v in row)


def _hash(rows) -> str:
    h = hashlib.sha256()
    for r in sorted(repr(tuple(round(v, 6) if isinstance(v, float) else v for v in row))
                    for row in rows):
        h.update(r.encode())
    return h.hexdigest()[:16]


def compare(spark_df: pd.DataFrame, duck_df: pd.DataFrame, rel: float = 1e-9) -> dict:
    res = {"spark_rows": len(spark_df), "oracle_rows": len(duck_df)}
    sc, dc = sorted(spark_df.columns), sorted(duck_df.columns)
    res["schema_match"] = sc == dc
    if sc != dc:
        res["detail"] = f"columns differ: spark-only {set(sc) - set(dc)}, sql-only {set(dc) - set(sc)}"
        res["match"] = False
        return res
    a, b = sorted(_rows(spark_df, sc), key=_key), sorted(_rows(duck_df, sc), key=_key)
    res["hash_match"] = _hash(a) == _hash(b)
    if len(a) != len(b):
        res["match"] = False
        res["detail"] = "row count differs"
        return res
    for i, (ra, rb) in enumerate(zip(a, b)):
        for c, va, vb in zip(sc, ra, rb):
            if isinstance(va, float) and isinstance(vb, float):
                if not math.isclose(va, vb, rel_tol=rel, abs_tol=1e-12):
                    res["match"] = False
                    res["detail"] = f"row {i} col {c}: {va!r} vs {vb!r}"
                    return res
            elif isinstance(va, float) or isinstance(vb, float):
                if va is None or vb is None or not math.isclose(float(va), float(vb), rel_tol=rel):
                    res["match"] = False
                    res["detail"] = f"row {i} col {c}: {va!r} vs {vb!r}"
                    return res
            elif va != vb:
                res["match"] = False
                res["detail"] = f"row {i} col {c}: {va!r} vs {vb!r}"
                return res
    res["match"] = True
    return res


def run(spark, sf_dir: str, keys: list[str] | None = None) -> dict[str, dict]:
    sys.path.insert(0, ".")
    import __spark_entry__ as ent

    qs, sqls = ent.queries(), ent.oracle_sql()
    con = duck(sf_dir)
    out = {}
    for k in keys or list(qs):
        t0 = time.time()
        sdf = qs[k](spark, sf_dir).toPandas()
        t1 = time.time()
        if k not in sqls:
            out[k] = {"spark_rows": len(sdf), "oracle": None, "spark_s": round(t1 - t0, 2)}
            continue
        ddf = con.execute(sqls[k]).df()
        t2 = time.time()
        r = compare(sdf, ddf)
        r.update(spark_s=round(t1 - t0, 2), sql_s=round(t2 - t1, 2))
        out[k] = r
    return out


if __name__ == "__main__":
    from scoreline.session import get_spark

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = get_spark("local[8]", shuffle_partitions=8)
    for k, r in run(spark, sf, sys.argv[2:] or None).items():
        print(k, r, flush=True)
