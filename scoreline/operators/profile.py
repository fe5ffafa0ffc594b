"""Dataset profile and column summaries, each a single aggregate pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_profile(df: DataFrame, name: str, key: str, date: str | None = None,
                  exact: bool = True, rsd: float = 0.01) -> DataFrame:
    """One row: rows, distinct keys, rows per key, first and last date.

    ``exact=False`` counts keys with a HyperLogLog++ sketch (relative error ``rsd``):
    one pass without shuffling the distinct keys, for very large key sets."""
    d = F.col(date) if date else F.lit(None).cast("date")
    distinct = F.count_distinct(key) if exact else F.approx_count_distinct(key, rsd)
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        distinct.alias("n_keys"),
        F.min(d).alias("min_date"),
        F.max(d).alias("max_date"),
    ).select(
        F.lit(name).alias("table_name"), "n_rows", "n_keys",
        (F.col("n_rows") / F.col("n_keys")).cast("bigint").alias("rows_per_key"),
        "min_date", "max_date")


def describe_columns(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """count / mean / sample stddev / min / max per numeric column, one pass.

    Columns are unpivoted to (column, value) and aggregated per column name, so
    every statistic is a partial aggregate.
    """
    long = df.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        [], list(cols), "column_name", "value")
    return long.groupBy("column_name").agg(
        F.count("value").alias("n"),
        F.round(F.avg("value"), digits).alias("mean"),
        F.round(F.stddev_samp("value"), digits).alias("stddev"),
        F.min("value").alias("min"),
        F.max("value").alias("max"))
