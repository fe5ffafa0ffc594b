"""Ordered per-key sequences that stay parallel when one key is hot.

``running_sum`` and ``previous_value`` work per (key, bucket) - the bucket is a coarse
function of the order (a day, a season) - and carry across buckets through a small table
with one row per (key, bucket).  There is one path at every size: a task holds one bucket
of one key, and the caller chooses the bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, str],
                bucket: Column, include_current: bool = True) -> DataFrame:
    """``values`` maps output -> input; each output is the sum of its input over earlier
    rows of the key (and the row itself)."""
    keys, order = list(keys), list(order)
    end = Window.currentRow if include_current else -1
    b = df.withColumn("_bk", bucket)
    inside = (Window.partitionBy(*keys, "_bk").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, end))
    before = (Window.partitionBy(*keys).orderBy("_bk")
              .rowsBetween(Window.unboundedPreceding, -1))
    total = b.groupBy(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_bk"]]).agg(
        *[F.sum(src).alias(f"_t_{dst}") for dst, src in values.items()])
    total = total.withColumnsRenamed({f"_k_{c}": c for c in [*keys, "_bk"]})
    carry = total.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_bk"]], *[
        F.coalesce(F.sum(f"_t_{dst}").over(before), F.lit(0)).alias(f"_c_{dst}") for dst in values])
    inner = b.select("*", *[F.coalesce(F.sum(src).over(inside), F.lit(0)).alias(f"_in_{dst}")
                            for dst, src in values.items()])
    return _back(inner, carry, keys).select(*df.columns, *[
        (F.col(f"_c_{dst}") + F.col(f"_in_{dst}")).alias(dst) for dst in values])


def previous_value(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str,
                   out: str, bucket: Column) -> DataFrame:
    """``out`` = ``value`` of the previous row of the key (null for the first row)."""
    keys, order = list(keys), list(order)
    b = df.withColumn("_bk", bucket)
    inside = Window.partitionBy(*keys, "_bk").orderBy(*order)
    last = b.groupBy(*keys, "_bk").agg(
        F.max_by(F.struct(F.col(value).alias("v")),
                 F.struct(*[F.col(c) for c in order])).alias("_last"))
    carry = last.select(*[F.col(c).alias(f"_k_{c}") for c in [*keys, "_bk"]], F.lag("_last").over(
        Window.partitionBy(*keys).orderBy("_bk")).alias("_c"))
    inner = b.select("*", F.lag(value).over(inside).alias("_in"),
                     (F.row_number().over(inside) == 1).alias("_first"))
    return _back(inner, carry, keys).select(*df.columns, F.when(
        F.col("_first"), F.col("_c.v")).otherwise(F.col("_in")).alias(out))


def _back(inner: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their bucket's carried values (keys may be null)."""
    on = [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in [*keys, "_bk"]]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return inner.join(carry, cond)



def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str,
          values: Sequence[str], bucket: Column, right_order: Sequence[str] = (),
          strict: bool = False) -> DataFrame:
    """``left`` with ``values`` of the latest row of ``right`` with the same keys at or before the
    row's time (before it, if ``strict``); null where there is none.

    Both sides go in one stream ordered by time.  ``bucket`` is a coarse function of the column
    ``at`` (the time); inside a (key, bucket) the last right row is carried by a window, and across
    buckets by one row per (key, bucket), so a hot key is spread over its buckets.  Among right
    rows of one time the largest by ``right_order`` counts.  Rows with a null key or time on the
    left get nulls; such rows on the right match nothing."""
    keys, values = list(keys), list(values)
    row = F.struct(*[F.col(f"`{c}`") for c in left.columns])
    l = left.select(*[F.col(c).alias(f"k_{c}") for c in keys], F.col(left_time).alias("at"),
                    F.lit(0 if strict else 1).alias("turn"), row.alias("row"))
    r = right.where(F.col(right_time).isNotNull()).select(
        *[F.col(c).alias(f"k_{c}") for c in keys], F.col(right_time).alias("at"),
        F.lit(1 if strict else 0).alias("turn"),
        F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate([right_time, *right_order])],
                 *[F.col(c).alias(f"v{i}") for i, c in enumerate(values)]).alias("value"))
    both = l.unionByName(r, allowMissingColumns=True).withColumn("bk", bucket)
    k = [f"k_{c}" for c in keys]
    order = ["at", "turn", *[F.col(f"value.o{i + 1}") for i in range(len(right_order))]]
    inside = F.last("value", True).over(Window.partitionBy(*k, "bk").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow))
    latest = both.where("value IS NOT NULL").groupBy(*k, "bk").agg(F.max("value").alias("value"))
    # what a bucket inherits: the last value of an earlier bucket that has one
    buckets = both.select(*k, "bk").distinct().join(latest, [*k, "bk"], "left")
    carried = buckets.select(*k, "bk", F.last("value", True).over(
        Window.partitionBy(*k).orderBy("bk").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    carried = carried.select(*[F.col(c).alias(f"c_{c}") for c in [*k, "bk"]], "carried")
    found = both.withColumn("inside", inside).where("row IS NOT NULL").join(
        carried, [F.col(c) == F.col(f"c_{c}") for c in [*k, "bk"]], "left")
    known = F.col("at").isNotNull()
    for c in k:
        known = known & F.col(c).isNotNull()
    value = F.when(known, F.coalesce("inside", "carried"))
    return found.withColumn("value", value).select(
        *[F.col(f"row.{c}").alias(c) for c in left.columns],
        *[F.col(f"value.v{i}").alias(c) for i, c in enumerate(values)])


CHUNK = 256     # elements whose outputs are gathered before they join the result


def fold(values: str, init: str, step: str, out: str, out_type: str) -> str:
    """SQL text: for each element of the array ``values`` (``x``) the value ``out`` before it,
    while the state (``s``) goes from ``init`` through ``step``.  All are SQL texts over ``s``
    and ``x``.  Outputs are gathered chunk by chunk, so a long array is not copied for every
    element."""
    inner = (f"aggregate(c, struct(a.s AS s, cast(array() AS array<{out_type}>) AS got), (b, x) -> "
             f"element_at(transform(array(b.s), s -> struct({step} AS s, concat(b.got, array({out})) "
             f"AS got)), 1))")
    chunks = (f"transform(sequence(0, (size({values}) - 1) div {CHUNK}), "
              f"i -> slice({values}, int(i * {CHUNK} + 1), {CHUNK}))")
    return (f"CASE WHEN size({values}) = 0 THEN cast(array() AS array<{out_type}>) ELSE "
            f"flatten(aggregate({chunks}, struct({init} AS s, cast(array() AS array<array<{out_type}>>) "
            f"AS got), (a, c) -> element_at(transform(array({inner}), r -> struct(r.s AS s, "
            f"concat(a.got, array(r.got)) AS got)), 1), a -> a.got)) END")
