"""Connected components over written tables (``Tables``: Parquet in the shared folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreline.sources.scratch import Tables


def components(tables: Tables, edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph (columns ``u``, ``v``; longs).

    Returns (``node``, ``component``) with the smallest node of each component.  Every
    round hooks each vertex to its smallest neighbour, follows the hooks to their ends by
    pointer doubling and contracts the graph; at least half of the remaining vertices
    that have a neighbour vanish per round.  Only aggregates (minimum, distinct) and joins
    are used, so no neighbourhood is gathered in one task; all tables are written.
    """
    todo = tables.put(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                      .where("u < v").distinct())
    done: DataFrame | None = None        # node -> current root
    while todo.limit(1).count():
        hook = (todo.select(F.col("v").alias("node"), F.col("u").alias("up"))
                .unionByName(todo.select(F.col("u").alias("node"), F.col("u").alias("up")))
                .groupBy("node").agg(F.min("up").alias("up")))
        hook = tables.put(hook)
        while True:                       # up := up of up, until every path has length one
            far = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            jumped = tables.put(hook.join(far, "up").select("node", "up", "top"))
            moved = jumped.where("up <> top").limit(1).count()
            hook2 = jumped.select("node", F.col("top").alias("up"))
            hook2._written = jumped._written
            tables.drop(hook)
            hook = hook2
            if not moved:
                break
        a = hook.select(F.col("node").alias("u"), F.col("up").alias("a"))
        b = hook.select(F.col("node").alias("v"), F.col("up").alias("b"))
        nxt = tables.put(todo.join(a, "u").join(b, "v")
                         .select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"))
                         .where("u < v").distinct(), todo)
        if done is None:
            done = hook
        else:
            step = hook.select(F.col("node").alias("root"), F.col("up").alias("next"))
            new = tables.put(done.join(step, done["up"] == step["root"], "left")
                             .select("node", F.coalesce("next", "up").alias("up")), done, hook)
            done = new
        todo = nxt
    if done is None:
        return todo.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return done.select("node", F.col("up").alias("component"))
