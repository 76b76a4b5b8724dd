"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docketry.session import materialise

MAX_ROUNDS = 60
# Edges whose minima (a row for each id) travel with the tasks; those of more are joined like any table.
MAX_BROADCAST_EDGES = 1 << 16


def components(edges: DataFrame) -> DataFrame:
    """`id`, `component` (the smallest id reachable) of every id of `edges` (`a`, `b`).

    A large star hangs every larger neighbour of an id on the smallest neighbour, a small star the
    smaller ones. Both are a minimum by key and a join, so a centre with many neighbours is
    pre-aggregated and its join side may be split. Rounds write to the shared folder and end when all edges are stars.
    Of few edges only the minima are shuffled, not the edges.
    """
    edges = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges = materialise(edges, "edges")
    n = edges.count()
    small = F.broadcast if n <= MAX_BROADCAST_EDGES else lambda rows: rows
    for _ in range(MAX_ROUNDS):
        if n == 0:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(small(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        hung = hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = materialise(hung, "edges")
        # Whoever hangs on an id hangs on one, and nothing hangs on it.
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("hangs"), F.lit(0).alias("holds")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("hangs"), F.lit(1).alias("holds")))
        ends = ends.groupBy("x").agg(F.sum("hangs").alias("hangs"), F.max("holds").alias("holds"))
        if ends.where("hangs > 1 OR (hangs > 0 AND holds > 0)").isEmpty():
            break
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def joined(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """`labels` (`id`, `component`) after further `links` (`a`, `b`); an id without a label is a component of its own."""
    if labels is None:
        return materialise(components(links), "components")
    for end in ("a", "b"):
        label = labels.select(F.col("id").alias(end), F.col("component").alias("label"))
        links = links.join(label, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    moved = materialise(components(links.where("a <> b")), "moved")
    if moved.isEmpty():
        return labels
    after = labels.join(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), "component", "left")
    after = after.select("id", F.coalesce("to", "component").alias("component"))
    return materialise(after.unionByName(moved.join(labels.select("id"), "id", "left_anti").select("id", "component")), "components")
