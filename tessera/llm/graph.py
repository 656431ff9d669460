"""Connected components of links, and joins on keys of which few may have very many rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import KEY_ROWS
from tessera.session import durable

#: Rows of a key from which on its rows are not brought together.
HUB_ROWS = 64


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each ``key``, inner or left; no key's rows meet in one task.

    Keys with many rows of ``left`` (more than ``HUB_ROWS``, and more than the share that leaves at most ``KEY_ROWS``
    such keys) get their row of ``right`` by broadcast, the others by shuffle. ``left`` is read three times, so it should be
    durable. A null key matches nothing.
    """
    least = max(HUB_ROWS, (left.count() if rows is None else rows) // KEY_ROWS)
    many = left.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > least)
    hubs = durable(right.join(many.select(key), key))
    if hubs.isEmpty():
        return left.join(right, key, how)
    hot = left.join(F.broadcast(hubs), key)
    rest = left.join(F.broadcast(hubs.select(key)), key, "left_anti").join(right, key, how)
    return hot.unionByName(rest)


def ordered(a: Column, b: Column) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), by alternating stars.

    The large star hangs every larger neighbour under a node's smallest one, the small star every
    smaller one; both repeat until each tree is a star, which takes a number of rounds logarithmic in the
    longest path. Edges are kept as a table in the checkpoint folder, none reaches the driver; a hub's edges stay
    where they are and its smallest neighbour comes to them.
    """
    edges = durable(links.select(*ordered(F.col("a"), F.col("b"))).where("a <> b").distinct())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        sides = down.union(down.select("v", "u")) if large else down
        low = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("m", "u"))
        limit = max(HUB_ROWS, 2 * edges.count() // KEY_ROWS)
        hubs = durable(low.where(F.col("n") > limit).select("u", "m"))
        rest, low = sides, low.select("u", "m")
        moved = None
        if not hubs.isEmpty():
            moved = sides.join(F.broadcast(hubs), "u")
            rest = sides.join(F.broadcast(hubs.select("u")), "u", "left_anti")
        own = rest.join(low, "u")
        moved = own if moved is None else moved.unionByName(own)
        if large:
            moved = moved.where("v > u").select("m", F.col("v").alias("x"))
        else:
            moved = moved.select("m", F.col("v").alias("x")).union(low.select("m", F.col("u").alias("x")))
        return moved.where("m <> x").select(*ordered(F.col("m"), F.col("x")))

    def all_stars(edges: DataFrame) -> bool:
        """No node has two roots, or a root that hangs under another."""
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")).union(
            edges.select("a", F.lit(0), F.lit(1))
        )
        mixed = ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
        return mixed.where("under > 1 or (under > 0 and over > 0)").isEmpty()

    while not all_stars(edges):
        edges = durable(star(durable(star(edges, True).distinct()), False).distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )
