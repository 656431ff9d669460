"""Cells that follow the density of points: a grid over the globe whose crowded cells are trees of sixteenths.

The grid has cells about as wide as a radius, so a join on it meets each point with the sites of nine cells. A city
centre would still be one cell and one task. Cells with more than :data:`CELL_POINTS` points are therefore split into
sixteenths (two levels of a quadtree at once), and those again, and a site goes only to the leaves that its circle reaches. Leaves that more than
:data:`CELL_POINTS` sites reach are dealt into slices, so that a task never compares more than a bounded number of pairs
of one leaf and slice. No leaf, slice or pair is left out: the tree decides where a pair is compared, never whether.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import degrees, radians, sin

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import EARTH_RADIUS_KM
from tessera.session import durable

#: Points of a leaf, and sites of a slice.
CELL_POINTS = 4096
#: Halvings of a cell's sides; points still together then share a few metres of a kilometre's cell.
MAX_LEVEL = 12
#: Halvings in one split, so that a tree needs few passes and joins.
STEP = 2
#: Split nodes that may be broadcast, some tens of MB once hashed.
BROADCAST_NODES = 200_000

BASE = ("_band", "_cell")
PLACE = ("_level", "_i", "_j")


def band_degrees(km: float) -> float:
    return degrees(km / EARTH_RADIUS_KM) * 1.0001


def columns_in(band: Column, km: float) -> Column:
    """Number of longitude cells of a latitude band; one where meridians run too close together."""
    step = band_degrees(km)
    edge = F.greatest(F.abs((band - 1) * step - 90), F.abs((band + 2) * step - 90))
    shrink = F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(0.0))
    width = F.lit(step * 1.05) / F.nullif(shrink, F.lit(0.0))
    wide = F.coalesce(width > 15.0, F.lit(True))
    return F.when(wide, F.lit(1)).otherwise(F.floor(F.lit(360.0) / width)).cast("long")


def _at_root(df: DataFrame) -> DataFrame:
    return df.withColumns({name: F.lit(0).cast("long") for name in PLACE})


def grid_points(points: DataFrame, km: float) -> DataFrame:
    """Points (``latitude, longitude``) in their grid cell, with the place inside it as fractions ``_u, _v``."""
    south = (F.col("latitude") + 90) / band_degrees(km)
    west = (F.col("longitude") + 180) / 360 * columns_in(F.col("_band"), km)
    rows = points.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull()).withColumn(
        "_band", F.floor(south).cast("long")
    ).withColumn("_cell", F.floor(west).cast("long")).withColumns(
        {"_u": south - F.col("_band"), "_v": west - F.col("_cell")}
    )
    # longitude 180 closes the circle onto the first cell
    return _at_root(rows.withColumn("_cell", F.pmod("_cell", columns_in(F.col("_band"), km))))


def grid_sites(sites: DataFrame, km: float) -> DataFrame:
    """Sites (``site_latitude, site_longitude``) in their grid cell and each neighbour of it."""
    home = F.floor((F.col("site_latitude") + 90) / band_degrees(km)).cast("long")
    at = F.floor((F.col("site_longitude") + 180) / 360 * F.col("_columns")).cast("long")
    rows = (
        sites.withColumn("_home", home)
        .withColumn("_band", F.explode(F.array(*[F.col("_home") + d for d in (-1, 0, 1)])))
        .withColumn("_columns", columns_in(F.col("_band"), km))
        .withColumn("_at", at)
        .withColumn("_cell", F.explode(F.array_distinct(F.array(*[
            F.pmod(F.col("_at") + d, F.col("_columns")) for d in (-1, 0, 1)
        ]))))
        .drop("_home", "_columns", "_at")
    )
    return _at_root(rows)


def _place(level: Column | int) -> dict[str, Column]:
    scale = F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)
    return {"_i": F.floor(F.col("_u") * scale).cast("long"), "_j": F.floor(F.col("_v") * scale).cast("long")}


def crowded_nodes(gridded: DataFrame, keys: Sequence[str], most: int) -> list[DataFrame]:
    """Nodes with more than ``most`` points, one checkpointed table for each split; empty where no cell is crowded.

    The first pass counts cells, each further one reads only points of crowded nodes and counts their sixteenths.
    Counts are partial before they are shuffled, so a crowded cell costs a row a task. A table within
    :data:`BROADCAST_NODES` counted rows is broadcast; beyond it Spark shuffles, and splits crowded keys itself.
    """
    node = [*keys, *BASE, *PLACE]
    levels: list[DataFrame] = []
    rows = gridded
    for level in range(0, MAX_LEVEL, STEP):
        rows = rows.withColumns({"_level": F.lit(level).cast("long"), **_place(level)})
        found = durable(rows.groupBy(*node).agg(F.count("*").alias("_n")).filter(F.col("_n") > most).drop("_n"))
        nodes = found.limit(BROADCAST_NODES + 1).count()
        if nodes == 0:
            break
        levels.append(F.broadcast(found) if nodes <= BROADCAST_NODES else found)
        rows = rows.join(levels[-1], node, "left_semi")
    return levels


def _flagged(rows: DataFrame, nodes: DataFrame, node: Sequence[str]) -> DataFrame:
    return rows.join(nodes.withColumn("_split", F.lit(True)), list(node), "left")


def points_in_leaves(gridded: DataFrame, levels: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Each point in the one leaf that holds it."""
    node = [*keys, *BASE, *PLACE]
    rows = gridded
    for number, nodes in enumerate(levels, 1):
        inner = _place(number * STEP)
        rows = _flagged(rows, nodes, node).withColumns({
            "_level": F.when(F.col("_split"), F.lit(number * STEP).cast("long")).otherwise(F.col("_level")),
            **{name: F.when(F.col("_split"), value).otherwise(F.col(name)) for name, value in inner.items()},
        }).drop("_split")
    return rows.drop("_u", "_v")


def _reaches(km: float, child: Column) -> Column:
    """Whether a site's circle may touch a part: a lower bound of the haversine against the radius."""
    step, scale = band_degrees(km), F.pow(F.lit(2.0), child["_level"])
    height = F.lit(step) / scale
    width = F.lit(360.0) / columns_in(F.col("_band"), km) / scale
    south = F.col("_band") * step - 90 + child["_i"] * height
    middle = -180 + F.col("_cell") * F.lit(360.0) / columns_in(F.col("_band"), km) + (child["_j"] + 0.5) * width
    up = F.greatest(F.lit(0.0), south - F.col("site_latitude"), F.col("site_latitude") - south - height)
    apart = F.abs(F.col("site_longitude") - middle)
    aside = F.greatest(F.lit(0.0), F.least(apart, 360 - apart) - width / 2)
    narrow = F.greatest(F.lit(0.0), F.least(F.cos(F.radians(south)), F.cos(F.radians(south + height))))
    bound = F.pow(F.sin(F.radians(up) / 2), 2) + narrow * F.cos(F.radians("site_latitude")) * F.pow(F.sin(F.radians(aside) / 2), 2)
    # the margin is far above the rounding of a cell's edges
    return bound <= F.lit(sin(min(radians(90.0), km * 1.0002 / EARTH_RADIUS_KM / 2)) ** 2)


def sites_in_leaves(spread: DataFrame, levels: Sequence[DataFrame], keys: Sequence[str], km: float) -> DataFrame:
    """Each site in every leaf that its circle may reach."""
    node = [*keys, *BASE, *PLACE]
    rows = spread
    side = 2 ** STEP
    parts = F.sequence(F.lit(0), F.lit(side * side - 1))
    for number, nodes in enumerate(levels, 1):
        stays = F.struct(*PLACE)
        children = F.transform(parts, lambda part: F.struct(
            F.lit(number * STEP).cast("long").alias("_level"),
            (F.col("_i") * side + F.floor(part / side)).alias("_i"), (F.col("_j") * side + part % side).alias("_j"),
        ))
        reached = F.filter(children, lambda child: _reaches(km, child))
        rows = _flagged(rows, nodes, node).withColumn(
            "_child", F.explode(F.when(F.col("_split"), reached).otherwise(F.array(stays)))
        ).drop("_split", *PLACE).select("*", "_child.*").drop("_child")
    return rows


def in_slices(points: DataFrame, sites: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_slice``: leaves that more than ``most`` sites reach are dealt by the site's position.

    Points of such a leaf go to each of its slices, sites to one; elsewhere there is one slice.
    """
    node = [*keys, *BASE, *PLACE]
    full = durable(
        sites.groupBy(*node).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
        .select(*node, F.ceil(F.col("_n") / most).cast("long").alias("_slices"))
    )
    if full.isEmpty():
        return points, sites
    slices = F.coalesce("_slices", F.lit(1).cast("long"))
    dealt = sites.join(full, node, "left").withColumn(
        "_slice", F.pmod(F.xxhash64("site_latitude", "site_longitude"), slices)
    )
    copied = points.join(full, node, "left").withColumn("_slice", F.explode(F.sequence(F.lit(0).cast("long"), slices - 1)))
    return copied.drop("_slices"), dealt.drop("_slices")
