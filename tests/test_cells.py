import itertools
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import cells
from tessera.plans import facility
from test_facility import km


def tables(spark, points, sites):
    left = spark.createDataFrame(points, "id int, latitude double, longitude double")
    right = spark.createDataFrame(sites, "site int, site_latitude double, site_longitude double")
    return left, right


def crowded(rng, lat0, lon0, n, tight):
    """Half of the points within a small part of one cell, the others around it."""
    rows = []
    for i in range(n):
        width = tight if i % 2 else tight * 40
        lat = max(-90.0, min(90.0, lat0 + rng.uniform(-width, width)))
        rows.append((i, lat, (lon0 + rng.uniform(-width, width) + 180) % 360 - 180))
    return rows


@pytest.mark.parametrize("lat0,lon0,radius,most", [
    (0.0, 0.0, 30.0, 20), (51.5, 179.99, 30.0, 10), (-89.9, 12.0, 20.0, 15), (60.0, -180.0, 5.0, 3), (89.99, 0.0, 100.0, 7),
])
def test_crowded_cells_match_brute_force(spark, lat0, lon0, radius, most):
    rng = random.Random(5)
    points = crowded(rng, lat0, lon0, 300, 0.02)
    sites = crowded(rng, lat0, lon0, 90, 0.05)
    got = [(r.id, r.site) for r in facility.radius_pairs(*tables(spark, points, sites), radius, most=most).collect()]
    wanted = [(p[0], s[0]) for p, s in itertools.product(points, sites) if km(p[1:], s[1:]) <= radius]
    assert sorted(got) == sorted(wanted) and wanted


def test_half_of_all_points_in_one_cell_are_spread(spark):
    rng = random.Random(9)
    points = [(i, 10 + rng.uniform(0, 0.2) if i % 2 else rng.uniform(-60, 60), 10 + rng.uniform(0, 0.2) if i % 2 else rng.uniform(-170, 170))
              for i in range(4000)]
    left, _ = tables(spark, points, [])
    gridded = cells.grid_points(left, 50.0)
    assert gridded.groupBy("_band", "_cell").count().agg(F.max("count")).first()[0] >= 1000
    levels = cells.crowded_nodes(gridded, [], 50)
    leaves = cells.points_in_leaves(gridded, levels, [])
    sizes = leaves.groupBy(*cells.BASE, *cells.PLACE).count().agg(F.max("count"), F.sum("count")).first()
    assert sizes[0] <= 50 and sizes[1] == 4000 and len(levels) >= 2


def test_points_that_no_split_parts_stay_together(spark):
    same = [(i, 1.0, 1.0) for i in range(40)]
    left, right = tables(spark, same, [(0, 1.0, 1.0), (1, 3.0, 3.0)])
    levels = cells.crowded_nodes(cells.grid_points(left, 10.0), [], 5)
    assert len(levels) == cells.MAX_LEVEL // cells.STEP
    assert facility.radius_pairs(left, right, 10.0, most=5).count() == 40


def test_many_sites_at_one_leaf_are_dealt_into_slices(spark):
    points = [(i, 0.01 * i, 0.0) for i in range(4)]
    sites = [(i, 0.0001 * i, 0.0001) for i in range(100)]
    left, right = tables(spark, points, sites)
    placed, reaching = cells.in_slices(
        cells.points_in_leaves(cells.grid_points(left, 5.0), [], []), cells.sites_in_leaves(cells.grid_sites(right, 5.0), [], [], 5.0), [], 10)
    assert reaching.groupBy(*cells.BASE, *cells.PLACE, "_slice").count().agg(F.max("count")).first()[0] < 40
    got = sorted((r.id, r.site) for r in facility.radius_pairs(left, right, 5.0, most=10).collect())
    assert got == sorted((p[0], s[0]) for p in points for s in sites if km(p[1:], s[1:]) <= 5.0)


def test_nulls_and_empty_tables(spark):
    left, right = tables(spark, [(1, None, 0.0), (2, 0.0, None), (3, 0.0, 0.0)], [(1, 0.0, 0.0), (2, None, None)])
    assert [(r.id, r.site) for r in facility.radius_pairs(left, right, 1.0).collect()] == [(3, 1)]
    assert facility.radius_pairs(left.limit(0), right, 1.0).count() == 0
    assert facility.radius_pairs(left, right.limit(0), 1.0).count() == 0


def test_keys_keep_areas_apart(spark):
    rows = [(a, i, 0.001 * i, 0.0) for a in "xy" for i in range(30)]
    left = spark.createDataFrame(rows, "area string, id int, latitude double, longitude double")
    right = spark.createDataFrame([("x", 0, 0.0, 0.0), ("y", 1, 0.02, 0.0)], "area string, site int, site_latitude double, site_longitude double")
    got = facility.radius_pairs(left, right, 1.0, ["area"], most=4).groupBy("area").count().collect()
    wanted = {a: sum(km((0.001 * i, 0.0), s) <= 1.0 for i in range(30)) for a, s in (("x", (0.0, 0.0)), ("y", (0.02, 0.0)))}
    assert {r.area: r["count"] for r in got} == wanted
