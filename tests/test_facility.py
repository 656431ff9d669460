import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions.scalar import haversine_km
from tessera.plans import facility as f

SCHEMA = "area_id string, id string, latitude double, longitude double, population long, need double, rate double"
CFG = f.FacilityConfig(max_facilities=2, facility_cost=10, budget=20, radius_km=1.0,
                       min_priority_coverage=1.0, priority_share=0.34)


def three(spark, needs=(50.0, 30.0, 20.0), rates=(50.0, 30.0, 20.0)):
    rows = [("x", n, 0.0, lon, int(pop), need, rate) for n, lon, pop, need, rate in zip(
        "abc", (0.0, 0.005, 0.03), (50, 30, 20), needs, rates)]
    return spark.createDataFrame(rows, SCHEMA)


def km(a, b):
    lat1, lon1, lat2, lon2 = map(math.radians, (*a, *b))
    h = math.sin((lat2 - lat1) / 2) ** 2 + math.cos(lat1) * math.cos(lat2) * math.sin((lon2 - lon1) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(h))


def test_distance(spark):
    row = spark.range(1).select(
        haversine_km(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)).alias("a"),
        haversine_km(F.lit(42.0), F.lit(-71.0), F.lit(42.0), F.lit(-71.0)).alias("b")).collect()[0]
    assert row.a == pytest.approx(111.195, rel=1e-4) and row.b == 0


def test_all_plans_are_kept(spark):
    plans = f.facility_plans(three(spark), CFG).collect()
    assert len(plans) == 6 and {p.feasible for p in plans} == {True, False}
    by = {tuple(p.selected_ids): p for p in plans}
    assert by[("a",)].estimated_need_covered == 80 and by[("a",)].covered_points == 2
    assert by[("a", "c")].overall_coverage_rate == 1.0
    assert "budget" in by[("a", "b")].binding_constraints
    best = f.best_plan(f.facility_plans(three(spark), CFG)).collect()[0]
    # score 0.8 - 0.15 * 10/20 = 0.725 against 1.0 - 0.15 = 0.85
    assert best.selected_ids == ["a", "c"] and best.objective_score == pytest.approx(0.85)


def test_zero_priority_need_counts_as_covered(spark):
    pts = three(spark, needs=(0.0, 30.0, 20.0), rates=(90.0, 10.0, 5.0))
    cfg = f.FacilityConfig(1, 10, 20, 1.0, 0.6, 0.30)
    assert {p.priority_coverage_rate for p in f.facility_plans(pts, cfg).collect()} == {1.0}


def test_infeasible_budget_has_no_best(spark):
    cfg = f.FacilityConfig(2, 10, 5, 1.0, 0.0, 0.34)
    plans = f.facility_plans(three(spark), cfg)
    assert plans.count() == 6 and f.best_plan(plans).count() == 0


def test_guards_are_rows(spark):
    zero = three(spark, needs=(0.0, 0.0, 0.0)).withColumn("area_id", F.lit("zero"))
    twice = three(spark).unionByName(three(spark)).withColumn("area_id", F.lit("twice"))
    pts = three(spark).unionByName(zero).unionByName(twice)
    sites = pts.select("area_id", F.col("id").alias("site_id"), "latitude", "longitude")
    guard = {r.area_id: r for r in f.candidate_guard(sites, f.area_totals(pts, CFG), CFG).collect()}
    assert guard["x"].status == "enumerated" and guard["x"].candidate_plans == 6
    assert guard["zero"].status == guard["twice"].status == "rejected"
    small = f.FacilityConfig(max_candidates=5)
    assert f.candidate_guard(sites, f.area_totals(pts, small), small).filter("area_id = 'x'").collect()[0].status == "candidate-limit"
    assert {r.area_id for r in f.facility_plans(pts, CFG).collect()} == {"x"}


@pytest.mark.parametrize("lat0,spread,radius", [(0.0, 0.05, 1.0), (78.0, 0.5, 30.0), (-89.5, 0.5, 20.0), (45.0, 2.0, 90.0)])
def test_radius_pairs_match_brute_force(spark, lat0, spread, radius):
    rng = random.Random(7)
    pts = [(i, max(-90, min(90, lat0 + rng.uniform(-spread, spread))), rng.choice([179.9, -179.95, 0.0, 12.3]) + rng.uniform(-spread, spread))
           for i in range(120)]
    pts = [(i, la, ((lo + 180) % 360) - 180) for i, la, lo in pts]
    left = spark.createDataFrame(pts, "id int, latitude double, longitude double")
    right = left.select(F.col("id").alias("site"), F.col("latitude").alias("site_latitude"), F.col("longitude").alias("site_longitude"))
    got = sorted((r.id, r.site) for r in f.radius_pairs(left, right, radius).collect())
    expected = sorted((a[0], b[0]) for a, b in itertools.product(pts, pts) if km(a[1:], b[1:]) <= radius)
    assert got == expected


def test_plans_match_brute_force_with_copies(spark):
    rng = random.Random(3)
    spots = [(rng.uniform(0, 0.05), rng.uniform(0, 0.05)) for _ in range(6)]
    rows = [("x", f"p{i:02d}", *spots[i % 6 if i < 30 else 0], 100, float(rng.randint(1, 50)), float(rng.randint(0, 40))) for i in range(40)]
    sites = [(f"s{i}", *spots[i]) for i in range(4)]
    pts = spark.createDataFrame(rows, SCHEMA)
    s = spark.createDataFrame([("x", *x) for x in sites], "area_id string, site_id string, latitude double, longitude double")
    cfg = f.FacilityConfig(3, 10, 20, 2.0, 0.5, 0.25)
    got = {tuple(p.selected_ids): p for p in f.facility_plans(pts, cfg, s).collect()}
    first = {r[1] for r in sorted(rows, key=lambda r: (-r[6], -r[5], r[1]))[:10]}
    for n in (1, 2, 3):
        for combo in itertools.combinations(sites, n):
            cov = [r for r in rows if any(km(r[2:4], c[1:]) <= 2.0 for c in combo)]
            p = got[tuple(c[0] for c in combo)]
            assert p.covered_points == len(cov)
            assert p.estimated_need_covered == pytest.approx(sum(r[5] for r in cov))
            assert p.priority_coverage_rate == pytest.approx(
                sum(r[5] for r in cov if r[1] in first) / sum(r[5] for r in rows if r[1] in first))
    long = f.plan_coverage(f.facility_plans(pts, cfg, s), pts, s, 2.0).groupBy("selected_ids").count().collect()
    assert {tuple(r.selected_ids): r["count"] for r in long} == {k: v.covered_points for k, v in got.items() if v.covered_points}
    assert f.covered_by_any(pts, s, 2.0).count() == len([r for r in rows if any(km(r[2:4], c[1:]) <= 2.0 for c in sites)])


def test_radius_sweep(spark):
    rows = {r.tested_radius_km: r.outcome for r in f.radius_sweep(three(spark), [1.0, 0.1, 5.0], CFG).collect()}
    assert set(rows) == {0.1, 5.0} and rows[5.0] == "reversed" and rows[0.1] in {"stable", "reversed"}


def test_point_rules(spark):
    bad = spark.createDataFrame([("x", "a", 95.0, 0.0, 5, 9.0, 120.0)], SCHEMA)
    assert len(f.point_issues(bad).collect()[0].issues) == 3 and f.point_issues(three(spark)).count() == 0
