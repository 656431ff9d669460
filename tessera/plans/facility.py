"""Facility location: radius coverage, plan scoring and radius sensitivity for many areas.

Demand points are ``area_id, id, latitude, longitude, population, need, rate``; candidate sites are
``area_id, site_id, latitude, longitude`` (by default the points themselves). Points that share a
position and a covering set are folded before plans are scored, so scoring works on coverage
signatures, whose number depends on the candidate sites and not on the size of the demand table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import global_rank
from tessera.functions.scalar import haversine_km, reasons
from tessera.operators import cells

OK, LIMITED, REJECTED = "enumerated", "candidate-limit", "rejected"


@dataclass(frozen=True)
class FacilityConfig:
    max_facilities: int = 2
    facility_cost: float = 8000.0
    budget: float = 16000.0
    radius_km: float = 1.25
    min_priority_coverage: float = 0.60
    priority_share: float = 0.25
    cost_penalty: float = 0.15
    max_candidates: int = 1_000_000

    def __post_init__(self):
        if not 1 <= self.max_facilities <= 10 or not 0 < self.radius_km <= 100:
            raise ValueError("max_facilities or radius_km is out of range")
        if min(self.facility_cost, self.budget) <= 0 or not 0 < self.priority_share <= 1:
            raise ValueError("costs must be positive and priority_share lie in (0, 1]")
        if not 0 <= self.min_priority_coverage <= 1 or not 0 <= self.cost_penalty <= 1:
            raise ValueError("coverage floor and cost penalty lie in [0, 1]")


# --- radius join -------------------------------------------------------------------------------

def radius_pairs(
    points: DataFrame, sites: DataFrame, km: float, keys: Sequence[str] = (), most: int = cells.CELL_POINTS
) -> DataFrame:
    """Pairs within ``km``: an equi-join on cells that follow the density of points, then the distance.

    ``points`` has ``latitude, longitude``; ``sites`` has ``site_latitude, site_longitude``. Both
    sides should hold distinct positions; copies of one position are the caller's to fold. Cells with
    more than ``most`` points are split, see :mod:`tessera.operators.cells`. Positions with nulls pair with nothing.
    """
    gridded, spread = cells.grid_points(points, km), cells.grid_sites(sites, km)
    levels = cells.crowded_nodes(gridded, keys, most)
    placed = cells.points_in_leaves(gridded, levels, keys)
    reaching = cells.sites_in_leaves(spread, levels, keys, km)
    placed, reaching = cells.in_slices(placed, reaching, keys, most)
    inner = [c for c in (*cells.BASE, *cells.PLACE, "_slice") if c in placed.columns]
    distance = haversine_km(
        F.col("latitude"), F.col("longitude"), F.col("site_latitude"), F.col("site_longitude")
    )
    return (
        placed.join(reaching, [*keys, *inner])
        .withColumn("distance_km", distance)
        .filter(F.col("distance_km") <= km)
        .drop(*inner)
    )


def covered_by_any(points: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """Points within ``km`` of at least one site."""
    spots = points.select("latitude", "longitude").distinct()
    places = sites.select(
        F.col("latitude").alias("site_latitude"), F.col("longitude").alias("site_longitude")
    ).distinct()
    near = radius_pairs(spots, places, km).select("latitude", "longitude").distinct()
    return points.join(near, ["latitude", "longitude"], "left_semi")


# --- demand ------------------------------------------------------------------------------------

def point_issues(points: DataFrame) -> DataFrame:
    """Points that break a row rule, with every reason."""
    checks = reasons(
        (~F.col("latitude").between(-90, 90), "latitude outside -90..90"),
        (~F.col("longitude").between(-180, 180), "longitude outside -180..180"),
        (F.col("population") < 0, "population is negative"),
        (F.col("need") < 0, "estimated need is negative"),
        (F.col("need") > F.col("population"), "estimated need cannot exceed population"),
        (~F.col("rate").between(0, 100), "priority rate outside 0..100"),
    )
    return points.withColumn("issues", checks).filter(F.size("issues") > 0)


def area_totals(points: DataFrame, config: FacilityConfig) -> DataFrame:
    """Totals and guards per area: points, need, size of the priority group."""
    keyed = points.groupBy("area_id", "id").agg(
        F.count("*").alias("_copies"), F.first("need").alias("need")
    )
    per = keyed.groupBy("area_id").agg(
        F.sum("_copies").alias("points"), F.max("_copies").alias("_most"), F.sum("need").alias("total_need")
    )
    return per.select(
        "area_id", "points", "total_need",
        F.greatest(F.lit(1), F.ceil(F.col("points") * config.priority_share)).alias("priority_points"),
        F.when(F.col("_most") > 1, "demand point ids must be unique")
        .when(F.col("total_need") <= 0, "facility optimization requires positive estimated need")
        .alias("rejection"),
    )


def top_share(points: DataFrame, share: float) -> DataFrame:
    """The leading ``max(1, ceil(n * share))`` points of each area by rate, need and id."""
    ranked = global_rank(
        points, ["area_id"], [F.desc("rate"), F.desc("need"), F.col("id")], "priority_rank", "_n"
    )
    limit = F.greatest(F.lit(1), F.ceil(F.col("_n") * share))
    return ranked.filter(F.col("priority_rank") <= limit).drop("_n")


def _folded(points: DataFrame, config: FacilityConfig) -> DataFrame:
    """Demand per area and position: points, need, priority need."""
    ranked = global_rank(
        points, ["area_id"], [F.desc("rate"), F.desc("need"), F.col("id")], "_rank", "_n"
    )
    first = F.col("_rank") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * config.priority_share))
    return ranked.groupBy("area_id", "latitude", "longitude").agg(
        F.count("*").alias("points"),
        F.sum("need").alias("need"),
        F.sum(F.when(first, F.col("need")).otherwise(0.0)).alias("priority_need"),
    )


def coverage_signatures(spots: DataFrame, sites: DataFrame, km: float, radii: Sequence[float]) -> DataFrame:
    """Demand folded by the exact set of covering sites, for every radius in one distance pass."""
    places = sites.select(
        "area_id", "site_id", F.col("latitude").alias("site_latitude"),
        F.col("longitude").alias("site_longitude"),
    )
    pairs = radius_pairs(spots, places, km, ["area_id"])
    within = F.explode(F.array_compact(F.array(*[
        F.when(F.col("distance_km") <= r, F.lit(float(r))) for r in radii
    ])))
    # the set of sites that cover one position is bounded by the area's candidate sites
    return (
        pairs.select("area_id", "latitude", "longitude", "site_id", "points", "need", "priority_need", within.alias("radius_km"))
        .groupBy("area_id", "radius_km", "latitude", "longitude")
        .agg(
            F.sort_array(F.collect_set("site_id")).alias("signature"),
            F.first("points").alias("points"),
            F.first("need").alias("need"),
            F.first("priority_need").alias("priority_need"),
        )
        .groupBy("area_id", "radius_km", "signature")
        .agg(
            F.sum("points").alias("points"), F.sum("need").alias("need"),
            F.sum("priority_need").alias("priority_need"),
        )
    )


# --- plans -------------------------------------------------------------------------------------

def site_combinations(sites: DataFrame, largest: int) -> DataFrame:
    """Every combination of one to ``largest`` sites of an area, built by extending sorted ones."""
    single = sites.select("area_id", F.array("site_id").alias("selected_ids"), F.col("site_id").alias("_last"))
    level, levels = single, [single]
    for _ in range(largest - 1):
        level = (
            level.join(sites.select("area_id", "site_id"), "area_id")
            .filter(F.col("site_id") > F.col("_last"))
            .select("area_id", F.array_append("selected_ids", F.col("site_id")).alias("selected_ids"),
                    F.col("site_id").alias("_last"))
        )
        levels.append(level)
    out = levels[0]
    for more in levels[1:]:
        out = out.unionByName(more)
    return out.drop("_last")


def _combination_count(n: Column, largest: int) -> Column:
    """Sum of n-choose-m for m = 1..largest, as a double so that it cannot overflow."""
    total, term = F.lit(0.0), F.lit(1.0)
    for m in range(1, largest + 1):
        term = term * F.greatest(n - (m - 1), F.lit(0)) / m
        total = total + term
    return total


def candidate_guard(sites: DataFrame, totals: DataFrame, config: FacilityConfig) -> DataFrame:
    """Status of each area before plans are enumerated; too many candidates is a row, not an error."""
    counted = sites.groupBy("area_id").agg(F.count_distinct("site_id").alias("sites"))
    rows = totals.join(counted, "area_id", "left").withColumn(
        "candidate_plans", _combination_count(F.coalesce("sites", F.lit(0)), config.max_facilities)
    )
    too_many = F.col("candidate_plans") > config.max_candidates
    return rows.select(
        "area_id", "points", "total_need", "sites", "candidate_plans",
        F.when(F.col("rejection").isNotNull(), REJECTED).when(F.col("sites").isNull(), REJECTED)
        .when(too_many, LIMITED).otherwise(OK).alias("status"),
        F.coalesce(
            F.col("rejection"),
            F.when(F.col("sites").isNull(), "facility optimization requires candidate sites"),
            F.when(too_many, F.lit(f"more than {config.max_candidates} candidate plans")),
        ).alias("failure_reason"),
    )


def facility_plans(
    points: DataFrame, config: FacilityConfig = FacilityConfig(), sites: DataFrame | None = None,
    radii: Sequence[float] | None = None,
) -> DataFrame:
    """Every plan of every enumerable area, feasible or not, for each service radius."""
    radii = sorted(set(radii or [config.radius_km]))
    if sites is None:
        sites = points.select("area_id", F.col("id").alias("site_id"), "latitude", "longitude")
    guard = candidate_guard(sites, area_totals(points, config), config)
    usable = guard.filter(F.col("status") == OK).select("area_id", "total_need")
    sites = sites.join(usable, "area_id", "left_semi")
    spots = _folded(points.join(usable, "area_id", "left_semi"), config)
    priority = spots.groupBy("area_id").agg(F.sum("priority_need").alias("total_priority"))
    signatures = coverage_signatures(spots, sites, max(radii), radii).withColumn(
        "_sig", F.xxhash64("signature")
    )
    combos = site_combinations(sites, config.max_facilities).withColumn(
        "radius_km", F.explode(F.array(*[F.lit(float(r)) for r in radii]))
    )
    by_site = signatures.withColumn("_site", F.explode("signature")).drop("_sig")
    plan_key = ["area_id", "radius_km", "selected_ids"]
    covered = (
        combos.withColumn("_site", F.explode("selected_ids"))
        .join(by_site, ["area_id", "radius_km", "_site"])
        # a signature reached through two sites of one plan counts once: take it at its first site
        .filter(
            F.col("_site") == F.get(F.array_intersect("selected_ids", "signature"), F.lit(0))
        )
        .groupBy(*plan_key)
        .agg(
            F.sum("points").alias("covered_points"), F.sum("need").alias("_need"),
            F.sum("priority_need").alias("_priority"),
        )
    )
    rows = (
        combos.join(covered, plan_key, "left").join(usable, "area_id").join(priority, "area_id")
        .withColumn("_need", F.coalesce("_need", F.lit(0.0)))
        .withColumn("_priority", F.coalesce("_priority", F.lit(0.0)))
        .withColumn("cost", F.size("selected_ids") * F.lit(config.facility_cost))
    )
    overall = F.col("_need") / F.col("total_need")
    first = F.when(F.col("total_priority") != 0, F.col("_priority") / F.nullif("total_priority", F.lit(0.0))).otherwise(1.0)
    rows = rows.withColumn("_overall", overall).withColumn("_first", first)
    cost, floor = F.col("cost"), config.min_priority_coverage
    return rows.select(
        "area_id", "radius_km", "selected_ids",
        F.coalesce("covered_points", F.lit(0)).cast("long").alias("covered_points"),
        F.round("cost", 6).alias("cost"),
        F.round("_need", 6).alias("estimated_need_covered"),
        F.round("_overall", 9).alias("overall_coverage_rate"),
        F.round("_first", 9).alias("priority_coverage_rate"),
        F.round(F.col("_overall") - config.cost_penalty * (cost / config.budget), 9).alias("objective_score"),
        ((cost <= config.budget) & (F.col("_first") >= floor)).alias("feasible"),
        reasons(
            (F.abs(cost - config.budget) < 1e-9, "budget"),
            (F.abs(F.col("_first") - floor) < 1e-9, "minimum-priority-coverage"),
        ).alias("binding_constraints"),
    )


def plan_coverage(plans: DataFrame, points: DataFrame, sites: DataFrame, km: float) -> DataFrame:
    """Long table of the points each plan covers, every point once per plan."""
    places = sites.select(
        "area_id", "site_id", F.col("latitude").alias("site_latitude"),
        F.col("longitude").alias("site_longitude"),
    )
    near = radius_pairs(points.select("area_id", "id", "latitude", "longitude"), places, km, ["area_id"])
    return (
        plans.select("area_id", "selected_ids", F.explode("selected_ids").alias("site_id"))
        .join(near.select("area_id", "site_id", "id"), ["area_id", "site_id"])
        .select("area_id", "selected_ids", F.col("id").alias("covered_id"))
        .distinct()
    )


def best_plan(plans: DataFrame) -> DataFrame:
    """Best feasible plan per area and radius: score, coverage, cost, ids."""
    key = F.struct(
        (-F.col("objective_score")).alias("s"), (-F.col("overall_coverage_rate")).alias("c"),
        F.col("cost"), F.col("selected_ids"),
    )
    chosen = plans.filter("feasible").groupBy("area_id", "radius_km").agg(
        F.min_by(
            F.struct("selected_ids", "objective_score", "overall_coverage_rate",
                     "priority_coverage_rate", "cost", "covered_points"), key
        ).alias("b")
    )
    return chosen.select("area_id", "radius_km", "b.*")


def radius_sweep(
    points: DataFrame, radii: Sequence[float], config: FacilityConfig = FacilityConfig(),
    sites: DataFrame | None = None,
) -> DataFrame:
    """Does the selected plan survive another service radius: stable, reversed or inconclusive."""
    tested = [r for r in sorted(set(radii)) if abs(r - config.radius_km) >= 1e-12]
    if not tested:
        raise ValueError("at least one distinct sensitivity radius is required")
    plans = facility_plans(points, config, sites, [config.radius_km, *tested])
    best = best_plan(plans)
    base = best.filter(F.col("radius_km") == config.radius_km).select(
        "area_id", F.col("selected_ids").alias("baseline_ids")
    )
    grid = base.withColumn("radius_km", F.explode(F.array(*[F.lit(float(r)) for r in tested])))
    rows = grid.join(best.select("area_id", "radius_km", "selected_ids"), ["area_id", "radius_km"], "left")
    return rows.select(
        "area_id", "baseline_ids", F.col("radius_km").alias("tested_radius_km"), "selected_ids",
        F.when(F.col("selected_ids").isNull(), "inconclusive")
        .when(F.col("selected_ids") == F.col("baseline_ids"), "stable")
        .otherwise("reversed").alias("outcome"),
    )
