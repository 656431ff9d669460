"""Matching, lookup and reconciliation joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Coordinates are bucketed far wider than the tolerance, so nearly every row meets one bucket.
CELL_DEGREES = 1e-3


def tolerance_join(cities: DataFrame, series: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Match each city to the series at its coordinates: matched, unmatched or ambiguous.

    ``cities(city_id, latitude, longitude)``, ``series(artifact_id, latitude, longitude)``. Copies of
    one coordinate are folded before the join, so they cannot multiply.
    """
    def cell(name: str, shift: float = 0.0):
        return F.floor((F.col(name) + shift) / CELL_DEGREES).cast("long")

    places = series.groupBy("latitude", "longitude").agg(
        F.count("*").alias("_n"), F.min("artifact_id").alias("artifact_id")
    )
    both = [F.explode(F.array_distinct(F.array(cell(c, -tolerance), cell(c, tolerance)))) for c in ("latitude", "longitude")]
    spread = places.select(
        "*", both[0].alias("_x")
    ).select("*", both[1].alias("_y")).select(
        "_x", "_y", "_n", "artifact_id",
        F.col("latitude").alias("_lat"), F.col("longitude").alias("_lon"),
    )
    points = cities.select("latitude", "longitude").distinct().withColumns(
        {"_x": cell("latitude"), "_y": cell("longitude")}
    )
    near = points.join(spread, ["_x", "_y"]).filter(
        (F.abs(F.col("latitude") - F.col("_lat")) <= tolerance)
        & (F.abs(F.col("longitude") - F.col("_lon")) <= tolerance)
    ).groupBy("latitude", "longitude").agg(
        F.sum("_n").alias("matches"), F.min("artifact_id").alias("artifact_id")
    )
    rows = cities.join(near, ["latitude", "longitude"], "left").withColumn(
        "matches", F.coalesce("matches", F.lit(0)).cast("long")
    )
    return rows.withColumn(
        "status",
        F.when(F.col("matches") == 0, "unmatched").when(F.col("matches") == 1, "matched").otherwise("ambiguous"),
    ).withColumn("artifact_id", F.when(F.col("status") == "matched", F.col("artifact_id")))


def join_context(cities: DataFrame, context: DataFrame, indicators: Sequence[str]) -> DataFrame:
    """Attach every required country indicator; the absent ones are listed per city.

    ``context(indicator, country_code, value, position)`` becomes one row per country first; where a
    country repeats, the row with the highest position wins.
    """
    wide = (
        context.filter(F.col("indicator").isin(list(indicators)))
        .groupBy("country_code")
        .pivot("indicator", list(indicators))
        .agg(F.max_by("value", "position"))
    )
    rows = cities.join(wide, "country_code", "left")
    missing = F.array_compact(F.array(*[F.when(F.col(f"`{i}`").isNull(), F.lit(i)) for i in indicators]))
    return rows.withColumn("missing_indicators", missing).withColumn(
        "complete", F.size("missing_indicators") == 0
    )


def join_population(cities: DataFrame, population: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cities with their population by place id, and the cities whose row is missing."""
    keyed = cities.withColumn("geoid", F.concat("state_code", "place_code"))
    return keyed.join(population, "geoid"), keyed.join(population, "geoid", "left_anti")


def fk_violations(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, relation: str) -> DataFrame:
    """Distinct references of the child that no parent row carries, with how often they occur."""
    refs = child.filter(F.col(child_key).isNotNull()).groupBy(
        F.col(child_key).cast("string").alias("reference")
    ).agg(F.count("*").alias("rows"))
    known = parent.select(F.col(parent_key).cast("string").alias("reference"))
    return refs.join(known, "reference", "left_anti").select(F.lit(relation).alias("relation"), "reference", "rows")


def reconcile_sets(expected: DataFrame, actual: DataFrame, ident: str) -> DataFrame:
    """Ids on one side only, each labelled missing or unexpected."""
    left = expected.select(ident).distinct().withColumn("_e", F.lit(True))
    right = actual.select(ident).distinct().withColumn("_a", F.lit(True))
    both = left.join(right, ident, "full_outer").filter(F.col("_e").isNull() | F.col("_a").isNull())
    return both.select(ident, F.when(F.col("_a").isNull(), "missing").otherwise("unexpected").alias("issue"))


# Deeper tiers win.
TIER_RANK = {"D": 0, "S": 1, "G": 2}


def highest_tier(*tiers: DataFrame) -> DataFrame:
    """One row per city id, taken from its deepest tier. Inputs share ``city_id, name, tier``."""
    rows = tiers[0]
    for more in tiers[1:]:
        rows = rows.unionByName(more)
    rank = F.create_map(*[F.lit(x) for pair in TIER_RANK.items() for x in pair])[F.col("tier")]
    names = rows.columns
    picked = rows.groupBy("city_id").agg(F.min_by(F.struct(*names), rank).alias("_r"))
    return picked.select("_r.*")


def expand(cities: DataFrame, templates: Mapping[str, str]) -> DataFrame:
    """Every city with every template (id -> suite), as a projection over the fixed template list."""
    listed = F.array(*[
        F.struct(F.lit(i + 1).alias("template_order"), F.lit(t).alias("template_id"), F.lit(s).alias("suite"))
        for i, (t, s) in enumerate(templates.items())
    ])
    return cities.select("*", F.explode(listed).alias("_t")).select("*", "_t.*").drop("_t").withColumn(
        "scenario_id", F.format_string("tierd.%s.%02d", F.col("city_id").cast("string"), F.col("template_order"))
    )


def check_registry(registry: DataFrame, packs: DataFrame) -> DataFrame:
    """Aligned id and hash arrays of the registry against the hashes of the packs themselves.

    ``registry(city_id, pack_ids, pack_hashes)``, ``packs(pack_id, content_hash)``.
    """
    uneven = registry.filter(F.size("pack_ids") != F.size("pack_hashes")).select(
        F.col("city_id").alias("key"), F.lit("array lengths differ").alias("issue")
    )
    entries = registry.filter(F.size("pack_ids") == F.size("pack_hashes")).select(
        F.explode(F.arrays_zip("pack_ids", "pack_hashes")).alias("e")
    ).select(F.col("e.pack_ids").alias("key"), F.col("e.pack_hashes").alias("declared"))
    compared = entries.join(
        packs.select(F.col("pack_id").alias("key"), F.col("content_hash").alias("found")), "key", "full_outer"
    )
    issue = (
        F.when(F.col("found").isNull(), "pack is missing")
        .when(F.col("declared").isNull(), "pack is not registered")
        .when(F.col("found") != F.col("declared"), "content hash differs")
    )
    return compared.select("key", issue.alias("issue")).filter(F.col("issue").isNotNull()).unionByName(uneven)


def join_designs(designs: DataFrame, families: DataFrame) -> DataFrame:
    """Designs with their family's title and suite; a design without a family keeps nulls."""
    return designs.join(
        families.select("family_id", F.col("title").alias("family_title"), F.col("suite").alias("family_suite")),
        "family_id", "left",
    )


def mapping_issues(designs: DataFrame, templates: DataFrame) -> DataFrame:
    """Template references of designs must match the templates one to one."""
    authored = designs.filter(F.col("template_ref").isNotNull()).groupBy(
        F.col("template_ref").alias("template_id")
    ).agg(F.count("*").alias("designs"))
    both = authored.join(
        templates.select("template_id").distinct().withColumn("_t", F.lit(True)), "template_id", "full_outer"
    )
    issue = (
        F.when(F.col("designs").isNull(), "template has no design")
        .when(F.col("_t").isNull(), "design refers to an unknown template")
        .when(F.col("designs") > 1, "template has several designs")
    )
    return both.select("template_id", issue.alias("issue")).filter(F.col("issue").isNotNull())
