"""Semantic tables: geographies, the seed graph, and their integrity checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import reasons
from tessera.operators.joins import fk_violations

# Evidence a graph edge or an observation may carry.
EDGE_EVIDENCE = ("observed", "estimated", "proposed")


def geographies(catalog: DataFrame) -> DataFrame:
    """Countries (distinct) and cities with their country as parent."""
    countries = catalog.select("country_code").distinct().select(
        F.concat(F.lit("country."), F.lower("country_code")).alias("geography_id"), F.lit("country").alias("kind"),
        F.col("country_code").alias("name"), F.lit(None).cast("string").alias("parent_id"),
    )
    cities = catalog.select(
        F.col("city_id").cast("string").alias("geography_id"), F.lit("city").alias("kind"), F.col("name"),
        F.concat(F.lit("country."), F.lower("country_code")).alias("parent_id"),
    )
    return countries.unionByName(cities)


def seed_graph(catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices for countries and cities and one located-in edge per city."""
    places = geographies(catalog)
    nodes = places.select(F.concat(F.lit("node."), "geography_id").alias("id"), "kind", F.col("name").alias("label"))
    edges = places.filter(F.col("parent_id").isNotNull()).select(
        F.concat(F.lit("edge."), "geography_id", F.lit(".located-in")).alias("id"),
        F.lit("located-in").alias("kind"),
        F.concat(F.lit("node."), "geography_id").alias("source"),
        F.concat(F.lit("node."), "parent_id").alias("target"),
        F.lit("observed").alias("evidence_type"),
    )
    return nodes, edges


def graph_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Repeated ids, dangling endpoints and evidence a graph may not carry."""
    def repeated(table: DataFrame, name: str) -> DataFrame:
        return table.groupBy("id").agg(F.count("*").alias("rows")).filter("rows > 1").select(
            F.lit(f"duplicate {name} id").alias("relation"), F.col("id").alias("reference"), "rows"
        )

    typed = edges.filter(~F.col("evidence_type").isin(*EDGE_EVIDENCE)).select(
        F.lit("edge evidence type not allowed").alias("relation"), F.col("id").alias("reference"),
        F.lit(1).cast("long").alias("rows"),
    )
    out = repeated(nodes, "node").unionByName(repeated(edges, "edge")).unionByName(typed)
    for end in ("source", "target"):
        out = out.unionByName(fk_violations(edges, nodes, end, "id", f"edge {end} does not exist"))
    return out


def bundle_violations(tables: dict[str, DataFrame]) -> DataFrame:
    """Referential checks of a semantic bundle.

    Expects ``geographies(geography_id, parent_id)``, ``measures(measure_id)``,
    ``observations(observation_id, geography_id, measure_id)``, ``facilities(facility_id,
    geography_id)``, ``events(event_id, geography_id)``.
    """
    g, m = tables["geographies"], tables["measures"]
    checks = [
        fk_violations(g, g, "parent_id", "geography_id", "geography parent"),
        fk_violations(tables["observations"], g, "geography_id", "geography_id", "observation geography"),
        fk_violations(tables["observations"], m, "measure_id", "measure_id", "observation measure"),
        fk_violations(tables["facilities"], g, "geography_id", "geography_id", "facility geography"),
        fk_violations(tables["events"], g, "geography_id", "geography_id", "event geography"),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out


def observation_violations(observations: DataFrame) -> DataFrame:
    """Rows that break an observation rule, with every reason.

    ``observation_id, evidence_type, method, minimum, maximum, value, start, end``.
    """
    value = F.col("value")
    issues = reasons(
        (~F.col("evidence_type").isin("observed", "estimated"), "evidence type not allowed"),
        ((F.col("evidence_type") == "estimated") & (F.coalesce(F.trim("method"), F.lit("")) == ""),
         "estimated observations require a method"),
        (F.col("minimum") > F.col("maximum"), "measure range is not ordered"),
        ((value < F.col("minimum")) | (value > F.col("maximum")), "value lies outside the measure range"),
        (F.col("start") >= F.col("end"), "interval start must precede its end"),
    )
    return observations.withColumn("issues", issues).filter(F.size("issues") > 0)
