"""Faceted catalog search and detail lookup over tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import search_key
from tessera.operators.postings import TextIndex, build_index, folded, joined
from tessera.operators.select import paginate

# Name of the one field of an index over joined columns.
NORMALISED = "joined"


def facets(df: DataFrame, wanted: Mapping[str, str | None]) -> DataFrame:
    """Keep rows equal to every given facet; filters stay on raw columns and reach the scan."""
    for column, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(column) == value)
    return df


def text_any(df: DataFrame, columns: Sequence[str], text: str | None, index: TextIndex | None = None) -> DataFrame:
    """Case-insensitive substring in any of the columns; an index over them narrows the rows first."""
    if not text:
        return df
    if index is not None:
        df = index.narrowed(df, columns, text.lower())
    needle = F.lit(text.lower())
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(column).cast("string")), needle), F.lit(False))
    return df.filter(hit)


def text_normalised(df: DataFrame, columns: Sequence[str], text: str | None, index: TextIndex | None = None) -> DataFrame:
    """Substring of the joined columns after folding punctuation, so ``cool roof`` finds ``cool-roof``."""
    if not text:
        return df
    if index is not None:
        key = re.sub("[^a-z0-9]+", " ", text.lower()).strip(" ")
        df = index.narrowed(df, [NORMALISED], key)
    return df.filter(F.contains(joined(columns), search_key(F.lit(text))))


def index_any(rows: DataFrame, ident: str, columns: Sequence[str], folder: str | None = None) -> TextIndex:
    """Index for :func:`text_any` over these columns or some of them."""
    return build_index(rows, ident, {column: folded(column) for column in columns}, folder)


def index_normalised(rows: DataFrame, ident: str, columns: Sequence[str], folder: str | None = None) -> TextIndex:
    """Index for :func:`text_normalised` over exactly these columns."""
    return build_index(rows, ident, {NORMALISED: joined(columns)}, folder)


# Columns that the text of a search is sought in.
CITY_TEXT = ("name", "city_id", "country_code")
SCENARIO_TEXT = ("execution_id", "title", "city_id", "suite")
PACK_TEXT = ("execution_id", "title", "city_id")
SOURCE_TEXT = ("source_id", "artifact_id", "name", "publisher")
DESIGN_TEXT = ("design_id", "title", "question", "family_id", "suite", "decision_type", "status")
FAMILY_TEXT = ("family_id", "title", "suite")


def search_cities(cities: DataFrame, tier=None, country=None, text=None, limit=25, offset=0, index=None) -> DataFrame:
    rows = facets(cities, {"tier": tier, "country_code": country.upper() if country else None})
    rows = text_any(rows, CITY_TEXT, text, index)
    return paginate(rows, [F.lower("name"), F.col("city_id")], limit, offset)


def search_scenarios(scenarios: DataFrame, kind=None, city=None, suite=None, status=None, text=None, limit=25, offset=0, index=None) -> DataFrame:
    rows = facets(scenarios, {"kind": kind, "city_id": city, "suite": suite, "status": status})
    rows = text_any(rows, SCENARIO_TEXT, text, index)
    return paginate(rows, ["kind", "execution_id"], limit, offset)


def search_packs(scenarios: DataFrame, city=None, status=None, text=None, limit=25, offset=0, index=None) -> DataFrame:
    """Decision packs are the deep and reference executions; standard screens are not packs."""
    rows = facets(scenarios.filter(F.col("kind").isin("deep", "reference")), {"city_id": city, "status": status})
    rows = text_any(rows, PACK_TEXT, text, index)
    return paginate(rows, ["execution_id"], limit, offset)


def search_sources(manifests: DataFrame, source=None, publisher=None, text=None, limit=25, offset=0, index=None) -> DataFrame:
    rows = text_any(facets(manifests, {"source_id": source}), ["publisher"], publisher, index)
    rows = text_any(rows, SOURCE_TEXT, text, index)
    return paginate(rows, ["source_id", "artifact_id"], limit, offset)


def search_designs(designs: DataFrame, suite=None, family=None, decision_type=None, status=None, readiness=None, text=None, limit=25, offset=0, index=None) -> DataFrame:
    rows = facets(designs, {
        "suite": suite, "family_id": family, "decision_type": decision_type, "status": status, "readiness": readiness,
    })
    return paginate(text_normalised(rows, DESIGN_TEXT, text, index), ["design_id"], limit, offset)


def search_families(families: DataFrame, suite=None, text=None, limit=25, offset=0, index=None) -> DataFrame:
    rows = text_normalised(facets(families, {"suite": suite}), FAMILY_TEXT, text, index)
    return paginate(rows, ["family_id"], limit, offset)


def lookup(rows: DataFrame, ident: str, value: str) -> DataFrame:
    """Detail by id; an unknown id is one row that says so."""
    asked = rows.sparkSession.range(1).select(F.lit(value).alias(ident))
    present = rows.filter(F.col(ident) == value).withColumn("found", F.lit(True))
    return asked.join(present, ident, "left").withColumn("found", F.coalesce("found", F.lit(False)))


def city_summaries(global_: DataFrame, standard: DataFrame, deep: DataFrame) -> list[DataFrame]:
    """The three tiers in one schema, ready for :func:`tessera.operators.joins.highest_tier`."""
    columns = ["city_id", "name", "country_code", "latitude", "longitude"]
    out = []
    for tier, table, metrics, capabilities in (
        ("G", global_, None, None), ("S", standard, "metric_count", None), ("D", deep, "metric_count", "capability_count"),
    ):
        out.append(table.select(
            *columns, F.lit(tier).alias("tier"),
            (F.col(metrics) if metrics else F.lit(0)).cast("long").alias("metric_count"),
            (F.col(capabilities) if capabilities else F.lit(0)).cast("long").alias("capability_count"),
        ))
    return out


def city_detail(cities: DataFrame, city_id: str, metrics: DataFrame, capabilities: DataFrame, sources: DataFrame) -> DataFrame:
    """One city with its metric, capability and provenance rows as arrays.

    The facts are filtered to the city before they are collected; a city has dozens of each.
    """
    def listed(table: DataFrame, name: str) -> DataFrame:
        fields = [c for c in table.columns if c != "city_id"]
        return table.filter(F.col("city_id") == city_id).groupBy("city_id").agg(
            F.sort_array(F.collect_list(F.struct(*fields))).alias(name)
        )

    rows = lookup(cities, "city_id", city_id)
    for table, name in ((metrics, "metrics"), (capabilities, "capabilities"), (sources, "sources")):
        rows = rows.join(listed(table, name), "city_id", "left")
    return rows


def library_overview(designs: DataFrame, families: DataFrame, by: str) -> DataFrame:
    """Designs and families per facet value, with the share of implemented designs."""
    counted = designs.groupBy(by).agg(
        F.count("*").alias("designs"), F.count_distinct("family_id").alias("families"),
        F.count_if(F.col("status") == "reference-implemented").alias("implemented"),
    )
    known = families.agg(F.count("*")).scalar()
    return counted.withColumn("library_families", known)


# The connectors whose landed files have a reader here.
SOURCE_CATALOG = (
    ("nasa-power-daily", "climate", "json"), ("world-bank-indicators", "country-context", "json"),
    ("nyc-311-service-requests", "municipal", "json"), ("cdc-places-tracts", "health", "json"),
    ("usgs-earthquakes", "hazard", "geojson"), ("openfema-declarations", "hazard", "json"),
    ("eurostat-statistics", "regional-statistics", "json-stat"), ("geonames-cities", "identity", "tsv"),
    ("census-acs-population", "population", "psv"), ("census-tigerweb-places", "boundary", "geojson"),
    ("municipal-service-requests", "municipal", "json"),
)


def source_catalog(spark, category: str | None = None) -> DataFrame:
    rows = spark.createDataFrame(SOURCE_CATALOG, "source_id string, category string, format string")
    return facets(rows, {"category": category})
