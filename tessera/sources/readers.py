"""Readers for landed public files.

Every reader has two halves: ``parse_*`` works on a table of document texts (``artifact, content``)
or of raw string columns, and ``read_*`` feeds it from files. Bad input never fails a job: rows carry
an ``issue`` that is null for good rows, so a caller splits good from quarantined with one filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.scalar import aware_timestamp, is_finite, reasons
from tessera.functions.hashing import digest


def landed_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole landed documents, one row per file."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_name").alias("artifact"), F.col("value").alias("content")
    )


def split_issues(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and quarantined rows."""
    return rows.filter(F.col("issue").isNull()).drop("issue"), rows.filter(F.col("issue").isNotNull())


# --- climate -----------------------------------------------------------------------------------

CLIMATE = (
    "header struct<fill_value:double>, geometry struct<coordinates:array<double>>, "
    "properties struct<parameter:map<string,map<string,string>>>"
)


def parse_param_series(texts: DataFrame, parameters: Sequence[str], max_days: int = 367) -> DataFrame:
    """Climate point series: ``artifact, longitude, latitude, parameter, day, value, is_fill, issue``.

    A requested parameter that is absent, a day key that is no date, and a value that is no finite
    number each yield a row with the reason.
    """
    doc = texts.select("artifact", F.from_json("content", CLIMATE).alias("d"))
    wanted = F.explode(F.array(*[F.lit(p) for p in parameters]))
    series = doc.select(
        "artifact", F.col("d.header.fill_value").alias("fill_value"),
        F.get(F.col("d.geometry.coordinates"), F.lit(0)).alias("longitude"),
        F.get(F.col("d.geometry.coordinates"), F.lit(1)).alias("latitude"),
        F.col("d.properties.parameter").alias("p"), wanted.alias("parameter"),
    ).withColumn("s", F.try_element_at("p", F.col("parameter")))
    rows = series.select(
        "artifact", "longitude", "latitude", "parameter", "fill_value", F.size("s").alias("_days"),
        F.explode_outer("s").alias("key", "text"),
    )
    day = F.to_date(F.try_to_timestamp("key", F.lit("yyyyMMdd")))
    value = F.expr("try_cast(text AS DOUBLE)")
    issue = (
        F.when(F.col("_days").isNull() | (F.col("_days") < 1), "parameter series is missing")
        .when(F.col("_days") > max_days, "series is longer than its window")
        .when(day.isNull(), "day key is not a date")
        .when(~is_finite(value), "value is not a finite number")
    )
    return rows.select(
        "artifact", "longitude", "latitude", "parameter", day.alias("day"), value.alias("value"),
        F.coalesce(value == F.col("fill_value"), F.lit(False)).alias("is_fill"), issue.alias("issue"),
    )


def read_param_series(spark: SparkSession, path: str, parameters: Sequence[str]) -> DataFrame:
    return parse_param_series(landed_texts(spark, path), parameters)


def fill_counts(series: DataFrame) -> DataFrame:
    """Values and fill markers per artifact."""
    return series.groupBy("artifact").agg(
        F.count("value").alias("values"), F.count_if("is_fill").alias("fill_values")
    )


# --- country indicators --------------------------------------------------------------------------

INDICATOR_ROWS = (
    "array<struct<indicator:struct<id:string>,country:struct<id:string,value:string>,date:string,value:string>>"
)


def parse_indicator_pages(texts: DataFrame) -> DataFrame:
    """Indicator pages ``[meta, rows]``: one row per indicator and country, the last one winning."""
    page = F.from_json("content", "array<string>")
    rows = texts.select("artifact", F.from_json(F.get(page, F.lit(1)), INDICATOR_ROWS).alias("r")).select(
        "artifact", F.posexplode("r").alias("position", "row")
    )
    value = F.expr("try_cast(row.value AS DOUBLE)")
    good = rows.withColumn("value", value).filter(
        is_finite(F.col("value")) & F.col("row.country.id").isNotNull() & F.col("row.indicator.id").isNotNull()
    )
    return good.groupBy(
        F.col("row.indicator.id").alias("indicator"), F.col("row.country.id").alias("country_code")
    ).agg(F.max_by("value", F.struct("artifact", "position")).alias("value"))


def read_indicator_pages(spark: SparkSession, path: str) -> DataFrame:
    return parse_indicator_pages(landed_texts(spark, path))


def check_page(returned: DataFrame, declared: DataFrame) -> DataFrame:
    """Returned rows and page number against what was asked for.

    ``returned(artifact, rows, page)``, ``declared(artifact, row_limit, page)``.
    """
    both = returned.join(declared.withColumnRenamed("page", "asked_page"), "artifact", "left")
    return both.select("artifact", "rows", "row_limit", reasons(
        (F.col("row_limit").isNull(), "no declared limit"),
        (F.col("rows") > F.col("row_limit"), "more rows than the declared limit"),
        (F.col("page") != F.col("asked_page"), "returned page differs from the requested page"),
    ).alias("issues"))


# --- service requests ------------------------------------------------------------------------------

REQUEST = (
    "unique_key string, created_date string, closed_date string, agency string, complaint_type string, "
    "borough string, status string, latitude string, longitude string"
)


def parse_requests(lines: DataFrame, column: str = "value") -> DataFrame:
    """Service-request JSON lines with a reason on every unusable row."""
    rows = lines.select(F.from_json(column, REQUEST).alias("r")).select("r.*")
    created = F.try_to_timestamp("created_date")
    issue = F.when(
        F.coalesce(F.trim("unique_key"), F.lit("")) == "", "unique_key is missing"
    ).when(created.isNull(), "created_date is missing or not a timestamp")
    return rows.select(
        "unique_key", created.alias("created"), F.try_to_timestamp("closed_date").alias("closed"),
        F.upper(F.trim("agency")).alias("agency"), "complaint_type", F.upper(F.trim("borough")).alias("borough"),
        "status", F.expr("try_cast(latitude AS DOUBLE)").alias("latitude"),
        F.expr("try_cast(longitude AS DOUBLE)").alias("longitude"), issue.alias("issue"),
    )


def select_requests(
    rows: DataFrame, start, end, agency: str | None = None, borough: str | None = None,
    limit: int | None = None, offset: int = 0,
) -> DataFrame:
    """Half-open window, optional facets, and a stable page (a distributed top-k)."""
    rows = rows.filter((F.col("created") >= F.lit(start)) & (F.col("created") < F.lit(end)))
    if agency:
        rows = rows.filter(F.col("agency") == agency.upper())
    if borough:
        rows = rows.filter(F.col("borough") == borough.upper())
    if limit is not None:
        rows = rows.orderBy("created", "unique_key").offset(offset).limit(limit)
    return rows


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    return parse_requests(spark.read.text(path))


# --- health tracts ---------------------------------------------------------------------------------

# Prevalence measures of a tract record.
PREVALENCE = (
    "lacktrpt_crudeprev", "foodinsecu_crudeprev", "housinsecu_crudeprev", "isolation_crudeprev",
    "casthma_crudeprev", "copd_crudeprev", "chd_crudeprev",
)
TRACT = (
    "stateabbr string, countyfips string, tractfips string, totalpopulation string, "
    + ", ".join(f"{p} string" for p in PREVALENCE)
    + ", geolocation struct<type:string,coordinates:array<double>>"
)


def parse_tracts(texts: DataFrame) -> DataFrame:
    """Tract records of JSON documents, typed, with every broken rule listed in ``issues``."""
    rows = texts.select(F.explode(F.from_json("content", f"array<struct<{TRACT.replace(' ', ':').replace(',:', ',')}>>")).alias("r")).select("r.*")
    typed = rows.select(
        F.upper("stateabbr").alias("stateabbr"), "countyfips", "tractfips",
        F.expr("try_cast(totalpopulation AS BIGINT)").alias("population"),
        *[F.expr(f"try_cast({p} AS DOUBLE)").alias(p) for p in PREVALENCE],
        F.get("geolocation.coordinates", F.lit(0)).alias("longitude"),
        F.get("geolocation.coordinates", F.lit(1)).alias("latitude"),
        (F.col("geolocation.type") == "Point").alias("_point"),
    )
    issues = reasons(
        (~F.coalesce(F.col("tractfips").rlike("^[0-9]{11}$"), F.lit(False)), "tract id is not 11 digits"),
        (~F.coalesce(F.col("countyfips").rlike("^[0-9]{5}$"), F.lit(False)), "county id is not 5 digits"),
        (~F.coalesce(F.col("population") >= 0, F.lit(False)), "population is missing or negative"),
        (~F.coalesce(F.col("_point"), F.lit(False)), "location is not a point"),
        *[(~F.coalesce(F.col(p).between(0, 100), F.lit(False)), f"{p} outside 0..100") for p in PREVALENCE],
    )
    return typed.withColumn("issues", issues).drop("_point")


def demand_points(tracts: DataFrame, area: Column) -> DataFrame:
    """Demand points of good tracts: need is population times the transport-barrier rate."""
    return tracts.filter(F.size("issues") == 0).select(
        area.alias("area_id"), F.col("tractfips").alias("id"), "latitude", "longitude", "population",
        F.round(F.col("population") * F.col("lacktrpt_crudeprev") / 100, 6).alias("need"),
        F.col("lacktrpt_crudeprev").alias("rate"),
    )


# --- hazards ----------------------------------------------------------------------------------------

QUAKES = (
    "type string, metadata struct<generated:bigint>, features array<struct<id:string,"
    "properties:struct<mag:double,place:string,time:bigint>,geometry:struct<coordinates:array<double>>>>"
)


def parse_geojson_features(texts: DataFrame) -> DataFrame:
    """Earthquake features; a document that is no feature collection is one row with a reason."""
    doc = texts.select("artifact", F.from_json("content", QUAKES).alias("d"))
    bad = F.when(~F.coalesce(F.col("d.type") == "FeatureCollection", F.lit(False)), "payload is not a FeatureCollection")
    rows = doc.select("artifact", bad.alias("issue"), F.timestamp_millis("d.metadata.generated").alias("upstream_updated_at"),
                      F.explode_outer("d.features").alias("f"))
    return rows.select(
        "artifact", F.col("f.id").alias("event_id"), F.col("f.properties.mag").alias("magnitude"),
        F.timestamp_millis("f.properties.time").alias("occurred"), "upstream_updated_at",
        F.get("f.geometry.coordinates", F.lit(0)).alias("longitude"),
        F.get("f.geometry.coordinates", F.lit(1)).alias("latitude"), "issue",
    ).filter(F.col("issue").isNotNull() | F.col("event_id").isNotNull())


def select_quakes(rows: DataFrame, start, end, minimum_magnitude: float) -> DataFrame:
    return rows.filter(
        (F.col("occurred") >= F.lit(start)) & (F.col("occurred") < F.lit(end))
        & (F.col("magnitude") >= minimum_magnitude)
    )


DECLARATIONS = (
    "DisasterDeclarationsSummaries array<struct<disasterNumber:bigint,state:string,incidentType:string,"
    "declarationDate:string,lastRefresh:string>>"
)


def parse_declarations(texts: DataFrame) -> DataFrame:
    return texts.select("artifact", F.explode(F.from_json("content", DECLARATIONS)["DisasterDeclarationsSummaries"]).alias("r")).select(
        "artifact", F.col("r.disasterNumber").alias("disaster_number"), F.upper("r.state").alias("state"),
        F.col("r.incidentType").alias("incident_type"), aware_timestamp(F.col("r.declarationDate")).alias("declared"),
        aware_timestamp(F.col("r.lastRefresh")).alias("refreshed"),
        F.when(aware_timestamp(F.col("r.declarationDate")).isNull(), "declaration date is missing or has no zone").alias("issue"),
    )


def select_declarations(rows: DataFrame, start, end, state: str | None = None, incident_types: Sequence[str] | None = None) -> DataFrame:
    rows = rows.filter((F.col("declared") >= F.lit(start)) & (F.col("declared") < F.lit(end)))
    if state:
        rows = rows.filter(F.col("state") == state.upper())
    if incident_types:
        rows = rows.filter(F.col("incident_type").isin(list(incident_types)))
    return rows


def upstream_time(rows: DataFrame) -> DataFrame:
    return rows.groupBy("artifact").agg(F.max("refreshed").alias("upstream_updated_at"), F.count("*").alias("records"))


# --- JSON-stat ---------------------------------------------------------------------------------------

JSONSTAT = "class string, id array<string>, size array<bigint>, value map<string,string>"


def parse_jsonstat(texts: DataFrame, max_cells: int = 100_000) -> DataFrame:
    """Cells of JSON-stat cubes with the flat index unravelled into dimension positions."""
    doc = texts.select("artifact", F.from_json("content", JSONSTAT).alias("d")).select("artifact", "d.*")
    cells = F.aggregate("size", F.lit(1).cast("double"), lambda a, x: a * x)
    issue = (
        F.when(~F.coalesce(F.col("class") == "dataset", F.lit(False)), "payload is not a JSON-stat dataset")
        .when(F.col("id").isNull() | F.col("size").isNull() | F.col("value").isNull(), "structure is incomplete")
        .when(F.size("id") != F.size("size"), "id and size differ in length")
        .when(F.exists("size", lambda s: s < 0), "size is negative")
        .when(cells > max_cells, "more cells than the declared limit")
    )
    checked = doc.withColumn("issue", issue).withColumn(
        "value", F.when(F.col("issue").isNull(), F.col("value"))
    )
    rows = checked.select("artifact", "id", "size", "issue", F.explode_outer("value").alias("index", "text"))
    flat = F.expr("try_cast(index AS BIGINT)")
    # walk from the last dimension to the first, peeling one position off the index each time
    positions = F.aggregate(
        F.reverse("size"),
        F.struct(F.col("flat").alias("rest"), F.array().cast("array<bigint>").alias("p")),
        lambda s, n: F.struct(
            F.floor(s["rest"] / n).alias("rest"), F.concat(F.array(F.pmod(s["rest"], n)), s["p"]).alias("p")
        ),
        lambda s: s["p"],
    )
    return rows.withColumn("flat", flat).select(
        "artifact", "flat", "id",
        F.when(F.col("issue").isNull() & F.col("flat").isNotNull(), positions).alias("positions"),
        F.expr("try_cast(text AS DOUBLE)").alias("value"), "issue",
    )


# --- gazetteer and census ------------------------------------------------------------------------------

# The nineteen columns of a gazetteer row, in file order.
GAZETTEER = (
    "geonameid", "name", "asciiname", "alternatenames", "latitude", "longitude", "feature_class",
    "feature_code", "country_code", "cc2", "admin1", "admin2", "admin3", "admin4", "population",
    "elevation", "dem", "timezone", "modification_date",
)
GAZETTEER_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in GAZETTEER])


def parse_gazetteer(rows: DataFrame) -> DataFrame:
    """Populated places from raw string columns; ``issues`` lists what is wrong with a row."""
    def blank(name: str) -> Column:
        return F.nullif(F.trim(name), F.lit(""))

    out = rows.select(
        F.expr("try_cast(geonameid AS BIGINT)").alias("geonameid"), F.trim("name").alias("name"),
        F.coalesce(blank("asciiname"), F.trim("name")).alias("ascii_name"),
        F.expr("try_cast(latitude AS DOUBLE)").alias("latitude"), F.expr("try_cast(longitude AS DOUBLE)").alias("longitude"),
        "feature_class", "feature_code", F.upper(F.trim("country_code")).alias("country_code"), blank("admin1").alias("admin1"),
        F.coalesce(F.expr("try_cast(population AS BIGINT)"), F.lit(0)).alias("population"), F.trim("timezone").alias("timezone"),
    )
    return out.withColumn("issues", reasons(
        (F.col("geonameid").isNull(), "id is missing"),
        (F.col("feature_class").isNull() | (F.col("feature_class") != "P"), "feature class is not P"),
        (F.coalesce(F.col("name"), F.lit("")) == "", "name is missing"),
        (~F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False)), "coordinates are invalid"),
        (~F.coalesce(F.col("country_code").rlike("^[A-Z]{2}$"), F.lit(False)), "country code is invalid"),
        (F.col("population") < 0, "population is negative"),
        (~F.coalesce(F.col("timezone").isin(sorted(available_timezones())), F.lit(False)), "time zone is invalid"),
    ))


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    return parse_gazetteer(spark.read.csv(path, sep="\t", quote="", schema=GAZETTEER_SCHEMA, encoding="UTF-8"))


def gazetteer_report(places: DataFrame, declared_rows: int) -> DataFrame:
    """Row count against the manifest and repeated ids, in one row."""
    repeated = places.groupBy("geonameid").agg(F.count("*").alias("n"))
    return repeated.agg(
        F.sum("n").alias("rows"), F.count_if(F.col("n") > 1).alias("repeated_ids")
    ).select("rows", "repeated_ids", reasons(
        (F.col("rows") != declared_rows, "row count differs from the manifest"),
        (F.col("repeated_ids") > 0, "ids repeat"),
    ).alias("issues"))


# Place prefix and the marker of a controlled margin.
PLACE_PREFIX = "1600000US"
CONTROLLED = -555555555


def parse_population(rows: DataFrame, requested: DataFrame) -> DataFrame:
    """Population rows of the requested places from ``GEO_ID, B01003_E001, B01003_M001`` strings.

    ``requested(geoid)`` names the wanted places; a place without a row, or with several, is kept
    with its reason.
    """
    named = rows.filter(F.col("GEO_ID").startswith(PLACE_PREFIX)).select(
        F.substring("GEO_ID", len(PLACE_PREFIX) + 1, 20).alias("geoid"),
        F.expr("try_cast(B01003_E001 AS BIGINT)").alias("estimate"),
        F.expr("try_cast(B01003_M001 AS BIGINT)").alias("raw_margin"),
    )
    per = named.groupBy("geoid").agg(
        F.count("*").alias("rows"), F.min("estimate").alias("estimate"), F.min("raw_margin").alias("raw_margin")
    )
    out = requested.select("geoid").distinct().join(per, "geoid", "left")
    controlled = F.col("raw_margin") == CONTROLLED
    issue = (
        F.when(F.col("rows").isNull(), "requested place has no row")
        .when(F.col("rows") > 1, "requested place repeats")
        .when(F.col("estimate").isNull() | F.col("raw_margin").isNull(), "row is not integer encoded")
        .when((F.col("raw_margin") < 0) & ~controlled, "unsupported special margin")
    )
    return out.select(
        "geoid", "estimate", F.when(controlled, F.lit(0)).otherwise(F.col("raw_margin")).cast("long").alias("margin"),
        F.when(controlled, "controlled").otherwise("available").alias("margin_status"), issue.alias("issue"),
    )


def read_population(spark: SparkSession, path: str, requested: DataFrame) -> DataFrame:
    schema = "GEO_ID string, B01003_E001 string, B01003_M001 string"
    return parse_population(spark.read.csv(path, sep="|", header=True, enforceSchema=False, schema=schema), requested)


BOUNDARY = (
    "type string, features array<struct<properties:struct<GEOID:string>,"
    "geometry:struct<type:string,coordinates:string>>>"
)


def parse_boundaries(texts: DataFrame) -> DataFrame:
    """One row per boundary document ``artifact, geoid, content``: vertices, box, issue."""
    doc = texts.select("artifact", "geoid", F.from_json("content", BOUNDARY).alias("d"))
    feature = F.get("d.features", F.lit(0))
    rows = doc.withColumn("f", feature).withColumn("kind", F.col("f.geometry.type"))
    polygon = F.from_json("f.geometry.coordinates", "array<array<array<double>>>")
    multi = F.from_json("f.geometry.coordinates", "array<array<array<array<double>>>>")
    points = F.when(F.col("kind") == "Polygon", F.flatten(polygon)).when(
        F.col("kind") == "MultiPolygon", F.flatten(F.flatten(multi))
    )
    rows = rows.withColumn("v", points)
    lon = F.transform("v", lambda p: F.get(p, F.lit(0)))
    lat = F.transform("v", lambda p: F.get(p, F.lit(1)))
    sound = F.forall("v", lambda p: (F.size(p) == 2) & p[0].between(-180, 180) & p[1].between(-90, 90))
    issue = (
        F.when(~F.coalesce(F.col("d.type") == "FeatureCollection", F.lit(False)), "payload is not a FeatureCollection")
        .when(F.size("d.features") != 1, "exactly one feature is required")
        .when(~F.col("f.properties.GEOID").eqNullSafe(F.col("geoid")), "feature id does not match")
        .when(~F.coalesce(F.col("kind").isin("Polygon", "MultiPolygon"), F.lit(False)), "geometry is not polygonal")
        .when(F.col("v").isNull() | (F.size("v") < 4), "too few vertices")
        .when(~F.coalesce(sound, F.lit(False)), "vertex is not a valid coordinate")
    )
    return rows.select(
        "artifact", "geoid", "kind", F.size("v").alias("vertices"), F.array_min(lon).alias("west"),
        F.array_min(lat).alias("south"), F.array_max(lon).alias("east"), F.array_max(lat).alias("north"), issue.alias("issue"),
    )


# --- envelopes and drift ---------------------------------------------------------------------------------

def unwrap(texts: DataFrame) -> DataFrame:
    """Rows of a platform payload (``platform, content``): list, record store or SQL endpoint."""
    platform = F.col("platform")
    ckan = F.from_json("content", "success boolean, result struct<records:array<string>>")
    inner = (
        F.when(platform == "socrata", F.from_json("content", "array<string>"))
        .when(platform == "ckan", ckan["result"]["records"])
        .when(platform == "carto", F.from_json("content", "rows array<string>")["rows"])
    )
    refused = (platform == "ckan") & ~F.coalesce(ckan["success"], F.lit(False))
    rows = texts.select("artifact", "platform", refused.alias("_refused"), inner.alias("_rows"))
    issue = F.when(F.col("_refused"), "response did not report success").when(
        F.col("_rows").isNull(), "response holds no row list"
    )
    return rows.select(
        "artifact", "platform", issue.alias("issue"),
        F.explode_outer(F.when(~F.col("_refused"), F.col("_rows"))).alias("row"),
    ).filter(F.col("issue").isNotNull() | F.col("row").isNotNull())


def schema_fingerprint(records: DataFrame, group: Sequence[str], column: str) -> DataFrame:
    """Hash of field -> value types over the JSON records of each group, independent of order.

    Distinct (field, type) pairs are what reaches the final aggregate: as many as the schema has.
    """
    parsed = records.select(*group, F.from_json(column, "map<string,variant>").alias("m"))
    pairs = parsed.select(*group, F.explode("m").alias("field", "v")).select(
        *group, "field", F.coalesce(F.schema_of_variant("v"), F.lit("VOID")).alias("kind")
    ).distinct()
    fields = pairs.groupBy(*group, "field").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))
    line = F.concat_ws(":", "field", F.array_join("kinds", "|"))
    return fields.groupBy(*group).agg(
        F.count("*").alias("fields"), F.array_join(F.sort_array(F.collect_list(line)), ",").alias("shape")
    ).withColumn("fingerprint", digest(F.col("shape")))


def drift_report(records: DataFrame, series: Sequence[str], version: str, column: str) -> DataFrame:
    """(series, version, previous, field, change, before, after): how JSON records differ from the version before.

    A field is ``added``, ``lost`` or ``retyped``; types of nested objects are part of a field's type. Versions are
    ordered within their series and the first one has no rows. Only distinct (version, field, type) triples travel on.
    Records that are null or no object have no fields; a null series is a series of its own, a null version is left out.
    """
    dated = records.filter(F.col(version).isNotNull())
    # structs compare with nulls equal, so a null in a series joins with itself
    key = F.struct(*[F.col(c) for c in series]).alias("_series")
    typed = dated.select(key, F.col(version).alias("_version"), F.try_parse_json(column).alias("_v"))
    objects = typed.filter(F.schema_of_variant("_v").startswith("OBJECT"))
    pairs = objects.select("_series", "_version", F.explode(F.col("_v").cast("map<string,variant>")).alias("field", "_value")).select(
        "_series", "_version", "field", F.coalesce(F.schema_of_variant("_value"), F.lit("VOID")).alias("_kind")
    ).distinct()
    kinds = pairs.groupBy("_series", "_version", "field").agg(F.array_join(F.sort_array(F.collect_set("_kind")), "|").alias("_kinds"))
    steps = typed.select("_series", "_version").distinct().withColumn(
        "_previous", F.lag("_version").over(Window.partitionBy("_series").orderBy("_version"))
    ).filter(F.col("_previous").isNotNull())
    after = steps.join(kinds, ["_series", "_version"]).select("*", F.lit(True).alias("_now"))
    earlier = kinds.withColumnRenamed("_version", "_previous")
    before = steps.join(earlier, ["_series", "_previous"]).select(*steps.columns, "field", "_kinds", F.lit(False).alias("_now"))
    both = after.select(*before.columns).unionByName(before).groupBy("_series", "_version", "_previous", "field").agg(
        F.max(F.when(~F.col("_now"), F.col("_kinds"))).alias("before"), F.max(F.when(F.col("_now"), F.col("_kinds"))).alias("after")
    )
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "lost").when(F.col("before") != F.col("after"), "retyped")
    return both.withColumn("change", change).filter(F.col("change").isNotNull()).select(
        *[F.col("_series").getField(c).alias(c) for c in series], F.col("_version").alias(version), F.col("_previous").alias("previous"),
        "field", "change", "before", "after",
    )
