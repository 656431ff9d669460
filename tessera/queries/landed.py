"""Readers over documents that Spark derives from the landed tables.

Each document is the JSON a source would have landed, built from table rows; groups are keyed so that
one document stays as small as a connector page.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.session import shared_folder, table
from tessera.sources import integrity, readers, sinks

PARAMETERS = ("click", "error", "purchase", "signup", "view", "absent")


def climate_documents(spark, sf):
    """One point series document per user: event types are parameters, days are keys."""
    day = F.date_format("ts", "yyyyMMdd")
    cell = table(spark, sf, "events").groupBy("user_id", "event_type", day.alias("d")).agg(
        F.round(F.avg("value"), 4).alias("v"), F.count("*").alias("n"))
    shown = F.when(F.col("n") > 3, F.lit(-999.0)).otherwise(F.col("v"))
    per = cell.groupBy("user_id", "event_type").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("d", shown.alias("v"))))).alias("m"))
    doc = per.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(
        F.col("event_type"), F.map_entries("m").alias("e"))))).alias("p"))
    parameter = F.transform_values("p", lambda _k, e: F.map_from_entries(e))
    return doc.select(
        F.concat(F.lit("user-"), "user_id").alias("artifact"),
        F.to_json(F.struct(
            F.struct(F.lit(-999.0).alias("fill_value")).alias("header"),
            F.struct(F.array(F.col("user_id") * 1.0, F.col("user_id") / 2).alias("coordinates")).alias("geometry"),
            F.struct(parameter.alias("parameter")).alias("properties"),
        )).alias("content"))


def q_param_series(spark, sf):
    rows = readers.parse_param_series(climate_documents(spark, sf), PARAMETERS)
    return rows.select("artifact", "parameter", "day", F.round("value", 4).alias("value"), "is_fill", "issue")


def q_fill_counts(spark, sf):
    return readers.fill_counts(readers.parse_param_series(climate_documents(spark, sf), PARAMETERS))


def q_indicators(spark, sf):
    row = F.struct(
        F.struct(F.concat(F.lit("IND."), "c_mktsegment").alias("id")).alias("indicator"),
        F.struct(F.concat(F.lit("C"), "c_nationkey").alias("id")).alias("country"),
        F.lit("2023").alias("date"), F.when(F.col("bal") > 0, F.col("bal")).alias("value"))
    per = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.round(F.max("c_acctbal"), 2).alias("bal"))
    pages = per.groupBy("c_mktsegment").agg(F.sort_array(F.collect_list(row)).alias("r")).select(
        F.col("c_mktsegment").alias("artifact"),
        F.concat(F.lit('[{"page":1},'), F.to_json("r"), F.lit("]")).alias("content"))
    return readers.parse_indicator_pages(pages)


def request_lines(spark, sf):
    return table(spark, sf, "orders").select(F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("unique_key"),
        F.when(F.col("o_orderstatus") != "P", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")).alias("created_date"),
        F.lower("o_orderpriority").alias("agency"), F.col("o_orderstatus").alias("status"))).alias("value"))


def q_request_rows(spark, sf):
    good, bad = readers.split_issues(readers.parse_requests(request_lines(spark, sf)))
    return good.groupBy("agency", "status").agg(F.count("*").alias("n"), F.max(F.col("created").cast("date")).alias("latest")).unionByName(
        bad.groupBy("agency", "status").agg(F.count("*").alias("n"), F.max(F.col("created").cast("date")).alias("latest")))


def q_request_page(spark, sf):
    good, _ = readers.split_issues(readers.parse_requests(request_lines(spark, sf)))
    return readers.select_requests(good, "1997-01-01", "1998-01-01", agency="1-urgent", limit=50, offset=25).select(
        "unique_key", F.col("created").cast("date").alias("created"), "agency")


def q_tracts(spark, sf):
    key = F.col("c_custkey")
    docs = table(spark, sf, "customer").select(F.concat(F.lit("t"), key).alias("artifact"), F.to_json(F.array(F.struct(
        F.lit("ma").alias("stateabbr"), F.lpad(F.col("c_nationkey").cast("string"), 5, "0").alias("countyfips"),
        F.lpad(key.cast("string"), 11, "0").alias("tractfips"), (key * 10).cast("string").alias("totalpopulation"),
        *[F.round(F.col("c_acctbal") / 100 + i, 4).alias(p) for i, p in enumerate(readers.PREVALENCE)],
        F.struct(F.lit("Point").alias("type"), F.array(key * 0.1, F.lit(1.5)).alias("coordinates")).alias("geolocation")))).alias("content"))
    return readers.parse_tracts(docs).select(
        "tractfips", "population", F.round("lacktrpt_crudeprev", 4).alias("rate"), F.round("longitude", 3).alias("longitude"),
        F.size("issues").cast("long").alias("issue_count"))


def q_quakes(spark, sf):
    feature = F.struct(
        F.concat(F.lit("e"), "event_id").alias("id"),
        F.struct(F.round(F.col("value") / 10, 3).alias("mag"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time")).alias("properties"),
        F.struct(F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0)).alias("coordinates")).alias("geometry"))
    docs = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 50).alias("b")).agg(F.collect_list(feature).alias("f")).select(
        F.concat(F.lit("b"), "b").alias("artifact"), F.to_json(F.struct(
            F.when(F.pmod("b", F.lit(10)) == 9, "Other").otherwise("FeatureCollection").alias("type"), F.col("f").alias("features"))).alias("content"))
    good, _ = readers.split_issues(readers.parse_geojson_features(docs))
    return readers.select_quakes(good, "2024-01-05", "2024-01-25", 7.0).select(
        "event_id", "magnitude", F.col("occurred").cast("date").alias("day"))


def q_declarations(spark, sf):
    row = F.struct(
        F.col("o_orderkey").alias("disasterNumber"), F.lower(F.substring("o_orderpriority", 3, 2)).alias("state"), F.col("o_orderstatus").alias("incidentType"),
        F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(F.col("o_orderstatus") == "P", "T00:00:00").otherwise("T00:00:00Z")).alias("declarationDate"),
        F.concat(F.date_format(F.date_add(F.col("o_orderdate").cast("date"), 10), "yyyy-MM-dd"), F.lit("T12:00:00.000Z")).alias("lastRefresh"))
    docs = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 100).alias("b")).agg(F.collect_list(row).alias("DisasterDeclarationsSummaries")).select(
        F.concat(F.lit("b"), "b").alias("artifact"), F.to_json(F.struct("DisasterDeclarationsSummaries")).alias("content"))
    rows = readers.parse_declarations(docs)
    good, _ = readers.split_issues(rows)
    return readers.select_declarations(good, "1996-01-01", "1999-01-01", "hi", ["F", "O"]).select(
        "disaster_number", "state", "incident_type", F.col("declared").cast("date").alias("day"))


def q_jsonstat(spark, sf):
    flat = (F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2) * 7 + F.col("l_linenumber") - 1).cast("string")
    cell = table(spark, sf, "lineitem").groupBy("l_suppkey", flat.alias("i")).agg(F.round(F.sum("l_quantity"), 1).alias("v"))
    docs = cell.groupBy("l_suppkey").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("i", "v")))).alias("value")).select(
        F.concat(F.lit("s"), "l_suppkey").alias("artifact"), F.to_json(F.struct(
            F.lit("dataset").alias("class"), F.array(F.lit("flag"), F.lit("line")).alias("id"), F.array(F.lit(3), F.lit(7)).alias("size"), "value")).alias("content"))
    return readers.parse_jsonstat(docs).select(
        "artifact", F.col("positions")[0].alias("flag"), F.col("positions")[1].alias("line"), "value", "issue")


def q_gazetteer(spark, sf):
    c = table(spark, sf, "customer")
    cols = {
        "geonameid": F.pmod("c_custkey", F.lit(1490)).cast("string"), "name": F.col("c_name"), "latitude": (F.col("c_acctbal") / 100).cast("string"),
        "longitude": F.lit("12.5"), "feature_class": F.when(F.col("c_mktsegment") == "MACHINERY", "A").otherwise("P"), "feature_code": F.lit("PPL"),
        "country_code": F.lit("de"), "population": F.when(F.col("c_acctbal") > 0, F.floor("c_acctbal").cast("string")).otherwise(F.lit("")), "timezone": F.lit("Europe/Berlin"),
    }
    raw = c.select(*[cols.get(n, F.lit("")).alias(n) for n in readers.GAZETTEER])
    return readers.parse_gazetteer(raw).select(
        "geonameid", "ascii_name", "country_code", "population", F.array_join("issues", "|").alias("issues"))


def q_population(spark, sf):
    c = table(spark, sf, "customer")
    rows = c.select(
        F.concat(F.lit("1600000US"), F.lpad(F.pmod("c_custkey", F.lit(1400)).cast("string"), 7, "0")).alias("GEO_ID"),
        F.floor(F.abs("c_acctbal")).cast("string").alias("B01003_E001"),
        F.when(F.col("c_acctbal") < 0, "-555555555").when(F.col("c_nationkey") == 3, "-1").otherwise("12").alias("B01003_M001"))
    wanted = table(spark, sf, "supplier").select(F.lpad((F.col("s_suppkey") * 20).cast("string"), 7, "0").alias("geoid"))
    return readers.parse_population(rows, wanted)


def q_boundaries(spark, sf):
    k = F.col("s_suppkey") * 0.5
    ring = F.array(F.array(k, F.lit(0.0)), F.array(k + 1, F.lit(0.0)), F.array(k + 1, F.lit(1.0)), F.array(k, F.lit(0.0)))
    docs = table(spark, sf, "supplier").select(
        F.concat(F.lit("b"), "s_suppkey").alias("artifact"), F.col("s_suppkey").cast("string").alias("geoid"),
        F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(F.struct(
            F.struct((F.col("s_suppkey") + F.when(F.col("s_nationkey") == 7, 1).otherwise(0)).cast("string").alias("GEOID")).alias("properties"),
            F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("features"))).alias("content"))
    return readers.parse_boundaries(docs).select("geoid", "vertices", F.round("west", 3).alias("west"), F.round("east", 3).alias("east"), "issue")


def q_unwrap(spark, sf):
    doc = table(spark, sf, "orders").groupBy(F.floor(F.col("o_orderkey") / 50).alias("b")).agg(
        F.collect_list(F.struct(F.col("o_orderkey").alias("k"))).alias("r"))
    kind = F.pmod("b", F.lit(4))
    content = (
        F.when(kind == 0, F.to_json("r")).when(kind == 1, F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.col("r").alias("records")).alias("result"))))
        .when(kind == 2, F.to_json(F.struct(F.lit(False).alias("success"), F.struct(F.col("r").alias("records")).alias("result"))))
        .otherwise(F.to_json(F.struct(F.col("r").alias("rows")))))
    docs = doc.select(F.concat(F.lit("b"), "b").alias("artifact"), F.when(kind == 0, "socrata").when(kind == 3, "carto").otherwise("ckan").alias("platform"), content.alias("content"))
    return readers.unwrap(docs).groupBy("platform", "issue").agg(F.count("row").alias("rows"), F.count("*").alias("lines"))


def q_check_page(spark, sf):
    o = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("artifact"))
    returned = o.agg(F.count("*").alias("rows"), F.lit(1).alias("page"))
    declared = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("artifact"), F.lit(12).alias("row_limit"), F.when(F.col("c_nationkey") == 1, 2).otherwise(1).alias("page"))
    return readers.check_page(returned, declared).select("artifact", "rows", F.array_join("issues", "|").alias("issues"))


def q_fingerprint(spark, sf):
    o = table(spark, sf, "orders").select("o_orderpriority", F.to_json(F.struct(
        "o_orderkey", F.when(F.col("o_orderpriority") == "5-LOW", F.lit(None)).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"))).alias("j"))
    return readers.schema_fingerprint(o, ["o_orderpriority"], "j")


def q_drift(spark, sf):
    """Two versions of the order documents: a field goes, one comes, a number becomes text and a nested one a fraction."""
    late = F.year("o_orderdate") >= 1996
    doc = F.when(late, F.to_json(F.struct(
        F.col("o_orderkey").cast("string").alias("key"), F.col("o_orderpriority").alias("priority"), F.struct(F.lit(True).alias("rush")).alias("fresh"),
    ))).otherwise(F.to_json(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("state"))))
    o = table(spark, sf, "orders").select("o_orderstatus", F.when(late, 2).otherwise(1).alias("version"), doc.alias("j"))
    return readers.drift_report(o, ["o_orderstatus"], "version", "j")


def q_gazetteer_report(spark, sf):
    c = table(spark, sf, "customer").select(F.pmod("c_custkey", F.lit(1490)).cast("long").alias("geonameid"))
    return readers.gazetteer_report(c, 1500).select("rows", "repeated_ids", F.array_join("issues", "|").alias("issues"))


def _ledger(spark, sf):
    """A ledger by status, one of whose partitions is written again with other rows."""
    folder = f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    sinks.write_layout(o, folder, ["o_orderstatus"], ["o_orderkey"])
    again = o.filter((F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") != "5-LOW")).withColumn("o_totalprice", -F.col("o_totalprice"))
    sinks.write_layout(again, folder, ["o_orderstatus"], ["o_orderkey"])
    return spark.read.parquet(folder)


def q_written_ledger(spark, sf):
    line = F.concat_ws("|", "o_orderkey", "o_orderstatus", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").cast("string"))
    return _ledger(spark, sf).select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", F.sha2(line, 256).alias("row_hash"))


def q_ledger_manifest(spark, sf):
    """Files of a partition hold disjoint ranges, so the files' order is that of the ledger."""
    files = sinks.layout_manifest(_ledger(spark, sf), ["o_orderstatus"], "o_orderkey")
    before = F.lag("last").over(Window.partitionBy("o_orderstatus").orderBy("first", "last"))
    return files.withColumn("_overlaps", F.coalesce((before >= F.col("first")).cast("long"), F.lit(0))).groupBy("o_orderstatus").agg(
        F.sum("record_count").alias("record_count"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("_overlaps").alias("overlaps"))


def q_verify_artifacts(spark, sf):
    d = table(spark, sf, "documents")
    files = d.filter(F.col("lang") != "de").select(
        F.concat(F.lit("docs/"), "doc_id").alias("name"), F.concat(F.lit("sha256:"), F.sha2(F.col("text").cast("binary"), 256)).alias("actual_hash"))
    manifests = d.select(
        F.col("doc_id").alias("artifact_id"),
        F.concat(F.when(F.col("source") == "src0", "../").otherwise(F.lit("")), F.lit("docs/"), "doc_id").alias("artifact_path"),
        F.concat(F.lit("sha256:"), F.sha2(F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text")).cast("binary"), 256)).alias("content_hash"))
    return integrity.verify_artifacts(files, manifests).groupBy("status").agg(F.count("*").alias("artifacts"), F.min("artifact_id").alias("first_artifact"))


def q_checksums(spark, sf):
    d = table(spark, sf, "documents")
    hex_ = F.sha2(F.col("text").cast("binary"), 256)
    files = d.filter("lang <> 'de'").select(F.concat(F.lit("d"), "doc_id").alias("name"), F.concat(F.lit("sha256:"), hex_).alias("actual_hash"))
    lines = d.filter("source <> 'src3'").select(F.concat(F.when(F.col("lang") == "es", F.reverse(hex_)).otherwise(hex_), F.lit("  d"), "doc_id").alias("value"))
    return integrity.verify_checksums(files, lines).groupBy("issue").agg(F.count("*").alias("files"))


def q_new_artifacts(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("source_id"), F.col("o_orderdate").cast("date").alias("window_start"),
        F.date_add(F.col("o_orderdate").cast("date"), 7).alias("window_end"), F.md5(F.col("o_orderkey").cast("string")).alias("content_hash"), "o_orderstatus")
    done = o.withColumn("status", F.when(F.col("o_orderstatus") == "F", "verified").otherwise("hash-mismatch"))
    return integrity.new_artifacts(o, done).groupBy("o_orderstatus").agg(F.count("*").alias("artifacts"))


def q_artifact_manifest(spark, sf):
    """Landed texts as output files: path, media type, size, digest."""
    p = table(spark, sf, "pages").select(
        F.concat_ws(".", F.concat(F.lit("pages/"), "page_id"), F.when(F.pmod("page_id", F.lit(2)) == 0, "md").otherwise("html")).alias("name"),
        F.octet_length("html").alias("bytes"), F.concat(F.lit("sha256:"), F.sha2(F.col("html").cast("binary"), 256)).alias("actual_hash"))
    return integrity.artifact_manifest(p).select("path", "media_type", F.col("bytes").cast("long").alias("bytes"), "content_hash")


def q_render_brief(spark, sf):
    packs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("pack_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"),
        F.concat(F.lit("city-"), "o_custkey").alias("city_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("insufficient-evidence").alias("status"),
        F.floor("o_totalprice").alias("observed_requests"), F.lit("bounded-portfolio").alias("selected_option_id"),
        F.when(F.col("o_orderstatus") == "O", "too few requests").alias("failure_reason"),
        F.array(F.lit("aggregates only"), F.col("o_orderpriority")).alias("limitations"), F.array(F.lit("pilot")).alias("next_evidence"))
    return sinks.render_brief(packs)


QUERIES = {
    "param_series": q_param_series, "fill_counts": q_fill_counts, "indicator_pages": q_indicators,
    "request_rows": q_request_rows, "request_page": q_request_page, "health_tracts": q_tracts,
    "earthquake_features": q_quakes, "disaster_declarations": q_declarations, "jsonstat_cells": q_jsonstat,
    "gazetteer_rows": q_gazetteer, "population_rows": q_population, "boundary_polygons": q_boundaries,
    "platform_envelopes": q_unwrap, "page_guard": q_check_page, "schema_fingerprint": q_fingerprint,
    "drift_report": q_drift, "gazetteer_report": q_gazetteer_report, "written_ledger": q_written_ledger, "ledger_manifest": q_ledger_manifest,
    "verify_artifacts": q_verify_artifacts, "verify_checksums": q_checksums, "incremental_ingest": q_new_artifacts,
    "artifact_manifest": q_artifact_manifest, "decision_briefs": q_render_brief,
}

SERIES = """cell AS (SELECT user_id, event_type AS parameter, CAST(ts AS DATE) AS day, round(avg(value), 4) AS v, count(*) AS n FROM events GROUP BY 1, 2, 3),
users AS (SELECT DISTINCT user_id FROM events), wanted AS (SELECT user_id, parameter FROM users, (VALUES ('click'), ('error'), ('purchase'), ('signup'), ('view'), ('absent')) p(parameter)),
series AS (SELECT 'user-' || user_id AS artifact, parameter, day, CASE WHEN n > 3 THEN -999.0 ELSE v END AS value, coalesce(n > 3, false) AS is_fill,
  CASE WHEN day IS NULL THEN 'parameter series is missing' END AS issue FROM wanted LEFT JOIN cell USING (user_id, parameter))"""

ORACLES = {
    "param_series": f"WITH {SERIES} SELECT * FROM series",
    "fill_counts": f"WITH {SERIES} SELECT artifact, count(value) AS values, count(*) FILTER (is_fill) AS fill_values FROM series GROUP BY 1",
    "indicator_pages": """SELECT 'IND.' || c_mktsegment AS indicator, 'C' || c_nationkey AS country_code, round(max(c_acctbal), 2) AS value
        FROM customer GROUP BY 1, 2 HAVING max(c_acctbal) > 0""",
    "request_rows": """SELECT upper(o_orderpriority) AS agency, o_orderstatus AS status, count(*) AS n,
        max(CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END) AS latest FROM orders GROUP BY 1, 2""",
    "request_page": """SELECT CAST(o_orderkey AS VARCHAR) AS unique_key, CAST(o_orderdate AS DATE) AS created, upper(o_orderpriority) AS agency FROM orders
        WHERE o_orderstatus <> 'P' AND o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1998-01-01' AND o_orderpriority = '1-URGENT'
        ORDER BY o_orderdate, CAST(o_orderkey AS VARCHAR) LIMIT 50 OFFSET 25""",
    "health_tracts": """SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS tractfips, c_custkey * 10 AS population, round(c_acctbal / 100, 4) AS rate,
        round(c_custkey * 0.1::DOUBLE, 3) AS longitude, CAST(len(list_filter(range(0, 7), lambda i: NOT (round(c_acctbal / 100 + i, 4) BETWEEN 0 AND 100))) AS BIGINT) AS issue_count FROM customer""",
    "earthquake_features": """SELECT 'e' || event_id AS event_id, round(value / 10, 3) AS magnitude, CAST(ts AS DATE) AS day FROM events
        WHERE (event_id // 50) % 10 <> 9 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-25' AND round(value / 10, 3) >= 7.0""",
    "disaster_declarations": """SELECT o_orderkey AS disaster_number, upper(substr(o_orderpriority, 3, 2)) AS state, o_orderstatus AS incident_type, CAST(o_orderdate AS DATE) AS day
        FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1999-01-01' AND upper(substr(o_orderpriority, 3, 2)) = 'HI'""",
    "jsonstat_cells": """SELECT 's' || l_suppkey AS artifact, CAST(CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS BIGINT) AS flag,
        CAST(l_linenumber - 1 AS BIGINT) AS line, round(sum(l_quantity), 1) AS value, CAST(NULL AS VARCHAR) AS issue FROM lineitem GROUP BY 1, 2, 3""",
    "gazetteer_rows": """SELECT c_custkey % 1490 AS geonameid, c_name AS ascii_name, 'DE' AS country_code, CAST(CASE WHEN c_acctbal > 0 THEN floor(c_acctbal) ELSE 0 END AS BIGINT) AS population,
        array_to_string(list_filter([CASE WHEN c_mktsegment = 'MACHINERY' THEN 'feature class is not P' END,
          CASE WHEN abs(c_acctbal / 100) > 90 THEN 'coordinates are invalid' END], lambda x: x IS NOT NULL), '|') AS issues FROM customer""",
    "population_rows": """WITH r AS (SELECT lpad(CAST(c_custkey % 1400 AS VARCHAR), 7, '0') AS geoid, CAST(floor(abs(c_acctbal)) AS BIGINT) AS e,
          CASE WHEN c_acctbal < 0 THEN -555555555 WHEN c_nationkey = 3 THEN -1 ELSE 12 END AS m FROM customer),
        p AS (SELECT geoid, count(*) AS n, min(e) AS e, min(m) AS m FROM r GROUP BY 1)
        SELECT w.geoid, e AS estimate, CAST(CASE WHEN m = -555555555 THEN 0 ELSE m END AS BIGINT) AS margin,
          CASE WHEN m = -555555555 THEN 'controlled' ELSE 'available' END AS margin_status,
          CASE WHEN n IS NULL THEN 'requested place has no row' WHEN n > 1 THEN 'requested place repeats' WHEN m < 0 AND m <> -555555555 THEN 'unsupported special margin' END AS issue
        FROM (SELECT lpad(CAST(s_suppkey * 20 AS VARCHAR), 7, '0') AS geoid FROM supplier) w LEFT JOIN p ON w.geoid = p.geoid""",
    "boundary_polygons": """SELECT CAST(s_suppkey AS VARCHAR) AS geoid, 4 AS vertices, round(s_suppkey * 0.5::DOUBLE, 3) AS west, round(s_suppkey * 0.5::DOUBLE + 1, 3) AS east,
        CASE WHEN s_nationkey = 7 THEN 'feature id does not match' WHEN s_suppkey * 0.5 + 1 > 180 THEN 'vertex is not a valid coordinate' END AS issue FROM supplier""",
    "platform_envelopes": """WITH b AS (SELECT o_orderkey // 50 AS b, count(*) AS n FROM orders GROUP BY 1)
        SELECT CASE b % 4 WHEN 0 THEN 'socrata' WHEN 3 THEN 'carto' ELSE 'ckan' END AS platform, CASE WHEN b % 4 = 2 THEN 'response did not report success' END AS issue,
          CAST(sum(CASE WHEN b % 4 = 2 THEN 0 ELSE n END) AS BIGINT) AS rows, CAST(sum(CASE WHEN b % 4 = 2 THEN 1 ELSE n END) AS BIGINT) AS lines FROM b GROUP BY 1, 2""",
    "page_guard": """SELECT o_custkey AS artifact, count(*) AS rows, array_to_string(list_filter([CASE WHEN count(*) > 12 THEN 'more rows than the declared limit' END,
        CASE WHEN any_value(c_nationkey) = 1 THEN 'returned page differs from the requested page' END], lambda x: x IS NOT NULL), '|') AS issues
        FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "schema_fingerprint": """WITH s AS (SELECT DISTINCT o_orderpriority, CASE WHEN o_orderpriority = '5-LOW' THEN 'o_orderkey:BIGINT' ELSE 'o_orderkey:BIGINT,o_orderstatus:STRING' END AS shape FROM orders)
        SELECT o_orderpriority, CAST(CASE WHEN o_orderpriority = '5-LOW' THEN 1 ELSE 2 END AS BIGINT) AS fields, shape, 'sha256:' || sha256(shape) AS fingerprint FROM s""",
    "drift_report": """WITH v AS (SELECT o_orderstatus, CASE WHEN year(o_orderdate) >= 1996 THEN 2 ELSE 1 END AS version FROM orders),
        s AS (SELECT o_orderstatus FROM v GROUP BY 1 HAVING count(DISTINCT version) = 2)
        SELECT o_orderstatus, 2 AS version, 1 AS previous, field, change, before, after FROM s, (VALUES ('key', 'retyped', 'BIGINT', 'STRING'),
          ('state', 'lost', 'STRING', NULL), ('fresh', 'added', NULL, 'OBJECT<rush: BOOLEAN>')) c(field, change, before, after)""",
    "gazetteer_report": """WITH n AS (SELECT c_custkey % 1490 AS k, count(*) AS n FROM customer GROUP BY 1)
        SELECT CAST(sum(n) AS BIGINT) AS rows, count(*) FILTER (n > 1) AS repeated_ids, array_to_string(list_filter([
          CASE WHEN sum(n) <> 1500 THEN 'row count differs from the manifest' END, CASE WHEN count(*) FILTER (n > 1) > 0 THEN 'ids repeat' END], lambda x: x IS NOT NULL), '|') AS issues FROM n""",
    "written_ledger": """WITH l AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN -o_totalprice ELSE o_totalprice END AS o_totalprice
          FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW')
        SELECT *, sha256(o_orderkey || '|' || o_orderstatus || '|' || o_orderpriority || '|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)) AS row_hash FROM l""",
    "ledger_manifest": """SELECT o_orderstatus, count(*) AS record_count, min(o_orderkey) AS first, max(o_orderkey) AS last, CAST(0 AS BIGINT) AS overlaps
        FROM orders WHERE o_orderstatus <> 'P' OR o_orderpriority <> '5-LOW' GROUP BY 1""",
    "verify_artifacts": """SELECT CASE WHEN source = 'src0' THEN 'unsafe-path' WHEN lang = 'de' THEN 'missing' WHEN lang = 'es' AND upper(text) <> text THEN 'hash-mismatch' ELSE 'verified' END AS status,
        count(*) AS artifacts, min(doc_id) AS first_artifact FROM documents GROUP BY 1""",
    "verify_checksums": """SELECT issue, count(*) AS files FROM (SELECT CASE WHEN lang = 'de' AND source <> 'src3' THEN 'listed file is missing'
        WHEN lang <> 'de' AND source = 'src3' THEN 'file is not listed' WHEN lang = 'es' AND source <> 'src3' THEN 'hash differs' END AS issue FROM documents) WHERE issue IS NOT NULL GROUP BY 1""",
    "incremental_ingest": "SELECT o_orderstatus, count(*) AS artifacts FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1",
    "artifact_manifest": """SELECT 'pages/' || page_id || CASE WHEN page_id % 2 = 0 THEN '.md' ELSE '.html' END AS path,
        CASE WHEN page_id % 2 = 0 THEN 'text/markdown' ELSE 'application/octet-stream' END AS media_type, CAST(strlen(html) AS BIGINT) AS bytes,
        'sha256:' || sha256(html) AS content_hash FROM pages""",
    "decision_briefs": """SELECT CAST(o_orderkey AS VARCHAR) AS pack_id, '# Order ' || o_orderkey || chr(10) || chr(10) || 'City: city-' || o_custkey || chr(10) || chr(10)
        || 'Observed requests: ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || chr(10) || chr(10) || 'Status: '
        || CASE WHEN o_orderstatus = 'F' THEN 'completed' ELSE 'insufficient-evidence' END || chr(10) || chr(10)
        || CASE o_orderstatus WHEN 'F' THEN 'Selected option: bounded-portfolio' WHEN 'O' THEN 'No recommendation: too few requests' ELSE 'No recommendation: no reason recorded' END
        || chr(10) || chr(10) || '## Limitations' || chr(10) || '- aggregates only' || chr(10) || '- ' || o_orderpriority || chr(10) || chr(10)
        || '## Evidence needed next' || chr(10) || '- pilot' AS text FROM orders""",
}
