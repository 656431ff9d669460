"""Selection, matching, summary, catalog, graph and text operators over the landed tables."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from tessera.functions import canonical, hashing, merkle, scalar
from tessera.operators import catalog, graph, joins, select, summaries
from tessera.operators import text_audit as ta
from tessera.session import table
from tessera.sources import readers

# --- selection ---------------------------------------------------------------------------------


def cities(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("city_id"), F.col("c_name").alias("name"),
        F.concat(F.lit("C"), F.col("c_nationkey")).alias("country_code"), F.col("c_acctbal").alias("score"),
        F.col("c_mktsegment").alias("segment"),
    )


def q_breadth_first(spark, sf):
    return select.select_breadth_first(cities(spark, sf), "country_code", "score", "city_id", 250).select(
        "city_id", "country_code", "selection_basis", F.col("selection_rank").cast("long").alias("selection_rank")
    )


def _eligibility(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("rank"), F.col("p_name").alias("name"), (F.col("p_size") > 40).alias("eligible")
    )


def q_first_eligible(spark, sf):
    chosen, excluded = select.first_eligible(_eligibility(spark, sf), "rank", "eligible", 30)
    return chosen.select(
        "rank", F.lit("selected").alias("outcome"), F.col("selection_order").cast("long").alias("selection_order")
    ).unionByName(excluded.select("rank", F.lit("excluded").alias("outcome"), F.lit(None).cast("long").alias("selection_order")))


def q_paginate(spark, sf):
    return select.paginate(table(spark, sf, "part"), [F.lower("p_name"), F.col("p_partkey")], 50, 100).select(
        "p_partkey", "p_name", "position", "total", "next_offset"
    )


def q_duplicate_keys(spark, sf):
    return select.duplicates(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


PARAMETERS = ("click", "error", "purchase", "signup", "view")


def q_calendar_check(spark, sf):
    series = table(spark, sf, "events").groupBy(
        F.floor(F.col("user_id") / 5).alias("artifact_id"), F.col("event_type").alias("parameter"),
        F.col("ts").cast("date").alias("day"),
    ).agg(F.avg("value").alias("value"))
    return select.calendar_check(series, "2024-01-01", 30, PARAMETERS)


def q_missing_ids(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"))
    seen = table(spark, sf, "orders").filter(F.col("o_orderstatus") == "P").select(F.col("o_custkey").alias("custkey"))
    return select.missing_ids(wanted, seen, "custkey")


# --- joins ---------------------------------------------------------------------------------------


def q_tolerance_join(spark, sf):
    def at(key, shift=0.0):
        return (
            (F.pmod(key, F.lit(89)) * 0.7 - 30 + shift).alias("latitude"),
            (F.pmod(key, F.lit(97)) * 1.1 - 50).alias("longitude"),
        )
    places = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("city_id"), *at(F.col("s_suppkey") * 3))
    series = table(spark, sf, "customer").select(F.col("c_custkey").alias("artifact_id"), *at(F.col("c_custkey"), 4e-10))
    return joins.tolerance_join(places, series).select("city_id", "matches", "status", "artifact_id")


INDICATORS = ("SP.POP.TOTL", "NY.GDP.PCAP.CD", "SP.URB.TOTL.IN.ZS")


def context(spark, sf):
    per = table(spark, sf, "supplier").groupBy("s_nationkey").agg(
        F.count("*").cast("double").alias("SP.POP.TOTL"),
        F.when(F.avg("s_acctbal") > 4000, F.round(F.avg("s_acctbal"), 2)).alias("NY.GDP.PCAP.CD"),
        F.when(F.count("*") > 3, F.round(F.max("s_acctbal"), 2)).alias("SP.URB.TOTL.IN.ZS"),
    )
    long = per.unpivot("s_nationkey", [f"`{i}`" for i in INDICATORS], "indicator", "value")
    return long.filter(F.col("value").isNotNull()).select(
        F.concat(F.lit("C"), "s_nationkey").alias("country_code"), "indicator", "value", F.lit(0).alias("position")
    )


def q_join_context(spark, sf):
    joined = joins.join_context(cities(spark, sf), context(spark, sf), INDICATORS)
    return joined.select(
        "city_id", "country_code", "complete", F.array_join("missing_indicators", "|").alias("missing"),
        F.round(F.col("`SP.POP.TOTL`"), 2).alias("population"), F.round(F.col("`NY.GDP.PCAP.CD`"), 2).alias("gdp"),
    )


def q_join_population(spark, sf):
    places = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("city_id"), F.lpad(F.col("s_nationkey").cast("string"), 2, "0").alias("state_code"),
        F.lpad(F.col("s_suppkey").cast("string"), 7, "0").alias("place_code"),
    )
    pop = table(spark, sf, "customer").select(
        F.concat(
            F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.lpad(F.col("c_custkey").cast("string"), 7, "0")
        ).alias("geoid"), F.round(F.col("c_acctbal") * 100).cast("long").alias("population"),
    )
    found, missing = joins.join_population(places, pop)
    return found.select("city_id", "geoid", "population", F.lit("found").alias("outcome")).unionByName(
        missing.select("city_id", "geoid", F.lit(None).cast("long").alias("population"), F.lit("missing").alias("outcome"))
    )


def q_fk_violations(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "part", "supplier", "customer", "labels", "documents")}
    checks = [
        joins.fk_violations(t["lineitem"], t["orders"], "l_orderkey", "o_orderkey", "line order"),
        joins.fk_violations(t["lineitem"], t["part"], "l_partkey", "p_partkey", "line part"),
        joins.fk_violations(t["orders"], t["customer"], "o_custkey", "c_custkey", "order customer"),
        joins.fk_violations(t["customer"], t["supplier"], "c_custkey", "s_suppkey", "customer as supplier"),
        joins.fk_violations(t["documents"], t["labels"], "doc_id", "doc_id", "document label"),
    ]
    out = checks[0]
    for more in checks[1:]:
        out = out.unionByName(more)
    return out.groupBy("relation").agg(
        F.count("*").alias("missing_references"), F.sum("rows").alias("rows"), F.min("reference").alias("example")
    )


def q_reconcile_sets(spark, sf):
    left = table(spark, sf, "documents").select("doc_id")
    right = table(spark, sf, "labels").select((F.col("doc_id") * 3).alias("doc_id"))
    return joins.reconcile_sets(left, right, "doc_id")


def _tiers(spark, sf):
    base = cities(spark, sf).select(
        "city_id", "name", "country_code", F.col("score").alias("latitude"), (F.col("score") / 2).alias("longitude"),
        "score", "segment",
    )
    standard = base.filter("score > 5000").withColumn("metric_count", F.lit(11))
    deep = base.filter("score > 8000 and segment = 'BUILDING'").withColumns(
        {"metric_count": F.lit(18), "capability_count": F.lit(7)})
    return catalog.city_summaries(base, standard, deep)


def q_highest_tier(spark, sf):
    return joins.highest_tier(*_tiers(spark, sf)).select("city_id", "name", "tier", "metric_count", "capability_count")


TEMPLATES = {"demand-forecast": "public-service", "heat-screen": "climate-disaster", "transit-access": "mobility-access"}


def q_expand(spark, sf):
    return joins.expand(cities(spark, sf).select("city_id"), TEMPLATES).select(
        "city_id", F.col("template_order").cast("long").alias("template_order"), "template_id", "suite", "scenario_id"
    )


def q_check_registry(spark, sf):
    packs = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("pack_id"),
        F.md5(F.concat_ws("|", "o_orderkey", "o_orderstatus")).alias("content_hash"), "o_orderkey", "o_orderstatus",
    )
    # one registry row lists the at most 100 packs of one key block; hashes of open packs are stale
    entries = packs.withColumn(
        "declared", F.when(F.col("o_orderstatus") == "P", F.md5("pack_id")).otherwise(F.col("content_hash"))
    ).groupBy(F.floor(F.col("o_orderkey") / 100).cast("string").alias("city_id")).agg(
        F.sort_array(F.collect_list(F.struct("pack_id", "declared"))).alias("e")
    ).select("city_id", F.col("e.pack_id").alias("pack_ids"), F.col("e.declared").alias("pack_hashes"))
    return joins.check_registry(entries, packs.select("pack_id", "content_hash"))


def designs(spark, sf):
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("design_id"), F.col("p_brand").alias("family_id"),
        F.col("p_type").alias("suite"), F.col("p_name").alias("title"),
        F.concat_ws("-", "p_type", "p_size").alias("question"),
        F.concat(F.lit("kind-"), F.pmod("p_size", F.lit(8))).alias("decision_type"),
        F.when(F.col("p_size") <= 5, "reference-implemented").otherwise("design-only").alias("status"),
        F.when(F.col("p_size") <= 5, "reference-implemented").otherwise("design-only").alias("implementation_status"),
        F.when(F.col("p_size") == 1, F.concat(F.lit("tmpl-"), F.pmod("p_partkey", F.lit(4000)))).alias("template_ref"),
    )


def q_join_designs(spark, sf):
    families = table(spark, sf, "part").filter("p_size > 10").groupBy(F.col("p_brand").alias("family_id")).agg(
        F.min("p_name").alias("title"), F.max("p_type").alias("suite"))
    return joins.join_designs(designs(spark, sf), families).groupBy("family_id", "family_title", "family_suite").agg(
        F.count("*").alias("designs"))


def q_mapping_issues(spark, sf):
    templates = table(spark, sf, "supplier").select(F.concat(F.lit("tmpl-"), F.col("s_suppkey") * 2).alias("template_id"))
    return joins.mapping_issues(designs(spark, sf), templates)


# --- summaries -----------------------------------------------------------------------------------


def climate_series(spark, sf):
    name = F.create_map(*[F.lit(x) for x in (
        "view", "T2M", "click", "T2M_MAX", "purchase", "PRECTOTCORR", "signup", "WS10M", "error", "RH2M")])
    return table(spark, sf, "events").select(
        F.col("user_id").alias("city_id"), name[F.col("event_type")].alias("parameter"),
        F.col("ts").cast("date").alias("day"), "value",
    )


def q_climate_window(spark, sf):
    return summaries.climate_metrics(climate_series(spark, sf), summaries.DEEP_CLIMATE).select(
        "city_id", "metric_id", F.round("value", 9).alias("value"), "evidence_type")


def q_climate_annual(spark, sf):
    return summaries.climate_metrics(climate_series(spark, sf), summaries.ANNUAL_CLIMATE, 9).select(
        "city_id", "metric_id", "value")


def q_country_metrics(spark, sf):
    return summaries.country_metrics(context(spark, sf))


def q_melt(spark, sf):
    return summaries.melt_metrics(table(spark, sf, "part"), "p_partkey", ["p_size", "p_retailprice"])


def q_compare(spark, sf):
    ledger = summaries.climate_metrics(climate_series(spark, sf), summaries.DEEP_CLIMATE)
    wide = summaries.compare_cities(ledger, ["climate.t2m-mean", "climate.precipitation-total"])
    return wide.select(
        "city_id", F.round(F.col("`climate.t2m-mean`"), 9).alias("t2m_mean"),
        F.round(F.col("`climate.precipitation-total`"), 9).alias("precipitation"),
        scalar.fmt_metric(F.round(F.col("`climate.precipitation-total`"), 2)).alias("precipitation_text"))


def q_enum_counts(spark, sf):
    o = table(spark, sf, "orders")
    members = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"]
    plain = summaries.enum_counts(o, F.col("o_orderpriority"), members).withColumn("field", F.lit("priority"))
    listed = summaries.enum_counts(o, F.array("o_orderstatus", F.substring("o_orderpriority", 1, 1)), ["F", "O", "P", "1", "9"], True)
    return plain.unionByName(listed.withColumn("field", F.lit("tags")))


def q_suite_overview(spark, sf):
    runs = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("suite"), F.col("o_custkey").alias("city_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("insufficient-evidence").alias("status"))
    plans = designs(spark, sf).withColumn("suite", F.element_at(
        F.array(F.lit("1-URGENT"), F.lit("2-HIGH"), F.lit("3-MEDIUM")), (F.pmod(F.length("title"), F.lit(3)) + 1)))
    return summaries.suite_overview(runs, plans, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW", "6-NONE"])


def q_family_summary(spark, sf):
    return summaries.family_summary(designs(spark, sf))


def _ledger(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("suite"), F.when(F.col("l_linestatus") == "F", "completed").otherwise("negative").alias("status"),
        F.col("l_quantity").cast("long").alias("observations"), F.col("l_linenumber").cast("long").alias("draws"))


def q_evidence_totals(spark, sf):
    return summaries.evidence_totals(_ledger(spark, sf), ["observations", "draws"], ["suite"])


def q_check_totals(spark, sf):
    ledger = _ledger(spark, sf)
    published = summaries.evidence_totals(
        ledger.filter(~((F.col("suite") == "A") & (F.col("draws") == 7))), ["observations", "draws"], ["suite"])
    return summaries.check_totals(published, ledger, ["observations", "draws"], ["suite"])


def q_nearest_rank(spark, sf):
    return summaries.nearest_rank_summary(table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag"]).select(
        "l_returnflag", "n", *[F.round(F.col(c), 4).alias(c) for c in ("minimum", "median", "p95", "maximum")])


def q_pack_ledger(spark, sf):
    packs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("pack_id"), F.col("o_custkey").alias("city_id"), F.col("o_orderpriority").alias("template_id"),
        F.when(F.col("o_orderstatus") == "F", "completed").otherwise("insufficient-evidence").alias("status"),
        F.round("o_totalprice").cast("long").alias("observed_requests"),
        F.when(F.col("o_orderstatus") == "F", F.lit(183)).alias("forecast_observations"),
        F.lit(None).cast("long").alias("draws"), F.when(F.col("o_orderstatus") == "F", F.lit(3125)).alias("search_space"),
        F.lit(None).cast("long").alias("evaluated_plans"), F.lit(0).alias("feasible_plans"),
        F.array("o_orderstatus", "o_orderpriority", "o_orderstatus").alias("source_refs"),
        F.md5(F.col("o_orderkey").cast("string")).alias("content_hash"))
    return summaries.pack_ledger(packs).withColumn("source_refs", F.array_join("source_refs", "|"))


def q_screen_tally(spark, sf):
    return summaries.screen_tally(table(spark, sf, "orders").select(
        F.col("o_custkey").alias("city_id"),
        F.when(F.col("o_orderstatus") == "F", "screened").otherwise("insufficient-evidence").alias("status")))


def q_dedupe(spark, sf):
    return summaries.dedupe_or_conflict(
        table(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), F.concat_ws("-", "source", "n_chars").alias("k")), "k", "h")


def q_catalog_summary(spark, sf):
    manifests = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("source_id"), F.col("l_orderkey").alias("artifact_id"),
        F.col("l_quantity").cast("long").alias("record_count"), F.col("l_shipdate").cast("date").alias("retrieved_at"))
    runs = table(spark, sf, "orders").select(F.when(F.col("o_orderstatus") == "F", "completed").otherwise("negative").alias("status"))
    return summaries.catalog_summary(cities(spark, sf), manifests, runs, designs(spark, sf))


# --- catalog -------------------------------------------------------------------------------------


def _indexed(build, rows, ident, columns, indexed):
    """The index of a search over whole tables, or none for the plain scan."""
    return build(rows, ident, columns) if indexed else None


def q_search_cities(spark, sf, indexed=False):
    rows = joins.highest_tier(*_tiers(spark, sf))
    index = _indexed(catalog.index_any, rows, "city_id", catalog.CITY_TEXT, indexed)
    return catalog.search_cities(rows, tier="S", country="c7", text="customer#", limit=40, index=index).select(
        "city_id", "name", "tier", "position", "total", "next_offset")


def executions(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("city_id"),
        F.element_at(F.array(F.lit("deep"), F.lit("standard"), F.lit("reference")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int")).alias("kind"),
        F.col("o_orderpriority").alias("suite"), F.col("o_orderstatus").alias("status"),
        F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("title"))


def q_search_scenarios(spark, sf, indexed=False):
    rows = executions(spark, sf)
    index = _indexed(catalog.index_any, rows, "execution_id", catalog.SCENARIO_TEXT, indexed)
    return catalog.search_scenarios(rows, kind="deep", status="F", text="urgent f", limit=30, offset=30, index=index).select(
        "execution_id", "city_id", "suite", "position", "total", "next_offset")


def q_search_packs(spark, sf, indexed=False):
    rows = executions(spark, sf)
    index = _indexed(catalog.index_any, rows, "execution_id", catalog.PACK_TEXT, indexed)
    return catalog.search_packs(rows, status="O", text="high", limit=100, index=index).select(
        "execution_id", "city_id", "kind", "position", "total")


def q_search_sources(spark, sf, indexed=False):
    manifests = table(spark, sf, "documents").select(
        F.col("source").alias("source_id"), F.col("doc_id").alias("artifact_id"), F.concat_ws("/", "source", "lang").alias("name"),
        F.concat(F.lit("Publisher "), F.upper("lang")).alias("publisher"))
    index = _indexed(catalog.index_any, manifests, "artifact_id", catalog.SOURCE_TEXT, indexed)
    return catalog.search_sources(manifests, publisher="publisher fr", text="src1", limit=50, index=index).select(
        "source_id", "artifact_id", "publisher", "position", "total", "next_offset")


def q_search_designs(spark, sf, indexed=False):
    plans = designs(spark, sf).withColumn("readiness", F.col("status"))
    index = _indexed(catalog.index_normalised, plans, "design_id", catalog.DESIGN_TEXT, indexed)
    return catalog.search_designs(plans, status="design-only", text="Brand#1 , promo", limit=60, index=index).select("design_id", "family_id", "position", "total")


def q_search_families(spark, sf, indexed=False):
    families = table(spark, sf, "part").groupBy(F.col("p_brand").alias("family_id")).agg(
        F.min("p_name").alias("title"), F.max("p_type").alias("suite"))
    index = _indexed(catalog.index_normalised, families, "family_id", catalog.FAMILY_TEXT, indexed)
    return catalog.search_families(families, text="brand 2", limit=10, index=index).select("family_id", "title", "position", "total")


def q_lookup(spark, sf):
    rows = joins.highest_tier(*_tiers(spark, sf)).withColumn("city_id", F.col("city_id").cast("string"))
    known = catalog.lookup(rows, "city_id", "17")
    return known.unionByName(catalog.lookup(rows, "city_id", "no-such-city")).select("city_id", "name", "tier", "found")


def q_city_detail(spark, sf):
    rows = joins.highest_tier(*_tiers(spark, sf)).withColumn("city_id", F.col("city_id").cast("string"))
    metrics = summaries.climate_metrics(climate_series(spark, sf), summaries.DEEP_CLIMATE).select(
        F.col("city_id").cast("string").alias("city_id"), "metric_id", F.round("value", 4).alias("value"))
    orders = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("city_id"), F.col("o_orderkey").alias("source_id"))
    capabilities = table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("city_id"), F.col("o_orderpriority").alias("capability")).distinct()
    return catalog.city_detail(rows, "17", metrics, capabilities, orders).select(
        "city_id", "name", "tier", "found",
        F.array_join(F.transform("metrics", lambda m: m["metric_id"]), "|").alias("metrics"),
        F.array_join(F.transform("capabilities", lambda m: m["capability"]), "|").alias("capabilities"),
        F.size("sources").cast("long").alias("source_count"))


def q_overview(spark, sf):
    families = table(spark, sf, "part").select(F.col("p_brand").alias("family_id")).distinct()
    return catalog.library_overview(designs(spark, sf), families, "suite")


# --- graph ---------------------------------------------------------------------------------------


def q_geographies(spark, sf):
    return graph.geographies(cities(spark, sf))


def q_seed_graph(spark, sf):
    nodes, edges = graph.seed_graph(cities(spark, sf))
    return nodes.select("id", "kind", F.lit("node").alias("element")).unionByName(
        edges.select("id", "kind", F.lit("edge").alias("element")))


def q_graph_violations(spark, sf):
    nodes = table(spark, sf, "customer").select(F.concat(F.lit("n"), "c_custkey").alias("id"))
    edges = table(spark, sf, "orders").select(
        F.concat(F.lit("e"), F.pmod("o_orderkey", F.lit(14990))).alias("id"),
        F.concat(F.lit("n"), "o_custkey").alias("source"), F.concat(F.lit("n"), F.col("o_custkey") + 700).alias("target"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "causal").otherwise("observed").alias("evidence_type"))
    return graph.graph_violations(nodes, edges).groupBy("relation").agg(
        F.count("*").alias("references"), F.sum("rows").alias("rows"))


def q_bundle_violations(spark, sf):
    g = graph.geographies(cities(spark, sf).filter("score > 0"))
    tables_ = {
        "geographies": g,
        "measures": table(spark, sf, "part").select(F.col("p_partkey").alias("measure_id")),
        "observations": table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("observation_id"), F.col("l_suppkey").cast("string").alias("geography_id"), F.col("l_partkey").alias("measure_id")),
        "facilities": table(spark, sf, "supplier").select(F.col("s_suppkey").alias("facility_id"), F.col("s_suppkey").cast("string").alias("geography_id")),
        "events": table(spark, sf, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("geography_id")),
    }
    return graph.bundle_violations(tables_).groupBy("relation").agg(F.count("*").alias("references"), F.sum("rows").alias("rows"))


def q_observation_violations(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", "estimated").when(F.col("l_returnflag") == "N", "observed").otherwise("simulated").alias("evidence_type"),
        F.when(F.col("l_tax") > 0.04, F.lit(" ")).otherwise(F.lit("survey")).alias("method"),
        F.lit(0.0).alias("minimum"), F.lit(40.0).alias("maximum"), F.col("l_quantity").alias("value"),
        F.col("l_shipdate").cast("date").alias("start"), F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber") - 1).alias("end"))
    return graph.observation_violations(rows).select(F.explode("issues").alias("issue")).groupBy("issue").agg(
        F.count("*").alias("rows"))


# --- text ----------------------------------------------------------------------------------------


def q_token_sets(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.size(ta.token_set(F.col("text"))).cast("long").alias("tokens"))


def q_duplicate_groups(spark, sf):
    return ta.duplicate_groups(table(spark, sf, "documents"), "doc_id", "text").select("first_id", "members")


def q_duplicate_members(spark, sf):
    return ta.duplicate_members(table(spark, sf, "documents"), "doc_id", "text")


def q_similar_pairs(spark, sf):
    return ta.similar_pairs(table(spark, sf, "documents"), "doc_id", ["text"]).select(
        "first_a", "first_b", "similarity", F.col("shared_terms").cast("long").alias("shared_terms"), "row_pairs")


def q_similarity_totals(spark, sf):
    return ta.similarity_totals(table(spark, sf, "documents"), "doc_id", ["text"])


def q_closest_sets(spark, sf):
    return ta.closest_sets(table(spark, sf, "documents"), "doc_id", ["text"], 2000).withColumn(
        "shared_terms", F.col("shared_terms").cast("long"))


def q_closest_pairs(spark, sf):
    return ta.closest_pairs(table(spark, sf, "documents"), "doc_id", ["text"])


def q_signature_collisions(spark, sf):
    found = ta.signature_collisions(table(spark, sf, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])
    return found.select("first_id", "members")


def q_audit_library(spark, sf):
    rules = {"title": F.length("title") > 0, "question": F.length("question") > 8, "family": F.col("family_id").isNotNull()}
    found = ta.audit_library(designs(spark, sf), "design_id", ["family_id", "suite", "question"], ["title"], ["title", "question"], rules)
    return found.select(F.size("failures").cast("long").alias("failed_checks"), "audit_passed",
                        F.array_join(F.filter("failures", lambda f: ~f.startswith("high")), ";").alias("failures"))


def q_completeness(spark, sf):
    d = designs(spark, sf)
    return ta.completeness(d, {"question": F.length("question") > 8, "family": F.col("family_id").isNotNull()})


FORBIDDEN = {"html-tag": "<", "license": "Licensed under", "guarantee": "guaranteed impact", "the-word": " the "}


def q_scan_forbidden(spark, sf):
    return ta.scan_forbidden(table(spark, sf, "documents"), "doc_id", "text", FORBIDDEN)


def q_scan_required(spark, sf):
    rules = table(spark, sf, "labels").select(
        F.concat(F.lit("r"), "doc_id").alias("rule_id"), F.col("doc_id").alias("document"),
        F.when(F.col("quality") == 1, " the ").otherwise(" und ").alias("phrase"))
    return ta.scan_required(table(spark, sf, "documents"), "doc_id", "text", rules)


def claims(spark, sf):
    op = F.when(F.col("event_type") == "view", "choose-two").when(F.col("event_type") == "click", "count").otherwise("single")
    k = F.regexp_extract("props", "([0-9]+)", 1).cast("long")
    return table(spark, sf, "events").select(
        F.col("event_id").alias("claim_id"), op.alias("operation"), F.lit(0).alias("source_order"),
        F.col("event_id").alias("document"),
        F.when(F.col("event_type") == "click", "").when(F.col("event_type") == "error", "/absent").otherwise("/k").alias("pointer"),
        F.when(F.col("event_type") == "view", (k * (k - 1) / 2).cast("long")).when(F.col("event_type") == "click", 1)
        .when(F.col("event_type") == "signup", k + 1).otherwise(k).cast("string").alias("expected"))


def evidence(spark, sf):
    return table(spark, sf, "events").select(F.col("event_id").alias("document"), F.col("props").alias("content"))


def q_claims(spark, sf):
    return ta.evaluate_claims(claims(spark, sf), evidence(spark, sf))


def q_renderings(spark, sf):
    checked = ta.evaluate_claims(claims(spark, sf), evidence(spark, sf)).filter(F.col("value").isNotNull())
    rend = table(spark, sf, "events").select(
        F.col("event_id").alias("claim_id"), F.lit(1).alias("ordinal"), F.col("event_id").alias("document"),
        F.lit('"k": {value}}').alias("template"))
    docs = table(spark, sf, "events").select(F.col("event_id").alias("document"), F.col("props").alias("text"))
    return ta.check_renderings(rend, checked, docs).select("check", "document", "passed")


def q_audit_summary(spark, sf):
    return ta.audit_summary(ta.evaluate_claims(claims(spark, sf), evidence(spark, sf)), ["operation"])


# --- hashes and scalars ---------------------------------------------------------------------------


def q_content_hash(spark, sf):
    return table(spark, sf, "nation").join(table(spark, sf, "customer"), F.col("n_nationkey") == F.col("c_nationkey")).select(
        "c_custkey", hashing.content_hash(["c_custkey", "n_name", "c_mktsegment"]).alias("content_hash"),
        hashing.short_key(F.concat_ws("/", "c_custkey", "n_name")).alias("short_key"),
        hashing.seed_of(F.concat_ws("/", "c_custkey", "n_name")).alias("seed"))


def q_canonical_documents(spark, sf):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    line = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), net.alias("net"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(line)).alias("lines"), F.sum(net).alias("total"))
    head = F.struct(
        F.col("o_orderstatus").alias("status"), F.col("o_orderdate").cast("date").alias("day"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority"),
    )
    docs = table(spark, sf, "orders").select("o_orderkey", head.alias("order")).join(
        lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").drop("l_orderkey")
    return docs.select("o_orderkey", canonical.canonical_json(docs).alias("document")).withColumn("content_hash", hashing.digest(F.col("document")))


def q_canonical_variants(spark, sf):
    text = F.concat(F.lit('{"props":'), "props", F.lit(',"at":[null,{"seventh":'), (F.col("value") / 7).cast("string"), F.lit("}]}"))
    docs = table(spark, sf, "events").filter(F.col("value").isNotNull() & F.col("props").isNotNull()).select("event_id", F.parse_json(text).alias("v"))
    return docs.select("event_id", canonical.canonical_json(docs, ["v"]).alias("document"))


def q_artifact_set_hash(spark, sf):
    rows = table(spark, sf, "documents").select("source", "doc_id", F.md5("text").alias("h"))
    return hashing.artifact_set_hash(rows, ["source"], "doc_id", "h")


def q_fingerprint(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return hashing.fingerprint({
        "nations": n.select("n_nationkey", "n_name", "n_regionkey"), "regions": r.select("r_regionkey", "r_name"),
        "orders": table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "none": r.select("r_name").limit(0),
    })


def q_differing_ranges(spark, sf):
    """Slots of order keys at which two versions of the orders differ."""
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_orderstatus")
    key = F.col("o_orderkey")
    later = orders.filter(key % 1999 != 7).withColumn(
        "o_orderstatus", F.when(key % 997 == 5, F.lit("X")).otherwise(F.col("o_orderstatus")))
    line = F.concat_ws("=", "o_orderkey", "o_orderstatus")
    a, b = (merkle.ordered_leaves(v, ["o_orderpriority"], key, ["o_orderkey"], line, 64) for v in (orders, later))
    return merkle.differing_slots(a, b, ["o_orderpriority"], merkle.ORDERED_LEVELS)


def q_scalars(spark, sf):
    c = table(spark, sf, "customer")
    box = scalar.bbox(F.col("c_acctbal") / 120, F.col("c_acctbal") / 50, 0.5)
    return c.select(
        "c_custkey", scalar.round_away(box["west"], 6).alias("west"), scalar.round_away(box["north"], 6).alias("north"),
        scalar.round_away(scalar.centroid(box)["latitude"], 6).alias("centre_latitude"),
        scalar.norm_code(F.lower("c_mktsegment"), allowed=["BUILDING", "MACHINERY"]).alias("code"),
        scalar.search_key(F.concat_ws("-#", "c_name", "c_mktsegment")).alias("search_key"),
        scalar.clamp(F.col("c_acctbal"), F.lit(0.0), F.lit(5000.0)).alias("clamped"),
        scalar.significant(F.col("c_acctbal") / 7).alias("portable"),
        scalar.fmt_metric(scalar.round_away(F.col("c_acctbal"), 2)).alias("text"),
        scalar.norm_dim(F.when(F.pmod("c_custkey", F.lit(3)) == 0, "  ").otherwise(F.concat(F.lit(" "), "c_mktsegment"))).alias("label"))


def q_missing_labels(spark, sf):
    """Documents that no label row names."""
    return select.missing_ids(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


def q_demand_points(spark, sf):
    tracts = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("tractfips"), (F.col("c_custkey") % 60).cast("double").alias("latitude"),
        (F.col("c_custkey") % 170).cast("double").alias("longitude"), F.floor(F.abs("c_acctbal")).cast("long").alias("population"),
        (F.col("c_custkey") * 13 % 101).cast("double").alias("lacktrpt_crudeprev"),
        F.when(F.col("c_acctbal") < 0, F.array(F.lit("population is missing or negative"))).otherwise(F.array().cast("array<string>")).alias("issues"),
        "c_nationkey")
    return readers.demand_points(tracts, F.concat(F.lit("area-"), F.col("c_nationkey")))


def q_local_time(spark, sf):
    zone = F.element_at(F.array(F.lit("America/New_York"), F.lit("Asia/Tokyo"), F.lit("UTC")), (F.pmod("o_orderkey", F.lit(3)) + 1).cast("int"))
    day = F.col("o_orderdate").cast("date")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.unix_seconds(scalar.local_midnight(day, zone)).alias("midnight"),
        F.unix_micros(scalar.local_day_end(day, zone)).alias("cutoff"))


QUERIES = {
    "breadth_first_selection": q_breadth_first, "first_eligible": q_first_eligible, "page": q_paginate,
    "duplicate_keys": q_duplicate_keys, "calendar_check": q_calendar_check, "missing_ids": q_missing_ids,
    "tolerance_join": q_tolerance_join, "context_join": q_join_context, "population_join": q_join_population,
    "fk_violations": q_fk_violations, "reconcile_sets": q_reconcile_sets, "highest_tier": q_highest_tier,
    "template_expansion": q_expand, "registry_check": q_check_registry, "design_join": q_join_designs,
    "mapping_issues": q_mapping_issues, "missing_labels": q_missing_labels, "demand_points": q_demand_points,
    "climate_window_metrics": q_climate_window, "climate_annual_metrics": q_climate_annual,
    "country_metrics": q_country_metrics, "melt_metrics": q_melt, "compare_cities": q_compare,
    "enum_counts": q_enum_counts, "suite_overview": q_suite_overview, "family_summary": q_family_summary,
    "evidence_totals": q_evidence_totals, "check_totals": q_check_totals, "nearest_rank_summary": q_nearest_rank,
    "pack_ledger": q_pack_ledger, "screen_tally": q_screen_tally, "dedupe_or_conflict": q_dedupe,
    "catalog_summary": q_catalog_summary,
    "search_cities": q_search_cities, "search_scenarios": q_search_scenarios, "search_packs": q_search_packs,
    "search_sources": q_search_sources, "search_designs": q_search_designs, "search_families": q_search_families,
    "indexed_cities": partial(q_search_cities, indexed=True), "indexed_scenarios": partial(q_search_scenarios, indexed=True),
    "indexed_packs": partial(q_search_packs, indexed=True), "indexed_sources": partial(q_search_sources, indexed=True),
    "indexed_designs": partial(q_search_designs, indexed=True), "indexed_families": partial(q_search_families, indexed=True),
    "city_lookup": q_lookup, "city_detail": q_city_detail, "library_overview": q_overview,
    "geographies": q_geographies, "seed_graph": q_seed_graph, "graph_violations": q_graph_violations,
    "bundle_violations": q_bundle_violations, "observation_violations": q_observation_violations,
    "token_sets": q_token_sets, "duplicate_groups": q_duplicate_groups, "duplicate_members": q_duplicate_members,
    "similar_pairs": q_similar_pairs, "similarity_totals": q_similarity_totals, "closest_pairs": q_closest_pairs,
    "closest_sets": q_closest_sets,
    "signature_collisions": q_signature_collisions, "library_audit": q_audit_library, "completeness": q_completeness,
    "forbidden_literals": q_scan_forbidden, "required_phrases": q_scan_required, "claim_values": q_claims,
    "claim_renderings": q_renderings, "audit_summary": q_audit_summary,
    "canonical_documents": q_canonical_documents, "canonical_variants": q_canonical_variants,
    "content_hash": q_content_hash, "artifact_set_hash": q_artifact_set_hash, "scalar_rules": q_scalars,
    "catalog_fingerprint": q_fingerprint, "differing_ranges": q_differing_ranges,
    "local_time": q_local_time,
}
