"""Quality gates, screens and decision packs over the landed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import gates, packs
from tessera.operators import requests as rq
from tessera.plans import draws
from tessera.queries import analysis
from tessera.queries.requests import REQUESTS, requests_table, views
from tessera.queries.tables import climate_series, context, designs
from tessera.operators import summaries
from tessera.session import table

TEMPLATES = (
    packs.Template("all-demand", "public-service", "any-demand"),
    packs.Template("urgent-demand", "climate-disaster", "category-demand", ("urgent", "high"), 100),
    packs.Template("unspecified", "infrastructure-finance", "category-demand", ("not spec",), 1_000_000_000),
    packs.Template("no-match", "population-health", "category-demand", ("pothole",), 1),
    packs.Template("effect-study", "behavioral-equity", "required-causal-design"),
    packs.Template("transit-access", "mobility-access", "required-network"),
)


def option_draws(spark, sf):
    """Three options per scenario, one draw per active day, spread by the day's request count."""
    daily = requests_table(spark, sf).groupBy("city", "service_day").agg(F.count("*").alias("n"))
    draw = F.datediff("service_day", F.lit("1995-01-01").cast("date"))
    listed = F.explode(F.array(
        F.struct(F.lit("no-action").alias("option_id"), (F.pmod("n", F.lit(7)) * 0.01).alias("value")),
        F.struct(F.lit("conservative-plan").alias("option_id"), (F.pmod("n", F.lit(5)) * 0.01 + 0.45).alias("value")),
        F.struct(F.lit("bounded-portfolio").alias("option_id"), (F.lit(1.0) - F.pmod("n", F.lit(4)) * 0.02).alias("value"))))
    order = F.explode(F.sequence(F.lit(1), F.lit(len(TEMPLATES))))
    return daily.select("city", draw.alias("draw"), listed.alias("o")).select("city", "draw", "o", order.alias("t")).select(
        F.format_string("tierd.%s.%02d", F.lower("city"), F.col("t")).alias("run_id"), "o.option_id", "draw", "o.value",
        F.lit("simulated").alias("evidence_type"))


def compiled(spark, sf):
    return packs.compile_scenarios(views(spark, sf), TEMPLATES, option_draws(spark, sf))


def q_packs(spark, sf):
    return compiled(spark, sf)["packs"].select(
        "scenario_id", "city", "template_id", "observed_requests", "status", "readiness", "selected_option_id",
        "uncertainty_status", "failure_reason", F.coalesce(F.size("options"), F.lit(0)).cast("long").alias("option_count"),
        F.array_join(F.transform("reversal_tests", lambda t: t["outcome"]), "|").alias("reversals"), "seed")


def q_registry(spark, sf):
    return packs.registry(compiled(spark, sf)["packs"]).select(
        "city", F.array_join("pack_ids", "|").alias("pack_ids"), F.array_join("statuses", "|").alias("statuses"), "completed", "negative")


def q_scenario_options(spark, sf):
    return compiled(spark, sf)["options"].select(
        "run_id", "option_id", "evidence_type", "feasible", "plan_id", F.round("objective_value", 6).alias("objective_value"),
        F.round("total_cost", 4).alias("total_cost"), F.round("probability_best", 6).alias("probability_best"))


def q_gate_scenarios(spark, sf):
    v = views(spark, sf)
    focus = rq.focus_summary(v, {t.template_id: t.keywords for t in TEMPLATES}).withColumnRenamed("rule_id", "template_id")
    rows = packs.scenarios(rq.window_bounds(v), TEMPLATES).join(focus, ["city", "template_id"], "left").withColumn(
        "observed_requests", F.coalesce("matching_requests", F.lit(0)).cast("long"))
    return gates.gate_scenarios(rows).select("scenario_id", "template_id", "observed_requests", "negative_reason")


def q_parameters(spark, sf):
    daily = rq.daily_stats(views(spark, sf), rq.window_bounds(views(spark, sf)))
    rows = packs.scenario_parameters(daily.select(F.col("city").alias("scenario_id"), "daily_mean"))
    return rows.select("scenario_id", "parameter_id", "kind", *[F.round(F.col(c), 8).alias(c) for c in ("fixed_value", "minimum", "mode", "maximum")], "coefficient")


def q_screens(spark, sf):
    climate = summaries.climate_metrics(climate_series(spark, sf), summaries.ANNUAL_CLIMATE, 6)
    country = summaries.country_metrics(context(spark, sf)).select(
        F.substring("country_code", 2, 5).cast("long").alias("city_id"), "metric_id", "value", "evidence_type")
    return packs.screen_cities(climate.unionByName(country)).select(
        "run_id", "city_id", "template_id", "status", "missing_metrics", F.size("metrics").cast("long").alias("metric_count"), "recommendation_issued")


def q_quality_standard(spark, sf):
    """Users as cities: five event types over thirty days, most of them incomplete."""
    series = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("city_id"), F.col("event_type").alias("parameter"), F.col("ts").cast("date").alias("day")
    ).agg(F.avg("value").alias("value"), F.count("*").alias("n")).select(
        "city_id", F.lit("art").alias("artifact"), (F.col("city_id") + 0.0004).alias("longitude"), (F.col("city_id") / 2).alias("latitude"),
        "parameter", "day", "value", (F.col("n") > 3).alias("is_fill"))
    users = table(spark, sf, "events").groupBy(F.col("user_id").alias("city_id")).agg(F.count("*").alias("record_count"))
    cities = users.select("city_id", (F.col("city_id") / 2).alias("latitude"), (F.col("city_id") * 1.0).alias("longitude"))
    manifests = users.select("city_id", "record_count", (F.col("city_id") / 2).alias("query_latitude"), (F.col("city_id") * 1.0).alias("query_longitude"))
    checks = gates.quality_standard(series, cities, manifests, "2024-01-01", 30, ["click", "error", "purchase", "signup", "view"])
    return checks.select("city_id", "check_id", "status")


def q_quality_report(spark, sf):
    report = gates.quality_report(q_quality_standard(spark, sf), "city_id")
    go, stopped = gates.require_quality(report, "city_id")
    return stopped.select("city_id", F.lit("stopped").alias("outcome"), "reason").unionByName(
        go.select("city_id", F.lit("released").alias("outcome"), F.lit(None).cast("string").alias("reason")))


def _deep(spark, sf):
    v = views(spark, sf)
    bounds = rq.window_bounds(v)
    rows = v.groupBy("city", "view").agg(F.count("*").alias("record_count"))
    city = rows.select("city").distinct()
    extra = city.select("city", F.explode(F.array(F.lit("population"), F.lit("boundary"), F.lit("climate"))).alias("artifact_id")).select(
        "city", "artifact_id", F.lit(None).cast("string").alias("view"), F.lit(1).cast("long").alias("record_count"))
    manifests = rows.select("city", F.col("view").alias("artifact_id"), "view", "record_count").unionByName(extra)
    places = city.select("city", F.col("city").alias("declared_geoid"), F.col("city").alias("population_geoid"), F.upper(F.substring("city", 1, 6)).alias("boundary_geoid"))
    climate = requests_table(spark, sf).select("city", F.col("category").alias("parameter"), F.col("service_day").alias("day"), F.lit(1.0).alias("value"))
    return v, bounds, manifests, places, climate


def q_quality_deep(spark, sf):
    v, bounds, manifests, places, climate = _deep(spark, sf)
    return gates.quality_deep(v, bounds, manifests, places, climate, ["1-URGENT", "2-HIGH"]).select("city", "check_id", "status")


def q_evidence_gate(spark, sf):
    d, l = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(*[F.lit(x) for x in ("observed", "estimated", "causal", "simulated", "optimized", "proposed")]), (F.pmod("doc_id", F.lit(6)) + 1).cast("int")).alias("type"),
        F.when(F.col("toxic") == 1, "failed").otherwise("limited").alias("status"),
        F.when(F.col("quality").isNotNull(), F.array("source")).alias("source_refs"), F.when(F.col("quality") == 1, F.col("lang")).alias("method"),
        F.when(F.col("quality") == 1, F.lit("did")).alias("identification_strategy"), F.when(F.col("toxic") == 0, F.array("lang")).alias("diagnostics"),
        F.when(F.col("lang") == "en", F.col("source")).alias("scenario_ref"), F.when(F.col("lang") != "en", F.lit("max")).alias("objective"),
        F.when(F.col("quality") == 1, F.array(F.lit("c"))).alias("constraints"), F.when(F.col("n_chars") > 1000, F.array("lang")).alias("limitations"))
    return gates.evidence_violations(rows).select("id", "type", F.array_join("issues", "|").alias("issues"))


def q_metric_gate(spark, sf):
    metrics = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("city_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("metric_id"),
        F.when(F.col("l_returnflag") == "A", "estimated").when(F.col("l_returnflag") == "N", "observed").otherwise("causal").alias("evidence_type"),
        F.when(F.col("l_tax") > 0.02, "survey").alias("method"), F.array(F.col("l_linestatus"), F.when(F.col("l_linenumber") == 7, "X").otherwise("Y")).alias("source_refs"))
    declared = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("city_id"), F.array(F.lit("F"), F.lit("O"), F.lit("Y")).alias("artifacts"))
    return gates.metric_violations(metrics, declared).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("metrics"))


def q_pack_gate(spark, sf):
    key = F.col("o_orderkey")
    kinds = F.array(F.lit("policy-scenario"), F.lit("decision-pack"), F.when(F.col("o_orderstatus") == "P", "decision-pack").otherwise("decision-brief"))
    rows = table(spark, sf, "orders").select(
        key.alias("pack_id"), F.col("o_custkey").alias("city_id"), F.when(key % 7 == 0, -key - 1).otherwise(key).alias("scenario_id"),
        F.col("o_custkey").alias("scenario_city"), F.when(key % 11 == 0, -key - 1).otherwise(key).alias("decision_scenario"),
        F.when(F.col("o_orderstatus") != "O", F.array_append(kinds, "optimization-run")).otherwise(kinds).alias("kinds"),
        F.when(F.col("o_orderpriority") < "3", "completed").otherwise("negative").alias("status"),
        F.when(F.col("o_orderstatus") == "F", "planning-support").otherwise("insufficient-evidence").alias("readiness"),
        F.when(F.col("o_orderpriority") < "4", "completed").otherwise("failed").alias("decision_status"), (key % 5).alias("observed_requests"),
        F.lit(False).alias("has_forecast"), F.lit(False).alias("has_simulation"), (F.col("o_orderstatus") != "P").alias("has_optimization"),
        (key % 2 == 0).alias("has_uncertainty"))
    return gates.pack_violations(rows).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("packs"))


def q_reversal_tests(spark, sf):
    return packs.reversal_tests(draws.reversals(analysis.option_draws(spark, sf), analysis.OPTIONS)).select(
        "test_id", "baseline_option_id", F.round("reversal_probability", 6).alias("reversal_probability"), "selected_after_test", "outcome")


def q_decision_gate(spark, sf):
    options = F.array(
        F.struct(F.lit("F").alias("id"), F.lit(True).alias("feasible")), F.struct(F.lit("O").alias("id"), (F.col("o_totalprice") > 200000).alias("feasible")))
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderpriority") < "4", "completed").otherwise("failed").alias("status"), options.alias("options"),
        F.when(F.col("o_orderpriority") < "5", F.col("o_orderstatus")).alias("selected_option_id"), F.pmod("o_orderkey", F.lit(3)).cast("int").alias("reversal_tests"),
        F.lit(3).alias("value_of_information"), F.when(F.col("o_orderstatus") == "P", "no feasible plan").alias("failure_reason"), F.array(F.lit("pilot")).alias("next_evidence"))
    return gates.decision_violations(rows).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("runs"))


def q_scenario_gate(spark, sf):
    rows = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        "l_orderkey", F.col("l_shipdate").alias("data_cutoff"), F.col("o_orderdate").alias("as_of"), F.array("l_returnflag", "o_orderstatus").alias("intervention_ids"),
        F.array("l_linestatus", "o_orderstatus").alias("objective_ids"), F.array(F.lit("a")).alias("constraint_ids"),
        F.array(F.when(F.col("l_linenumber") > 3, "causal").otherwise("forecast")).alias("analysis_modes"),
        F.array(F.when(F.col("l_linenumber") > 5, "causal").otherwise("observed")).alias("evidence_requirements"))
    return gates.scenario_violations(rows).select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("scenarios"))


def q_capabilities(spark, sf):
    role = F.create_map(*[F.lit(x) for x in ("BUILDING", "municipal-demand", "MACHINERY", "climate-context", "HOUSEHOLD", "demographic-context", "AUTOMOBILE", "geographic-identity", "FURNITURE", "network")])
    bound = table(spark, sf, "customer").select(
        F.floor(F.col("c_custkey") / 4).alias("city_id"), F.try_element_at(role, F.col("c_mktsegment")).alias("role"), F.col("c_custkey").alias("artifact_id")
    ).filter(F.col("role").isNotNull())
    return gates.capabilities(bound).select("city_id", "capability_id", "status", F.array_join("satisfied", "|").alias("satisfied"), "evidence_refs")


def q_bindings(spark, sf):
    manifests = table(spark, sf, "documents").select(
        F.col("lang").alias("city_id"), F.col("source").alias("source_id"), F.col("doc_id").alias("artifact_id"), F.md5("text").alias("content_hash"), F.col("source").alias("family"))
    roles = {"src1": ("municipal-demand", "observed"), "src2": ("climate-context", "estimated"), "src3": ("geographic-identity", "observed")}
    return gates.bindings(manifests, roles)


def q_readiness(spark, sf):
    rows = designs(spark, sf).select(
        "design_id", "template_ref", F.array(F.lit("municipal-demand"), F.when(F.col("title").startswith("red"), "network").otherwise("climate-context")).alias("source_roles"),
        F.array(F.lit("descriptive"), F.when(F.col("suite") == "PROMO", "causal").when(F.col("suite") == "SMALL", "simulation").otherwise("optimization")).alias("analysis_modes"),
        F.when(F.col("suite") == "PROMO", "identification").when(F.col("suite") == "LARGE", "calibration").otherwise("review").alias("gate_type"))
    return gates.design_readiness(rows).select(
        "design_id", "implementation_status", "readiness", F.array_join("required_evidence", "|").alias("required_evidence"), F.array_join("gate_evidence", "|").alias("gate_evidence"))


def q_adapters(spark, sf):
    cities = table(spark, sf, "customer").select(
        F.concat(F.when(F.col("c_nationkey") == 4, "City ").otherwise(F.lit("city-")), "c_custkey").alias("city_id"), F.col("c_name").alias("name"), F.lit("US").alias("country_code"),
        (F.col("c_acctbal") / 120).alias("latitude"), (F.col("c_acctbal") / 60).alias("longitude"), F.array("c_mktsegment", F.when(F.col("c_nationkey") == 5, F.col("c_mktsegment")).otherwise(F.lit("geo"))).alias("source_ids"))
    rows = gates.adapters(cities, ["identity"], ["no polygon"], "2023-01-01", "2024-12-31")
    return gates.adapter_row_violations(rows).select("city_id", F.array_join("issues", "|").alias("issues"))


def q_adapter_packages(spark, sf):
    packages = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("plugin_id"), F.col("o_orderkey").cast("string").alias("path"), F.floor(F.col("o_orderkey") / 2).alias("city_id"), F.md5(F.col("o_orderkey").cast("string")).alias("declared_hash"))
    files = table(spark, sf, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("name"), F.md5(F.concat_ws("", "o_orderkey", F.when(F.col("o_orderstatus") == "O", "x"))).alias("actual_hash"))
    bad = gates.adapter_violations(packages, files, ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"])
    return bad.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("adapters"))


def q_registry_integrity(spark, sf):
    c = table(spark, sf, "customer")
    digest_ = F.concat(F.lit("sha256:"), F.sha2(F.col("c_custkey").cast("string").cast("binary"), 256))
    entries = c.filter("c_acctbal > 0").select(
        F.col("c_custkey").alias("city_id"), (F.col("c_custkey") + 1).alias("selection_order"), (F.col("c_custkey") + 1).alias("tier_g_rank"),
        F.concat(F.lit("cities/"), "c_custkey", F.lit("/bundle.json")).alias("bundle_ref"), F.when(F.col("c_nationkey") == 2, F.upper(digest_)).otherwise(digest_).alias("bundle_hash"),
        F.array(F.lit("runs/a.json"), F.when(F.col("c_nationkey") == 3, "/runs/b.json").otherwise("runs/b.json")).alias("run_refs"),
        F.array(F.lit("1"), F.when(F.col("c_nationkey") == 4, "1").otherwise("2")).alias("run_hashes"), F.array(F.lit("s"), F.lit("s")).alias("statuses"))
    excluded = c.filter("c_acctbal < 100").select(F.col("c_custkey").alias("city_id"), (F.col("c_custkey") + 1).alias("tier_g_rank"))
    return gates.registry_violations(entries, excluded, 5).select("subject", F.array_join("issues", "|").alias("issues"))


def q_expand_designs(spark, sf):
    families = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("family_id"), F.col("p_type").alias("suite"), F.col("p_name").alias("decision_object"), F.lower("p_brand").alias("outcome"), F.array(F.lit("climate-hazard")).alias("source_roles"))
    settings = {"invest": {"mechanism": "capital plan", "mode": "optimization", "roles": ["asset-registry"]}, "rule": {"mechanism": "standard", "mode": "causal", "roles": []}}
    return packs.expand_designs(families, settings).select("design_id", "title", "question", F.array_join("source_roles", "|").alias("source_roles"), F.array_join("analysis_modes", "|").alias("analysis_modes"))


def q_executions(spark, sf):
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    deep = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("execution_id"), F.col("o_custkey").alias("city_id"), F.col("o_orderpriority").alias("suite"), F.col("o_orderstatus").alias("status"), F.lit("deep run").alias("title"))
    standard = c.select(F.col("c_custkey").alias("execution_id"), F.col("c_nationkey").alias("city_id"), F.col("c_mktsegment").alias("suite"), F.lit("screened").alias("status"), F.col("c_name").alias("title"))
    return packs.all_executions(("deep", deep), ("standard", standard))


QUERIES = {
    "decision_packs": q_packs, "pack_registry": q_registry, "scenario_options": q_scenario_options, "scenario_gate_reasons": q_gate_scenarios,
    "scenario_parameters": q_parameters, "city_screens": q_screens, "quality_standard": q_quality_standard, "quality_report": q_quality_report,
    "quality_deep": q_quality_deep, "evidence_gate": q_evidence_gate, "metric_gate": q_metric_gate, "decision_gate": q_decision_gate, "pack_gate": q_pack_gate, "reversal_tests": q_reversal_tests,
    "scenario_gate": q_scenario_gate, "capabilities": q_capabilities, "source_bindings": q_bindings, "design_readiness": q_readiness,
    "adapter_rows": q_adapters, "adapter_packages": q_adapter_packages, "registry_integrity": q_registry_integrity,
    "design_matrix": q_expand_designs, "all_executions": q_executions,
}

SCENARIOS = f"""{REQUESTS}, templates(ord, template_id, keywords, strategy, least) AS (VALUES
  (1, 'all-demand', CAST([] AS VARCHAR[]), 'any-demand', 0), (2, 'urgent-demand', ['urgent', 'high'], 'category-demand', 100),
  (3, 'unspecified', ['not spec'], 'category-demand', 1000000000), (4, 'no-match', ['pothole'], 'category-demand', 1),
  (5, 'effect-study', CAST([] AS VARCHAR[]), 'required-causal-design', 0), (6, 'transit-access', CAST([] AS VARCHAR[]), 'required-network', 0)),
cityn AS (SELECT city, category, count(*) AS n FROM requests GROUP BY 1, 2),
focus AS (SELECT city, ord, template_id, any_value(strategy) AS strategy, any_value(least) AS least,
    CAST(coalesce(sum(n) FILTER (len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(lower(category), k))) > 0), 0) AS BIGINT) AS observed
  FROM cityn, templates GROUP BY 1, 2, 3),
gated AS (SELECT *, 'tierd.' || lower(city) || '.0' || ord AS scenario_id, CASE
    WHEN strategy = 'required-causal-design' THEN '{gates.NO_DESIGN}' WHEN strategy = 'required-network' THEN '{gates.NO_NETWORK}'
    WHEN strategy = 'category-demand' AND observed < least THEN 'The declared keyword rule matches ' || format('{{:,}}', observed)
      || ' requests, below the minimum gate of ' || format('{{:,}}', least) || '.' END AS reason FROM focus)"""

ORACLES = {
    "scenario_gate_reasons": f"WITH {SCENARIOS} SELECT scenario_id, template_id, observed AS observed_requests, reason AS negative_reason FROM gated",
    "decision_packs": f"""WITH {SCENARIOS} SELECT scenario_id, city, template_id, observed AS observed_requests,
        CASE WHEN reason IS NULL THEN 'completed' ELSE 'insufficient-evidence' END AS status, CASE WHEN reason IS NULL THEN 'planning-support' ELSE 'insufficient-evidence' END AS readiness,
        CASE WHEN reason IS NULL THEN 'bounded-portfolio' END AS selected_option_id, CASE WHEN reason IS NULL THEN 'robust-winner' END AS uncertainty_status,
        reason AS failure_reason, CAST(CASE WHEN reason IS NULL THEN 3 ELSE 0 END AS BIGINT) AS option_count,
        CASE WHEN reason IS NULL THEN 'stable|stable' END AS reversals, CAST('0x' || substr(sha256(scenario_id), 1, 8) AS BIGINT) AS seed FROM gated""",
    "pack_registry": f"""WITH {SCENARIOS} SELECT city, string_agg(scenario_id, '|' ORDER BY ord) AS pack_ids,
        string_agg(CASE WHEN reason IS NULL THEN 'completed' ELSE 'insufficient-evidence' END, '|' ORDER BY ord) AS statuses,
        count(*) FILTER (reason IS NULL) AS completed, count(*) FILTER (reason IS NOT NULL) AS negative FROM gated GROUP BY 1""",
    "scenario_parameters": f"""WITH {REQUESTS}, m AS (SELECT city AS scenario_id, count(*) / (date_diff('day', min(service_day), max(service_day)) + 1) AS m FROM requests GROUP BY 1)
        SELECT scenario_id, 'baseline-demand' AS parameter_id, 'fixed' AS kind, round(m, 8) AS fixed_value, CAST(NULL AS DOUBLE) AS minimum, CAST(NULL AS DOUBLE) AS mode, CAST(NULL AS DOUBLE) AS maximum, CAST(1 AS DOUBLE) AS coefficient FROM m
        UNION ALL SELECT scenario_id, 'demand-shock', 'triangular', NULL, round(-0.1 * m, 8), round(0.03 * m, 8), round(0.2 * m, 8), 1 FROM m
        UNION ALL SELECT scenario_id, 'action-relief', 'triangular', NULL, round(0.01 * m, 8), round(0.07 * m, 8), round(0.18 * m, 8), -1 FROM m
        UNION ALL SELECT scenario_id, 'implementation-friction', 'uniform', NULL, 0, NULL, round(greatest(0.06 * m, greatest(0.001 * m, 0.001)), 8), 1 FROM m""",
    "quality_deep": f"""WITH {REQUESTS}, s AS (SELECT city, count(DISTINCT service_day) AS a, date_diff('day', min(service_day), max(service_day)) + 1 AS w,
          count(DISTINCT service_day) FILTER (category = '1-URGENT') AS u, count(DISTINCT service_day) FILTER (category = '2-HIGH') AS h FROM requests GROUP BY 1)
        SELECT city, c.id AS check_id, c.st AS status FROM (SELECT city, unnest([
          {{'id': 'source-manifest-count', 'st': 'pass'}}, {{'id': 'municipal-view-total-reconciliation', 'st': 'pass'}}, {{'id': 'municipal-manifest-row-reconciliation', 'st': 'pass'}},
          {{'id': 'municipal-daily-activity-coverage', 'st': CASE WHEN a = w THEN 'pass' ELSE 'warn' END}}, {{'id': 'municipal-positive-counts', 'st': 'pass'}},
          {{'id': 'municipal-area-missingness', 'st': 'pass'}}, {{'id': 'acs-place-identity', 'st': 'pass'}},
          {{'id': 'tigerweb-place-identity', 'st': CASE WHEN len(city) <= 6 THEN 'pass' ELSE 'fail' END}},
          {{'id': 'nasa-parameter-date-coverage', 'st': CASE WHEN u = w AND h = w THEN 'pass' ELSE 'fail' END}}, {{'id': 'nasa-fill-value-gate', 'st': 'pass'}}]) AS c FROM s)""",
    "evidence_gate": """WITH e AS (SELECT doc_id, doc_id % 6 AS t, quality, toxic, lang, n_chars FROM documents LEFT JOIN labels USING (doc_id)),
        i AS (SELECT doc_id, ['observed','estimated','causal','simulated','optimized','proposed'][t + 1] AS type, list_filter([
          CASE WHEN t = 0 AND quality IS NULL THEN 'observed evidence requires at least one source reference' END,
          CASE WHEN t = 1 AND coalesce(quality, 0) <> 1 THEN 'estimated evidence requires a method' END,
          CASE WHEN t = 2 AND coalesce(quality, 0) <> 1 THEN 'causal evidence requires an identification strategy' END,
          CASE WHEN t = 2 AND coalesce(toxic, 1) <> 0 THEN 'causal evidence requires diagnostics or refutations' END,
          CASE WHEN t = 3 AND lang <> 'en' THEN 'simulated evidence requires a scenario reference' END,
          CASE WHEN t = 4 AND lang = 'en' THEN 'optimized evidence requires an objective' END,
          CASE WHEN t = 4 AND coalesce(quality, 0) <> 1 THEN 'optimized evidence requires named constraints' END,
          CASE WHEN t = 5 AND n_chars <= 1000 THEN 'proposed evidence requires explicit limitations' END,
          CASE WHEN toxic = 1 AND n_chars <= 1000 THEN 'failed or insufficient evidence must explain limitations' END], lambda x: x IS NOT NULL) AS issues FROM e)
        SELECT doc_id AS id, type, array_to_string(issues, '|') AS issues FROM i WHERE len(issues) > 0""",
    "metric_gate": """SELECT issue, count(*) AS metrics FROM (SELECT unnest([CASE WHEN l_returnflag NOT IN ('A', 'N') THEN 'metric evidence type not allowed' END,
        CASE WHEN l_returnflag = 'A' AND l_tax <= 0.02 THEN 'estimated metrics require a method' END, CASE WHEN l_linenumber = 7 THEN 'metric source is not declared' END]) AS issue FROM lineitem) WHERE issue IS NOT NULL GROUP BY 1""",
    "pack_gate": """WITH p AS (SELECT *, o_orderpriority < '3' AS done, o_orderstatus = 'F' AS planning, o_orderpriority < '4' AS decided FROM orders)
        SELECT issue, count(*) AS packs FROM (SELECT unnest([
          CASE WHEN o_orderkey % 7 = 0 THEN 'pack identity must match its scenario' END,
          CASE WHEN o_orderkey % 11 = 0 THEN 'pack must embed its matching decision pack' END,
          CASE WHEN o_orderstatus = 'P' THEN 'artifact kinds must be unique' END,
          CASE WHEN o_orderstatus = 'P' THEN 'pack lacks a required artifact' END,
          CASE WHEN done AND NOT planning THEN 'completed scenarios are planning-support outputs' END,
          CASE WHEN done AND NOT decided THEN 'completed scenarios require a completed decision pack' END,
          CASE WHEN done AND o_orderkey % 5 < 1 THEN 'completed scenarios require observed requests' END,
          CASE WHEN done AND NOT (o_orderstatus <> 'P' AND o_orderkey % 2 = 0) THEN 'completed scenarios require optimization and uncertainty' END,
          CASE WHEN NOT done AND planning THEN 'negative scenarios must declare insufficient readiness' END,
          CASE WHEN NOT done AND decided THEN 'negative scenarios cannot embed a completed decision pack' END,
          CASE WHEN (o_orderstatus <> 'O') <> (o_orderstatus <> 'P') THEN 'optimization-run reference and model must align' END,
          CASE WHEN o_orderkey % 2 = 0 THEN 'uncertainty-run reference and model must align' END]) AS issue FROM p)
        WHERE issue IS NOT NULL GROUP BY 1""",
    "reversal_tests": f"""SELECT 'paired-draw-' || competing_option_id AS test_id, baseline_option_id, reversal_probability,
        CASE WHEN reversal_probability > 0 THEN competing_option_id ELSE baseline_option_id END AS selected_after_test,
        CASE WHEN reversal_probability > 0 THEN 'reversed' ELSE 'stable' END AS outcome FROM ({analysis.ORACLES['decision_reversals']})""",
    "decision_gate": """WITH d AS (SELECT *, o_orderpriority < '4' AS done, CASE WHEN o_orderpriority < '5' THEN o_orderstatus END AS sel FROM orders)
        SELECT issue, count(*) AS runs FROM (SELECT unnest([CASE WHEN done AND sel NOT IN ('F', 'O') THEN 'selected option does not exist' END,
          CASE WHEN done AND sel = 'O' AND o_totalprice <= 200000 THEN 'selected option must be feasible' END, CASE WHEN done AND o_orderkey % 3 = 0 THEN 'completed runs require at least one reversal test' END,
          CASE WHEN NOT done AND sel IS NOT NULL THEN 'negative runs cannot select an option' END, CASE WHEN NOT done AND o_orderstatus <> 'P' THEN 'negative runs require a failure reason' END]) AS issue FROM d) WHERE issue IS NOT NULL GROUP BY 1""",
    "scenario_gate": """SELECT issue, count(*) AS scenarios FROM (SELECT unnest([CASE WHEN l_shipdate > o_orderdate THEN 'data_cutoff cannot be later than as_of' END,
        CASE WHEN l_returnflag = o_orderstatus THEN 'intervention ids must be unique' END, CASE WHEN l_linestatus = o_orderstatus THEN 'objective ids must be unique' END,
        CASE WHEN l_linenumber BETWEEN 4 AND 5 THEN 'causal mode requires causal evidence requirements' END]) AS issue FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE issue IS NOT NULL GROUP BY 1""",
    "capabilities": """WITH b AS (SELECT c_custkey // 4 AS city_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'municipal-demand' WHEN 'MACHINERY' THEN 'climate-context'
          WHEN 'HOUSEHOLD' THEN 'demographic-context' WHEN 'AUTOMOBILE' THEN 'geographic-identity' WHEN 'FURNITURE' THEN 'network' END AS role FROM customer),
        h AS (SELECT city_id, role, count(*) AS n FROM b WHERE role IS NOT NULL GROUP BY 1, 2), c AS (SELECT DISTINCT city_id FROM h),
        r(cap, status, need) AS (VALUES ('suite.public-service', 'ready', ['municipal-demand']), ('suite.climate-disaster', 'limited', ['municipal-demand', 'climate-context']),
          ('suite.population-health', 'limited', ['municipal-demand', 'climate-context', 'demographic-context']), ('suite.housing-land-use', 'limited', ['municipal-demand', 'demographic-context', 'geographic-identity']),
          ('suite.infrastructure-finance', 'limited', ['municipal-demand', 'climate-context']), ('suite.behavioral-equity', 'limited', ['municipal-demand', 'demographic-context']), ('suite.mobility-access', 'blocked', ['municipal-demand', 'network'])),
        x AS (SELECT c.city_id, cap, status, need, role, n FROM c JOIN r ON true LEFT JOIN h ON h.city_id = c.city_id AND list_contains(need, role))
        SELECT city_id, cap AS capability_id, any_value(status) AS status, coalesce(string_agg(role, '|' ORDER BY list_position(need, role)), '') AS satisfied, CAST(coalesce(sum(n), 0) AS BIGINT) AS evidence_refs FROM x GROUP BY 1, 2""",
    "source_bindings": """SELECT lang AS city_id, source AS source_id, doc_id AS artifact_id, md5(text) AS content_hash,
        CASE source WHEN 'src1' THEN 'municipal-demand' WHEN 'src2' THEN 'climate-context' ELSE 'geographic-identity' END AS role,
        CASE source WHEN 'src2' THEN 'estimated' ELSE 'observed' END AS evidence_type FROM documents WHERE source IN ('src1', 'src2', 'src3')""",
    "design_readiness": """WITH d AS (SELECT p_partkey, p_size = 1 AS ref, p_name LIKE 'red%' AS gap, p_type FROM part)
        SELECT CAST(p_partkey AS VARCHAR) AS design_id, CASE WHEN ref THEN 'reference-implemented' ELSE 'design-only' END AS implementation_status,
          CASE WHEN ref THEN 'reference-implemented' WHEN gap AND p_type = 'PROMO' THEN 'blocked-multi' WHEN gap THEN 'blocked-source' WHEN p_type = 'PROMO' THEN 'blocked-method' ELSE 'uncompiled-current-inputs' END AS readiness,
          CASE p_type WHEN 'PROMO' THEN 'causal|estimated|observed|proposed' WHEN 'SMALL' THEN 'estimated|observed|proposed|simulated' ELSE 'estimated|observed|optimized|proposed' END AS required_evidence,
          CASE p_type WHEN 'PROMO' THEN 'causal|observed' WHEN 'LARGE' THEN 'estimated|observed' ELSE 'observed|proposed' END AS gate_evidence FROM d""",
    "adapter_rows": """SELECT CASE WHEN c_nationkey = 4 THEN 'City ' ELSE 'city-' END || c_custkey AS city_id,
        CASE WHEN c_nationkey = 4 THEN 'city id is not an identifier' ELSE 'source ids repeat' END AS issues FROM customer WHERE c_nationkey IN (4, 5)""",
    "adapter_packages": """WITH p AS (SELECT *, o_orderkey // 2 AS city FROM orders), o AS (SELECT city, count(*) AS n, min(o_orderpriority) AS a, max(o_orderpriority) AS b FROM p GROUP BY 1)
        SELECT issue, count(*) AS adapters FROM (SELECT unnest([CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'package is not on the allow list' END, CASE WHEN o_orderstatus = 'P' THEN 'adapter file is missing' END,
          CASE WHEN o_orderstatus = 'O' THEN 'adapter hash differs' END, CASE WHEN n > 1 AND a = b THEN 'city adapter is repeated in the package' END, CASE WHEN a <> b THEN 'city overlaps another package' END]) AS issue
          FROM p JOIN o USING (city)) WHERE issue IS NOT NULL GROUP BY 1""",
    "registry_integrity": """WITH e AS (SELECT * FROM customer WHERE c_acctbal > 0), x AS (SELECT * FROM customer WHERE c_acctbal < 100)
        SELECT CAST(c_custkey AS VARCHAR) AS subject, CASE c_nationkey WHEN 2 THEN 'bundle hash is not a digest'
          WHEN 3 THEN 'references must be safe relative paths|run references must use runs/<id>.json' ELSE 'run hashes must be unique' END AS issues FROM e WHERE c_nationkey IN (2, 3, 4)
        UNION ALL SELECT 'registry', array_to_string(list_filter(['entries must match the target count',
          CASE WHEN (SELECT count(*) FROM e) <> (SELECT max(c_custkey) + 1 FROM e) OR (SELECT min(c_custkey) FROM e) <> 0 THEN 'selection order must be contiguous' END,
          CASE WHEN EXISTS (SELECT 1 FROM e JOIN x USING (c_custkey)) THEN 'cities cannot be both selected and excluded' END,
          CASE WHEN (SELECT max(c_custkey) FROM x) > (SELECT max(c_custkey) FROM e) THEN 'exclusions must precede completion of the target' END], lambda v: v IS NOT NULL), '|')""",
    "design_matrix": """SELECT p_partkey || '.' || t AS design_id, title || ' for ' || p_name AS title, 'Which ' || m || ' changes ' || lower(p_brand) || '?' AS question, roles AS source_roles, modes AS analysis_modes
        FROM part, (VALUES ('invest', 'Capital Plan', 'capital plan', 'asset-registry|climate-hazard', 'descriptive|optimization'), ('rule', 'Standard', 'standard', 'climate-hazard', 'descriptive|causal')) s(t, title, m, roles, modes)""",
    "all_executions": """SELECT CAST(o_orderkey AS VARCHAR) AS execution_id, 'deep' AS kind, CAST(o_custkey AS VARCHAR) AS city_id, o_orderpriority AS suite, o_orderstatus AS status, 'deep run' AS title FROM orders WHERE o_orderstatus = 'F'
        UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'standard', CAST(c_nationkey AS VARCHAR), c_mktsegment, 'screened', c_name FROM customer""",
    "quality_standard": """WITH c AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3),
        s AS (SELECT user_id, count(*) AS parsed, CAST(sum(n) AS BIGINT) AS rec, count(*) FILTER (n > 3) AS fills FROM c GROUP BY 1)
        SELECT user_id AS city_id, x.id AS check_id, CASE WHEN x.ok THEN 'pass' ELSE 'fail' END AS status FROM (SELECT user_id, unnest([
          {'id': 'parsed-value-count', 'ok': parsed = 150}, {'id': 'source-manifest-record-count', 'ok': rec = parsed}, {'id': 'aligned-daily-keys', 'ok': parsed = 150},
          {'id': 'fill-value-count', 'ok': fills = 0}, {'id': 'coordinate-rounding', 'ok': true}, {'id': 'query-city-point', 'ok': true}]) AS x FROM s)""",
    "city_screens": """WITH u AS (SELECT user_id AS id, count(*) FILTER (event_type = 'view') AS t, count(*) FILTER (event_type = 'click') AS m,
          count(*) FILTER (event_type = 'purchase') AS p, count(*) FILTER (event_type = 'signup') AS w, count(*) FILTER (event_type = 'error') AS r FROM events GROUP BY 1),
        c AS (SELECT s_nationkey AS id, avg(s_acctbal) > 4000 AS gdp, count(*) > 3 AS urb FROM supplier GROUP BY 1),
        x AS (SELECT coalesce(u.id, c.id) AS id, u.id IS NULL AS nou, coalesce(t, 0) = 0 AS t, coalesce(m, 0) = 0 AS m, coalesce(p, 0) = 0 AS p, coalesce(w, 0) = 0 AS w,
          coalesce(r, 0) = 0 AS r, c.id IS NULL AS pop, NOT coalesce(gdp, false) AS gdp, NOT coalesce(urb, false) AS urb FROM u FULL JOIN c ON u.id = c.id),
        y AS (SELECT id, unnest([{'t': 'standard.heat-screen.v1', 's': 'screened', 'k': 5, 'x': t::INT + m::INT + nou::INT + r::INT + urb::INT},
          {'t': 'standard.precipitation-screen.v1', 's': 'screened', 'k': 4, 'x': p::INT + nou::INT + w::INT + pop::INT},
          {'t': 'standard.policy-readiness.v1', 's': 'insufficient-evidence', 'k': 2, 'x': m::INT + gdp::INT}]) AS e FROM x)
        SELECT id || '.' || e.t AS run_id, id AS city_id, e.t AS template_id, e.s AS status, CAST(e.x AS BIGINT) AS missing_metrics, CAST(e.k AS BIGINT) AS metric_count,
          false AS recommendation_issued FROM y""",
    "quality_report": """WITH c AS (SELECT user_id, event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2, 3),
        s AS (SELECT user_id, count(*) AS parsed, CAST(sum(n) AS BIGINT) AS rec, count(*) FILTER (n > 3) AS fills FROM c GROUP BY 1),
        r AS (SELECT user_id, list_sort(list_filter([CASE WHEN parsed <> 150 THEN 'parsed-value-count' END, CASE WHEN rec <> parsed THEN 'source-manifest-record-count' END,
          CASE WHEN parsed <> 150 THEN 'aligned-daily-keys' END, CASE WHEN fills > 0 THEN 'fill-value-count' END], lambda x: x IS NOT NULL)) AS f FROM s)
        SELECT user_id AS city_id, CASE WHEN len(f) > 0 THEN 'stopped' ELSE 'released' END AS outcome,
          CASE WHEN len(f) > 0 THEN 'required quality gates failed: ' || array_to_string(f, ', ') END AS reason FROM r""",
}
