"""Quality checks and integrity gates. A gate returns the rows that break it, with every reason."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import covers, reasons, valid_digest, valid_identifier
from tessera.operators.requests import VIEWS, reconcile_views
from tessera.operators.select import calendar_check
from tessera.sources.integrity import safe_relative

PASS, WARN, FAIL = "pass", "warn", "fail"


def violations(rows: DataFrame, *checks: tuple[Column, str]) -> DataFrame:
    """Rows for which at least one condition holds."""
    return rows.withColumn("issues", reasons(*checks)).filter(F.size("issues") > 0)


def _check(name: str, ok: Column, measured: Column, expected: Column, otherwise: str = FAIL) -> Column:
    return F.struct(
        F.lit(name).alias("check_id"), F.when(F.coalesce(ok, F.lit(False)), PASS).otherwise(otherwise).alias("status"),
        measured.cast("string").alias("measured"), expected.cast("string").alias("expected"),
    )


def _long(rows: DataFrame, key: str, checks: Sequence[Column]) -> DataFrame:
    return rows.select(key, F.explode(F.array(*checks)).alias("c")).select(key, "c.*")


def quality_standard(
    series: DataFrame, cities: DataFrame, manifests: DataFrame, start, days: int, parameters: Sequence[str]
) -> DataFrame:
    """Six checks per standardised city.

    ``series(city_id, artifact, longitude, latitude, parameter, day, value, is_fill)``;
    ``cities(city_id, latitude, longitude)``; ``manifests(city_id, record_count, query_latitude,
    query_longitude)``.
    """
    keyed = series.withColumn("artifact_id", F.col("city_id"))
    calendar = calendar_check(keyed, start, days, parameters).withColumnRenamed("artifact_id", "city_id")
    parsed = series.groupBy("city_id").agg(
        F.count("value").alias("parsed"), F.count_if("is_fill").alias("fills"),
        F.max("longitude").alias("_lon"), F.max("latitude").alias("_lat"),
    )
    rows = (
        cities.select("city_id", "latitude", "longitude").join(manifests, "city_id", "left")
        .join(parsed, "city_id", "left").join(calendar, "city_id", "left")
    )
    off = F.greatest(F.abs(F.col("_lon") - F.col("longitude")), F.abs(F.col("_lat") - F.col("latitude")))
    total = F.lit(days * len(parameters))
    exact = (F.col("query_latitude") == F.col("latitude")) & (F.col("query_longitude") == F.col("longitude"))
    return _long(rows, "city_id", [
        _check("parsed-value-count", F.col("parsed") == total, F.col("parsed"), total),
        _check("source-manifest-record-count", F.col("record_count") == F.col("parsed"), F.col("record_count"), F.col("parsed")),
        _check("aligned-daily-keys", F.col("calendar_complete"), F.col("aligned_days"), F.lit(days)),
        _check("fill-value-count", F.col("fills") == 0, F.col("fills"), F.lit(0)),
        _check("coordinate-rounding", off <= 0.001, off, F.lit("maximum coordinate difference <= 0.001 degrees")),
        _check("query-city-point", exact, F.concat_ws(",", "query_latitude", "query_longitude"), F.concat_ws(",", "latitude", "longitude")),
    ])


def quality_deep(
    views: DataFrame, bounds: DataFrame, manifests: DataFrame, places: DataFrame, climate: DataFrame,
    parameters: Sequence[str],
) -> DataFrame:
    """Ten checks per deep city.

    ``manifests(city, artifact_id, view, record_count)`` (view null for the other sources),
    ``places(city, declared_geoid, population_geoid, boundary_geoid)``, ``climate(city, parameter,
    day, value)``, ``bounds(city, start_day, end_day)``.
    """
    totals = reconcile_views(views).select("city", "least_total", "greatest_total", F.col("status").alias("_views"))
    shape = views.groupBy("city").agg(
        F.count("*").alias("aggregate_rows"), F.min("request_count").alias("_least"),
        F.count_distinct(F.when(F.col("view") == "daily-category", F.col("service_day"))).alias("active_days"),
        F.coalesce(F.sum(F.when((F.col("view") == "area-status") & (F.col("area") == "(missing)"), F.col("request_count"))), F.lit(0)).alias("missing_area"),
    )
    per_view = views.groupBy("city", "view").agg(F.count("*").alias("rows"))
    declared = manifests.groupBy("city").agg(F.count_distinct("artifact_id").alias("manifests"))
    matching = per_view.join(manifests.filter(F.col("view").isNotNull()).select("city", "view", "record_count"), ["city", "view"], "left").groupBy("city").agg(
        F.sum("record_count").alias("declared_rows"),
        F.count_if(F.col("rows") == F.col("record_count")).alias("matching_views"),
    )
    inside = (F.col("day") >= F.col("start_day")) & (F.col("day") < F.col("end_day"))
    dated = climate.join(bounds, "city").groupBy("city", "parameter").agg(
        F.count_distinct(F.when(inside, F.col("day"))).alias("covered"), F.count_if(~inside).alias("outside"),
        F.count_if(F.col("value") <= -900).alias("fills"), F.first(F.datediff("end_day", "start_day")).alias("window_days"),
    ).groupBy("city").agg(
        F.count_if((F.col("covered") == F.col("window_days")) & (F.col("outside") == 0) & F.col("parameter").isin(list(parameters))).alias("complete_parameters"),
        F.sum("fills").alias("fills"),
    )
    rows = bounds.join(totals, "city", "left").join(shape, "city", "left").join(declared, "city", "left").join(
        matching, "city", "left").join(places, "city", "left").join(dated, "city", "left")
    window = F.datediff("end_day", "start_day")
    return _long(rows, "city", [
        _check("source-manifest-count", F.col("manifests") == 7, F.col("manifests"), F.lit(7)),
        _check("municipal-view-total-reconciliation", F.col("_views") == PASS, F.concat_ws("..", "least_total", "greatest_total"), F.lit("one total")),
        _check("municipal-manifest-row-reconciliation", F.col("matching_views") == len(VIEWS), F.col("aggregate_rows"), F.col("declared_rows")),
        _check("municipal-daily-activity-coverage", F.col("active_days") == window, F.col("active_days"), window, WARN),
        _check("municipal-positive-counts", F.col("_least") > 0, F.col("_least"), F.lit(">0")),
        _check("municipal-area-missingness", F.col("missing_area") == 0, F.col("missing_area"), F.lit(0), WARN),
        _check("acs-place-identity", F.col("population_geoid") == F.col("declared_geoid"), F.col("population_geoid"), F.col("declared_geoid")),
        _check("tigerweb-place-identity", F.col("boundary_geoid") == F.col("declared_geoid"), F.col("boundary_geoid"), F.col("declared_geoid")),
        _check("nasa-parameter-date-coverage", F.col("complete_parameters") == len(parameters), F.col("complete_parameters"), F.lit(len(parameters))),
        _check("nasa-fill-value-gate", F.col("fills") == 0, F.col("fills"), F.lit(0)),
    ])


def quality_report(checks: DataFrame, key: str, counts: DataFrame | None = None) -> DataFrame:
    """Roll-up per city: FAIL over WARN over PASS, failed ids, completeness.

    ``counts(key, total, missing)`` feeds the completeness rate.
    """
    rank = F.when(F.col("status") == FAIL, 2).when(F.col("status") == WARN, 1).otherwise(0)
    per = checks.groupBy(key).agg(
        F.max(rank).alias("_worst"), F.count("*").alias("checks"),
        (F.count("*") == F.count_distinct("check_id")).alias("unique_ids"),
        # a city has a fixed handful of checks
        F.sort_array(F.collect_list(F.when(F.col("status") == FAIL, F.col("check_id")))).alias("failed_checks"),
    )
    out = per.withColumn(
        "overall_status", F.when(F.col("_worst") == 2, FAIL).when(F.col("_worst") == 1, WARN).otherwise(PASS)
    ).drop("_worst")
    if counts is None:
        return out
    return out.join(counts, key, "left").withColumn(
        "completeness_rate", F.try_divide(F.col("total") - F.col("missing"), F.col("total"))
    )


def require_quality(report: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Fail-closed: cities that may go on, and stopped cities with a reason naming the checks."""
    stopped = report.filter(F.col("overall_status") == FAIL).select(
        key, F.concat(F.lit("required quality gates failed: "), F.array_join("failed_checks", ", ")).alias("reason")
    )
    return report.filter(F.col("overall_status") != FAIL), stopped


def _absent(name: str) -> Column:
    return F.coalesce(F.trim(name), F.lit("")) == ""


def _empty(name: str) -> Column:
    return F.coalesce(F.size(name), F.lit(0)) <= 0


def evidence_violations(items: DataFrame) -> DataFrame:
    """Evidence items that lack what their type demands."""
    kind = F.col("type")
    return violations(
        items,
        ((kind == "observed") & _empty("source_refs"), "observed evidence requires at least one source reference"),
        ((kind == "estimated") & _absent("method"), "estimated evidence requires a method"),
        ((kind == "causal") & _absent("identification_strategy"), "causal evidence requires an identification strategy"),
        ((kind == "causal") & _empty("diagnostics"), "causal evidence requires diagnostics or refutations"),
        ((kind == "simulated") & _absent("scenario_ref"), "simulated evidence requires a scenario reference"),
        ((kind == "optimized") & _absent("objective"), "optimized evidence requires an objective"),
        ((kind == "optimized") & _empty("constraints"), "optimized evidence requires named constraints"),
        ((kind == "proposed") & _empty("limitations"), "proposed evidence requires explicit limitations"),
        (F.col("status").isin("failed", "insufficient") & _empty("limitations"), "failed or insufficient evidence must explain limitations"),
    )


def metric_violations(metrics: DataFrame, declared: DataFrame) -> DataFrame:
    """Metrics of a forbidden evidence type, without method, or citing undeclared sources.

    ``metrics(city_id, metric_id, evidence_type, method, source_refs)``, ``declared(city_id, artifacts)``.
    """
    rows = metrics.join(declared, "city_id", "left")
    refs = F.coalesce("source_refs", F.array().cast("array<string>"))
    return violations(
        rows,
        (~F.col("evidence_type").isin("observed", "estimated"), "metric evidence type not allowed"),
        ((F.col("evidence_type") == "estimated") & _absent("method"), "estimated metrics require a method"),
        (F.size(F.array_distinct(refs)) != F.size(refs), "source references repeat"),
        (F.size(refs) == 0, "source references are missing"),
        (~covers(refs, F.coalesce("artifacts", F.array().cast("array<string>"))), "metric source is not declared"),
    ).drop("artifacts")


# Alignments every standardised bundle must hold.
ALIGNMENTS = ("identity-point", "gridded-point", "country-context")


def bundle_violations(bundles: DataFrame) -> DataFrame:
    """Standardised bundles whose parts do not fit together.

    One row per city: ``tier, city_id, catalog_city_id, manifest_ids, binding_ids, manifest_sources,
    adapter_sources, alignments, overall_status, completeness_rate, metric_ids, metric_refs, run_ids,
    template_ids, run_cities, run_metric_ids``.
    """
    def unique(name: str) -> Column:
        return F.size(F.array_distinct(name)) == F.size(name)

    def same(a: str, b: str) -> Column:
        return covers(F.col(a), F.col(b)) & covers(F.col(b), F.col(a))

    needed = F.array(*[F.lit(a) for a in ALIGNMENTS])
    return violations(
        bundles,
        (F.col("tier") != "S", "standardized bundles require a Tier-S adapter"),
        (~F.col("city_id").eqNullSafe(F.col("catalog_city_id")), "adapter and catalog city identifiers must match"),
        (~unique("manifest_ids"), "source manifest artifact identifiers must be unique"),
        (~unique("binding_ids"), "source binding artifact identifiers must be unique"),
        (~same("binding_ids", "manifest_ids"), "source bindings must cover every source manifest exactly"),
        (~same("adapter_sources", "manifest_sources"), "adapter source ids must match bundle source families"),
        (~covers(needed, F.col("alignments")), "bundle lacks a required geographic alignment layer"),
        (F.col("overall_status") == FAIL, "bundle contains failed required quality checks"),
        (F.coalesce(F.col("completeness_rate") != 1, F.lit(True)), "required fields must be complete"),
        (~unique("metric_ids"), "bundle metric ids must be unique"),
        (~covers(F.col("metric_refs"), F.col("manifest_ids")), "bundle metric source is not declared"),
        (~unique("run_ids"), "scenario run identifiers must be unique"),
        (~unique("template_ids"), "scenario templates must be unique per city"),
        (F.exists("run_cities", lambda c: c != F.col("city_id")), "scenario run city does not match its bundle"),
        (~covers(F.col("run_metric_ids"), F.col("metric_ids")), "scenario run contains an undeclared bundle metric"),
    )


# Artifacts every pack must release and the engine behind each optional one.
PACK_KINDS = ("policy-scenario", "decision-pack", "decision-brief")
ENGINE_KINDS = {
    "forecast-run": "has_forecast", "simulation-run": "has_simulation",
    "optimization-run": "has_optimization", "uncertainty-run": "has_uncertainty",
}


def pack_violations(packs: DataFrame) -> DataFrame:
    """Deep packs whose identity, artifacts or status disagree.

    ``pack_id, city_id, scenario_id, scenario_city, decision_scenario, kinds, status, readiness,
    decision_status, observed_requests`` and one flag per engine.
    """
    done = F.col("status") == "completed"
    checks = [
        ((F.col("scenario_id") != F.col("pack_id")) | (F.col("scenario_city") != F.col("city_id")), "pack identity must match its scenario"),
        (F.col("decision_scenario") != F.col("pack_id"), "pack must embed its matching decision pack"),
        (F.size(F.array_distinct("kinds")) != F.size("kinds"), "artifact kinds must be unique"),
        (~covers(F.array(*[F.lit(k) for k in PACK_KINDS]), F.col("kinds")), "pack lacks a required artifact"),
        (done & (F.col("readiness") != "planning-support"), "completed scenarios are planning-support outputs"),
        (done & (F.col("decision_status") != "completed"), "completed scenarios require a completed decision pack"),
        (done & (F.col("observed_requests") < 1), "completed scenarios require observed requests"),
        (done & ~(F.col("has_optimization") & F.col("has_uncertainty")), "completed scenarios require optimization and uncertainty"),
        (~done & (F.col("readiness") != "insufficient-evidence"), "negative scenarios must declare insufficient readiness"),
        (~done & (F.col("decision_status") == "completed"), "negative scenarios cannot embed a completed decision pack"),
    ]
    checks += [
        (F.array_contains("kinds", kind) != F.col(flag), f"{kind} reference and model must align")
        for kind, flag in ENGINE_KINDS.items()
    ]
    return violations(packs, *checks)


def decision_violations(packs: DataFrame) -> DataFrame:
    """Decision packs whose outcome is not backed.

    ``run_id, status, options array<struct<id, feasible>>, selected_option_id, reversal_tests int,
    value_of_information int, failure_reason, next_evidence array``.
    """
    done = F.col("status") == "completed"
    ids = F.transform("options", lambda o: o["id"])
    chosen = F.filter("options", lambda o: o["id"] == F.col("selected_option_id"))
    known = F.coalesce(F.size(chosen) > 0, F.lit(False))
    return violations(
        packs,
        (F.size(F.array_distinct(ids)) != F.size(ids), "decision option ids must be unique"),
        (done & F.col("selected_option_id").isNull(), "completed runs require a selected option"),
        (done & F.col("selected_option_id").isNotNull() & ~known, "selected option does not exist"),
        (done & known & ~F.coalesce(F.get(chosen, F.lit(0))["feasible"], F.lit(False)), "selected option must be feasible"),
        (done & (F.col("reversal_tests") < 1), "completed runs require at least one reversal test"),
        (done & (F.col("value_of_information") < 1), "completed runs require value-of-information guidance"),
        (~done & F.col("selected_option_id").isNotNull(), "negative runs cannot select an option"),
        (~done & _absent("failure_reason"), "negative runs require a failure reason"),
        (~done & _empty("next_evidence"), "negative runs require next-evidence guidance"),
    )


def scenario_violations(scenarios: DataFrame) -> DataFrame:
    """Scenarios with a late cut-off, repeated ids, or a causal mode without causal evidence."""
    def repeated(name: str) -> Column:
        return F.size(F.array_distinct(name)) != F.size(name)

    return violations(
        scenarios,
        (F.col("data_cutoff") > F.col("as_of"), "data_cutoff cannot be later than as_of"),
        *[
            (repeated(c), f"{c.replace('_', ' ')} must be unique")
            for c in ("intervention_ids", "objective_ids", "constraint_ids", "analysis_modes", "evidence_requirements")
        ],
        (F.array_contains("analysis_modes", "causal") & ~F.array_contains("evidence_requirements", "causal"), "causal mode requires causal evidence requirements"),
    )


# Roles each application suite needs and the best status it may claim.
SUITE_RULES = {
    "public-service": ("ready", ("municipal-demand",)),
    "climate-disaster": ("limited", ("municipal-demand", "climate-context")),
    "population-health": ("limited", ("municipal-demand", "climate-context", "demographic-context")),
    "housing-land-use": ("limited", ("municipal-demand", "demographic-context", "geographic-identity")),
    "infrastructure-finance": ("limited", ("municipal-demand", "climate-context")),
    "behavioral-equity": ("limited", ("municipal-demand", "demographic-context")),
    "mobility-access": ("blocked", ("municipal-demand", "network")),
}


def bindings(manifests: DataFrame, roles: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Role and evidence type of every source, by source family; unknown families are left out."""
    role = F.create_map(*[F.lit(x) for family, (r, _) in roles.items() for x in (family, r)])
    kind = F.create_map(*[F.lit(x) for family, (_, e) in roles.items() for x in (family, e)])
    return manifests.select(
        "city_id", "source_id", "artifact_id", "content_hash",
        F.try_element_at(role, F.col("family")).alias("role"), F.try_element_at(kind, F.col("family")).alias("evidence_type"),
    ).filter(F.col("role").isNotNull())


def capabilities(bound: DataFrame, rules: Mapping[str, tuple[str, Sequence[str]]] = SUITE_RULES) -> DataFrame:
    """Readiness of every suite in every city from the roles its sources satisfy.

    ``bound(city_id, role, artifact_id)``. The number of references is counted per role first; the
    references themselves stay in the bindings table.
    """
    held = bound.groupBy("city_id", "role").agg(F.count("*").alias("refs"))
    roles = held.groupBy("city_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "refs")))).alias("have"))
    listed = F.explode(F.array(*[
        F.struct(F.lit(suite).alias("suite"), F.lit(status).alias("status"), F.array(*[F.lit(r) for r in need]).alias("required"))
        for suite, (status, need) in rules.items()
    ]))
    rows = roles.select("city_id", "have", listed.alias("r")).select("city_id", "have", "r.*").withColumn(
        "satisfied", F.filter("required", lambda r: F.map_contains_key("have", r))
    )
    return rows.select(
        "city_id", F.concat(F.lit("suite."), "suite").alias("capability_id"), "status", "required", "satisfied",
        F.aggregate("satisfied", F.lit(0).cast("long"), lambda s, r: s + F.try_element_at("have", r)).alias("evidence_refs"),
    )


def capability_violations(rows: DataFrame) -> DataFrame:
    full = covers(F.col("required"), F.col("satisfied"))
    return violations(
        rows,
        (~covers(F.col("satisfied"), F.col("required")), "satisfied roles must be a subset of required roles"),
        ((F.col("status") == "ready") & ~full, "ready capability must satisfy every required source role"),
        ((F.col("status") == "blocked") & full, "blocked capability cannot satisfy every required source role"),
        ((F.col("evidence_refs") > 0) != (F.size("satisfied") > 0), "evidence references must match satisfied roles"),
    )


NO_DESIGN = (
    "The committed aggregate sources contain no dated intervention, comparison group, repeated outcome "
    "panel, or identification diagnostics."
)
NO_NETWORK = (
    "The committed evidence contains no versioned routable network, service calendar, impedance validation, "
    "or real-time disruption state."
)


def gate_scenarios(rows: DataFrame) -> DataFrame:
    """Reason why a scenario cannot be completed, or null.

    ``strategy, observed_requests, minimum_requests``.
    """
    short = F.concat(
        F.lit("The declared keyword rule matches "), F.format_number("observed_requests", 0),
        F.lit(" requests, below the minimum gate of "), F.format_number("minimum_requests", 0), F.lit("."),
    )
    strategy = F.col("strategy")
    return rows.withColumn(
        "negative_reason",
        F.when(strategy == "required-causal-design", NO_DESIGN).when(strategy == "required-network", NO_NETWORK)
        .when((strategy == "category-demand") & (F.col("observed_requests") < F.col("minimum_requests")), short),
    )


# Source roles the current inputs provide.
CURRENT_ROLES = ("municipal-demand", "climate-context", "climate-hazard", "geographic-identity", "demographic-context")


def design_readiness(designs: DataFrame, current: Sequence[str] = CURRENT_ROLES) -> DataFrame:
    """Readiness, required evidence and gate evidence of each design.

    ``source_roles, analysis_modes, template_ref, gate_type``.
    """
    gap = ~covers(F.col("source_roles"), F.array(*[F.lit(r) for r in current]))
    causal = F.array_contains("analysis_modes", "causal")
    readiness = (
        F.when(F.col("template_ref").isNotNull(), "reference-implemented")
        .when(gap & causal, "blocked-multi").when(gap, "blocked-source").when(causal, "blocked-method")
        .otherwise("uncompiled-current-inputs")
    )
    evidence = F.sort_array(F.array_compact(F.array(
        F.lit("observed"), F.lit("estimated"), F.lit("proposed"), F.when(causal, F.lit("causal")),
        F.when(F.array_contains("analysis_modes", "simulation"), F.lit("simulated")),
        F.when(F.array_contains("analysis_modes", "optimization"), F.lit("optimized")),
    )))
    gate = (
        F.when(F.col("gate_type") == "identification", F.array(F.lit("causal"), F.lit("observed")))
        .when(F.col("gate_type").isin("calibration", "external-validation"), F.array(F.lit("estimated"), F.lit("observed")))
        .otherwise(F.array(F.lit("observed"), F.lit("proposed")))
    )
    return designs.withColumns({
        "implementation_status": F.when(F.col("template_ref").isNotNull(), "reference-implemented").otherwise("design-only"),
        "readiness": readiness, "required_evidence": evidence, "gate_evidence": gate,
    })


def adapter_violations(packages: DataFrame, files: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Adapter rows (``plugin_id, path, city_id, declared_hash``) that are not listed, altered or overlap."""
    owners = packages.groupBy("city_id").agg(
        F.count("*").alias("_rows"), F.min("plugin_id").alias("_a"), F.max("plugin_id").alias("_b")
    )
    rows = packages.join(files.select(F.col("name").alias("path"), "actual_hash"), "path", "left").join(owners, "city_id")
    return violations(
        rows,
        (~F.col("plugin_id").isin(list(allowed)), "package is not on the allow list"),
        (F.col("actual_hash").isNull(), "adapter file is missing"),
        (F.col("actual_hash") != F.col("declared_hash"), "adapter hash differs"),
        ((F.col("_rows") > 1) & (F.col("_a") == F.col("_b")), "city adapter is repeated in the package"),
        (F.col("_a") != F.col("_b"), "city overlaps another package"),
    ).drop("_rows", "_a", "_b", "actual_hash")


def adapters(cities: DataFrame, capabilities_: Sequence[str], gaps: Sequence[str], start: str, end: str) -> DataFrame:
    """Adapter rows of standardised cities: box, coverage window, capability and gap lists."""
    from tessera.functions.scalar import bbox

    return cities.select(
        "city_id", F.col("name").alias("display_name"), "country_code", F.lit("S").alias("tier"),
        bbox(F.col("latitude"), F.col("longitude")).alias("bbox"),
        F.struct(F.lit(start).cast("timestamp").alias("start"), F.lit(end).cast("timestamp").alias("end")).alias("coverage"),
        "source_ids", F.array(*[F.lit(c) for c in capabilities_]).alias("capabilities"),
        F.array(*[F.lit(g) for g in gaps]).alias("data_gaps"),
    )


def adapter_row_violations(rows: DataFrame) -> DataFrame:
    def repeated(name: str) -> Column:
        return F.size(F.array_distinct(name)) != F.size(name)

    return violations(
        rows,
        (~valid_identifier(F.col("city_id")), "city id is not an identifier"),
        (F.col("bbox.west") >= F.col("bbox.east"), "bounding box west must be below east"),
        (F.col("bbox.south") >= F.col("bbox.north"), "bounding box south must be below north"),
        (F.col("coverage.start") >= F.col("coverage.end"), "coverage window is not ordered"),
        (repeated("source_ids"), "source ids repeat"), (repeated("capabilities"), "capabilities repeat"),
    )


def registry_violations(entries: DataFrame, exclusions: DataFrame, target: int) -> DataFrame:
    """Registry entries that break order, alignment, paths or hashes, and registry-wide faults.

    ``entries(city_id, selection_order, tier_g_rank, bundle_ref, bundle_hash, run_refs, run_hashes,
    statuses)``, ``exclusions(city_id, tier_g_rank)``.
    """
    refs = F.concat(F.array("bundle_ref"), F.col("run_refs"))
    aligned = (F.size("run_refs") == F.size("run_hashes")) & (F.size("run_refs") == F.size("statuses"))
    rows = violations(
        entries,
        (~aligned, "run references, hashes and statuses must align"),
        (F.size(F.array_distinct("run_refs")) != F.size("run_refs"), "run references must be unique"),
        (F.size(F.array_distinct("run_hashes")) != F.size("run_hashes"), "run hashes must be unique"),
        (F.col("bundle_ref") != F.concat(F.lit("cities/"), "city_id", F.lit("/bundle.json")), "bundle reference must match the city"),
        (F.exists(refs, lambda p: ~safe_relative(p)), "references must be safe relative paths"),
        (F.exists("run_refs", lambda p: ~(p.startswith("runs/") & p.endswith(".json"))), "run references must use runs/<id>.json"),
        (~valid_digest(F.col("bundle_hash")), "bundle hash is not a digest"),
    ).select(F.col("city_id").alias("subject"), "issues")
    facts = entries.agg(
        F.count("*").alias("n"), F.count_distinct("city_id").alias("ids"), F.count_distinct("selection_order").alias("orders"),
        F.min("selection_order").alias("first"), F.max("selection_order").alias("last"), F.max("tier_g_rank").alias("deepest"),
    ).withColumn("_k", F.lit(1))
    skipped = exclusions.agg(
        F.count("*").alias("x"), F.count_distinct("city_id").alias("xids"), F.count_distinct("tier_g_rank").alias("xranks"),
        F.max("tier_g_rank").alias("xdeepest"),
    ).withColumn("_k", F.lit(1))
    both = entries.join(exclusions.select("city_id"), "city_id", "left_semi").agg(F.count("*").alias("both")).withColumn("_k", F.lit(1))
    whole = facts.join(F.broadcast(skipped), "_k").join(F.broadcast(both), "_k")
    wide = violations(
        whole,
        (F.col("n") != target, "entries must match the target count"),
        ((F.col("orders") != F.col("n")) | (F.col("first") != 1) | (F.col("last") != F.col("n")), "selection order must be contiguous"),
        (F.col("ids") != F.col("n"), "city identifiers must be unique"),
        ((F.col("xids") != F.col("x")) | (F.col("xranks") != F.col("x")), "exclusion identifiers and ranks must be unique"),
        (F.col("both") > 0, "cities cannot be both selected and excluded"),
        (F.col("xdeepest") > F.col("deepest"), "exclusions must precede completion of the target"),
    ).select(F.lit("registry").alias("subject"), "issues")
    return rows.select(F.col("subject").cast("string").alias("subject"), "issues").unionByName(wide)
