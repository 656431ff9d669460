from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates as g
from tessera.operators import packs as p
from tessera.operators import requests as rq

A = "array<string>"


def issues(df, key):
    return {r[key]: r.issues for r in df.collect()}


def test_evidence_gate(spark):
    cols = f"id string, type string, status string, source_refs {A}, method string, identification_strategy string, diagnostics {A}, scenario_ref string, objective string, constraints {A}, limitations {A}"
    base = dict(status="limited", source_refs=None, method=None, identification_strategy=None, diagnostics=None, scenario_ref=None, objective=None, constraints=None, limitations=None)
    need = {"observed": {"source_refs": ["a"]}, "estimated": {"method": "m"}, "causal": {"identification_strategy": "d", "diagnostics": ["x"]},
            "simulated": {"scenario_ref": "s"}, "optimized": {"objective": "o", "constraints": ["c"]}, "proposed": {"limitations": ["l"]}}
    rows = []
    for kind, extra in need.items():
        rows.append({"id": f"{kind}-ok", "type": kind, **base, **extra})
        rows.append({"id": f"{kind}-bad", "type": kind, **base})
    rows.append({"id": "failed", "type": "observed", **base, "status": "failed", "source_refs": ["a"]})
    names = [c.split()[0] for c in cols.split(", ")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], cols)
    bad = issues(g.evidence_violations(df), "id")
    assert set(bad) == {f"{k}-bad" for k in need} | {"failed"}
    assert len(bad["causal-bad"]) == 2 and len(bad["optimized-bad"]) == 2


def test_metric_gate(spark):
    m = spark.createDataFrame([("c", "ok", "observed", None, ["a"]), ("c", "kind", "causal", "m", ["a"]), ("c", "meth", "estimated", " ", ["a"]),
                               ("c", "rep", "observed", None, ["a", "a"]), ("c", "undeclared", "observed", None, ["z"])],
                              f"city_id string, metric_id string, evidence_type string, method string, source_refs {A}")
    d = spark.createDataFrame([("c", ["a", "b"])], f"city_id string, artifacts {A}")
    assert set(issues(g.metric_violations(m, d), "metric_id")) == {"kind", "meth", "rep", "undeclared"}


def test_decision_gate(spark):
    cols = f"run_id string, status string, options array<struct<id:string,feasible:boolean>>, selected_option_id string, reversal_tests int, value_of_information int, failure_reason string, next_evidence {A}"
    o = [("a", True), ("b", False)]
    df = spark.createDataFrame([
        ("ok", "completed", o, "a", 1, 1, None, []), ("infeasible", "completed", o, "b", 1, 1, None, []), ("ghost", "completed", o, "z", 1, 1, None, []),
        ("none", "completed", o, None, 0, 0, None, []), ("neg", "failed", [], None, 0, 0, "why", ["x"]), ("negbad", "failed", o + o, "a", 0, 0, "", [])], cols)
    bad = issues(g.decision_violations(df), "run_id")
    assert set(bad) == {"infeasible", "ghost", "none", "negbad"} and len(bad["none"]) == 3 and len(bad["negbad"]) == 4


def test_scenario_and_pack_gates(spark):
    cols = f"id string, data_cutoff timestamp, as_of timestamp, intervention_ids {A}, objective_ids {A}, constraint_ids {A}, analysis_modes {A}, evidence_requirements {A}"
    t0, t1 = datetime(2024, 1, 1), datetime(2024, 2, 1)
    df = spark.createDataFrame([("ok", t0, t1, ["a"], ["b"], ["c"], ["causal"], ["causal"]), ("late", t1, t0, ["a"], ["b"], ["c"], ["x"], ["y"]),
                                ("rep", t0, t1, ["a", "a"], ["b"], ["c"], ["x"], ["y"]), ("causal", t0, t1, ["a"], ["b"], ["c"], ["causal"], ["observed"])], cols)
    assert set(issues(g.scenario_violations(df), "id")) == {"late", "rep", "causal"}
    cols = f"pack_id string, city_id string, scenario_id string, scenario_city string, decision_scenario string, kinds {A}, status string, readiness string, decision_status string, observed_requests int, has_forecast boolean, has_simulation boolean, has_optimization boolean, has_uncertainty boolean"
    full = ["policy-scenario", "decision-pack", "decision-brief", "forecast-run", "simulation-run", "optimization-run", "uncertainty-run"]
    df = spark.createDataFrame([
        ("ok", "c", "ok", "c", "ok", full, "completed", "planning-support", "completed", 5, True, True, True, True),
        ("id", "c", "x", "c", "id", full, "completed", "planning-support", "completed", 5, True, True, True, True),
        ("kinds", "c", "kinds", "c", "kinds", full[1:], "completed", "planning-support", "completed", 5, True, True, True, True),
        ("model", "c", "model", "c", "model", full, "completed", "planning-support", "completed", 5, False, True, True, True),
        ("neg", "c", "neg", "c", "neg", full[:3], "insufficient-evidence", "insufficient-evidence", "insufficient", 0, False, False, False, False),
        ("negbad", "c", "negbad", "c", "negbad", full[:3], "insufficient-evidence", "planning-support", "completed", 0, False, False, False, False)], cols)
    assert set(issues(g.pack_violations(df), "pack_id")) == {"id", "kinds", "model", "negbad"}


def test_bundle_gate(spark):
    cols = f"case string, tier string, city_id string, catalog_city_id string, manifest_ids {A}, binding_ids {A}, manifest_sources {A}, adapter_sources {A}, alignments {A}, overall_status string, completeness_rate double, metric_ids {A}, metric_refs {A}, run_ids {A}, template_ids {A}, run_cities {A}, run_metric_ids {A}"
    good = ["S", "c", "c", ["1", "2"], ["2", "1"], ["s"], ["s"], list(g.ALIGNMENTS), "pass", 1.0, ["m"], ["1"], ["r"], ["t"], ["c"], ["m"]]
    change = {"tier": (0, "D"), "city": (2, "x"), "cover": (4, ["1"]), "align": (7, ["gridded-point"]), "fail": (8, "fail"), "part": (9, 0.5),
              "metric": (10, ["m", "m"]), "ref": (11, ["9"]), "runcity": (14, ["z"]), "runmetric": (15, ["q"])}
    rows = [("ok", *good)]
    for name, (i, v) in change.items():
        row = list(good)
        row[i] = v
        rows.append((name, *row))
    assert set(issues(g.bundle_violations(spark.createDataFrame(rows, cols)), "case")) == set(change)


def test_capabilities_and_readiness(spark):
    b = spark.createDataFrame([("c", "municipal-demand", "1"), ("c", "municipal-demand", "2"), ("c", "climate-context", "3")], "city_id string, role string, artifact_id string")
    rows = g.capabilities(b)
    by = {r.capability_id: r for r in rows.collect()}
    assert by["suite.public-service"].evidence_refs == 2 and by["suite.climate-disaster"].evidence_refs == 3
    assert by["suite.mobility-access"].satisfied == ["municipal-demand"] and g.capability_violations(rows).count() == 0
    wrong = rows.withColumn("status", F.lit("ready"))
    assert g.capability_violations(wrong).count() == 4
    d = spark.createDataFrame([("ref", ["municipal-demand"], ["causal"], "t", "identification"), ("both", ["network"], ["causal"], None, "identification"),
                               ("src", ["network"], ["simulation"], None, "calibration"), ("meth", ["municipal-demand"], ["causal"], None, "x"),
                               ("none", ["municipal-demand"], ["optimization"], None, "external-validation")],
                              f"id string, source_roles {A}, analysis_modes {A}, template_ref string, gate_type string")
    r = {x.id: x for x in g.design_readiness(d).collect()}
    assert {k: v.readiness for k, v in r.items()} == {"ref": "reference-implemented", "both": "blocked-multi", "src": "blocked-source", "meth": "blocked-method", "none": "uncompiled-current-inputs"}
    assert r["src"].required_evidence == ["estimated", "observed", "proposed", "simulated"] and r["meth"].gate_evidence == ["observed", "proposed"]


def test_adapters_and_registry(spark):
    cities = spark.createDataFrame([("ok-city", "OK", "US", 10.0, 20.0, ["a", "b"]), ("Bad City", "B", "US", 10.0, 20.0, ["a", "a"])], f"city_id string, name string, country_code string, latitude double, longitude double, source_ids {A}")
    rows = g.adapters(cities, ["x"], ["y"], "2023-01-01", "2024-12-31")
    assert {k: len(v) for k, v in issues(g.adapter_row_violations(rows), "city_id").items()} == {"Bad City": 2}
    packs_ = spark.createDataFrame([("p1", "a.json", "c1", "h"), ("p2", "b.json", "c1", "h"), ("p1", "c.json", "c2", "h"), ("bad", "d.json", "c3", "h"), ("p1", "e.json", "c4", "x")], "plugin_id string, path string, city_id string, declared_hash string")
    files = spark.createDataFrame([(n, "h") for n in ("a.json", "b.json", "c.json", "d.json", "e.json")], "name string, actual_hash string")
    assert set(issues(g.adapter_violations(packs_, files, ["p1", "p2"]), "path")) == {"a.json", "b.json", "d.json", "e.json"}
    h = "sha256:" + "0" * 64
    cols = f"city_id string, selection_order int, tier_g_rank int, bundle_ref string, bundle_hash string, run_refs {A}, run_hashes {A}, statuses {A}"
    good = [(f"c{i}", i, i + 1, f"cities/c{i}/bundle.json", h, ["runs/a.json", "runs/b.json"], ["1", "2"], ["s", "s"]) for i in (1, 2)]
    ex = spark.createDataFrame([("z", 2)], "city_id string, tier_g_rank int")
    assert g.registry_violations(spark.createDataFrame(good, cols), ex, 2).count() == 0
    bad = [good[0], ("c1", 3, 2, "/abs/bundle.json", "nope", ["x.json"], ["1", "1"], ["s"])]
    got = issues(g.registry_violations(spark.createDataFrame(bad, cols), spark.createDataFrame([("c1", 9)], "city_id string, tier_g_rank int"), 3), "subject")
    assert len(got["registry"]) == 5 and len(got["c1"]) == 6


def test_quality_roll_up(spark):
    checks = spark.createDataFrame([("a", "x", "pass"), ("a", "y", "warn"), ("b", "x", "fail"), ("b", "y", "pass"), ("c", "x", "pass")], "city string, check_id string, status string")
    rep = g.quality_report(checks, "city", spark.createDataFrame([("a", 10, 1)], "city string, total int, missing int"))
    by = {r.city: r for r in rep.collect()}
    assert {k: v.overall_status for k, v in by.items()} == {"a": "warn", "b": "fail", "c": "pass"} and by["a"].completeness_rate == 0.9
    go, stop = g.require_quality(rep, "city")
    assert go.count() == 2 and stop.collect()[0].reason == "required quality gates failed: x"


def climate(spark, city="c", days=4, drop=None, fill=None):
    rows = [(city, "art", 10.0004, 20.0, par, date(2024, 1, d + 1), -999.0 if (par, d) == fill else 1.0, (par, d) == fill)
            for par in ("T2M", "RH2M") for d in range(days) if (par, d) != drop]
    return spark.createDataFrame(rows, "city_id string, artifact string, longitude double, latitude double, parameter string, day date, value double, is_fill boolean")


def test_standard_quality(spark):
    cities = spark.createDataFrame([("c", 20.0, 10.0)], "city_id string, latitude double, longitude double")
    man = spark.createDataFrame([("c", 8, 20.0, 10.0)], "city_id string, record_count int, query_latitude double, query_longitude double")
    ok = g.quality_standard(climate(spark), cities, man, "2024-01-01", 4, ["T2M", "RH2M"])
    assert ok.count() == 6 and ok.filter("status <> 'pass'").count() == 0
    bad = g.quality_standard(climate(spark, drop=("T2M", 1), fill=("RH2M", 2)), cities, man, "2024-01-01", 4, ["T2M", "RH2M"])
    assert {r.check_id for r in bad.filter("status = 'fail'").collect()} == {"parsed-value-count", "source-manifest-record-count", "aligned-daily-keys", "fill-value-count"}


def request_rows(spark, days=60):
    rows = [("Alpha", date(2024, 1, 1 + d) if d < 31 else date(2024, 2, d - 30), "Pothole" if i % 3 else "Noise", "Area 1" if i % 2 else None, "Open")
            for d in range(days) for i in range(6 + d % 7)]
    return spark.createDataFrame(rows, "city string, service_day date, category string, area string, status string")


def test_deep_quality(spark):
    views = rq.request_views(request_rows(spark, 30)).cache()
    bounds = rq.window_bounds(views)
    per = {r.view: r.n for r in views.groupBy("view").agg(F.count("*").alias("n")).collect()}
    man = spark.createDataFrame([("Alpha", f"m{i}", v, n) for i, (v, n) in enumerate(per.items())] + [("Alpha", f"o{i}", None, 1) for i in range(3)], "city string, artifact_id string, view string, record_count long")
    places = spark.createDataFrame([("Alpha", "1", "1", "2")], "city string, declared_geoid string, population_geoid string, boundary_geoid string")
    clim = spark.createDataFrame([("Alpha", p_, date(2024, 1, 1 + d), 1.0 if d else -999.0) for p_ in ("T2M", "RH2M") for d in range(30)], "city string, parameter string, day date, value double")
    got = {r.check_id: r.status for r in g.quality_deep(views, bounds, man, places, clim, ["T2M", "RH2M"]).collect()}
    assert len(got) == 10
    assert {k for k, v in got.items() if v == "fail"} == {"tigerweb-place-identity", "nasa-fill-value-gate"}
    assert {k for k, v in got.items() if v == "warn"} == {"municipal-area-missingness"}


def test_screens(spark):
    names = sorted({m for _, ms in p.SCREENS.values() for m in ms})
    df = spark.createDataFrame([("c", n, 1.0) for n in names] + [("d", names[0], 2.0)], "city_id string, metric_id string, value double")
    rows = p.screen_cities(df).collect()
    assert len(rows) == 6 and not any(r.recommendation_issued for r in rows)
    assert {r.missing_metrics for r in rows if r.city_id == "c"} == {0}
    assert sorted({r.status for r in rows}) == ["insufficient-evidence", "screened"]


TEMPLATES = (
    p.Template("all-demand", "public-service", "any-demand"), p.Template("potholes", "infrastructure-finance", "category-demand", ("POTHOLE",), 50),
    p.Template("rare", "public-service", "category-demand", ("graffiti",), 5), p.Template("effect", "behavioral-equity", "required-causal-design"),
    p.Template("transit", "mobility-access", "required-network"),
)


def test_compile_keeps_negative_scenarios(spark):
    views = rq.request_views(request_rows(spark)).cache()
    rows = [(f"tierd.alpha.{n:02d}", o, i, m + 0.01 * ((i * 7) % 5), "simulated") for n in (1, 2, 3, 4, 5) for i in range(40) for o, m in (("no-action", 0.0), ("conservative-plan", 0.45), ("bounded-portfolio", 1.0))]
    option_draws = spark.createDataFrame(rows, "run_id string, option_id string, draw int, value double, evidence_type string")
    out = p.compile_scenarios(views, TEMPLATES, option_draws)
    by = {r.template_id: r for r in out["packs"].collect()}
    assert len(by) == 5
    assert by["all-demand"].status == by["potholes"].status == "completed"
    assert by["all-demand"].selected_option_id == "bounded-portfolio" and by["all-demand"].uncertainty_status == "robust-winner"
    assert len(by["potholes"].options) == 3 and {t.outcome for t in by["potholes"].reversal_tests} == {"stable"}
    assert "matches 0 requests" in by["rare"].failure_reason and by["effect"].failure_reason == g.NO_DESIGN and by["transit"].failure_reason == g.NO_NETWORK
    assert by["rare"].options is None and by["rare"].selected_option_id is None
    solved = {r.problem_id: r for r in out["problems"].collect()}
    assert len(solved) == 2 and {r.search_space for r in solved.values()} == {3125} and {r.status for r in solved.values()} == {"optimal"}
    assert out["parameters"].count() == 8 and {r.status for r in out["forecasts"].collect()} == {"completed"}
    reg = p.registry(out["packs"]).collect()[0]
    assert (reg.completed, reg.negative) == (2, 3) and len(reg.pack_ids) == len(set(reg.pack_hashes)) == 5
    again = {r.template_id: r.content_hash for r in p.compile_scenarios(views, TEMPLATES, option_draws)["packs"].collect()}
    assert again == {k: v.content_hash for k, v in by.items()}


def test_designs_expand(spark):
    fam = spark.createDataFrame([("heat", "climate-disaster", "cool roofs", "indoor heat", ["climate-hazard"])], f"family_id string, suite string, decision_object string, outcome string, source_roles {A}")
    rows = p.expand_designs(fam, {"invest": {"mechanism": "capital plan", "mode": "optimization", "roles": ["network"]}, "rule": {"mechanism": "standard", "mode": "causal", "roles": []}}).collect()
    assert [r.design_id for r in rows] == ["heat.invest", "heat.rule"] and rows[0].source_roles == ["climate-hazard", "network"]
    assert rows[0].title == "Capital Plan for cool roofs"
