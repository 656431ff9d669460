"""Screens and decision packs: the end of the path from request views to gated decisions.

A scenario (city x template) is the unit of everything here; its id keys the forecast series, the
portfolio problem and the option draws, so all parts meet in equi-joins on one column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.canonical import document_hash
from tessera.functions.hashing import seed_of
from tessera.operators import requests as rq
from tessera.operators.gates import gate_scenarios
from tessera.plans import draws, portfolio
from tessera.plans.forecast import ForecastConfig, forecast
from tessera.session import durable

# The three descriptive screens and the metrics each one shows.
SCREENS = {
    "standard.heat-screen.v1": ("screened", (
        "climate-t2m-annual-mean", "climate-t2m-max-annual-maximum", "climate-days-t2m-max-ge-35c",
        "climate-relative-humidity-annual-mean", "country-sp-urb-totl-in-zs")),
    "standard.precipitation-screen.v1": ("screened", (
        "climate-precipitation-annual-sum", "climate-days-precipitation-ge-20mm",
        "climate-wind-speed-annual-mean", "country-sp-pop-totl")),
    "standard.policy-readiness.v1": ("insufficient-evidence", (
        "climate-t2m-max-annual-maximum", "country-ny-gdp-pcap-cd")),
}
# Planning actions (cost, capacity, risk, benefit per unit) of the bounded portfolio.
ACTIONS = {
    "triage-shift": (2.0, 1.4, 0.7, 1.00), "surge-crew": (3.0, 2.1, 1.2, 1.35),
    "digital-intake": (1.5, 1.0, 0.5, 0.72), "targeted-outreach": (2.5, 1.2, 0.9, 0.88),
    "reserve-capacity": (2.2, 1.8, 0.8, 1.08),
}
EFFECTS = {"central": 1.0, "high-demand": 0.72, "low-effect": 0.55}
LIMITS = {"budget": 12.0, "capacity": 15.0, "maximum_risk": 8.0, "maximum_selected": 4, "minimum_selected": 1}
MAX_UNITS = 4
FORECAST = ForecastConfig(horizon=14, folds=12, min_folds=5, min_train=28)
PORTFOLIO = portfolio.PortfolioConfig(maximum_evaluations=10_000, retained=60)
UNCERTAINTY = draws.OptionConfig(confidence=0.95, margin=0.02, robust_threshold=0.90, max_regret=0.20)
BASELINE = "bounded-portfolio"
# Evidence that would most change a decision, by priority.
VALUE_OF_INFORMATION = (
    ("local-action-effectiveness", 1.0, "Run a pre-registered pilot or quasi-experiment on action effects."),
    ("operational-cost-capacity", 0.96, "Obtain versioned local cost, staffing and capacity records."),
    ("distributional-outcomes", 0.92, "Define reviewed subgroup outcomes and an equity rule."),
)


@dataclass(frozen=True)
class Template:
    template_id: str
    suite: str
    strategy: str = "category-demand"  # or any-demand, required-causal-design, required-network
    keywords: Sequence[str] = ()
    minimum_requests: int = 0


def screen_cities(metrics: DataFrame) -> DataFrame:
    """Three screens per city with their metrics; a screen that lacks a metric says so.

    ``metrics(city_id, metric_id, value)``. No screen is a recommendation.
    """
    wanted = F.array(*[
        F.struct(F.lit(t).alias("template_id"), F.lit(s).alias("status"), F.lit(m).alias("metric_id"), F.lit(i).alias("ord"))
        for t, (s, ms) in SCREENS.items() for i, m in enumerate(ms)
    ])
    cities = metrics.select("city_id").distinct().select("city_id", F.explode(wanted).alias("w")).select("city_id", "w.*")
    rows = cities.join(metrics.select("city_id", "metric_id", "value"), ["city_id", "metric_id"], "left")
    return rows.groupBy("city_id", "template_id", "status").agg(
        F.sort_array(F.collect_list(F.struct("ord", "metric_id", "value"))).alias("m"),
        F.count_if(F.col("value").isNull()).alias("missing_metrics"),
    ).select(
        F.concat_ws(".", "city_id", "template_id").alias("run_id"), "city_id", "template_id", "status",
        F.transform("m", lambda x: F.struct(x["metric_id"], x["value"])).alias("metrics"), "missing_metrics",
        F.lit(False).alias("recommendation_issued"),
    )


def scenarios(bounds: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """City x template rows with their stable id and seed."""
    listed = F.explode(F.array(*[
        F.struct(
            F.lit(i + 1).alias("template_order"), F.lit(t.template_id).alias("template_id"), F.lit(t.suite).alias("suite"),
            F.lit(t.strategy).alias("strategy"), F.lit(t.minimum_requests).cast("long").alias("minimum_requests"),
        )
        for i, t in enumerate(templates)
    ]))
    rows = bounds.select("city", "start_day", "end_day", listed.alias("t")).select("city", "start_day", "end_day", "t.*")
    named = F.format_string("tierd.%s.%02d", F.lower("city"), F.col("template_order"))
    return rows.withColumn("scenario_id", named).withColumn("seed", seed_of(F.col("scenario_id")))


def scenario_parameters(means: DataFrame) -> DataFrame:
    """Workload parameter rows of each scenario: bounds are fixed fractions of the daily mean.

    ``means(scenario_id, daily_mean)``.
    """
    m = F.col("daily_mean")
    none = F.lit(None).cast("double")

    def row(name: str, kind: str, fixed: Column, low: Column, mode: Column, high: Column, coefficient: float) -> Column:
        return F.struct(
            F.lit(name).alias("parameter_id"), F.lit(kind).alias("kind"), fixed.cast("double").alias("fixed_value"),
            low.cast("double").alias("minimum"), mode.cast("double").alias("mode"), high.cast("double").alias("maximum"),
            F.lit(coefficient).alias("coefficient"),
            F.lit("estimated" if kind == "fixed" else "proposed").alias("evidence_type"),
        )

    floor = F.greatest(m * 0.001, F.lit(0.001))
    listed = F.array(
        row("baseline-demand", "fixed", m, none, none, none, 1.0),
        row("demand-shock", "triangular", none, m * -0.10, m * 0.03, m * 0.20, 1.0),
        row("action-relief", "triangular", none, m * 0.01, m * 0.07, m * 0.18, -1.0),
        row("implementation-friction", "uniform", none, F.lit(0.0), none, F.greatest(m * 0.06, floor), 1.0),
    )
    return means.select("scenario_id", F.explode(listed).alias("p")).select("scenario_id", "p.*")


def scenario_portfolios(means: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Action, effect-state and constraint tables of each scenario, scaled by its daily mean."""
    scale = F.greatest(F.lit(1.0), F.col("daily_mean") / 100)
    problem = F.col("scenario_id").alias("problem_id")
    actions = means.select(problem, F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("action_id"), F.lit(i).alias("ord"), F.lit(MAX_UNITS).alias("max_units"),
            F.lit(cost).alias("unit_cost"), F.lit(cap).alias("unit_capacity"), F.lit(risk).alias("unit_risk"),
            (benefit * scale).alias("unit_benefit"),
        )
        for i, (name, (cost, cap, risk, benefit)) in enumerate(ACTIONS.items())
    ])).alias("a")).select("problem_id", "a.*")
    effects = means.select(problem, F.explode(F.array(*[
        F.struct(F.lit(name).alias("action_id"), F.lit(state).alias("scenario_id"), (spec[3] * scale * share).alias("value"))
        for name, spec in ACTIONS.items() for state, share in EFFECTS.items()
    ])).alias("s")).select("problem_id", "s.*")
    limits = means.select(
        problem, *[F.lit(LIMITS[n]).alias(n) for n in ("budget", "capacity", "maximum_risk")],
        F.lit(None).cast("double").alias("minimum_benefit"),
        *[F.lit(LIMITS[n]).alias(n) for n in ("maximum_selected", "minimum_selected")],
    )
    return actions, effects, limits


def reversal_tests(moves: DataFrame) -> DataFrame:
    """Reversal rows as tests: reversed when the competitor ever wins."""
    flipped = F.col("reversal_probability") > 0
    return moves.select(
        "run_id", F.concat(F.lit("paired-draw-"), "competing_option_id").alias("test_id"),
        "baseline_option_id", "reversal_probability",
        F.when(flipped, F.col("competing_option_id")).otherwise(F.col("baseline_option_id")).alias("selected_after_test"),
        F.when(flipped, "reversed").otherwise("stable").alias("outcome"),
    )


def decision_options(runs: DataFrame, conservative: DataFrame, summary: DataFrame, selected: DataFrame) -> DataFrame:
    """No-action, conservative and selected option rows per scenario.

    ``selected(problem_id, plan_id, objective_value, total_cost, selected_action_count,
    binding_constraints)`` holds the optimal plan of each completed problem.
    """
    def option(name: str, kind: str, feasible: bool, plan: Column | None) -> Column:
        def of(field: str, default) -> Column:
            return plan[field] if plan is not None else F.lit(default)
        return F.struct(
            F.lit(name).alias("option_id"), F.lit(kind).alias("evidence_type"), F.lit(feasible).alias("feasible"),
            of("plan_id", "zero-action-baseline").alias("plan_id"), of("objective_value", 0.0).alias("objective_value"),
            of("total_cost", 0.0).alias("total_cost"), of("selected_action_count", 0).alias("selected_action_count"),
            (plan["binding_constraints"] if plan is not None else F.array(F.lit("minimum-selected-actions"))).alias("binding_constraints"),
        )

    best = selected.select("problem_id", F.struct("plan_id", "objective_value", "total_cost", "selected_action_count", "binding_constraints").alias("best"))
    rows = runs.filter("status = 'optimal'").select("problem_id").join(best, "problem_id").join(conservative, "problem_id", "left")
    listed = F.array_compact(F.array(
        option("no-action", "proposed", False, None),
        F.when(F.col("conservative").isNotNull(), option("conservative-plan", "optimized", True, F.col("conservative"))),
        option(BASELINE, "optimized", True, F.col("best")),
    ))
    long = rows.select(F.col("problem_id").alias("run_id"), F.explode(listed).alias("o")).select("run_id", "o.*")
    return long.join(
        summary.select("run_id", "option_id", "probability_best", "expected_regret"), ["run_id", "option_id"], "left"
    )


def decision_packs(scenario_rows: DataFrame, options: DataFrame, tests: DataFrame, decisions: DataFrame) -> DataFrame:
    """One nested document per scenario, positive or negative, with its content hash.

    ``scenario_rows(scenario_id, city, template_id, negative_reason, observed_requests)``.
    """
    listed = options.groupBy(F.col("run_id").alias("scenario_id")).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in options.columns if c != "run_id"]))).alias("options"))
    tested = tests.groupBy(F.col("run_id").alias("scenario_id")).agg(
        F.sort_array(F.collect_list(F.struct(*[c for c in tests.columns if c != "run_id"]))).alias("reversal_tests"))
    chosen = decisions.select(
        F.col("run_id").alias("scenario_id"), "selected_option_id", F.col("status").alias("uncertainty_status"),
        F.col("failure_reason").alias("_uncertain"))
    rows = scenario_rows.join(listed, "scenario_id", "left").join(tested, "scenario_id", "left").join(chosen, "scenario_id", "left")
    pick = F.filter("options", lambda o: (o["option_id"] == F.col("selected_option_id")) & o["feasible"])
    unbacked = F.coalesce(F.size(pick) < 1, F.lit(True))
    reason = F.coalesce(
        F.col("negative_reason"),
        F.when(F.col("options").isNull(), "No feasible bounded portfolio is available."),
        F.col("_uncertain"),
        F.when(unbacked, "The paired draws select an infeasible or unknown option."),
    )
    rows = rows.withColumn("failure_reason", reason)
    done = F.col("failure_reason").isNull()
    voi = F.array(*[
        F.struct(F.lit(i).alias("id"), F.lit(p).alias("priority_score"), F.lit(a).alias("collection_action"))
        for i, p, a in VALUE_OF_INFORMATION
    ])
    body = rows.select(
        "scenario_id", "city", "template_id", "suite", "observed_requests",
        F.when(done, "completed").otherwise("insufficient-evidence").alias("status"),
        F.when(done, "planning-support").otherwise("insufficient-evidence").alias("readiness"),
        F.when(done, F.col("selected_option_id")).alias("selected_option_id"),
        F.when(done, F.col("uncertainty_status")).alias("uncertainty_status"),
        "failure_reason", F.when(done, F.col("options")).alias("options"),
        F.when(done, F.col("reversal_tests")).alias("reversal_tests"), voi.alias("value_of_information"),
        "seed",
    )
    return body.withColumn("content_hash", document_hash(body))


def compile_scenarios(
    views: DataFrame, templates: Sequence[Template], option_draws: DataFrame, config: ForecastConfig = FORECAST
) -> dict[str, DataFrame]:
    """From request views to decision packs for every city and template in one set of joins.

    Negative scenarios stop at the gate and are released with their reason. ``option_draws`` is the
    table of paired option draws per scenario. The views and the scored plans feed several branches,
    so each is computed once and kept in the shared checkpoint folder.
    """
    views = durable(views)
    rules: Mapping[str, Sequence[str]] = {t.template_id: t.keywords for t in templates}
    bounds = rq.window_bounds(views)
    focus = rq.focus_summary(views, rules).withColumnRenamed("rule_id", "template_id")
    daily = rq.focus_daily(views, rules, bounds).withColumnRenamed("rule_id", "template_id")
    keys = ["city", "template_id"]
    gated = gate_scenarios(
        scenarios(bounds, templates).join(focus, keys, "left")
        .withColumn("observed_requests", F.coalesce("matching_requests", F.lit(0)).cast("long"))
    )
    gated = gated.withColumn(
        "negative_reason",
        F.when(~F.coalesce("reconciled", F.lit(True)), "Daily and category focus totals do not reconcile.")
        .otherwise(F.col("negative_reason")),
    )
    gated = durable(gated)
    alive = gated.filter(F.col("negative_reason").isNull()).select(*keys, "scenario_id")
    points = daily.join(alive, keys).select(
        F.col("scenario_id").alias("series_id"), F.col("service_day").cast("timestamp").alias("ts"),
        F.col("request_count").cast("double").alias("value"),
    )
    runs = forecast(points, config)
    means = points.groupBy(F.col("series_id").alias("scenario_id")).agg(F.avg("value").alias("daily_mean"))
    actions, effects, limits = scenario_portfolios(means)
    problems = portfolio.problem_rows(actions, effects, limits, PORTFOLIO)
    scored = durable(portfolio.score_plans(portfolio.plan_grid(problems), PORTFOLIO))
    plans = portfolio.retain_plans(scored, PORTFOLIO.retained)
    solved = portfolio.solve(problems, scored, PORTFOLIO)
    drawn = durable(
        option_draws.join(alive.select(F.col("scenario_id").alias("run_id")), "run_id", "left_semi")
    )
    summary = draws.option_summary(drawn, UNCERTAINTY)
    decided = draws.option_decision(drawn, UNCERTAINTY, BASELINE)
    tests = reversal_tests(draws.reversals(drawn, UNCERTAINTY, BASELINE))
    selected = plans.join(
        solved.select("problem_id", F.col("selected_plan_id").alias("plan_id")), ["problem_id", "plan_id"], "left_semi"
    )
    options = decision_options(solved, portfolio.conservative_plan(plans, solved), summary, selected)
    failed = runs.filter("status <> 'completed'").select(
        F.col("series_id").alias("scenario_id"), F.col("failure_reason").alias("_forecast_reason")
    )
    released = gated.join(failed, "scenario_id", "left").withColumn(
        "negative_reason", F.coalesce("negative_reason", "_forecast_reason")
    )
    packs = decision_packs(released, options, tests, decided)
    return {
        "scenarios": gated, "forecasts": runs, "parameters": scenario_parameters(means), "problems": solved,
        "options": options, "decisions": decided, "packs": packs,
    }


def registry(packs: DataFrame) -> DataFrame:
    """Registry row per city: packs in order with aligned ids, hashes and statuses, and totals.

    A city has one pack per template, so its arrays are as short as the template list.
    """
    entry = F.sort_array(F.collect_list(F.struct("scenario_id", "content_hash", "status")))
    return packs.groupBy("city").agg(
        entry.alias("e"), F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") != "completed").alias("negative"),
    ).select(
        "city", F.transform("e", lambda x: x["scenario_id"]).alias("pack_ids"),
        F.transform("e", lambda x: x["content_hash"]).alias("pack_hashes"),
        F.transform("e", lambda x: x["status"]).alias("statuses"), "completed", "negative",
    )


def all_executions(*kinds: tuple[str, DataFrame]) -> DataFrame:
    """Every kind of execution in one summary schema: ``execution_id, kind, city_id, suite, status, title``."""
    out = None
    for kind, table in kinds:
        rows = table.select(
            F.col("execution_id").cast("string").alias("execution_id"), F.lit(kind).alias("kind"),
            F.col("city_id").cast("string").alias("city_id"), "suite", "status", "title",
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def expand_designs(families: DataFrame, settings: Mapping[str, Mapping[str, object]]) -> DataFrame:
    """Family axes x decision-type settings to design rows.

    ``families(family_id, suite, decision_object, outcome, source_roles)``; each setting gives a
    ``mechanism``, ``mode`` and extra ``roles``. The settings are a fixed literal, so this is a projection.
    """
    listed = F.explode(F.array(*[
        F.struct(
            F.lit(name).alias("decision_type"), F.lit(s["mechanism"]).alias("mechanism"), F.lit(s["mode"]).alias("mode"),
            F.array(*[F.lit(r) for r in s["roles"]]).cast("array<string>").alias("extra_roles"),
        )
        for name, s in settings.items()
    ]))
    rows = families.select("*", listed.alias("s")).select("*", "s.*").drop("s")
    return rows.select(
        F.concat_ws(".", "family_id", "decision_type").alias("design_id"), "family_id", "suite", "decision_type",
        F.concat_ws(" ", F.initcap("mechanism"), F.lit("for"), F.col("decision_object")).alias("title"),
        F.concat(F.lit("Which "), "mechanism", F.lit(" changes "), "outcome", F.lit("?")).alias("question"),
        F.sort_array(F.array_union("source_roles", "extra_roles")).alias("source_roles"),
        F.array(F.lit("descriptive"), F.col("mode")).alias("analysis_modes"),
    )
