"""Plan scoring for many portfolio problems: bounded integer grids, constraints, ranking, frontier.

Tables: ``actions(problem_id, action_id, ord, max_units, unit_cost, unit_capacity, unit_risk,
unit_benefit)``, long ``groups(problem_id, action_id, group_id, benefit)`` and
``scenarios(problem_id, action_id, scenario_id, value)``, ``constraints(problem_id, budget,
capacity, maximum_risk, minimum_benefit, maximum_selected, minimum_selected)`` and ``floors(problem_id,
group_id, minimum)``. A problem's declaration is a handful of rows, so it becomes one row of arrays;
its plans are generated from that row in blocks and scored by projection, without any join.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.ranking import running_max
from tessera.functions.scalar import portable
from tessera.session import durable

OPTIMAL, INFEASIBLE, LIMITED, REJECTED = "optimal", "infeasible", "search-limited", "rejected"
NO_FEASIBLE = "Complete enumeration found no plan satisfying every hard constraint."
# Plans generated by one task step; a large grid is spread over as many blocks as it needs.
BLOCK = 32768


@dataclass(frozen=True)
class PortfolioConfig:
    worst_case: bool = True
    weights: Mapping[str, float] = field(default_factory=dict)
    maximum_evaluations: int = 1_000_000
    retained: int = 500
    tolerance: float = 1e-9

    def __post_init__(self):
        if not 1 <= self.maximum_evaluations <= 10_000_000 or not 1 <= self.retained <= 100_000:
            raise ValueError("maximum_evaluations or retained is out of range")
        if not 0 < self.tolerance <= 1e-3:
            raise ValueError("tolerance is out of range")
        if self.worst_case and self.weights:
            raise ValueError("worst-case objectives cannot declare scenario weights")
        if any(w < 0 for w in self.weights.values()):
            raise ValueError("scenario weights must be nonnegative")
        if not self.worst_case and abs(sum(self.weights.values()) - 1) > self.tolerance:
            raise ValueError("expected objective scenario weights must sum to one")


def _dot(quantities: Column, per_unit: Column) -> Column:
    products = F.zip_with(quantities, per_unit, lambda q, u: q * u)
    return portable(F.aggregate(products, F.lit(0.0), lambda s, x: s + x))


def problem_rows(
    actions: DataFrame, scenarios: DataFrame, constraints: DataFrame, config: PortfolioConfig,
    groups: DataFrame | None = None, floors: DataFrame | None = None,
) -> DataFrame:
    """One row of arrays per problem with its search-space size and, if unsound, the reason."""
    spark = actions.sparkSession
    if groups is None:
        groups = spark.createDataFrame([], "problem_id string, action_id string, group_id string, benefit double")
    if floors is None:
        floors = spark.createDataFrame([], "problem_id string, group_id string, minimum double")
    listed = actions.groupBy("problem_id").agg(
        F.sort_array(F.collect_list(F.struct(
            "ord", "action_id", "max_units", "unit_cost", "unit_capacity", "unit_risk", "unit_benefit"
        ))).alias("a"),
    )

    def keyed(table: DataFrame, name: str, value: str) -> DataFrame:
        """Array of (name, map action -> value), sorted by name."""
        per = table.groupBy("problem_id", name).agg(
            F.map_from_entries(F.sort_array(F.collect_set(F.struct("action_id", value)))).alias("m")
        )
        return per.groupBy("problem_id").agg(
            F.sort_array(F.collect_list(F.struct(F.col(name).alias("id"), F.map_entries("m").alias("e")))).alias(name)
        )

    rows = (
        listed.join(keyed(scenarios, "scenario_id", "value"), "problem_id", "left")
        .join(keyed(groups, "group_id", "benefit"), "problem_id", "left")
        .join(
            floors.groupBy("problem_id").agg(
                F.sort_array(F.collect_list(F.struct("group_id", "minimum"))).alias("floors")
            ),
            "problem_id", "left",
        )
        .join(constraints, "problem_id")
    )

    def aligned(source: str) -> Column:
        """Per-unit values in action order, absent ones zero."""
        return F.transform(
            F.coalesce(F.col(source), F.array().cast("array<struct<id:string,e:array<struct<key:string,value:double>>>>")),
            lambda s: F.struct(
                s["id"].alias("id"),
                F.transform(
                    "a",
                    lambda a: F.coalesce(
                        F.try_element_at(F.map_from_entries(s["e"]), a["action_id"]), F.lit(0.0)
                    ),
                ).alias("u"),
                F.size(s["e"]).alias("declared"),
            ),
        )

    sizes = F.transform("a", lambda a: (a["max_units"] + 1).cast("double"))
    rows = rows.select(
        "problem_id", "a", "budget", "capacity", "maximum_risk", "minimum_benefit",
        "maximum_selected", "minimum_selected",
        F.coalesce("floors", F.array().cast("array<struct<group_id:string,minimum:double>>")).alias("floors"),
        aligned("scenario_id").alias("s"), aligned("group_id").alias("g"),
        F.aggregate(sizes, F.lit(1.0), lambda p, x: p * x).alias("_space"),
    )
    ids = F.transform("a", lambda a: a["action_id"])
    scenario_ids = F.transform("s", lambda s: s["id"])
    declared = F.array(*[F.lit(k) for k in sorted(config.weights)]).cast("array<string>")
    reason = (
        F.when(F.size(F.array_distinct(ids)) < F.size(ids), "portfolio action ids must be unique")
        .when(F.size("s") == 0, "portfolio actions require objective scenarios")
        .when(
            F.exists("s", lambda s: s["declared"] != F.size("a")),
            "portfolio actions must share the same objective scenarios",
        )
        .when(
            F.exists("floors", lambda f: ~F.array_contains(F.transform("g", lambda g: g["id"]), f["group_id"])),
            "portfolio group constraints must reference declared groups",
        )
    )
    if not config.worst_case:
        reason = reason.when(
            scenario_ids != declared, "expected objective weights must exactly cover scenarios"
        )
    return rows.withColumn("rejection", reason).withColumns({
        "search_space": F.least(F.col("_space"), F.lit(9.0e18)).cast("long"),
        "evaluated": F.least(F.col("_space"), F.lit(float(config.maximum_evaluations))).cast("long"),
    }).drop("_space")


def plan_grid(problems: DataFrame) -> DataFrame:
    """Every plan index below the cap with its quantities; the last action varies fastest.

    Block numbers are expanded and spread before the plans are, so no task holds a whole grid.
    """
    # the number is explicit, because block rows are few and small and would otherwise be merged into
    # one task just before they grow
    spread = int(problems.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = problems.filter(F.col("rejection").isNull()).withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.floor((F.col("evaluated") - 1) / BLOCK)))
    ).repartition(spread, "problem_id", "block")
    first = F.col("block") * BLOCK
    last = F.least(first + BLOCK, F.col("evaluated")) - 1
    plans = blocks.withColumn("plan_index", F.explode(F.sequence(first, last))).drop("block")
    # walk the radices from the last action to the first, peeling one digit off the index each time
    digits = F.aggregate(
        F.reverse("a"),
        F.struct(F.col("plan_index").alias("rest"), F.array().cast("array<bigint>").alias("q")),
        lambda st, a: F.struct(
            F.floor(st["rest"] / (a["max_units"] + 1)).alias("rest"),
            F.concat(F.array(F.pmod(st["rest"], (a["max_units"] + 1).cast("long"))), st["q"]).alias("q"),
        ),
        lambda st: st["q"],
    )
    return plans.withColumn("quantities", digits)


def score_plans(grid: DataFrame, config: PortfolioConfig) -> DataFrame:
    """Totals, objective, violations, binding constraints and feasibility of every plan."""
    q = F.col("quantities")

    def total(name: str) -> Column:
        return _dot(q, F.transform("a", lambda a: a[name]))

    def keyed(source: str) -> Column:
        return F.transform(source, lambda s: F.struct(s["id"].alias("id"), _dot(q, s["u"]).alias("value")))

    scored = grid.select(
        "problem_id", "plan_index", "quantities", "budget", "capacity", "maximum_risk",
        "minimum_benefit", "maximum_selected", "minimum_selected", "floors",
        total("unit_cost").alias("total_cost"),
        total("unit_capacity").alias("total_capacity"),
        total("unit_risk").alias("total_risk"),
        total("unit_benefit").alias("total_benefit"),
        keyed("g").alias("group_benefits"),
        keyed("s").alias("scenario_objectives"),
        F.size(F.filter("quantities", lambda x: x > 0)).cast("double").alias("selected_actions"),
    )
    values = F.col("scenario_objectives")
    if config.worst_case:
        objective = F.array_min(F.transform(values, lambda v: v["value"]))
    else:
        weight = F.create_map(*[F.lit(x) for pair in config.weights.items() for x in pair])
        objective = portable(F.aggregate(
            values, F.lit(0.0), lambda s, v: s + v["value"] * F.try_element_at(weight, v["id"])
        ))

    def entry(name: Column | str, measured: Column, bound: Column, excess: Column, bindable: bool) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(
            name.alias("constraint_id"), measured.cast("double").alias("measured"),
            bound.cast("double").alias("bound"), portable(excess).alias("excess"),
            F.lit(bindable).alias("bindable"),
        )

    def upper(name: str, measured: str, bound: str, bindable: bool = True) -> Column:
        m, b = F.col(measured), F.col(bound)
        return F.when(b.isNotNull(), entry(name, m, b, m - b, bindable))

    def lower(name: str, measured: str, bound: str, bindable: bool = True) -> Column:
        m, b = F.col(measured), F.col(bound)
        return F.when(b.isNotNull(), entry(name, m, b, b - m, bindable))

    def group_floor(f: Column) -> Column:
        measured = F.aggregate(
            "group_benefits", F.lit(0.0),
            lambda s, g: F.when(g["id"] == f["group_id"], g["value"]).otherwise(s),
        )
        return entry(
            F.concat(F.lit("group-"), f["group_id"]), measured, f["minimum"], f["minimum"] - measured, True
        )

    checks = F.concat(
        F.array_compact(F.array(
            upper("budget", "total_cost", "budget"),
            upper("capacity", "total_capacity", "capacity"),
            upper("maximum-risk", "total_risk", "maximum_risk"),
            lower("minimum-benefit", "total_benefit", "minimum_benefit"),
        )),
        F.transform("floors", group_floor),
        F.array_compact(F.array(
            upper("maximum-selected-actions", "selected_actions", "maximum_selected", False),
            lower("minimum-selected-actions", "selected_actions", "minimum_selected", False),
        )),
    )
    tol = config.tolerance
    return (
        scored.withColumn("objective_value", objective)
        .withColumn("_checks", checks)
        .withColumn("violations", F.transform(
            F.filter("_checks", lambda c: c["excess"] > tol),
            lambda c: F.struct(c["constraint_id"], c["measured"], c["bound"], c["excess"]),
        ))
        .withColumn("binding_constraints", F.transform(
            F.filter("_checks", lambda c: c["bindable"] & (F.abs(c["measured"] - c["bound"]) <= tol)),
            lambda c: c["constraint_id"],
        ))
        .select(
            "problem_id", "plan_index",
            F.format_string("portfolio-plan-%08d", F.col("plan_index")).alias("plan_id"),
            "quantities", "total_cost", "total_capacity", "total_risk", "total_benefit",
            "group_benefits", "scenario_objectives", "objective_value",
            F.col("selected_actions").cast("int").alias("selected_action_count"),
            (F.size("violations") == 0).alias("feasible"), "violations", "binding_constraints",
        )
    )


def _rank_key() -> Column:
    """Feasible first, objective down, cost up, quantities, index."""
    return F.struct(
        (~F.col("feasible")).alias("x"), (-F.col("objective_value")).alias("o"),
        F.col("total_cost"), F.col("quantities"), F.col("plan_index"),
    )


def retain_plans(plans: DataFrame, retained: int) -> DataFrame:
    """Leading plans of each problem. The best feasible plan ranks first, so it is always kept.

    Each task keeps only its own leading rows before the shuffle.
    """
    order = W.partitionBy("problem_id").orderBy(_rank_key())
    return plans.withColumn("plan_rank", F.row_number().over(order)).filter(
        F.col("plan_rank") <= retained
    )


def pareto(plans: DataFrame, config: PortfolioConfig = PortfolioConfig(), retained: int | None = None) -> DataFrame:
    """Feasible plans no other feasible plan beats on objective or cost beyond the tolerance.

    Plans are reduced to the best objective per distinct cost. Each cost then asks twice for the best objective up
    to some cost: one tolerance below its own, and one above. Costs and questions lie in one order, split over ranges with
    prefix maxima, so a problem of any number of plans is spread over all tasks. With ``retained`` the frontier of all plans
    is listed as far as its plans are among the first so many of their problem (:func:`retain_plans`).
    """
    t = config.tolerance
    # read by both sides of the join below, so the scoring runs once
    feasible = durable(plans.filter("feasible").select(
        "problem_id", "plan_id", "total_cost", "objective_value", "quantities", "selected_action_count", "plan_index", "feasible"
    ))
    levels = feasible.groupBy("problem_id", "total_cost").agg(F.max("objective_value").alias("_top"))
    # at an equal place costs come before questions, as a cost exactly a tolerance away counts
    asked = levels.select("problem_id", "_top", F.col("total_cost").alias("_of"), F.explode(F.array(
        F.struct(F.col("total_cost").alias("_at"), F.lit(0).alias("_kind")),
        F.struct((F.col("total_cost") - t).alias("_at"), F.lit(1).alias("_kind")),
        F.struct((F.col("total_cost") + t).alias("_at"), F.lit(2).alias("_kind")),
    )).alias("_e")).select(
        "problem_id", "_e._at", "_e._kind", "_of", F.when(F.col("_e._kind") == 0, F.col("_top")).alias("_value")
    )
    answered = running_max(asked, ["problem_id"], ["_at", "_kind", "_of"], "_value", "_best")
    reach = answered.filter("_kind > 0").groupBy("problem_id", F.col("_of").alias("total_cost")).agg(
        F.max(F.when(F.col("_kind") == 1, F.col("_best"))).alias("_cheaper"),
        F.max(F.when(F.col("_kind") == 2, F.col("_best"))).alias("_at_cost"),
    )
    objective = F.col("objective_value")
    beaten = (F.col("_at_cost") > objective + t) | F.coalesce(
        F.col("_cheaper") >= objective - t, F.lit(False)
    )
    frontier = feasible.join(reach, ["problem_id", "total_cost"]).filter(~beaten).drop("_at_cost", "_cheaper")
    if retained is not None:
        leading = retain_plans(feasible, retained).select("problem_id", "plan_id")
        frontier = frontier.join(leading, ["problem_id", "plan_id"], "left_semi")
    return frontier.drop("plan_index", "feasible")


def violation_counts(plans: DataFrame) -> DataFrame:
    """Number of plans that break each constraint, per problem."""
    return (
        plans.select("problem_id", F.explode("violations.constraint_id").alias("constraint_id"))
        .groupBy("problem_id", "constraint_id")
        .agg(F.count("*").alias("violating_plans"))
    )


def solve(problems: DataFrame, plans: DataFrame, config: PortfolioConfig) -> DataFrame:
    """One row per problem: status, selection, gap, bound, change against doing nothing."""
    key = F.struct(
        (-F.col("objective_value")).alias("o"), F.col("total_cost"), F.col("quantities"), F.col("plan_index")
    )
    per = plans.groupBy("problem_id").agg(
        F.count("*").alias("evaluated_plans"),
        F.count_if("feasible").alias("feasible_plans"),
        F.min_by(
            F.when(F.col("feasible"), F.struct("plan_id", "objective_value", "total_cost", "quantities")),
            F.when(F.col("feasible"), key),
        ).alias("incumbent"),
        F.max(F.when(F.col("plan_index") == 0, F.col("objective_value"))).alias("baseline_objective"),
    )
    bound = portable(F.aggregate(
        F.transform(
            F.sequence(F.lit(0), F.size("a") - 1),
            lambda i: F.get(F.col("a"), i)["max_units"]
            * F.array_max(F.transform("s", lambda s: F.get(s["u"], i))),
        ),
        F.lit(0.0), lambda s, x: s + x,
    ))
    declared = problems.select(
        "problem_id", "rejection", "search_space",
        F.when(F.col("rejection").isNull(), bound).alias("theoretical_upper_bound"),
    )
    rows = declared.join(per, "problem_id", "left")
    complete = F.col("evaluated_plans") == F.col("search_space")
    found = F.col("incumbent").isNotNull()
    status = (
        F.when(F.col("rejection").isNotNull(), REJECTED)
        .when(complete & found, OPTIMAL).when(complete, INFEASIBLE).otherwise(LIMITED)
    )
    limited = F.concat(
        F.lit(f"Stopped after deterministic evaluation limit {config.maximum_evaluations} of "),
        F.col("search_space"), F.lit(" plans; no optimality claim is issued."),
    )
    optimal = F.col("status") == OPTIMAL
    return rows.withColumn("status", status).select(
        "problem_id", "status", "search_space", "evaluated_plans", "feasible_plans",
        F.least(F.col("evaluated_plans"), F.lit(config.retained)).alias("retained_plans"),
        complete.alias("enumeration_complete"), "theoretical_upper_bound",
        F.col("incumbent.objective_value").alias("incumbent_objective"),
        F.when(optimal, F.lit(0.0)).alias("optimality_gap"),
        F.when(optimal, F.col("incumbent.plan_id")).alias("selected_plan_id"),
        F.when(optimal, portable(F.col("incumbent.objective_value") - F.col("baseline_objective")))
        .alias("change_from_baseline"),
        F.coalesce(
            F.col("rejection"),
            F.when(F.col("status") == INFEASIBLE, NO_FEASIBLE).when(F.col("status") == LIMITED, limited),
        ).alias("failure_reason"),
    )


def conservative_plan(plans: DataFrame, runs: DataFrame, share: float = 0.55) -> DataFrame:
    """Feasible plan, other than the selected, nearest to a share of the selected objective."""
    target = runs.filter(F.col("status") == OPTIMAL).select(
        "problem_id", "selected_plan_id", (F.col("incumbent_objective") * share).alias("_target")
    )
    near = plans.filter("feasible").join(target, "problem_id").filter(
        F.col("plan_id") != F.col("selected_plan_id")
    )
    key = F.struct(
        F.abs(F.col("objective_value") - F.col("_target")).alias("d"), F.col("total_cost"), F.col("plan_id")
    )
    return near.groupBy("problem_id").agg(
        F.min_by(
            F.struct(
                "plan_id", "objective_value", "total_cost", "selected_action_count", "binding_constraints"
            ), key
        ).alias("conservative")
    )
