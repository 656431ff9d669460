"""Draw tables: outcome scoring, summaries, sensitivity, and paired option uncertainty.

Draws are a table; nothing here generates random numbers. Parameter draws are
``run_id, draw, parameter_id, value``; option draws are ``run_id, option_id, draw, value,
evidence_type``. A run may hold any number of draws.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions import merkle
from tessera.functions.hashing import PREFIX
from tessera.functions.ranking import exact_quantiles
from tessera.functions.scalar import clamp, portable
from tessera.session import SMALL_ROWS, durable, sized, spread_join

COVERAGE_REASON = "Simulation parameters do not exactly cover the model terms."
TWO_OPTIONS = "At least two option draw streams are required for uncertainty comparison."
PAIRED = "Paired uncertainty analysis requires aligned draw counts for every option."
INDEPENDENT = "Independent unequal-length summaries cannot estimate joint best-option probabilities."


def _parameter_sets(draws: DataFrame) -> DataFrame:
    """Draw count of every parameter, the run's inventory (partial aggregation keeps it small)."""
    return draws.groupBy("run_id", "parameter_id").agg(F.count("*").alias("draws"))


def coverage(draws: DataFrame, terms: DataFrame) -> DataFrame:
    """Per run: whether the drawn parameters are exactly the model's terms, equally often."""
    return _covered(_parameter_sets(draws), terms)


def _covered(have: DataFrame, terms: DataFrame) -> DataFrame:
    both = have.join(
        terms.select("run_id", "parameter_id", F.lit(True).alias("declared")),
        ["run_id", "parameter_id"], "full_outer",
    )
    per_run = both.groupBy("run_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("draws").isNull(), F.col("parameter_id")))).alias("missing"),
        F.sort_array(F.collect_set(F.when(F.col("declared").isNull(), F.col("parameter_id")))).alias("undeclared"),
        F.count_distinct("draws").alias("_lengths"),
        F.max("draws").alias("draws"),
    )
    exact = (F.size("missing") == 0) & (F.size("undeclared") == 0) & (F.col("_lengths") == 1)
    return per_run.select(
        "run_id", "draws", "missing", "undeclared",
        F.when(exact, "completed").otherwise("insufficient-evidence").alias("status"),
        F.when(~exact, F.lit(COVERAGE_REASON)).alias("failure_reason"),
    )


def score_draws(
    draws: DataFrame, terms: DataFrame, models: DataFrame, digits: int | None = None
) -> DataFrame:
    """Bounded linear outcome of every draw of every completed run.

    A run may hold most of the draws, so tables with a row for each run or term are never joined by the run alone.
    """
    have = durable(_parameter_sets(draws))
    usable = durable(_covered(have, terms).filter("status = 'completed'").select("run_id"))
    rows = have.agg(F.sum("draws")).first()[0] or 0
    weights = terms.select("run_id", "parameter_id", "coefficient").join(usable, "run_id", "left_semi")
    weighted = spread_join(draws, weights, ["run_id", "parameter_id"], "draw").select(
        "run_id", "draw", (F.col("coefficient") * F.col("value")).alias("_term")
    )
    summed = sized(weighted, ["run_id", "draw"], rows).groupBy("run_id", "draw").agg(F.sum("_term").alias("_linear"))
    outcome = clamp(
        F.col("intercept") + F.col("_linear"), F.col("floor"), F.col("ceiling")
    )
    if digits is not None:
        outcome = portable(outcome, digits)
    bounds = models.select("run_id", "intercept", "floor", "ceiling").join(usable, "run_id", "left_semi")
    return spread_join(summed, bounds, ["run_id"], "draw").select("run_id", "draw", outcome.alias("outcome"))


def draw_summary(
    outcomes: DataFrame, threshold: float | None = None, at_least: bool = True
) -> DataFrame:
    """Mean, sample deviation, bounds and inclusive threshold probability per run."""
    value = F.col("outcome")
    hit = (value >= threshold) if at_least else (value <= threshold)
    probability = (
        F.avg(hit.cast("double")) if threshold is not None else F.lit(None).cast("double")
    )
    return outcomes.groupBy("run_id").agg(
        F.count("*").alias("draws"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("standard_deviation"),
        F.min(value).alias("minimum"),
        F.max(value).alias("maximum"),
        probability.alias("threshold_probability"),
    )


def draw_quantiles(outcomes: DataFrame, probabilities: Sequence[float]) -> DataFrame:
    return exact_quantiles(outcomes, ["run_id"], "outcome", probabilities)


def sensitivity(draws: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pearson correlation of each parameter with the outcome and its rank by magnitude.

    A constant on either side gives zero, where the built-in correlation would fail.
    """
    x, y = F.col("value"), F.col("outcome")
    scale = F.stddev_pop(x) * F.stddev_pop(y)
    correlated = (
        draws.join(outcomes, ["run_id", "draw"])
        .groupBy("run_id", "parameter_id")
        .agg(F.coalesce(F.covar_pop(x, y) / F.nullif(scale, F.lit(0.0)), F.lit(0.0)).alias("_r"))
        .withColumn("correlation", portable(F.col("_r")))
        .drop("_r")
    )
    order = W.partitionBy("run_id").orderBy(F.desc(F.abs("correlation")), "parameter_id")
    return correlated.withColumn("absolute_rank", F.row_number().over(order))


def draw_prefix(draws: DataFrame, outcomes: DataFrame, count: int) -> DataFrame:
    """The first draws of each run with their parameters as one map, for replay inspection."""
    kept = draws.filter(F.col("draw") < count)
    parameters = kept.groupBy("run_id", "draw").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("parameter_id", "value"))))
        .alias("parameters")
    )
    return parameters.join(outcomes, ["run_id", "draw"])


#: Positions of draws in a leaf of the stream's hash tree, digits of a hashed value, and the key of an outcome's record.
DRAWS_PER_LEAF = 64
DIGITS = 12
OUTCOME = "=outcome"


def draws_hash(draws: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(run_id, draw_stream_hash): hash of a run's records in the order of their draws and parameters.

    A leaf of the tree holds ``DRAWS_PER_LEAF`` consecutive draws, so a run may have any length. Values count with
    twelve digits. Records are shuffled once, as values; :func:`scored_hash` scores draws that it hashes.
    """
    records = draws.select("run_id", "draw", F.col("parameter_id").alias("key"), F.col("value").cast("double").alias("value")).unionByName(
        outcomes.select("run_id", "draw", F.lit(OUTCOME).alias("key"), F.col("outcome").cast("double").alias("value"))
    )
    rows, levels = merkle.dealt(records, ["run_id"], F.col("draw"), DRAWS_PER_LEAF)
    packed = rows.groupBy("run_id", "branch", "draw").agg(F.collect_list(record(F.col("key"), F.col("value"))).alias("records"))
    return _rooted(merkle.branches(_leaves(packed), ["run_id"], levels), levels)


def draw_leaves(draws: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Leaves of the hash tree of each run, for :func:`tessera.functions.merkle.differing_slots`."""
    records = draws.select("run_id", "draw", F.col("parameter_id").alias("key"), _text(F.col("value")).alias("text")).unionByName(
        outcomes.select("run_id", "draw", F.lit(OUTCOME).alias("key"), _text(F.col("outcome")).alias("text"))
    )
    line = F.concat_ws("/", "draw", "key", "text")
    return merkle.ordered_leaves(records, ["run_id"], F.col("draw"), ["draw", "key"], line, DRAWS_PER_LEAF)


def _text(value: Column) -> Column:
    # adding 0.0 turns a negative zero into zero
    return F.format_string(f"%.{DIGITS - 1}e", value.cast("double") + F.lit(0.0))


def record(key: Column, value: Column) -> Column:
    """(key, hash, value) of one value of the row's ``draw``, as its run's stream hashes it."""
    line = F.concat_ws("/", F.col("draw"), key, _text(value))
    return F.struct(key.alias("key"), merkle.sha(line).alias("hash"), value.cast("double").alias("value"))


def scored_hash(packed: DataFrame, levels: int, terms: DataFrame, models: DataFrame, digits: int | None = None) -> DataFrame:
    """:func:`draws_hash` of draws and of the outcomes that :func:`score_draws` gives them, in one pass over the draws.

    ``packed`` has one row for each draw, ``run_id, branch, draw, parameters`` (an array of :func:`record`), dealt by
    :func:`tessera.functions.merkle.dealt` with these ``levels``. A run is completed if each of its draws has each term
    once, without nulls, so such draws are scored where they stand, terms added in the order of the array. Runs
    in which any draw differs are scored and hashed anew by the general way, which counts first.
    """
    weights = terms.groupBy("run_id").agg(
        F.sort_array(F.collect_list("parameter_id")).alias("_ids"),
        F.collect_list(F.struct("parameter_id", "coefficient")).alias("_terms"),
        F.count("coefficient").alias("_coefficients"),
    )
    sound = (F.size(F.array_distinct("_ids")) == F.size("_terms")) & (F.col("_coefficients") == F.size("_terms"))
    bounds = models.groupBy("run_id").agg(
        F.count("*").alias("_models"), *[F.first(c).alias(c) for c in ("intercept", "floor", "ceiling")]
    ).filter("_models = 1")
    known = weights.join(bounds, "run_id").select(
        "run_id", "_ids", F.when(sound, F.map_from_entries("_terms")).alias("_weights"), "intercept", "floor", "ceiling"
    )
    linear = F.aggregate("parameters", F.col("intercept").cast("double"), lambda total, p: (
        total + F.try_element_at("_weights", p["key"]).cast("double") * p["value"]))
    outcome = clamp(F.col("_linear"), F.col("floor"), F.col("ceiling"))
    if digits is not None and digits != DIGITS:  # rounding to the digits of the text leaves the text as it is
        outcome = portable(outcome, digits)
    scored = spread_join(packed, known, ["run_id"], "draw", how="left").withColumn("_linear", linear).select(
        "run_id", "branch", "draw",
        F.concat("parameters", F.array(record(F.lit(OUTCOME), outcome))).alias("records"),
        F.coalesce(F.col("_linear").isNotNull() & (F.sort_array(F.col("parameters")["key"]) == F.col("_ids")), F.lit(False)).alias("exact"),
    )
    tops = durable(merkle.branches(_leaves(scored, "exact"), ["run_id"], levels, ["exact"]))
    runs = durable(tops.groupBy(F.col("run_id").alias("_run")).agg(F.bool_and("exact").alias("exact")))
    same = F.col("run_id").eqNullSafe(F.col("_run"))
    hashed = _rooted(tops.join(runs.filter("exact"), same, "left_semi"), levels)
    rest = runs.filter("not exact")
    found = rest.count()
    if not found:
        return hashed
    again = packed.join(F.broadcast(rest) if found <= SMALL_ROWS else rest, same, "left_semi").select(
        "run_id", "draw", F.explode("parameters").alias("p")
    ).select("run_id", "draw", F.col("p.key").alias("parameter_id"), "p.value")
    return hashed.unionByName(draws_hash(again, score_draws(again, terms, models, digits)))


def _leaves(packed: DataFrame, *flags: str) -> DataFrame:
    """(run_id, branch, slot, hash, rows, flags): leaves over dealt draws that hold their records as an array."""
    rows = packed.select(
        "run_id", "branch", merkle.slot_at(F.col("draw"), DRAWS_PER_LEAF).alias("slot"), "draw",
        F.array_join(F.sort_array("records")["hash"], ",").alias("_hashes"), F.size("records").cast("long").alias("rows"), *flags,
    )
    return merkle.gathered(rows, ["run_id", "branch", "slot"], "draw", F.col("_hashes"), flags)


def _rooted(tops: DataFrame, levels: int) -> DataFrame:
    return merkle.roots(tops.select("run_id", "slot", "hash", "rows"), ["run_id"], merkle.ORDERED_LEVELS - levels).select(
        "run_id", F.concat(F.lit(PREFIX), "hash").alias("draw_stream_hash")
    )


@dataclass(frozen=True)
class OptionConfig:
    maximize: bool = True
    confidence: float = 0.95
    margin: float = 0.0
    robust_threshold: float = 0.90
    max_regret: float | None = None
    paired: bool = True

    def __post_init__(self):
        if not 0.5 < self.confidence < 0.999 or self.margin < 0:
            raise ValueError("confidence or margin is out of range")
        if not 0.5 < self.robust_threshold <= 1:
            raise ValueError("robust_threshold must lie in (0.5, 1]")

    @property
    def sign(self) -> int:
        return 1 if self.maximize else -1

    def better(self, left: Column, right: Column) -> Column:
        """Whether ``left`` beats ``right`` by more than the margin."""
        if self.maximize:
            return left > right + self.margin
        return left < right - self.margin


def _clean(options: DataFrame) -> DataFrame:
    """One row per (run, option, draw); repeated keys are counted so that they can be refused."""
    return options.groupBy("run_id", "option_id", "draw").agg(
        F.first("value").alias("value"),
        F.count("*").alias("copies"),
        F.bool_or(F.col("evidence_type") == "simulated").alias("simulated"),
    )


def check_draws(options: DataFrame, config: OptionConfig = OptionConfig()) -> DataFrame:
    """Status of each run before any comparison: options, equal draw counts, unique keys."""
    return _gate(_clean(options), config)


def _gate(clean: DataFrame, config: OptionConfig) -> DataFrame:
    per_option = clean.groupBy("run_id", "option_id").agg(
        F.count("*").alias("n"),
        F.max("copies").alias("copies"),
        F.bool_or("simulated").alias("simulated"),
    )
    per_run = per_option.groupBy("run_id").agg(
        F.count("*").alias("options"),
        F.min("n").alias("draws"),
        F.max("n").alias("_most"),
        F.max("copies").alias("copies"),
        F.bool_or("simulated").alias("_simulated"),
    )
    unequal = F.col("draws") != F.col("_most")
    reason = (
        F.when(F.col("options") < 2, F.lit(TWO_OPTIONS))
        .when(F.col("copies") > 1, F.lit("Option draw keys must be unique."))
        .when(unequal, F.lit(PAIRED if config.paired else INDEPENDENT))
    )
    return per_run.withColumn("failure_reason", reason).select(
        "run_id", "options", "draws",
        F.when(F.col("failure_reason").isNotNull(), "insufficient-evidence").otherwise("comparable")
        .alias("status"),
        "failure_reason",
        F.when(
            F.lit(not config.paired) & unequal & (F.col("options") >= 2), "independent-summaries"
        ).otherwise("paired-draws").alias("method"),
        F.when(F.col("_simulated") & F.col("failure_reason").isNull(), "simulated")
        .otherwise("estimated").alias("evidence_type"),
    )


def _aligned(clean: DataFrame, gate: DataFrame) -> DataFrame:
    """One row per draw of a comparable run with its options as a sorted array.

    An array holds one entry per option of the run, so its size does not grow with the data.
    """
    usable = gate.filter("status = 'comparable'").select("run_id")
    return (
        clean.join(usable, "run_id", "left_semi")
        .groupBy("run_id", "draw")
        .agg(F.sort_array(F.collect_list(F.struct("option_id", "value"))).alias("o"))
    )


def _option_rows(aligned: DataFrame, config: OptionConfig) -> DataFrame:
    values = F.transform("o", lambda x: x["value"])
    best = F.array_max(values) if config.maximize else F.array_min(values)
    rows = aligned.withColumn("_best", best).withColumn(
        "_ties", F.size(F.filter("o", lambda x: x["value"] == F.col("_best")))
    )
    entry = F.explode(
        F.transform(
            "o",
            lambda x: F.struct(
                x["option_id"].alias("option_id"),
                x["value"].alias("value"),
                F.when(x["value"] == F.col("_best"), 1 / F.col("_ties")).otherwise(0.0).alias("share"),
                (config.sign * (F.col("_best") - x["value"])).alias("regret"),
                config.better(F.col("_best"), x["value"]).cast("double").alias("dominated"),
            ),
        )
    )
    return rows.select("run_id", "draw", entry.alias("e")).select("run_id", "draw", "e.*")


def _summary(aligned: DataFrame, config: OptionConfig) -> DataFrame:
    rows = _option_rows(aligned, config)
    core = rows.groupBy("run_id", "option_id").agg(
        F.count("*").alias("draws"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("standard_deviation"),
        (F.sum("share") / F.count("*")).alias("probability_best"),
        F.avg("regret").alias("expected_regret"),
        F.max("regret").alias("maximum_regret"),
        F.avg("dominated").alias("dominated_probability"),
    )
    alpha = 1 - config.confidence
    bounds = exact_quantiles(
        rows, ["run_id", "option_id"], "value", [alpha / 2, 1 - alpha / 2]
    ).groupBy("run_id", "option_id").agg(
        F.min_by("quantile", "probability").alias("lower"),
        F.max_by("quantile", "probability").alias("upper"),
    )
    return core.join(bounds, ["run_id", "option_id"])


def option_summary(options: DataFrame, config: OptionConfig = OptionConfig()) -> DataFrame:
    """Per option: mean, deviation, interval, P(best) with shared ties, regret, domination."""
    clean = _clean(options)
    return _summary(_aligned(clean, _gate(clean, config)), config)


def _ordered_pairs(aligned: DataFrame, config: OptionConfig) -> DataFrame:
    """Both directions of every option pair, aggregated over draws.

    The pairs of one draw are generated next to a partial aggregate keyed by the pair, so what is
    shuffled is one row per task and pair of options, not one per draw.
    """
    pairs = F.explode(
        F.flatten(
            F.transform(
                "o",
                lambda a: F.transform(
                    F.filter("o", lambda b: b["option_id"] != a["option_id"]),
                    lambda b: F.struct(
                        a["option_id"].alias("option_a"), b["option_id"].alias("option_b"),
                        config.better(a["value"], b["value"]).alias("better"),
                        (config.sign * (a["value"] - b["value"])).alias("difference"),
                    ),
                ),
            )
        )
    )
    rows = aligned.select("run_id", "draw", pairs.alias("p")).select("run_id", "draw", "p.*")
    return rows.groupBy("run_id", "option_a", "option_b").agg(
        F.avg(F.col("better").cast("double")).alias("probability_a_better"),
        F.avg("difference").alias("mean_difference"),
        F.min(F.when(F.col("better"), F.col("draw"))).alias("first_draw"),
    )


def pairwise_dominance(options: DataFrame, config: OptionConfig = OptionConfig()) -> DataFrame:
    """Every unordered option pair: P(first better by the margin) and the mean signed difference."""
    clean = _clean(options)
    pairs = _ordered_pairs(_aligned(clean, _gate(clean, config)), config)
    return pairs.filter(F.col("option_a") < F.col("option_b")).drop("first_draw")


def _baselines(summary: DataFrame, config: OptionConfig, baseline: str | None) -> DataFrame:
    best_mean = F.min_by(
        F.col("option_id"), F.struct((-config.sign * F.col("mean")).alias("m"), F.col("option_id"))
    )
    given = F.max(F.when(F.col("option_id") == F.lit(baseline), F.col("option_id")))
    pick = best_mean if baseline is None else given
    return summary.groupBy("run_id").agg(pick.alias("baseline_option_id"))


def reversals(
    options: DataFrame, config: OptionConfig = OptionConfig(), baseline: str | None = None
) -> DataFrame:
    """How often, and first when, each competitor beats the baseline option."""
    clean = _clean(options)
    aligned = _aligned(clean, _gate(clean, config))
    base = _baselines(_means(aligned), config, baseline)
    return _reversals(_ordered_pairs(aligned, config), base)


def _means(aligned: DataFrame) -> DataFrame:
    rows = aligned.select("run_id", F.explode("o").alias("x"))
    return rows.groupBy("run_id", F.col("x.option_id").alias("option_id")).agg(
        F.avg("x.value").alias("mean")
    )


def _reversals(pairs: DataFrame, base: DataFrame) -> DataFrame:
    return pairs.join(
        base.withColumnRenamed("baseline_option_id", "option_b"), ["run_id", "option_b"]
    ).select(
        "run_id",
        F.col("option_b").alias("baseline_option_id"),
        F.col("option_a").alias("competing_option_id"),
        F.col("probability_a_better").alias("reversal_probability"),
        F.col("first_draw").alias("first_reversal_draw"),
    )


def option_decision(
    options: DataFrame, config: OptionConfig = OptionConfig(), baseline: str | None = None
) -> DataFrame:
    """One row per run: status, baseline, selected option and why.

    Selection order is P(best), then expected regret, then id. A baseline that does not exist
    leaves the run without a comparison.
    """
    clean = _clean(options)
    gate = _gate(clean, config)
    summary = _summary(_aligned(clean, gate), config)
    order = F.struct(
        (-F.col("probability_best")).alias("p"), F.col("expected_regret"), F.col("option_id")
    )
    chosen = summary.groupBy("run_id").agg(
        F.min_by(F.struct("option_id", "probability_best", "expected_regret"), order).alias("s")
    )
    base = _baselines(summary, config, baseline)
    rows = gate.join(chosen, "run_id", "left").join(base, "run_id", "left")
    lost = (F.col("status") == "comparable") & F.col("baseline_option_id").isNull()
    robust = F.col("s.probability_best") >= config.robust_threshold
    if config.max_regret is not None:
        robust = robust & (F.col("s.expected_regret") <= config.max_regret)
    usable = (F.col("status") == "comparable") & ~lost
    return rows.select(
        "run_id",
        F.when(~usable, "insufficient-evidence").when(robust, "robust-winner")
        .otherwise("reversal-risk").alias("status"),
        "method", "evidence_type", "options", "draws",
        F.when(usable, F.col("baseline_option_id")).alias("baseline_option_id"),
        F.when(usable, F.col("s.option_id")).alias("selected_option_id"),
        F.when(usable, F.col("s.probability_best")).alias("probability_best"),
        F.when(usable, F.col("s.expected_regret")).alias("expected_regret"),
        F.when(lost, F.lit("The baseline option does not exist in this run."))
        .otherwise(F.col("failure_reason")).alias("failure_reason"),
    )


def check_option_run(
    decisions: DataFrame, summary: DataFrame, pairs: DataFrame, reversed_: DataFrame
) -> DataFrame:
    """Output contract of each completed run: shares sum to one, pairs and reversals are complete."""
    shares = summary.groupBy("run_id").agg(
        F.count("*").alias("_options"), F.sum("probability_best").alias("_shares"),
        F.count_distinct("draws").alias("_lengths"),
    )
    paired = pairs.groupBy("run_id").agg(
        F.count("*").alias("_pairs"),
        F.count_distinct(F.sort_array(F.array("option_a", "option_b"))).alias("_distinct_pairs"),
    )
    moved = reversed_.groupBy("run_id").agg(
        F.count("*").alias("_reversals"),
        F.count_distinct("competing_option_id").alias("_competitors"),
    )
    n = F.col("_options")
    rows = (
        decisions.join(shares, "run_id", "left").join(paired, "run_id", "left")
        .join(moved, "run_id", "left")
    )
    negative = F.col("status") == "insufficient-evidence"
    checks = F.array_compact(F.array(
        F.when(negative & n.isNotNull(), F.lit("negative run emits results")),
        F.when(negative & F.col("failure_reason").isNull(), F.lit("negative run lacks a reason")),
        F.when(~negative & (F.abs(F.col("_shares") - 1) > 1e-9), F.lit("shares do not sum to one")),
        F.when(~negative & (F.col("_lengths") != 1), F.lit("draw counts are not aligned")),
        F.when(
            ~negative & ((F.col("_pairs") != n * (n - 1) / 2) | (F.col("_pairs") != F.col("_distinct_pairs"))),
            F.lit("pairs do not cover all options"),
        ),
        F.when(
            ~negative & ((F.col("_reversals") != n - 1) | (F.col("_competitors") != n - 1)),
            F.lit("reversals do not cover all competitors"),
        ),
    ))
    return rows.select("run_id", "status", checks.alias("issues"))
