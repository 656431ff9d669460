"""Gated difference-in-differences over many studies at once.

Input panel: ``study_id, unit_id, period INT, outcome DOUBLE, treated BOOLEAN``. Everything is a
partial aggregate keyed by (study, unit) or (study, period), so one study may hold most rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import reasons, two_sided_p

PASSED, INSUFFICIENT, REJECTED = "identification-passed", "insufficient-evidence", "rejected"
# Diagnostic names in the order they are reported.
DIAGNOSTICS = (
    "treated-unit-count", "comparison-unit-count", "pre-period-count", "post-period-count",
    "balanced-panel", "pretrend-slope-equivalence", "placebo-effect-equivalence",
)
DESIGN = DIAGNOSTICS[:5]


@dataclass(frozen=True)
class DidConfig:
    intervention_period: int
    slope_margin: float
    placebo_margin: float
    min_units: int = 5
    min_pre: int = 4
    min_post: int = 2
    confidence: float = 0.95

    def __post_init__(self):
        if self.min_units < 2 or self.min_pre < 3 or self.min_post < 1:
            raise ValueError("min_units >= 2, min_pre >= 3 and min_post >= 1 are required")
        if not 0.5 < self.confidence < 0.999 or min(self.slope_margin, self.placebo_margin) <= 0:
            raise ValueError("confidence or equivalence margins are out of range")

    @property
    def critical(self) -> float:
        return NormalDist().inv_cdf(0.5 + self.confidence / 2)


def _cells(panel: DataFrame) -> DataFrame:
    """One row per unit and period; copies are counted, not kept."""
    return panel.groupBy("study_id", "unit_id", "period").agg(
        F.count("*").alias("copies"),
        F.min(F.col("outcome").cast("double")).alias("outcome"),
        F.bool_and("treated").alias("all_treated"),
        F.bool_or("treated").alias("any_treated"),
    )


def _unit_cells(panel: DataFrame, config: DidConfig) -> DataFrame:
    """Cells with their unit's pre-period mean and first pre-period outcome (a unit's own periods)."""
    unit = W.partitionBy("study_id", "unit_id")
    pre = F.col("period") < config.intervention_period
    return _cells(panel).withColumns({
        "is_pre": pre,
        "pre_mean": F.avg(F.when(pre, F.col("outcome"))).over(unit),
        "first_pre": F.min(F.when(pre, F.col("period"))).over(unit),
        "base": F.min_by(
            F.when(pre, F.col("outcome")), F.when(pre, F.col("period"))
        ).over(unit),
    })


def _units(cells: DataFrame) -> DataFrame:
    pre = F.col("is_pre")
    return cells.groupBy("study_id", "unit_id").agg(
        F.bool_or("any_treated").alias("treated"),
        (F.bool_or("any_treated") & ~F.bool_and("all_treated")).alias("mixed"),
        F.max("copies").alias("copies"),
        F.count("*").alias("periods"),
        F.sum("copies").alias("observations"),
        F.first("pre_mean").alias("pre_mean"),
        F.avg(F.when(~pre, F.col("outcome"))).alias("post_mean"),
        F.regr_slope(F.when(pre, F.col("outcome")), F.when(pre, F.col("period"))).alias("slope"),
    )


def _studies(cells: DataFrame, units: DataFrame, config: DidConfig) -> DataFrame:
    periods = (
        cells.groupBy("study_id", "period").agg(F.first("is_pre").alias("is_pre"))
        .groupBy("study_id")
        .agg(
            F.count_if("is_pre").alias("pre_periods"),
            F.count_if(~F.col("is_pre")).alias("post_periods"),
            F.max("period").alias("data_cutoff_period"),
        )
    )
    shape = units.groupBy("study_id").agg(
        F.count_if("treated").alias("treated_units"),
        F.count_if(~F.col("treated")).alias("comparison_units"),
        F.min("periods").alias("fewest_periods"),
        F.sum("observations").alias("observation_count"),
        F.max("copies").alias("copies"),
        F.count_if("mixed").alias("mixed_units"),
    )
    total = F.col("pre_periods") + F.col("post_periods")
    return shape.join(periods, "study_id").withColumns({
        "balanced": F.col("fewest_periods") == total,
        "rejection": F.when(F.col("copies") > 1, "panel unit-period keys must be unique").when(
            F.col("mixed_units") > 0, "treatment-group assignment must be constant within unit"
        ),
    })


def _design(config: DidConfig) -> list[tuple[str, Column, Column, Column]]:
    """(id, passed, measured, threshold) of the five design checks."""
    def counted(name: str, column: str, least: int):
        value = F.col(column)
        return (name, value >= least, value.cast("string"), F.lit(f">={least}"))

    return [
        counted("treated-unit-count", "treated_units", config.min_units),
        counted("comparison-unit-count", "comparison_units", config.min_units),
        counted("pre-period-count", "pre_periods", config.min_pre),
        counted("post-period-count", "post_periods", config.min_post),
        ("balanced-panel", F.col("balanced"), F.col("balanced").cast("string"), F.lit("true")),
    ]


def check_panel(panel: DataFrame) -> DataFrame:
    """Studies whose unit-period keys repeat or whose units change group, with the reason."""
    cells = _cells(panel)
    units = cells.groupBy("study_id", "unit_id").agg(
        F.max("copies").alias("copies"),
        (F.bool_or("any_treated") & ~F.bool_and("all_treated")).alias("mixed"),
    )
    per_study = units.groupBy("study_id").agg(
        F.count_if(F.col("copies") > 1).alias("units_with_repeats"),
        F.count_if("mixed").alias("mixed_units"),
    )
    return per_study.withColumn("issues", reasons(
        (F.col("units_with_repeats") > 0, "panel unit-period keys must be unique"),
        (F.col("mixed_units") > 0, "treatment-group assignment must be constant within unit"),
    ))


def contrast(changes: DataFrame, keys: list[str], config: DidConfig) -> DataFrame:
    """Two-group contrast of ``change`` by ``treated``: effect, Welch-type error, interval, p."""
    t, c = F.col("treated"), ~F.col("treated")
    value = F.col("change")
    stats = changes.groupBy(*keys).agg(
        F.count_if(t).alias("treated_units"),
        F.count_if(c).alias("comparison_units"),
        F.avg(F.when(t, value)).alias("_mt"),
        F.avg(F.when(c, value)).alias("_mc"),
        F.var_samp(F.when(t, value)).alias("_vt"),
        F.var_samp(F.when(c, value)).alias("_vc"),
    ).filter((F.col("treated_units") >= 2) & (F.col("comparison_units") >= 2))
    effect = F.col("_mt") - F.col("_mc")
    error = F.sqrt(F.col("_vt") / F.col("treated_units") + F.col("_vc") / F.col("comparison_units"))
    flat = F.col("standard_error") == 0
    scored = stats.withColumn("estimate", effect).withColumn("standard_error", error).withColumn(
        "_z", F.when(~flat, F.col("estimate") / F.col("standard_error"))
    )
    z = F.lit(config.critical)
    return scored.select(
        *keys, "estimate", "standard_error",
        (F.col("estimate") - z * F.col("standard_error")).alias("lower"),
        (F.col("estimate") + z * F.col("standard_error")).alias("upper"),
        F.when(flat, F.when(F.col("estimate") == 0, 1.0).otherwise(0.0))
        .otherwise(two_sided_p(F.col("_z"))).alias("p_value"),
        "treated_units", "comparison_units",
    )


def _sound(studies: DataFrame, config: DidConfig) -> DataFrame:
    """Studies that clear the design checks, the only ones whose effects are estimated."""
    passed = F.col("rejection").isNull()
    for _, ok, _, _ in _design(config):
        passed = passed & ok
    return studies.filter(passed).select("study_id")


def _effects(cells: DataFrame, units: DataFrame, studies: DataFrame, config: DidConfig) -> DataFrame:
    keep = _sound(studies, config)
    period, outcome = F.col("period"), F.col("outcome")
    by_period = cells.filter(~F.col("is_pre") | (period > F.col("first_pre"))).select(
        "study_id",
        F.when(F.col("is_pre"), "placebo").otherwise("event").alias("kind"),
        period.alias("calendar_period"),
        F.col("any_treated").alias("treated"),
        F.when(F.col("is_pre"), outcome - F.col("base")).otherwise(outcome - F.col("pre_mean"))
        .alias("change"),
    )
    per_unit = units.select(
        "study_id",
        F.explode(F.array(
            F.struct(F.lit("pretrend").alias("kind"), F.col("slope").alias("change")),
            F.struct(F.lit("primary").alias("kind"), (F.col("post_mean") - F.col("pre_mean")).alias("change")),
        )).alias("_e"),
        "treated",
    ).select(
        "study_id", "_e.kind", F.lit(None).cast("int").alias("calendar_period"), "treated", "_e.change"
    )
    changes = by_period.unionByName(per_unit).join(keep, "study_id", "left_semi")
    return contrast(changes, ["study_id", "kind", "calendar_period"], config).withColumn(
        "relative_period", F.col("calendar_period") - config.intervention_period
    )


def did_effects(panel: DataFrame, config: DidConfig) -> DataFrame:
    """Pre-trend, placebo, event-time and primary effects of every sound study, long."""
    cells = _unit_cells(panel, config)
    units = _units(cells)
    return _effects(cells, units, _studies(cells, units, config), config)


def did(panel: DataFrame, config: DidConfig) -> DataFrame:
    """One run per study: status, evidence type, diagnostics, effects, reason.

    A failed design keeps no effects; a failed equivalence check keeps them, typed as estimates.
    """
    cells = _unit_cells(panel, config)
    units = _units(cells)
    studies = _studies(cells, units, config)
    effects = _effects(cells, units, studies, config)
    reach = F.abs("estimate") + F.lit(config.critical) * F.col("standard_error")
    inside = (F.col("lower") > -config.slope_margin) & (F.col("upper") < config.slope_margin)
    effect = F.struct(
        "calendar_period", "relative_period", "estimate", "standard_error", "lower", "upper", "p_value"
    )
    by_study = effects.groupBy("study_id").agg(
        F.max(F.when(F.col("kind") == "pretrend", reach)).alias("slope_reach"),
        F.bool_and(F.when(F.col("kind") == "pretrend", inside)).alias("slope_inside"),
        F.max(F.when(F.col("kind") == "placebo", reach)).alias("placebo_reach"),
        F.max(F.when(F.col("kind") == "primary", effect)).alias("primary_effect"),
        # one entry per period of the study
        F.sort_array(F.collect_list(F.when(F.col("kind") == "event", effect))).alias("event_effects"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "placebo", effect))).alias("placebo_effects"),
    )
    rows = studies.join(by_study, "study_id", "left")
    checks = [
        F.struct(F.lit(name).alias("id"), ok.alias("passed"), m.alias("measured"), t.alias("threshold"))
        for name, ok, m, t in _design(config)
    ]
    identification = [
        F.struct(
            F.lit("pretrend-slope-equivalence").alias("id"), F.col("slope_inside").alias("passed"),
            F.col("slope_reach").cast("string").alias("measured"),
            F.lit(f"<{config.slope_margin}").alias("threshold"),
        ),
        F.struct(
            F.lit("placebo-effect-equivalence").alias("id"),
            (F.col("placebo_reach") < config.placebo_margin).alias("passed"),
            F.col("placebo_reach").cast("string").alias("measured"),
            F.lit(f"<{config.placebo_margin}").alias("threshold"),
        ),
    ]
    estimated = F.col("slope_reach").isNotNull()
    diagnostics = F.when(estimated, F.array(*checks, *identification)).otherwise(F.array(*checks))
    failed = F.transform(
        F.filter("diagnostics", lambda d: ~d["passed"]), lambda d: d["id"]
    )
    ok = F.col("rejection").isNull() & (F.size("failed_ids") == 0)
    status = F.when(F.col("rejection").isNotNull(), REJECTED).when(ok, PASSED).otherwise(INSUFFICIENT)
    reason = F.coalesce(
        F.col("rejection"),
        F.when(
            ~ok,
            F.concat(
                F.when(estimated, "Identification diagnostics failed: ").otherwise(
                    "Required design diagnostics failed: "
                ),
                F.array_join("failed_ids", ", "), F.lit("."),
            ),
        ),
    )
    return (
        rows.withColumn("diagnostics", diagnostics)
        .withColumn("failed_ids", failed)
        .withColumn("status", status)
        .select(
            "study_id", "status",
            F.when(F.col("status") == PASSED, "causal").otherwise("estimated").alias("evidence_type"),
            (F.col("status") == PASSED).alias("causal_claim_issued"),
            reason.alias("failure_reason"), "observation_count",
            (F.col("treated_units") + F.col("comparison_units")).alias("unit_count"),
            "pre_periods", "post_periods", "data_cutoff_period", "diagnostics",
            "primary_effect", "event_effects", "placebo_effects",
        )
    )


def diagnostics_long(runs: DataFrame) -> DataFrame:
    return runs.select("study_id", F.explode("diagnostics").alias("d")).select("study_id", "d.*")
