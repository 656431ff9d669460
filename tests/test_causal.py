import pytest

from tessera.plans.causal import DidConfig, check_panel, did, diagnostics_long, did_effects

CFG = DidConfig(intervention_period=4, slope_margin=0.2, placebo_margin=0.5)


def panel(spark, change=None, units=6, drop=(), study="s", extra=()):
    rows = []
    for treated in (True, False):
        for u in range(units):
            for t in range(6):
                y = 10 + 0.4 * u + t + (3.0 if treated and t >= 4 else 0.0)
                if change:
                    y += change(treated, u, t)
                name = f"{'t' if treated else 'c'}{u}"
                if (name, t) not in drop:
                    rows.append((study, name, t, y, treated))
    return spark.createDataFrame(
        rows + list(extra), "study_id string, unit_id string, period int, outcome double, treated boolean"
    )


def test_passing_panel_is_causal(spark):
    run = did(panel(spark), CFG).collect()[0]
    assert run.status == "identification-passed" and run.evidence_type == "causal"
    assert run.primary_effect.estimate == pytest.approx(3.0)
    assert [e.relative_period for e in run.event_effects] == [0, 1]
    assert [e.calendar_period for e in run.placebo_effects] == [1, 2, 3]
    assert all(d.passed for d in run.diagnostics) and len(run.diagnostics) == 7
    assert run.failure_reason is None
    # identical changes in every unit: no error, so the p-value is 0 or 1
    assert run.primary_effect.p_value == pytest.approx(0.0)


def test_pretrend_keeps_estimate_without_claim(spark):
    df = panel(spark, lambda treated, u, t: min(t, 3) if treated else 0.0)
    run = did(df, CFG).collect()[0]
    assert run.status == "insufficient-evidence" and run.evidence_type == "estimated"
    assert run.primary_effect is not None and not run.causal_claim_issued
    assert "pretrend-slope-equivalence" in run.failure_reason


def test_design_failures_have_no_effects(spark):
    runs = did(panel(spark, drop={("t0", 2)}).unionByName(panel(spark, units=3, study="small")), CFG)
    by = {r.study_id: r for r in runs.collect()}
    assert "balanced-panel" in by["s"].failure_reason and by["s"].primary_effect is None
    assert "treated-unit-count, comparison-unit-count" in by["small"].failure_reason
    assert not by["small"].event_effects
    assert did_effects(panel(spark, units=3), CFG).count() == 0


def test_bad_keys_are_rejected_rows(spark):
    twice = panel(spark, extra=[("s", "t0", 1, 1.0, True)])
    mixed = panel(spark, study="m", drop={("t0", 1)}, extra=[("m", "t0", 1, 1.0, False)])
    by = {r.study_id: r for r in did(twice.unionByName(mixed), CFG).collect()}
    assert by["s"].status == by["m"].status == "rejected"
    assert "unique" in by["s"].failure_reason and "constant" in by["m"].failure_reason
    issues = {r.study_id: r.issues for r in check_panel(twice.unionByName(mixed)).collect()}
    assert len(issues["s"]) == 1 and len(issues["m"]) == 1


def test_zero_effect_without_error_has_p_one(spark):
    df = panel(spark, lambda treated, u, t: -3.0 if treated and t >= 4 else 0.0)
    run = did(df, CFG).collect()[0]
    assert run.primary_effect.standard_error == pytest.approx(0, abs=1e-12)
    assert run.primary_effect.p_value == 1.0


def test_interval_and_p_value_agree_with_normal_theory(spark):
    from statistics import NormalDist, fmean, variance
    df = panel(spark, lambda treated, u, t: (0.05 * ((u * 7 + t * 3) % 5) if treated else 0.04 * ((u + t) % 3)))
    run = did(df, CFG).collect()[0]
    data = {(r.unit_id, r.period): r.outcome for r in df.collect()}

    def changes(group):
        return [
            fmean(data[(f"{group}{u}", t)] for t in (4, 5)) - fmean(data[(f"{group}{u}", t)] for t in range(4))
            for u in range(6)
        ]
    a, b = changes("t"), changes("c")
    effect, se = fmean(a) - fmean(b), (variance(a) / 6 + variance(b) / 6) ** 0.5
    assert run.primary_effect.estimate == pytest.approx(effect)
    assert run.primary_effect.standard_error == pytest.approx(se)
    assert run.primary_effect.p_value == pytest.approx(2 * (1 - NormalDist().cdf(abs(effect / se))))
    assert diagnostics_long(did(df, CFG)).count() == 7


def test_config_is_checked():
    with pytest.raises(ValueError):
        DidConfig(1, 0.1, 0.1, min_pre=2)
