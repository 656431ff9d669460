import pytest
from pyspark.sql import functions as F

from tessera.functions.ranking import exact_quantiles, global_rank
from tessera.plans import draws as d


def options(spark, runs, evidence="simulated"):
    rows = [
        (run, option, i, float(v), evidence)
        for run, table in runs.items() for option, values in table.items() for i, v in enumerate(values)
    ]
    return spark.createDataFrame(
        rows, "run_id string, option_id string, draw int, value double, evidence_type string"
    )


def test_robust_winner(spark):
    df = options(spark, {"r": {"a": range(10, 15), "b": range(5, 10), "c": range(1, 6)}})
    cfg = d.OptionConfig(margin=0.5, max_regret=0.0)
    run = d.option_decision(df, cfg, "a").collect()[0]
    assert (run.status, run.selected_option_id, run.probability_best, run.expected_regret) == (
        "robust-winner", "a", 1.0, 0.0)
    pairs = d.pairwise_dominance(df, cfg)
    assert pairs.count() == 3
    checked = d.check_option_run(
        d.option_decision(df, cfg, "a"), d.option_summary(df, cfg), pairs, d.reversals(df, cfg, "a"))
    assert checked.collect()[0].issues == []


def test_crossing_streams_carry_reversal_risk(spark):
    df = options(spark, {"r": {"incumbent": [10, 2, 10, 2], "competitor": [2, 10, 2, 10]}})
    cfg = d.OptionConfig(robust_threshold=0.75)
    run = d.option_decision(df, cfg, "incumbent").collect()[0]
    assert (run.status, run.selected_option_id) == ("reversal-risk", "competitor")
    move = d.reversals(df, cfg, "incumbent").collect()[0]
    assert (move.reversal_probability, move.first_reversal_draw) == (0.5, 1)


def test_minimise_mirrors_everything(spark):
    df = options(spark, {"r": {"low": [1, 2, 1, 2], "high": [5, 6, 5, 6]}}, "estimated")
    cfg = d.OptionConfig(maximize=False)
    run = d.option_decision(df, cfg).collect()[0]
    assert (run.status, run.selected_option_id, run.evidence_type) == ("robust-winner", "low", "estimated")
    assert run.baseline_option_id == "low"


def test_negative_releases(spark):
    df = options(spark, {"one": {"a": [1, 2]}, "ragged": {"a": [1, 2], "b": [1, 2, 3]},
                         "tied": {"b": [1, 1], "a": [1, 1]}})
    runs = {r.run_id: r for r in d.option_decision(df).collect()}
    assert runs["one"].failure_reason == d.TWO_OPTIONS
    assert runs["ragged"].failure_reason == d.PAIRED and runs["ragged"].selected_option_id is None
    assert runs["tied"].selected_option_id == "a" and runs["tied"].probability_best == 0.5
    free = {r.run_id: r for r in d.check_draws(df, d.OptionConfig(paired=False)).collect()}
    assert free["ragged"].failure_reason == d.INDEPENDENT
    assert free["ragged"].method == "independent-summaries"
    assert d.option_summary(df).filter("run_id in ('one', 'ragged')").count() == 0


def parameters(spark):
    rows = [("r", i, p, v) for i, (a, b, c) in enumerate(
        [(1.0, 5.0, 0.0), (2.0, 3.0, 1.0), (4.0, 2.0, 0.0), (3.0, 3.5, 1.0), (9.0, 1.0, 1.0)])
        for p, v in (("exposure", a), ("protection", b), ("shock", c))]
    draws = spark.createDataFrame(rows, "run_id string, draw int, parameter_id string, value double")
    terms = spark.createDataFrame(
        [("r", "exposure", 2.0), ("r", "protection", -3.0), ("r", "shock", 10.0)],
        "run_id string, parameter_id string, coefficient double")
    models = spark.createDataFrame(
        [("r", 5.0, 0.0, 25.0)], "run_id string, intercept double, floor double, ceiling double")
    return draws, terms, models


def test_scoring_clamps_and_ranks(spark):
    draws, terms, models = parameters(spark)
    out = d.score_draws(draws, terms, models)
    values = {r.draw: r.outcome for r in out.collect()}
    assert values == {0: 0.0, 1: 10.0, 2: 7.0, 3: 10.5, 4: 25.0}
    ranks = {r.parameter_id: (r.correlation, r.absolute_rank) for r in d.sensitivity(draws, out).collect()}
    assert {v[1] for v in ranks.values()} == {1, 2, 3} and all(-1 <= v[0] <= 1 for v in ranks.values())
    s = d.draw_summary(out, threshold=10.0).collect()[0]
    assert (s.mean, s.minimum, s.maximum, s.threshold_probability) == (10.5, 0.0, 25.0, 0.6)
    assert d.draw_summary(out, 10.0, at_least=False).collect()[0].threshold_probability == 0.6
    assert d.draw_prefix(draws, out, 2).count() == 2
    first = d.draws_hash(draws, out).collect()[0].draw_stream_hash
    assert d.draws_hash(draws.repartition(3), out).collect()[0].draw_stream_hash == first
    changed = draws.withColumn("value", F.when(F.col("draw") == 3, 0.0).otherwise(F.col("value")))
    assert d.draws_hash(changed, out).collect()[0].draw_stream_hash != first


def test_uncovered_terms_are_insufficient(spark):
    draws, terms, models = parameters(spark)
    short = draws.filter("parameter_id <> 'shock'")
    row = d.coverage(short, terms).collect()[0]
    assert row.status == "insufficient-evidence" and row.missing == ["shock"]
    assert d.score_draws(short, terms, models).count() == 0


def test_constant_parameter_has_zero_correlation(spark):
    draws, terms, models = parameters(spark)
    flat = draws.withColumn("value", F.when(F.col("parameter_id") == "shock", 1.0).otherwise(F.col("value")))
    out = d.score_draws(flat, terms, models)
    assert {r.parameter_id: r.correlation for r in d.sensitivity(flat, out).collect()}["shock"] == 0.0


@pytest.mark.parametrize("values", [
    [5.0], [1.0, 2.0], [3.0] * 50 + [7.0], [float(i * i % 97) for i in range(500)],
    [-1e9, 0.0, 1e-9, 5.0, 1e12, -3.0],
])
def test_exact_quantiles_match_interpolation(spark, values):
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    probs = [0.0, 0.025, 0.3, 0.5, 0.975, 1.0]
    got = {r.probability: r.quantile for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    ordered = sorted(values)
    for p in probs:
        pos = (len(ordered) - 1) * p
        lo = int(pos)
        hi = min(lo + 1, len(ordered) - 1)
        assert got[p] == pytest.approx(ordered[lo] + (pos - lo) * (ordered[hi] - ordered[lo]))
    assert {r.probability: r.quantile for r in exact_quantiles(df, [], "v", probs).collect()} == got


def test_global_rank_is_contiguous_under_ties(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"),
        (F.col("id") % 2).alias("k"), "id")
    ranked = global_rank(df, ["g"], [F.desc("k"), F.col("id")], size_col="n").collect()
    for group in ("hot", "cold"):
        rows = sorted((r for r in ranked if r.g == group), key=lambda r: (-r.k, r.id))
        assert [r["rank"] for r in rows] == list(range(1, len(rows) + 1))
        assert {r.n for r in rows} == {len(rows)}


def test_no_run_meets_in_one_task(spark):
    """A run of nearly all draws is dealt over tasks, both where the tables of runs are broadcast and where they are too large."""
    from tessera import session

    large = spark.range(0, 40_000, 1, 4).select(
        F.when(F.col("id") < 39_000, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 5)).alias("run_id"), F.col("id").alias("draw"))
    small = large.select("run_id").distinct().withColumn("x", F.length("run_id"))
    expected = {(r.run_id, r.draw, len(r.run_id)) for r in large.collect()}
    conf = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(conf)
    spark.conf.set(conf, "false")
    try:
        for limit in (100, 0):
            joined = session.spread_join(large, small, ["run_id"], "draw", limit)
            assert {tuple(r) for r in joined.select("run_id", "draw", "x").collect()} == expected
            sizes = joined.groupBy(F.spark_partition_id()).count().collect()
            assert len(sizes) > 1 and max(r["count"] for r in sizes) < 20_000
    finally:
        spark.conf.set(conf, before)
    dealt = session.sized(large, ["run_id", "draw"], 40 * session.TASK_ROWS)
    assert dealt.rdd.getNumPartitions() == 41


def _general_hash(draws, outcomes):
    """Roots over leaves that are written first, as any two tables are compared."""
    from tessera.functions import merkle

    roots = merkle.roots(d.draw_leaves(draws, outcomes), ["run_id"], merkle.ORDERED_LEVELS)
    return {r.run_id: "sha256:" + r["hash"] for r in roots.collect()}


@pytest.mark.parametrize("most", [0, 1, 2])
def test_scored_hash_is_that_of_scored_draws(spark, monkeypatch, most):
    """At any height of branches, for completed runs, for all kinds of others, for gaps in draws and for odd values."""
    from tessera.functions import merkle

    names = ("b", "a", "c")
    wide = spark.range(0, 24_000, 1, 5).select(
        F.element_at(F.array(*[F.lit(r) for r in ("whole", "short", "null", "unmodelled", "unknown", "doubled")], F.lit(None).cast("string")),
                     (F.col("id") % 7 + 1).cast("int")).alias("run_id"),
        F.when(F.col("id") < 4000, F.col("id")).otherwise(F.col("id") * 997).alias("draw"),
        F.when(F.col("id") % 3 == 0, -0.0).otherwise(F.col("id") / 7.0).alias("b"),
        (F.col("id") % 11 / 100).alias("a"), F.when((F.col("id") % 7 == 2) & (F.col("id") % 5 == 0), None).otherwise(1e-9 * F.col("id")).alias("c"),
    ).filter("draw % 13 <> 5")
    runs = ("whole", "short", "null", "unmodelled", "doubled")
    terms = spark.createDataFrame(
        [(r, n, w) for r in runs for n, w in zip(names, (2.0, -300.0, 1e6))] + [("short", "d", 1.0), ("doubled", "a", 1.0)],
        "run_id string, parameter_id string, coefficient double")
    models = spark.createDataFrame(
        [(r, 5.0, 0.0, 5000.0) for r in runs if r != "unmodelled"], "run_id string, intercept double, floor double, ceiling double")
    draws = wide.unpivot(["run_id", "draw"], list(names), "parameter_id", "value")
    want = _general_hash(draws, d.score_draws(draws, terms, models, 12))
    assert len(want) == 7
    monkeypatch.setattr(merkle, "BRANCH_LEVELS", most)
    monkeypatch.setattr(merkle, "TASK_BRANCHES", 1)
    rows, levels = merkle.dealt(wide, ["run_id"], F.col("draw"), d.DRAWS_PER_LEAF)
    assert levels == most
    packed = rows.select("run_id", "branch", "draw", F.array(*[d.record(F.lit(n), F.col(n)) for n in names]).alias("parameters"))
    got = d.scored_hash(packed, levels, terms, models, 12)
    assert {r.run_id: r.draw_stream_hash for r in got.collect()} == want
    general = d.draws_hash(draws, d.score_draws(draws, terms, models, 12))
    assert {r.run_id: r.draw_stream_hash for r in general.collect()} == want


def test_stream_hash_shuffles_lines_once(spark, tmp_path):
    """Each line crosses the shuffle once, as values: no hashes of records or leaves do, nor are leaves written."""
    from tessera.functions import merkle
    from tessera.queries import analysis

    lines = 60_000
    spark.range(0, lines, 1, 4).select(
        F.floor(F.col("id") / 4).alias("l_orderkey"), (F.col("id") % 4 + 1).cast("int").alias("l_linenumber"),
        F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") * 7919 % 3 + 1).cast("int")).alias("l_returnflag"),
        (F.col("id") * 31 % 50 + 1).cast("double").alias("l_quantity"), (F.col("id") * 17 % 11 / 100).alias("l_discount"),
        (F.col("id") * 13 % 9 / 100).alias("l_tax"),
    ).write.parquet(f"{tmp_path}/lineitem.parquet")
    context = spark.sparkContext._jsc.sc()
    written = []

    def stages():
        context.listenerBus().waitUntilEmpty(30_000)
        found = context.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), spark.sparkContext._jvm.java.util.ArrayList())
        return {(s.stageId(), s.attemptId()): (s.shuffleWriteRecords(), s.shuffleWriteBytes()) for s in (found.apply(i) for i in range(found.size()))}

    def noted(df, keep=merkle.durable):
        out = keep(df)
        written.append(out.count())
        return out

    before = stages()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(merkle, "durable", noted)
        patch.setattr(d, "durable", noted)
        got = {r.run_id: r.draw_stream_hash for r in analysis.q_draws_hash(spark, str(tmp_path)).collect()}
    new = [v for k, v in stages().items() if k not in before]
    assert sum(n for n, _ in new) < 1.5 * lines and sum(b for _, b in new) < 60 * lines
    assert sum(written) < lines / 2
    draws, outcomes = analysis._scored(spark, str(tmp_path))
    assert got == _general_hash(draws, outcomes)
