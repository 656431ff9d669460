from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.plans.forecast import ForecastConfig, candidates, forecast, forecast_values, replay

START = datetime(2024, 1, 1)


def points(spark, series):
    rows = [
        (name, START + timedelta(days=day), float(v))
        for name, values in series.items() for day, v in values
    ]
    return spark.createDataFrame(rows, "series_id string, ts timestamp, value double")


def test_weekly_pattern_selects_seasonal_naive(spark):
    cfg = ForecastConfig(horizon=7, folds=6)
    df = points(spark, {"weekly": [(i, 10 + i % 7) for i in range(70)]})
    run = forecast(df, cfg).collect()[0]
    assert (run.status, run.selected_method, run.radius) == ("completed", "seasonal-naive", 0.0)
    assert [f.point for f in run.forecast] == [10, 11, 12, 13, 14, 15, 16]
    assert all(f.lower == f.point == f.upper for f in run.forecast)
    assert run.forecast[0].ts == START + timedelta(days=70)
    best = candidates(df, cfg).filter("method = 'seasonal-naive'").collect()[0]
    assert best.mae == 0 and best.observations == 42


def test_trend_selects_drift(spark):
    cfg = ForecastConfig(horizon=3, folds=8, min_train=10, window=5, season=7)
    run = forecast(points(spark, {"trend": [(i, i) for i in range(50)]}), cfg).collect()[0]
    assert run.selected_method == "drift"
    assert [f.point for f in run.forecast] == [50, 51, 52]


def test_decline_stays_nonnegative(spark):
    cfg = ForecastConfig(horizon=3, folds=4, min_train=5, window=3, season=3)
    run = forecast(points(spark, {"decline": [(i, 20 - i) for i in range(20)]}), cfg).collect()[0]
    assert all(f.point >= 0 and f.lower >= 0 for f in run.forecast)


def test_negative_releases_are_rows(spark):
    df = points(spark, {
        "short": [(i, i) for i in range(5)],
        "one": [(0, 1)],
        "uneven": [(0, 1), (1, 2), (3, 3)] + [(4 + i, i) for i in range(40)],
        "repeated": [(0, 1), (0, 2)] + [(i, i) for i in range(1, 40)],
        "fine": [(i, i % 5) for i in range(60)],
    })
    runs = {r.series_id: r for r in forecast(df).collect()}
    assert runs["short"].status == runs["one"].status == "insufficient-evidence"
    assert runs["one"].failure_reason.startswith("At least two")
    assert runs["uneven"].status == runs["repeated"].status == "rejected"
    assert runs["short"].forecast is None and runs["uneven"].forecast is None
    assert runs["fine"].status == "completed"
    excluded = candidates(df).filter("series_id = 'short'").collect()
    assert len(excluded) == 4 and all("requires at least 23 regular" in c.exclusion_reason for c in excluded)


def test_zero_actuals_have_no_wape(spark):
    rows = candidates(points(spark, {"zero": [(i, 0) for i in range(40)]})).collect()
    assert all(r.wape is None and r.mae == 0 for r in rows)
    run = forecast(points(spark, {"zero": [(i, 0) for i in range(40)]})).collect()[0]
    assert run.selected_method == "drift"  # ties end in the method name


def test_moving_average_feeds_on_its_own_predictions(spark):
    cfg = ForecastConfig(horizon=3, folds=3, min_train=4, window=2, season=2, methods=("moving-average",))
    values = [3.0, 8.0, 1.0, 9.0, 4.0, 7.0, 2.0, 6.0, 5.0, 11.0]
    run = forecast(points(spark, {"m": list(enumerate(values))}), cfg).collect()[0]
    history, expected = list(values), []
    for _ in range(3):
        expected.append(float(f"{sum(history[-2:]) / 2:.12g}"))
        history.append(expected[-1])
    assert [f.point for f in run.forecast] == expected


def test_result_does_not_depend_on_partitioning(spark):
    df = points(spark, {f"s{j}": [(i, (i * j) % 11) for i in range(45)] for j in range(6)})
    first = sorted(map(str, forecast(df).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert sorted(map(str, forecast(df.repartition(7)).collect())) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_replay_holds_out_the_end(spark):
    cfg = ForecastConfig(horizon=7, folds=4)
    df = points(spark, {"weekly": [(i, 10 + i % 7) for i in range(70)], "tiny": [(0, 1), (1, 2)]})
    rows = {r.series_id: r for r in replay(df, cfg).collect()}
    assert rows["weekly"].training_values == 63 and rows["weekly"].mae == 0
    assert rows["weekly"].interval_coverage == 1.0
    assert rows["tiny"].status == "insufficient-evidence" and rows["tiny"].failure_reason


def test_config_is_checked():
    with pytest.raises(ValueError):
        ForecastConfig(min_folds=9, folds=8)
    with pytest.raises(ValueError):
        ForecastConfig(methods=("naive", "naive"))


def test_values_long_form(spark):
    cfg = ForecastConfig(horizon=7, folds=6)
    df = forecast_values(forecast(points(spark, {"w": [(i, i % 7) for i in range(70)]}), cfg))
    assert df.count() == 7 and df.agg(F.max("step")).collect()[0][0] == 7
