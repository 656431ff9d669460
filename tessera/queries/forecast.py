"""Forecasts over the event stream: series = event type, value = daily sum, horizon 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.plans import forecast as fc
from tessera.session import table

CONFIG = fc.ForecastConfig(horizon=3, folds=8)
USER_CONFIG = fc.ForecastConfig(horizon=2, folds=4, min_train=8, window=4, season=7)


def daily_points(spark, sf):
    day = F.col("ts").cast("date")
    return (
        table(spark, sf, "events")
        .groupBy(F.col("event_type").alias("series_id"), day.alias("_day"))
        .agg(F.round(F.sum("value"), 4).alias("value"))
        .select("series_id", F.col("_day").cast("timestamp").alias("ts"), "value")
    )


def q_series_shape(spark, sf):
    return fc.series_shape(daily_points(spark, sf)).select(
        "series_id", "n", "distinct_stamps", "interval_seconds", "offgrid",
        F.round("first_value", 4).alias("first_value"),
    )


def q_candidates(spark, sf):
    rows = fc.candidates(daily_points(spark, sf), CONFIG)
    rounded = ("mae", "rmse", "wape", "bias", "coverage", "interval_width", "radius")
    return rows.select(
        "series_id", "method", "eligible", F.col("observations").cast("long").alias("observations"),
        *[F.round(F.col(c), 5).alias(c) for c in rounded],
    )


def q_forecast(spark, sf):
    values = fc.forecast_values(fc.forecast(daily_points(spark, sf), CONFIG))
    return values.select(
        "series_id", "selected_method", F.col("step").cast("long").alias("step"),
        F.col("ts").cast("date").alias("day"),
        *[F.round(F.col(c), 5).alias(c) for c in ("point", "lower", "upper")],
    )


def q_replay(spark, sf):
    rows = fc.replay(daily_points(spark, sf), CONFIG)
    return rows.select(
        "series_id", "status", "selected_method",
        F.col("training_values").cast("long").alias("training_values"), "held_out", "aligned",
        *[F.round(F.col(c), 5).alias(c) for c in ("mae", "rmse", "wape", "interval_coverage")],
    )


def q_forecast_by_user(spark, sf):
    """Every user's daily activity as its own series: many gappy series, so most are rejected."""
    day = F.col("ts").cast("date")
    points = (
        table(spark, sf, "events")
        .groupBy(F.concat(F.lit("user-"), F.col("user_id")).alias("series_id"), day.alias("_day"))
        .agg(F.count("*").cast("double").alias("value"))
        .select("series_id", F.col("_day").cast("timestamp").alias("ts"), "value")
    )
    runs = fc.forecast(points, USER_CONFIG)
    return runs.groupBy("status").agg(
        F.count("*").alias("series"), F.sum("observation_count").alias("points")
    )


QUERIES = {
    "series_regularity": q_series_shape,
    "forecast_candidates": q_candidates,
    "forecast_values": q_forecast,
    "forecast_replay": q_replay,
    "forecast_many_series": q_forecast_by_user,
}

POINTS = """pts AS (
  SELECT series_id, day, value, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i,
         count(*) OVER (PARTITION BY series_id) AS n
  FROM (SELECT event_type AS series_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS value
        FROM events GROUP BY 1, 2) {where})"""
# h = 3, folds = 8, window = season = 7, required history 14
CHAIN = """hist AS (SELECT series_id, any_value(n) AS n, list(value ORDER BY i) AS v FROM pts GROUP BY 1),
origins AS (
  SELECT series_id, n, v, o FROM (SELECT *, unnest(range(1, n + 1)) AS o FROM hist)
  WHERE (o >= 14 AND o <= n - 3 AND o > n - 3 - 8) OR o = n),
ma AS (SELECT *, CAST(printf('%.11e', greatest(0, list_avg(v[o - 6:o]))) AS DOUBLE) AS m1 FROM origins),
mb AS (SELECT *, CAST(printf('%.11e', greatest(0, (list_sum(v[o - 5:o]) + m1) / 7)) AS DOUBLE) AS m2 FROM ma),
mc AS (SELECT *, CAST(printf('%.11e', greatest(0, (list_sum(v[o - 4:o]) + m1 + m2) / 7)) AS DOUBLE) AS m3 FROM mb),
pred AS (
  SELECT series_id, n, o, v, 'naive' AS method, k, greatest(0, v[o]) AS p FROM mc, range(1, 4) t(k)
  UNION ALL SELECT series_id, n, o, v, 'drift', k, greatest(0, v[o] + k * (v[o] - v[1]) / (o - 1))
    FROM mc, range(1, 4) t(k)
  UNION ALL SELECT series_id, n, o, v, 'moving-average', k, CASE k WHEN 1 THEN m1 WHEN 2 THEN m2 ELSE m3 END
    FROM mc, range(1, 4) t(k)
  UNION ALL SELECT series_id, n, o, v, 'seasonal-naive', k, greatest(0, v[o - 7 + k]) FROM mc, range(1, 4) t(k)),
rounded AS (SELECT * EXCLUDE (p), CAST(printf('%.11e', p) AS DOUBLE) AS p FROM pred),
errs AS (SELECT series_id, method, o, k, p, v[o + k] AS a, p - v[o + k] AS e FROM rounded WHERE o < n),
ranked AS (SELECT *, row_number() OVER (PARTITION BY series_id, method ORDER BY abs(e)) AS r,
  count(*) OVER (PARTITION BY series_id, method) AS c FROM errs),
radius AS (SELECT series_id, method, CAST(printf('%.11e', max(abs(e))) AS DOUBLE) AS radius FROM ranked
  WHERE r = least(c, CAST(ceil((c + 1) * 0.9) AS BIGINT)) GROUP BY 1, 2),
cand AS (
  SELECT series_id, method, true AS eligible, count(*) AS observations, avg(abs(e)) AS mae,
    sqrt(avg(e * e)) AS rmse, sum(abs(e)) / nullif(sum(abs(a)), 0) AS wape, avg(e) AS bias,
    avg(CASE WHEN abs(e) <= radius THEN 1.0 ELSE 0.0 END) AS coverage, any_value(radius) AS radius
  FROM errs JOIN radius USING (series_id, method) GROUP BY 1, 2),
best AS (SELECT series_id, method, radius FROM (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY coalesce(wape, 1e308), mae, method) AS r
  FROM cand) WHERE r = 1)"""
FULL = POINTS.format(where="")
TRAIN = """allpts AS (
  SELECT event_type AS series_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS value FROM events GROUP BY 1, 2),
cut AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS back FROM allpts),
pts AS (SELECT series_id, day, value, row_number() OVER (PARTITION BY series_id ORDER BY day) AS i,
  count(*) OVER (PARTITION BY series_id) AS n FROM cut WHERE back > 3)"""

ORACLES = {
    "series_regularity": f"""WITH {FULL}
        SELECT series_id, CAST(any_value(n) AS BIGINT) AS n, count(DISTINCT day) AS distinct_stamps,
          CAST(86400 AS DOUBLE) AS interval_seconds, CAST(0 AS BIGINT) AS offgrid,
          round(min_by(value, day), 4) AS first_value FROM pts GROUP BY 1""",
    "forecast_candidates": f"""WITH {FULL}, {CHAIN}
        SELECT series_id, method, eligible, observations, round(mae, 5) AS mae, round(rmse, 5) AS rmse,
          round(wape, 5) AS wape, round(bias, 5) AS bias, round(coverage, 5) AS coverage,
          round(2 * radius, 5) AS interval_width, round(radius, 5) AS radius FROM cand""",
    "forecast_values": f"""WITH {FULL}, {CHAIN}
        SELECT p.series_id, p.method AS selected_method, p.k AS step,
          CAST((SELECT max(day) FROM pts x WHERE x.series_id = p.series_id) + CAST(k AS INTEGER) AS DATE) AS day,
          round(p.p, 5) AS point, round(greatest(0, p.p - radius), 5) AS lower, round(p.p + radius, 5) AS upper
        FROM pred p JOIN best b ON p.series_id = b.series_id AND p.method = b.method WHERE p.o = p.n""",
    "forecast_replay": f"""WITH {TRAIN}, {CHAIN}, scored AS (
          SELECT p.series_id, p.method, p.n, p.p, c.value AS a,
            CASE WHEN c.value BETWEEN greatest(0, p.p - radius) AND p.p + radius THEN 1.0 ELSE 0.0 END AS inside
          FROM pred p JOIN best b ON p.series_id = b.series_id AND p.method = b.method
          JOIN cut c ON c.series_id = p.series_id AND c.back = 4 - p.k WHERE p.o = p.n)
        SELECT series_id, 'completed' AS status, any_value(method) AS selected_method,
          CAST(any_value(n) AS BIGINT) AS training_values, CAST(3 AS BIGINT) AS held_out, count(*) AS aligned,
          round(avg(abs(p - a)), 5) AS mae, round(sqrt(avg((p - a) * (p - a))), 5) AS rmse,
          round(sum(abs(p - a)) / nullif(sum(abs(a)), 0), 5) AS wape, round(avg(inside), 5) AS interval_coverage
        FROM scored GROUP BY 1""",
    "forecast_many_series": """WITH pts AS (
          SELECT user_id, CAST(ts AS DATE) AS day FROM events GROUP BY 1, 2),
        shape AS (SELECT user_id, count(*) AS n, date_diff('day', min(day), max(day)) AS span,
          CASE WHEN count(*) > 1 THEN date_diff('day', min(day), max(day)) / (count(*) - 1) END AS gap,
          min(day) AS first_day FROM pts GROUP BY 1),
        off AS (SELECT user_id, count(*) FILTER (gap > 0
            AND abs(date_diff('day', first_day, day) / gap - round(date_diff('day', first_day, day) / gap)) > 1e-9) AS bad
          FROM pts JOIN shape USING (user_id) GROUP BY 1),
        runs AS (SELECT n, CASE WHEN bad > 0 THEN 'rejected' WHEN n < 13 THEN 'insufficient-evidence'
            ELSE 'completed' END AS status FROM shape JOIN off USING (user_id))
        SELECT status, count(*) AS series, CAST(sum(n) AS BIGINT) AS points FROM runs GROUP BY 1""",
}
