"""Request views and city metrics over orders as service requests.

city = region, area = nation, category = order priority, status = order status, day = order date.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import scalar
from tessera.operators import requests as rq
from tessera.session import table

# Focus rules used by the keyword queries: an empty rule keeps every category.
FOCUS_RULES = {
    "all-demand": [],
    "urgent-demand": ["urgent", "HIGH"],
    "unspecified": ["not spec"],
    "no-match": ["pothole"],
}


def requests_table(spark, sf):
    orders, customer = table(spark, sf, "orders"), table(spark, sf, "customer")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            F.col("r_name").alias("city"),
            F.col("o_orderdate").cast("date").alias("service_day"),
            F.col("o_orderpriority").alias("category"),
            F.col("n_name").alias("area"),
            F.col("o_orderstatus").alias("status"),
        )
    )


def views(spark, sf):
    return rq.request_views(requests_table(spark, sf))


def population(spark, sf):
    customer, nation = table(spark, sf, "customer"), table(spark, sf, "nation")
    region = table(spark, sf, "region")
    return (
        customer.groupBy("c_nationkey").agg(F.count("*").alias("n"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("r_name").alias("city"))
        .agg(
            (F.sum("n") * 1000).alias("population_estimate"),
            F.sum("n").alias("population_margin"),
        )
    )


REQUESTS = """requests AS (
  SELECT r_name AS city, CAST(o_orderdate AS DATE) AS service_day, o_orderpriority AS category,
         n_name AS area, o_orderstatus AS status
  FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
POPULATION = """population AS (
  SELECT r_name AS city, 1000 * count(*) AS population_estimate, count(*) AS population_margin
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"""
RULES = """rules(rule_id, keywords) AS (VALUES
  ('all-demand', CAST([] AS VARCHAR[])), ('urgent-demand', ['urgent', 'high']),
  ('unspecified', ['not spec']), ('no-match', ['pothole']))"""
MATCHED = f"""{REQUESTS}, {RULES}, matched AS (
  SELECT city, rule_id, service_day, category FROM requests, rules
  WHERE len(keywords) = 0
     OR len(list_filter(keywords, lambda k: contains(lower(category), k))) > 0)"""
DAILY = f"""{REQUESTS}, bounds AS (
  SELECT city, min(service_day) AS s, max(service_day) AS e FROM requests GROUP BY 1),
calendar AS (
  SELECT city, CAST(unnest(generate_series(s, e, INTERVAL 1 DAY)) AS DATE) AS service_day FROM bounds),
daily AS (
  SELECT c.city, c.service_day, count(r.city) AS n FROM calendar c LEFT JOIN requests r
  ON r.city = c.city AND r.service_day = c.service_day GROUP BY 1, 2)"""


def q_request_views(spark, sf):
    return views(spark, sf)


def q_view_contract(spark, sf):
    return rq.view_contract(views(spark, sf)).select(
        "city", "view", F.col("aggregate_rows").cast("long").alias("aggregate_rows"),
        "total_requests", "duplicate_keys", "missing_dimensions", "unexpected_dimensions",
        "nonpositive_counts", F.size("issues").cast("long").alias("issue_count"),
    )


def q_reconcile_views(spark, sf):
    return rq.reconcile_views(views(spark, sf))


def q_consolidate(spark, sf):
    dirty = requests_table(spark, sf).select(
        "city",
        F.when(F.col("category").startswith("5"), F.lit("  "))
        .when(F.col("status") == "O", F.concat(F.lit(" "), "category", F.lit("  ")))
        .otherwise(F.col("category")).alias("category"),
        "status", F.lit("1").alias("request_count"),
    )
    return rq.consolidate(dirty, ["category", "status"])


def q_daily_stats(spark, sf):
    v = views(spark, sf)
    return rq.daily_stats(v, rq.window_bounds(v)).withColumn("daily_mean", F.round("daily_mean", 6))


def q_label_metrics(spark, sf):
    out = rq.label_metrics(views(spark, sf))
    for name in ("missing_area_share", "top_category_share", "top_known_area_share"):
        out = out.withColumn(name, F.round(name, 6))
    return out


def q_rate_metrics(spark, sf):
    totals = rq.label_metrics(views(spark, sf)).select("city", "requests_total")
    return rq.rate_metrics(totals, population(spark, sf)).withColumn(
        "requests_per_100k", F.round("requests_per_100k", 6)
    )


def q_keyword_filter(spark, sf):
    matched = rq.match_rules(requests_table(spark, sf), FOCUS_RULES)
    return matched.groupBy("rule_id", "category").agg(F.count("*").alias("request_count"))


def q_focus_summary(spark, sf):
    return rq.focus_summary(views(spark, sf), FOCUS_RULES).select(
        "city", "rule_id", "daily_total", "matching_requests", "active_days", "matching_labels",
        "reconciled",
        F.array_join(
            F.transform("top_categories", lambda t: F.concat_ws(":", t["category"], t["request_count"])), "|"
        ).alias("top_categories"),
    )


def q_complete_calendar(spark, sf):
    v = views(spark, sf)
    daily = v.filter(F.col("view") == "daily-category")
    return rq.complete_calendar(daily, ["city"], rq.window_bounds(v))


def q_time_window(spark, sf):
    kept = table(spark, sf, "events").filter(
        scalar.between_half_open(F.col("ts").cast("date"), "2024-01-05", "2024-01-20")
    )
    return kept.groupBy("event_type").agg(
        F.count("*").alias("n"),
        F.min(F.col("ts").cast("date")).alias("first_day"),
        F.max(F.col("ts").cast("date")).alias("last_day"),
    )


QUERIES = {
    "request_views": q_request_views,
    "view_contract": q_view_contract,
    "reconcile_views": q_reconcile_views,
    "consolidate_rows": q_consolidate,
    "daily_stats": q_daily_stats,
    "label_metrics": q_label_metrics,
    "rate_metrics": q_rate_metrics,
    "keyword_filter": q_keyword_filter,
    "focus_summary": q_focus_summary,
    "complete_calendar": q_complete_calendar,
    "half_open_window": q_time_window,
}

VIEW_SQL = f"""{REQUESTS}, views AS (
  SELECT city, CASE grouping(service_day, category, area, status)
      WHEN 3 THEN 'daily-category' WHEN 5 THEN 'daily-area'
      WHEN 10 THEN 'category-status' WHEN 12 THEN 'area-status' END AS view,
    service_day, category, area, status, count(*) AS request_count
  FROM requests GROUP BY GROUPING SETS ((city, service_day, category), (city, service_day, area),
    (city, category, status), (city, area, status)))"""

ORACLES = {
    "request_views": f"WITH {VIEW_SQL} SELECT * FROM views",
    "view_contract": f"""WITH {VIEW_SQL}
        SELECT city, view, count(*) AS aggregate_rows, CAST(sum(request_count) AS BIGINT) AS total_requests,
          CAST(0 AS BIGINT) AS duplicate_keys, CAST(0 AS BIGINT) AS missing_dimensions,
          CAST(0 AS BIGINT) AS unexpected_dimensions, CAST(0 AS BIGINT) AS nonpositive_counts,
          CAST(0 AS BIGINT) AS issue_count FROM views GROUP BY city, view""",
    "reconcile_views": f"""WITH {REQUESTS}
        SELECT city, CAST(4 AS BIGINT) AS views, count(*) AS least_total, count(*) AS greatest_total,
          'pass' AS status FROM requests GROUP BY city""",
    "consolidate_rows": f"""WITH {REQUESTS}
        SELECT city, CASE WHEN category LIKE '5%' THEN '(missing)' ELSE category END AS category,
          status, count(*) AS request_count FROM requests GROUP BY 1, 2, 3""",
    "daily_stats": f"""WITH {DAILY}
        SELECT city, count(*) AS reference_days, count(*) FILTER (n = 0) AS zero_days,
          round(avg(n), 6) AS daily_mean, quantile_cont(n, 0.5) AS daily_median,
          max(n) AS daily_maximum FROM daily GROUP BY city""",
    "label_metrics": f"""WITH {REQUESTS}, c AS (
          SELECT city, max(n) AS top_category, count(*) AS category_labels FROM (
            SELECT city, category, count(*) AS n FROM requests GROUP BY 1, 2) GROUP BY 1),
        a AS (SELECT city, max(n) AS top_area, count(*) AS area_labels FROM (
            SELECT city, area, count(*) AS n FROM requests GROUP BY 1, 2) GROUP BY 1),
        t AS (SELECT city, count(*) AS requests_total, count(DISTINCT status) AS status_labels
            FROM requests GROUP BY 1)
        SELECT city, requests_total, category_labels, area_labels, status_labels,
          CAST(0 AS DOUBLE) AS missing_area_share,
          round(top_category / requests_total, 6) AS top_category_share,
          round(top_area / requests_total, 6) AS top_known_area_share
        FROM t JOIN c USING (city) JOIN a USING (city)""",
    "rate_metrics": f"""WITH {REQUESTS}, {POPULATION}
        SELECT city, requests_total, population_estimate, population_margin,
          round(requests_total * 100000.0 / population_estimate, 6) AS requests_per_100k
        FROM (SELECT city, count(*) AS requests_total FROM requests GROUP BY 1) JOIN population USING (city)""",
    "keyword_filter": f"""WITH {MATCHED}
        SELECT rule_id, category, count(*) AS request_count FROM matched GROUP BY 1, 2""",
    "focus_summary": f"""WITH {MATCHED}, cat AS (
          SELECT city, rule_id, category, count(*) AS n FROM matched GROUP BY 1, 2, 3),
        top AS (SELECT city, rule_id, count(*) AS matching_labels,
            array_to_string(list_slice(list(category || ':' || n ORDER BY n DESC, category), 1, 5), '|') AS top_categories
          FROM cat GROUP BY 1, 2)
        SELECT city, rule_id, count(*) AS daily_total, count(*) AS matching_requests,
          count(DISTINCT service_day) AS active_days, any_value(matching_labels) AS matching_labels,
          true AS reconciled, any_value(top_categories) AS top_categories
        FROM matched JOIN top USING (city, rule_id) GROUP BY 1, 2""",
    "complete_calendar": f"""WITH {DAILY}
        SELECT city, service_day, n AS request_count, n = 0 AS zero_completed FROM daily""",
    "half_open_window": """SELECT event_type, count(*) AS n, min(CAST(ts AS DATE)) AS first_day,
          max(CAST(ts AS DATE)) AS last_day FROM events
        WHERE ts >= DATE '2024-01-05' AND ts < DATE '2024-01-20' GROUP BY 1""",
}
