"""Service-request views, their reconciliation, and the city metrics derived from them.

Requests carry ``city, service_day, category, area, status`` (one row per request). The four views
are one long table ``city, view, service_day, category, area, status, request_count``; a dimension
a view does not use is null.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.scalar import MISSING, norm_dim, reasons

DIMENSIONS = ("service_day", "category", "area", "status")
# The four published views and the dimensions each one keeps.
VIEWS = {
    "daily-category": ("service_day", "category"),
    "daily-area": ("service_day", "area"),
    "category-status": ("category", "status"),
    "area-status": ("area", "status"),
}


def normalise(requests: DataFrame) -> DataFrame:
    """Trim the label dimensions and give blanks the missing marker."""
    return requests.select(
        "city",
        F.col("service_day").cast("date").alias("service_day"),
        *[norm_dim(F.col(name)).alias(name) for name in ("category", "area", "status")],
    )


def request_views(requests: DataFrame, start=None, end=None) -> DataFrame:
    """All four views in one pass over the requests; rows outside ``[start, end)`` are left out."""
    if start is not None:
        requests = requests.filter(F.col("service_day") >= F.lit(start))
    if end is not None:
        requests = requests.filter(F.col("service_day") < F.lit(end))
    rows = normalise(requests)
    sets = [["city", *dims] for dims in VIEWS.values()]
    used = {
        name: "".join("0" if d in dims else "1" for d in DIMENSIONS) for name, dims in VIEWS.items()
    }
    mask = F.grouping_id()
    counted = rows.groupingSets(sets, "city", *DIMENSIONS).agg(
        F.count("*").alias("request_count"), mask.alias("_mask")
    )
    label = F.coalesce(*[
        F.when(F.col("_mask") == int(bits, 2), F.lit(name)) for name, bits in used.items()
    ])
    return counted.select("city", label.alias("view"), *DIMENSIONS, "request_count")


def consolidate(rows: DataFrame, dims: Sequence[str], keys: Sequence[str] = ("city",)) -> DataFrame:
    """Merge pre-aggregated rows whose labels collide after normalisation."""
    text = [d for d in dims if d != "service_day"]
    cleaned = rows.select(
        *keys,
        *[norm_dim(F.col(d)).alias(d) if d in text else F.col(d).cast("date").alias(d) for d in dims],
        F.col("request_count").cast("long").alias("request_count"),
    )
    return cleaned.groupBy(*keys, *dims).agg(F.sum("request_count").alias("request_count"))


def view_contract(views: DataFrame) -> DataFrame:
    """One row per city and view: key uniqueness, required and unused dimensions, positive counts."""
    required = F.lit(False)
    unused = F.lit(False)
    for name, dims in VIEWS.items():
        here = F.col("view") == name
        for d in DIMENSIONS:
            if d in dims:
                required = required | (here & F.col(d).isNull())
            else:
                unused = unused | (here & F.col(d).isNotNull())
    keyed = views.groupBy("city", "view", *DIMENSIONS).agg(
        F.count("*").alias("_copies"),
        F.sum("request_count").alias("_sum"),
        F.min("request_count").alias("_least"),
    )
    checked = keyed.groupBy("city", "view").agg(
        F.sum("_copies").alias("aggregate_rows"),
        F.sum("_sum").alias("total_requests"),
        F.count_if(F.col("_copies") > 1).alias("duplicate_keys"),
        F.count_if(required).alias("missing_dimensions"),
        F.count_if(unused).alias("unexpected_dimensions"),
        F.count_if(F.col("_least") < 1).alias("nonpositive_counts"),
    )
    problems = ("duplicate_keys", "missing_dimensions", "unexpected_dimensions", "nonpositive_counts")
    return checked.withColumn(
        "issues", reasons(*[(F.col(p) > 0, p.replace("_", "-")) for p in problems])
    )


def reconcile_views(views: DataFrame) -> DataFrame:
    """Independent totals of one city must be one number across all four views."""
    totals = views.groupBy("city", "view").agg(F.sum("request_count").alias("total"))
    agreed = totals.groupBy("city").agg(
        F.count("*").alias("views"),
        F.min("total").alias("least_total"),
        F.max("total").alias("greatest_total"),
    )
    same = (F.col("least_total") == F.col("greatest_total")) & (F.col("views") == len(VIEWS))
    return agreed.withColumn("status", F.when(same, "pass").otherwise("fail"))


def complete_calendar(
    counts: DataFrame, keys: Sequence[str], bounds: DataFrame, value: str = "request_count"
) -> DataFrame:
    """Every day of ``[start_day, end_day)`` per key; an absent day counts zero.

    ``bounds`` holds one row per key with ``start_day`` and ``end_day``; the calendar is generated
    from it, so the fact rows meet it in one equi-join.
    """
    days = bounds.select(
        *keys,
        F.explode(
            F.sequence(F.col("start_day"), F.date_sub(F.col("end_day"), 1), F.expr("INTERVAL 1 DAY"))
        ).alias("service_day"),
    )
    summed = counts.groupBy(*keys, "service_day").agg(F.sum(value).alias("_n"))
    return days.join(summed, [*keys, "service_day"], "left").select(
        *keys,
        "service_day",
        F.coalesce(F.col("_n"), F.lit(0)).cast("long").alias(value),
        F.col("_n").isNull().alias("zero_completed"),
    )


def window_bounds(views: DataFrame) -> DataFrame:
    """Half-open day window of each city, read off the daily view."""
    return (
        views.filter(F.col("view") == "daily-category")
        .groupBy("city")
        .agg(
            F.min("service_day").alias("start_day"),
            F.date_add(F.max("service_day"), 1).alias("end_day"),
        )
    )


def daily_stats(views: DataFrame, bounds: DataFrame) -> DataFrame:
    """Mean, median and maximum of the zero-complete daily totals (calendar-bounded groups)."""
    daily = views.filter(F.col("view") == "daily-category")
    full = complete_calendar(daily, ["city"], bounds)
    return full.groupBy("city").agg(
        F.count("*").alias("reference_days"),
        F.count_if("zero_completed").alias("zero_days"),
        F.avg("request_count").alias("daily_mean"),
        F.percentile("request_count", 0.5).alias("daily_median"),
        F.max("request_count").alias("daily_maximum"),
    )


def label_metrics(views: DataFrame) -> DataFrame:
    """Label breadth and concentration per city, from the two status views."""
    category, area = F.col("view") == "category-status", F.col("view") == "area-status"
    labels = F.when(
        category, F.array(F.struct(F.lit("category").alias("kind"), F.col("category").alias("label")))
    ).otherwise(
        F.array(
            F.struct(F.lit("area").alias("kind"), F.col("area").alias("label")),
            F.struct(F.lit("status").alias("kind"), F.col("status").alias("label")),
        )
    )
    summed = (
        views.filter(category | area)
        .select("city", "request_count", F.explode(labels).alias("_l"))
        .groupBy("city", F.col("_l.kind").alias("kind"), F.col("_l.label").alias("label"))
        .agg(F.sum("request_count").alias("n"))
    )
    known = F.col("label") != MISSING

    def kind(name: str) -> Column:
        return F.col("kind") == name

    total = F.sum(F.when(kind("category"), F.col("n")))
    return summed.groupBy("city").agg(
        total.alias("requests_total"),
        F.count_if(kind("category") & known).alias("category_labels"),
        F.count_if(kind("area") & known).alias("area_labels"),
        F.count_if(kind("status")).alias("status_labels"),
        (F.coalesce(F.sum(F.when(kind("area") & ~known, F.col("n"))), F.lit(0)) / total)
        .alias("missing_area_share"),
        (F.max(F.when(kind("category"), F.col("n"))) / total).alias("top_category_share"),
        (F.coalesce(F.max(F.when(kind("area") & known, F.col("n"))), F.lit(0)) / total)
        .alias("top_known_area_share"),
    )


def rate_metrics(totals: DataFrame, population: DataFrame) -> DataFrame:
    """Requests per 100,000 estimated residents; a city without a population row keeps nulls."""
    joined = totals.join(population, "city", "left")
    return joined.select(
        "city",
        "requests_total",
        "population_estimate",
        "population_margin",
        F.try_divide(F.col("requests_total") * 100000.0, F.col("population_estimate"))
        .alias("requests_per_100k"),
    )


def match_rules(rows: DataFrame, rules: Mapping[str, Sequence[str]], category: str = "category") -> DataFrame:
    """Attach every rule a row satisfies: any keyword inside the lower-cased category.

    A rule without keywords keeps every row. The rules are a fixed configuration held as a literal,
    so matching is a projection and needs no join.
    """
    literal = F.array(*[
        F.struct(
            F.lit(rule).alias("rule_id"),
            F.array(*[F.lit(k.lower()) for k in words]).cast("array<string>").alias("keywords"),
        )
        for rule, words in rules.items()
    ])
    lowered = F.lower(F.col(category))
    hit = F.filter(
        literal,
        lambda r: (F.size(r["keywords"]) == 0)
        | F.exists(r["keywords"], lambda k: F.contains(lowered, k)),
    )
    return rows.withColumn("rule_id", F.explode(F.transform(hit, lambda r: r["rule_id"])))


def focus_summary(views: DataFrame, rules: Mapping[str, Sequence[str]], top: int = 5) -> DataFrame:
    """Per city and rule: matching total from both views, active days, labels, top categories."""
    matched = match_rules(views.filter(F.col("view").isin("daily-category", "category-status")), rules)
    by_view = matched.groupBy("city", "rule_id").agg(
        F.sum(F.when(F.col("view") == "daily-category", F.col("request_count"))).alias("daily_total"),
        F.sum(F.when(F.col("view") == "category-status", F.col("request_count"))).alias("matching_requests"),
        F.count_distinct(F.when(F.col("view") == "daily-category", F.col("service_day"))).alias("active_days"),
    )
    by_category = (
        matched.filter(F.col("view") == "category-status")
        .groupBy("city", "rule_id", "category")
        .agg(F.sum("request_count").alias("n"))
    )
    order = W.partitionBy("city", "rule_id").orderBy(F.desc("n"), "category")
    # the full label count is taken before the cut to the leading categories
    labels = by_category.groupBy("city", "rule_id").agg(F.count("*").alias("matching_labels"))
    leading = (
        by_category.withColumn("_rank", F.row_number().over(order))
        .filter(F.col("_rank") <= top)
        .groupBy("city", "rule_id")
        .agg(F.sort_array(F.collect_list(F.struct("_rank", "category", "n"))).alias("_top"))
        .select(
            "city", "rule_id",
            F.transform("_top", lambda t: F.struct(t["category"].alias("category"), t["n"].alias("request_count")))
            .alias("top_categories"),
        )
    )
    keys = ["city", "rule_id"]
    return (
        by_view.join(labels, keys, "left")
        .join(leading, keys, "left")
        .withColumn("reconciled", F.col("daily_total").eqNullSafe(F.col("matching_requests")))
    )


def focus_daily(views: DataFrame, rules: Mapping[str, Sequence[str]], bounds: DataFrame) -> DataFrame:
    """Zero-complete daily counts of every city and rule, the input of the forecasts."""
    matched = match_rules(views.filter(F.col("view") == "daily-category"), rules)
    rule_ids = F.explode(F.array(*[F.lit(rule) for rule in rules]))
    windows = bounds.withColumn("rule_id", rule_ids)
    return complete_calendar(matched, ["city", "rule_id"], windows)
