"""Metric ledgers, roll-ups and totals that must reconcile with the rows behind them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.ranking import exact_quantiles

# Climate parameters and the summary each one enters.
DEEP_CLIMATE = {
    "climate.t2m-mean": ("T2M", "mean"),
    "climate.t2m-max-maximum": ("T2M_MAX", "max"),
    "climate.precipitation-total": ("PRECTOTCORR", "sum"),
    "climate.wind-speed-mean": ("WS10M", "mean"),
    "climate.relative-humidity-mean": ("RH2M", "mean"),
}
ANNUAL_CLIMATE = {
    "climate-t2m-annual-mean": ("T2M", "mean"),
    "climate-t2m-max-annual-maximum": ("T2M_MAX", "max"),
    "climate-t2m-min-annual-minimum": ("T2M_MIN", "min"),
    "climate-days-t2m-max-ge-35c": ("T2M_MAX", "days>=35"),
    "climate-precipitation-annual-sum": ("PRECTOTCORR", "sum"),
    "climate-days-precipitation-ge-20mm": ("PRECTOTCORR", "days>=20"),
    "climate-wind-speed-annual-mean": ("WS10M", "mean"),
    "climate-relative-humidity-annual-mean": ("RH2M", "mean"),
}


def _summary(parameter: str, kind: str) -> Column:
    value = F.when(F.col("parameter") == parameter, F.col("value"))
    if kind.startswith("days>="):
        return F.count_if(value >= float(kind[6:])).cast("double")
    return {"mean": F.avg, "max": F.max, "min": F.min, "sum": F.sum}[kind](value)


def climate_metrics(series: DataFrame, metrics: Mapping[str, tuple[str, str]], digits: int | None = None) -> DataFrame:
    """Long metric rows per city from ``city_id, parameter, day, value``: one partial aggregate."""
    wide = series.groupBy("city_id").agg(*[
        _summary(*how).alias(name.replace(".", "_")) for name, how in metrics.items()
    ])
    entries = F.array(*[
        F.struct(
            F.lit(name).alias("metric_id"),
            (F.round(F.col(name.replace(".", "_")), digits) if digits else F.col(name.replace(".", "_"))).alias("value"),
        )
        for name in metrics
    ])
    return wide.select("city_id", F.explode(entries).alias("m")).select(
        "city_id", "m.metric_id", "m.value", F.lit("estimated").alias("evidence_type")
    )


def country_metrics(context: DataFrame) -> DataFrame:
    """Indicator values as metric rows; the id is the lower-cased code with dashes."""
    return context.select(
        "country_code",
        F.concat(F.lit("country-"), F.replace(F.lower("indicator"), F.lit("."), F.lit("-"))).alias("metric_id"),
        F.round(F.col("value").cast("double"), 6).alias("value"),
        F.lit("estimated").alias("evidence_type"),
    )


def melt_metrics(wide: DataFrame, ident: str, columns: Sequence[str]) -> DataFrame:
    """Wide metric columns to one row per metric."""
    typed = wide.select(ident, *[F.col(c).cast("double").alias(c) for c in columns])
    return typed.unpivot(ident, list(columns), "metric_id", "value")


def compare_cities(ledger: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Metric rows to one row per city; the metric list is given, so no pass is spent finding it."""
    return ledger.groupBy("city_id").pivot("metric_id", list(metrics)).agg(F.max("value"))


def enum_counts(df: DataFrame, value: Column, members: Sequence[str], explode: bool = False) -> DataFrame:
    """Count of every declared member, zeros included."""
    values = df.select(F.explode(value).alias("member") if explode else value.alias("member"))
    counted = values.groupBy("member").agg(F.count("*").alias("n"))
    declared = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(m) for m in members])).alias("member"))
    return declared.join(counted, "member", "left").select("member", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def suite_overview(executions: DataFrame, designs: DataFrame, suites: Sequence[str]) -> DataFrame:
    """Per application suite: executions, outcomes, distinct cities, designs and families.

    ``executions(suite, city_id, status)``, ``designs(suite, design_id, family_id, template_ref)``.
    """
    declared = executions.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(s) for s in suites])).alias("suite")
    )
    ran = executions.groupBy("suite").agg(
        F.count("*").alias("executions"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") != "completed").alias("negative"),
        F.count_distinct("city_id").alias("cities"),
    )
    planned = designs.groupBy("suite").agg(
        F.count("*").alias("designs"), F.count_distinct("family_id").alias("families"),
        F.count("template_ref").alias("templates"),
    )
    names = ("executions", "completed", "negative", "cities", "designs", "families", "templates")
    return declared.join(ran, "suite", "left").join(planned, "suite", "left").select(
        "suite", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names]
    )


def family_summary(designs: DataFrame) -> DataFrame:
    """Designs of a family, split by implementation status."""
    return designs.groupBy("family_id").agg(
        F.count("*").alias("designs"),
        F.count_if(F.col("implementation_status") == "reference-implemented").alias("implemented"),
        F.count_if(F.col("implementation_status") == "design-only").alias("design_only"),
    )


def evidence_totals(ledger: DataFrame, sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Executions by outcome and the sums of the engine counters."""
    return ledger.groupBy(*by).agg(
        F.count("*").alias("executions"),
        F.count_if(F.col("status") == "completed").alias("completed"),
        F.count_if(F.col("status") != "completed").alias("negative"),
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in sums],
    )


def check_totals(published: DataFrame, ledger: DataFrame, sums: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Published totals against totals recomputed from the ledger; one row per differing figure."""
    again = evidence_totals(ledger, sums, by)
    names = ["executions", "completed", "negative", *sums]
    long = [
        t.select(*by, *[F.col(c).cast("long").alias(c) for c in names]).unpivot(list(by), names, "figure", side)
        for t, side in ((published, "published"), (again, "recomputed"))
    ]
    return long[0].join(long[1], [*by, "figure"], "full_outer").filter(
        ~F.col("published").eqNullSafe(F.col("recomputed"))
    )


def nearest_rank_summary(df: DataFrame, value: str, group: Sequence[str]) -> DataFrame:
    """Minimum, median, nearest-rank 95th percentile and maximum."""
    ends = df.groupBy(*group).agg(
        F.count(value).alias("n"), F.min(value).alias("minimum"), F.max(value).alias("maximum")
    )
    middle = exact_quantiles(df, group, value, [0.5]).select(*group, F.col("quantile").alias("median"))
    p95 = exact_quantiles(df, group, value, [0.95], nearest=True).select(*group, F.col("quantile").alias("p95"))
    return ends.join(middle, list(group)).join(p95, list(group))


def pack_ledger(packs: DataFrame) -> DataFrame:
    """Ledger row per pack: engine counters default to zero, references are distinct and sorted."""
    counters = ("forecast_observations", "draws", "search_space", "evaluated_plans", "feasible_plans")
    return packs.select(
        "pack_id", "city_id", "template_id", "status", "observed_requests",
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counters],
        F.sort_array(F.array_distinct("source_refs")).alias("source_refs"), "content_hash",
    )


def screen_tally(runs: DataFrame) -> DataFrame:
    """Screens of each city by outcome; a screen never issues a recommendation."""
    return runs.groupBy("city_id").agg(
        F.count_if(F.col("status") == "screened").alias("screened"),
        F.count_if(F.col("status") == "insufficient-evidence").alias("insufficient"),
        F.count_if(F.col("status") == "recommended").alias("recommendations_issued"),
    )


def dedupe_or_conflict(df: DataFrame, ident: str, hashed: str) -> DataFrame:
    """Repeated ids must carry identical content: one row per id with its verdict."""
    return df.groupBy(ident).agg(
        F.count("*").alias("copies"), F.min(hashed).alias("content_hash"),
        (F.min(hashed) == F.max(hashed)).alias("_same"),
    ).select(
        ident, "copies", "content_hash",
        F.when(F.col("_same"), "unique").otherwise("conflict").alias("status"),
    )


def catalog_summary(cities: DataFrame, manifests: DataFrame, executions: DataFrame, designs: DataFrame) -> DataFrame:
    """One row of reconciled catalog counts; every figure is its own aggregate, attached as a scalar."""
    one = cities.agg(F.count("*").alias("cities"), F.count_distinct("country_code").alias("countries"))
    figures = {
        "sources": manifests.agg(F.count_distinct("source_id")),
        "artifacts": manifests.agg(F.count_distinct("artifact_id")),
        "records": manifests.agg(F.sum("record_count")),
        "latest_retrieval": manifests.agg(F.max("retrieved_at")),
        "executions": executions.agg(F.count("*")),
        "completed": executions.agg(F.count_if(F.col("status") == "completed")),
        "designs": designs.agg(F.count("*")),
    }
    for name, figure in figures.items():
        one = one.withColumn(name, figure.scalar())
    return one
