"""Ranking, selection, paging, uniqueness and set comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def select_breadth_first(df: DataFrame, group: str, score: str, ident: str, n: int) -> DataFrame:
    """Best row of every group first (in global order, at most ``n``), then the best of the rest.

    Leaders come from a partial aggregate with one row per group; the fill is a distributed top-n.
    Only the at most ``n`` selected rows are numbered in one place.
    """
    if n < 1:
        raise ValueError("n must be positive")
    best = df.groupBy(group).agg(
        F.min_by(ident, F.struct((-F.col(score)).alias("s"), F.col(ident))).alias(ident)
    ).withColumn("_leader", F.lit(True))
    marked = df.join(best.select(ident, "_leader"), ident, "left").withColumn(
        "selection_basis",
        F.when(F.col("_leader"), "group-leader").otherwise("global-fill"),
    ).drop("_leader")
    order = [F.col("selection_basis") != "group-leader", F.desc(score), F.col(ident)]
    chosen = marked.orderBy(*order).limit(n)
    return chosen.withColumn("selection_rank", F.row_number().over(W.orderBy(*order)))


def first_eligible(df: DataFrame, rank: str, eligible: str, n: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` eligible rows in rank order, and the ineligible ones ranked before the last.

    Exclusions after the target are not listed. Fewer than ``n`` eligible rows is visible in the
    ``status`` of every selected row.
    """
    leading = df.filter(F.col(eligible)).orderBy(rank).limit(n)
    order = W.orderBy(rank)  # at most n rows
    selected = leading.withColumn("selection_order", F.row_number().over(order)).withColumn(
        "status", F.when(F.count("*").over(W.orderBy(F.lit(1))) == n, "complete").otherwise("short")
    )
    last = leading.agg(F.max(rank).alias("m"), F.count("*").alias("c"))
    cut = last.select(F.when(F.col("c") == n, F.col("m")).otherwise(F.lit(2**62))).scalar()
    excluded = df.filter(~F.col(eligible)).filter(F.col(rank) < cut)
    return selected, excluded


def paginate(df: DataFrame, order: Sequence[Column | str], limit: int = 25, offset: int = 0) -> DataFrame:
    """One page in a stable order with the page facts on every row.

    The page is a distributed top-k; the total is one aggregate attached as a scalar.
    """
    if not 1 <= limit <= 100 or offset < 0:
        raise ValueError("limit must lie in 1..100 and offset be nonnegative")
    total = df.agg(F.count("*")).scalar()
    page = df.orderBy(*order).offset(offset).limit(limit)
    position = F.row_number().over(W.orderBy(*order))  # at most 100 rows
    following = F.lit(offset) + F.lit(limit)
    return page.withColumn("position", (position + offset).cast("long")).withColumn(
        "total", total
    ).withColumn("next_offset", F.when(F.col("total") > following, following.cast("long")))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def canonical_order(df: DataFrame, *names: str) -> DataFrame:
    """Stable order by the lower-cased text of each key."""
    return df.orderBy(*[F.lower(F.col(n).cast("string")) for n in names], *names)


def calendar_check(series: DataFrame, start, days: int, parameters: Sequence[str]) -> DataFrame:
    """Per artifact: do all parameters cover exactly the expected days, and how many days align.

    Input ``artifact_id, parameter, day, value``.
    """
    first = F.lit(start).cast("date")
    inside = (F.col("day") >= first) & (F.col("day") < F.date_add(first, days))
    wanted = series.filter(F.col("parameter").isin(list(parameters)))
    by_day = wanted.groupBy("artifact_id", "day").agg(
        F.count_distinct("parameter").alias("_parameters"), F.count("*").alias("_values")
    )
    return by_day.groupBy("artifact_id").agg(
        F.sum("_values").alias("values"),
        F.count_if(F.col("_parameters") == len(parameters)).alias("aligned_days"),
        F.count_if(inside & (F.col("_parameters") == len(parameters))).alias("complete_days"),
        F.count_if(~inside).alias("unexpected_days"),
    ).withColumn(
        "calendar_complete",
        (F.col("complete_days") == days) & (F.col("unexpected_days") == 0)
        & (F.col("values") == days * len(parameters)),
    )


def missing_ids(requested: DataFrame, seen: DataFrame, ident: str) -> DataFrame:
    """Requested ids that were never seen."""
    return requested.select(ident).distinct().join(seen.select(ident), ident, "left_anti")
