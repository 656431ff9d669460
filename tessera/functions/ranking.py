"""Ranks and quantiles that never put one whole group into one task.

A plain ``row_number() over (partition by g order by k)`` sends every row of ``g`` to one task.
The helpers here first range-partition on the full order (whose last column is unique, so no key
is hot), number rows inside each range, and add the sizes of the ranges in front.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import durable, spread_join

# Number of value bins a group is cut into when a quantile is located.
QUANTILE_BINS = 4096


def global_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[Column],
    rank_col: str = "rank",
    size_col: str | None = None,
) -> DataFrame:
    """Exact contiguous rank per group over a total order, split over ranges.

    The range-partitioned rows are checkpointed, because a range boundary drawn twice (from two
    samples) would number rows twice.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(name) for name in group]
    ranged = durable(
        df.repartitionByRange(partitions, *[*keys, *order]).withColumn(
            "_slice", F.spark_partition_id()
        )
    )
    by_slice = [*group, "_slice"]
    sizes = ranged.groupBy(*by_slice).agg(F.count("*").alias("_slice_rows"))
    scope = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = scope.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    # one row per (group, slice): at most one row per shuffle partition and group
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_slice_rows").over(before), F.lit(0)))
    if size_col is not None:
        offsets = offsets.withColumn(size_col, F.sum("_slice_rows").over(scope))
    local = F.row_number().over(W.partitionBy(*by_slice).orderBy(*order))
    return (
        ranged.withColumn("_local", local)
        .join(offsets.drop("_slice_rows"), by_slice)
        .withColumn(rank_col, (F.col("_local") + F.col("_before")).cast("long"))
        .drop("_local", "_before", "_slice")
    )


def running_max(df: DataFrame, group: Sequence[str], order: Sequence[str], value: str, name: str = "running") -> DataFrame:
    """Adds the greatest ``value`` of the group's rows up to and including each row in the total order, split over ranges.

    Each range takes the maxima of the ranges in front from a table with one row for each of its groups, so a
    group may have any number of rows. Nulls of ``value`` count for nothing.
    """
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = durable(
        df.repartitionByRange(partitions, *group, *order).withColumn("_slice", F.spark_partition_id())
    )
    by_slice = [*group, "_slice"]
    before = (W.partitionBy(*group) if group else W.partitionBy(F.lit(0))).orderBy("_slice").rowsBetween(
        W.unboundedPreceding, -1
    )
    tops = ranged.groupBy(*by_slice).agg(F.max(value).alias("_top")).select(*by_slice, F.max("_top").over(before).alias("_front"))
    local = F.max(value).over(W.partitionBy(*by_slice).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        ranged.withColumn("_local", local).join(tops, by_slice)
        .withColumn(name, F.greatest("_local", "_front")).drop("_local", "_front", "_slice")
    )


def exact_quantiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float],
    nearest: bool = False,
) -> DataFrame:
    """Linear-interpolated quantiles at position ``(n - 1) * p``, exact for any group size.

    With ``nearest`` the value at rank ``ceil(n * p)`` is taken instead.

    Rows are counted per distinct value, values are binned on a monotone scale between the group's
    bounds, and only the bins that hold a wanted position are sorted. Returns one row per group and
    probability: ``probability, quantile``.
    """
    group = list(group)
    # read three times below, so whatever produces the values is computed once
    counted = durable(
        df.filter(F.col(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count("*").alias("_n"))
    )
    scale = F.signum("_v") * F.log1p(F.abs(F.col("_v")))
    scaled = counted.withColumn("_s", scale)
    bounds = scaled.groupBy(*group).agg(
        F.min("_s").alias("_lo"), F.max("_s").alias("_hi"), F.sum("_n").alias("_total")
    )
    binned = _join_group(scaled, bounds, group).withColumn(
        "_bin",
        F.when(F.col("_hi") > F.col("_lo"), F.floor(
            (F.col("_s") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * QUANTILE_BINS
        )).otherwise(F.lit(0)).cast("long"),
    )
    scope = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    running = scope.orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    # at most QUANTILE_BINS + 1 rows per group
    histogram = (
        binned.groupBy(*group, "_bin")
        .agg(F.sum("_n").alias("_in_bin"), F.first("_total").alias("_total"))
        .withColumn("_upto", F.sum("_in_bin").over(running))
        .withColumn("_before", F.col("_upto") - F.col("_in_bin"))
    )
    wanted = F.explode(
        F.array(*[
            F.struct(F.lit(float(p)).alias("probability"), F.lit(side).alias("_side"))
            for p in probabilities for side in (0, 1)
        ])
    )
    targets = (
        histogram.withColumn("_w", wanted)
        .select("*", "_w.probability", "_w._side")
        .withColumn(
            "_pos",
            F.greatest(F.lit(0.0), F.ceil(F.col("_total") * F.col("probability")) - 1).cast("double")
            if nearest else (F.col("_total") - 1) * F.col("probability"),
        )
        .withColumn(
            "_index",
            F.least(F.floor("_pos") + F.col("_side"), F.col("_total") - 1).cast("long"),
        )
        .filter((F.col("_index") >= F.col("_before")) & (F.col("_index") < F.col("_upto")))
        .groupBy(*group, "_bin")
        .agg(
            F.first("_before").alias("_before"),
            F.collect_list(F.struct("probability", "_side", "_index", "_pos")).alias("_wanted"),
        )
    )
    in_bin = W.partitionBy(*group, "_bin").orderBy("_v").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    located = (
        binned.select(*group, "_bin", "_v", "_n")
        .join(targets, [*group, "_bin"])
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_bin))
        .withColumn("_begin", F.col("_end") - F.col("_n"))
        .withColumn("_hit", F.explode("_wanted"))
        .filter(
            (F.col("_hit._index") >= F.col("_begin")) & (F.col("_hit._index") < F.col("_end"))
        )
    )
    low = F.max(F.when(F.col("_hit._side") == 0, F.col("_v")))
    high = F.max(F.when(F.col("_hit._side") == 1, F.col("_v")))
    fraction = F.max(F.col("_hit._pos") - F.floor("_hit._pos"))
    return located.groupBy(*group, F.col("_hit.probability").alias("probability")).agg(
        (low + fraction * (high - low)).alias("quantile")
    )


def _join_group(left: DataFrame, right: DataFrame, group: Sequence[str]) -> DataFrame:
    """Attach one row per group to values ``_v``; without a group key the single row is attached by a constant."""
    if group:
        return spread_join(left, right, group, "_v")
    return left.withColumn("_one", F.lit(1)).join(
        F.broadcast(right.withColumn("_one", F.lit(1))), "_one"
    ).drop("_one")


def median(df: DataFrame, group: Sequence[str], value: str, name: str = "median") -> DataFrame:
    return exact_quantiles(df, group, value, [0.5]).select(*group, F.col("quantile").alias(name))
