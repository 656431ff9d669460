"""Helpers on whole tables."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two longs that may be broadcast, some tens of MB once hashed.
KEY_ROWS = 500_000


def small(df: DataFrame, limit: int = KEY_ROWS) -> DataFrame:
    """A side of a join, broadcast only if its counted rows are within the limit; else Spark shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of results that nothing refers to any more.

    It acts when the driver collects its garbage, which a driver with little to do may not for long; files of finished steps
    would then lie beside those of the next.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def quoted(names: list[str]) -> list[str]:
    return [f"`{n}`" for n in names]


def free_names(columns: list[str], *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to clash with no column (in any case)."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
