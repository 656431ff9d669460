"""Session helpers: table loading and durable lineage cuts."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Read one landed parquet table; timestamps are interpreted in UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{directory}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where none is set a temporary one is, for local masters alone: elsewhere executors would write to their own disks.
    """
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            master = context.master
            if master != "local" and not master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        context.setCheckpointDir(folder)
        folder = context.getCheckpointDir()
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage through the cluster's shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# Rows that one task of a sized shuffle takes.
TASK_ROWS = 500_000
# Rows that may be broadcast, and parts that a key's rows are dealt into where the other table is larger.
SMALL_ROWS = 100_000
PARTS = 64


def sized(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` of that many rows dealt by its keys into as many tasks as keep each at ``TASK_ROWS``.

    An aggregate or a join on these keys follows the number, so the memory of a task stays as the input grows; a number
    left to the engine follows the session instead.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, rows // TASK_ROWS + 1), *keys)


def spread_join(large: DataFrame, small: DataFrame, keys: Sequence[str], within: str, limit: int = SMALL_ROWS, how: str = "inner") -> DataFrame:
    """Inner (or left) join on keys that very many rows of ``large`` may share, so that no key's rows meet in one task.

    ``small``, which is counted, is broadcast up to ``limit`` rows. Beyond, each of its rows is copied to all
    parts of its key, and the rows of ``large`` are dealt into these by the hash of ``within``.
    """
    small = durable(small)
    if small.count() <= limit:
        return large.join(F.broadcast(small), list(keys), how)
    dealt = large.withColumn("_part", F.pmod(F.xxhash64(within), F.lit(PARTS)).cast("int"))
    copied = small.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return dealt.join(copied, [*keys, "_part"], how).drop("_part")
