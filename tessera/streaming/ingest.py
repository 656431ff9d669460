"""Streaming forms: verified ingest of new landed files, and the day x category view."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.hashing import PREFIX
from tessera.functions.scalar import norm_dim
from tessera.sources.integrity import verify_artifacts


def landed_stream(spark: SparkSession, path: str) -> DataFrame:
    """New landed files, each seen once, with their digest."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true").load(path)
        .select(
            F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
            F.concat(F.lit(PREFIX), F.sha2("content", 256)).alias("actual_hash"),
            F.col("content").cast("string").alias("content"),
        )
    )


def landed_records(spark: SparkSession, path: str) -> DataFrame:
    """New landed records (name, content) of Parquet files below ``path``, each file seen once, with their digest."""
    return (
        spark.readStream.schema("name string, content string").parquet(path)
        .select(
            "name", F.octet_length("content").cast("long").alias("bytes"),
            F.concat(F.lit(PREFIX), F.sha2(F.col("content").cast("binary"), 256)).alias("actual_hash"), "content",
        )
    )


def ingest_stream(
    landed: DataFrame, manifests: DataFrame, output: str, checkpoint: str, written: Callable[[int], None] | None = None
) -> StreamingQuery:
    """Append the landed rows (name, bytes, actual_hash, content) that match their manifest; process what there is and stop.

    The stream's checkpoint remembers what was seen, and every batch is written under its own number, so a batch
    replayed after a failure replaces itself and does not append twice. ``written`` is called between the write of
    a batch and its commit, for a ledger of batches. Rows without a manifest, or whose digest differs, are left out.
    """
    def land(batch: DataFrame, number: int) -> None:
        status = verify_artifacts(batch.select("name", "actual_hash"), manifests).filter("status = 'verified'")
        # equal names and digests verify once
        good = batch.join(
            status.select(F.col("artifact_path").alias("name"), "actual_hash", "artifact_id").distinct(), ["name", "actual_hash"]
        )
        good.write.mode("overwrite").parquet(f"{output}/batch={number}")
        if written is not None:
            written(number)

    return (
        landed.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ingest_new(
    spark: SparkSession, landing: str, manifests: DataFrame, output: str, checkpoint: str
) -> StreamingQuery:
    """:func:`ingest_stream` over the files below ``landing``, each one artifact."""
    return ingest_stream(landed_stream(spark, landing), manifests, output, checkpoint)


def daily_category_stream(requests: DataFrame, late: str = "1 day") -> DataFrame:
    """Day x category counts of a request stream; rows later than the watermark are dropped.

    Event time must be TIMESTAMP (a zone-less column is refused by the watermark). A day comes out
    once it is closed, so it equals the batch view of the same day.
    """
    return (
        requests.withWatermark("created", late)
        .groupBy(F.window("created", "1 day"), "city", norm_dim(F.col("category")).alias("category"))
        .agg(F.count("*").alias("request_count"))
        .select("city", F.col("window.start").cast("date").alias("service_day"), "category", "request_count")
    )


def run_available(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process everything available into parquet and stop."""
    return (
        stream.writeStream.outputMode("append").format("parquet").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
