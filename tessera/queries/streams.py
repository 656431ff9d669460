"""Streams bound to the test tables: each runs to the end of what has landed, and its sink is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.session import shared_folder, table
from tessera.streaming import ingest


def _run_folder(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def q_streamed_days(spark, sf):
    """Closed days of the event stream."""
    folder = _run_folder(spark, "streamed-days")
    schema = table(spark, sf, "events").schema
    # a glob, as a stream reads folders and the table may be one file
    events = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    rows = events.select(
        F.concat(F.lit("user-"), F.col("user_id") % 10).alias("city"), F.col("ts").cast("timestamp").alias("created"),
        F.when(F.col("event_type") != "view", F.concat(F.lit(" "), "event_type")).alias("category"),
    )
    ingest.run_available(ingest.daily_category_stream(rows), f"{folder}/days", f"{folder}/seen").awaitTermination()
    return spark.read.parquet(f"{folder}/days")


def q_streamed_ingest(spark, sf):
    """Documents land in two parts; each run takes what is new, and only what its manifest vouches for."""
    folder = _run_folder(spark, "streamed-ingest")
    documents = table(spark, sf, "documents")
    name = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"))
    digest = F.sha2(F.when(F.col("lang") == "es", F.upper("text")).otherwise(F.col("text")).cast("binary"), 256)
    manifests = documents.select(
        F.col("doc_id").alias("artifact_id"), name.alias("artifact_path"), F.concat(F.lit("sha256:"), digest).alias("content_hash")
    )
    early = F.coalesce(F.col("source") <= "src1", F.lit(False))
    for part in (early, ~early):
        documents.filter(part).select(name.alias("name"), F.col("text").alias("content")).write.mode("append").parquet(
            f"{folder}/landed"
        )
        landed = ingest.landed_records(spark, f"{folder}/landed")
        ingest.ingest_stream(landed, manifests, f"{folder}/ledger", f"{folder}/seen").awaitTermination()
    ledger = spark.read.parquet(f"{folder}/ledger")
    return ledger.select("name", "artifact_id", "bytes", "actual_hash", F.col("batch").cast("long").alias("batch"))


QUERIES = {"streamed_days": q_streamed_days, "streamed_ingest": q_streamed_ingest}

ORACLES = {
    "streamed_days": """WITH e AS (SELECT 'user-' || user_id % 10 AS city, CAST(ts AS DATE) AS service_day,
          CASE WHEN event_type <> 'view' THEN event_type ELSE '(missing)' END AS category, ts FROM events)
        SELECT city, service_day, category, count(*) AS request_count FROM e
        WHERE service_day + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY GROUP BY 1, 2, 3""",
    "streamed_ingest": """SELECT 'docs/' || doc_id AS name, doc_id AS artifact_id, CAST(strlen(text) AS BIGINT) AS bytes,
        'sha256:' || sha256(text) AS actual_hash, CAST(CASE WHEN coalesce(source <= 'src1', false) THEN 0 ELSE 1 END AS BIGINT) AS batch
        FROM documents WHERE CASE WHEN lang = 'es' THEN upper(text) ELSE text END = text""",
}
