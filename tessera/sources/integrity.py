"""Artifact verification, checksum inventories, incremental ingest and output manifests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.hashing import PREFIX
from tessera.functions.scalar import reasons


def hashed_files(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """Relative name, size and digest of every file below ``path``; contents stay in the tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    root = path.rstrip("/") + "/"
    return files.select(
        F.element_at(F.split("path", F.concat(F.lit("\\Q"), F.lit(root), F.lit("\\E"))), -1).alias("name"),
        F.col("length").alias("bytes"),
        F.concat(F.lit(PREFIX), F.sha2("content", 256)).alias("actual_hash"),
    )


def safe_relative(path: Column) -> Column:
    """Relative path that cannot leave its root."""
    return ~(path.startswith("/") | path.contains("\\") | path.rlike(r"(^|/)\.\.(/|$)") | (F.trim(path) == ""))


def verify_artifacts(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """Status of every manifest: verified, missing, hash mismatch or unsafe path.

    ``files(name, actual_hash)``, ``manifests(artifact_id, artifact_path, content_hash)``.
    """
    rows = manifests.join(files.select("name", "actual_hash"), F.col("artifact_path") == F.col("name"), "left")
    status = (
        F.when(~safe_relative(F.col("artifact_path")), "unsafe-path")
        .when(F.col("actual_hash").isNull(), "missing")
        .when(F.col("actual_hash") != F.col("content_hash"), "hash-mismatch")
        .otherwise("verified")
    )
    return rows.select("artifact_id", "artifact_path", "content_hash", "actual_hash", status.alias("status"))


def verify_checksums(files: DataFrame, lines: DataFrame) -> DataFrame:
    """Checksum list (``<hex>  <name>`` lines) against the files: one row per disagreement."""
    parts = F.split(F.trim("value"), r"\s+", 2)
    listed = lines.filter(F.trim("value") != "").select(
        F.get(parts, F.lit(0)).alias("hex"), F.get(parts, F.lit(1)).alias("name")
    )
    per = listed.groupBy("name").agg(F.count("*").alias("copies"), F.min("hex").alias("hex"))
    both = per.join(files.select("name", "actual_hash"), "name", "full_outer")
    issue = (
        F.when(F.col("copies") > 1, "listed more than once")
        .when(F.col("actual_hash").isNull(), "listed file is missing")
        .when(F.col("copies").isNull(), "file is not listed")
        .when(F.concat(F.lit(PREFIX), F.col("hex")) != F.col("actual_hash"), "hash differs")
    )
    return both.select("name", issue.alias("issue")).filter(F.col("issue").isNotNull())


def new_artifacts(landed: DataFrame, processed: DataFrame) -> DataFrame:
    """Manifests not yet verified for the same source, window and content."""
    keys = ["source_id", "window_start", "window_end", "content_hash"]
    done = processed.filter(F.col("status") == "verified").select(*keys)
    return landed.join(done, keys, "left_anti")


# Media types by file ending.
MEDIA = {
    "json": "application/json", "csv": "text/csv", "md": "text/markdown", "geojson": "application/geo+json",
    "parquet": "application/vnd.apache.parquet", "txt": "text/plain",
}


def artifact_manifest(files: DataFrame, record_counts: DataFrame | None = None) -> DataFrame:
    """Manifest of written outputs: path, media type, bytes, hash and record count."""
    media = F.create_map(*[F.lit(x) for pair in MEDIA.items() for x in pair])
    ending = F.lower(F.element_at(F.split("name", r"\."), -1))
    rows = files.select(
        F.col("name").alias("path"), F.coalesce(F.try_element_at(media, ending), F.lit("application/octet-stream")).alias("media_type"),
        "bytes", F.col("actual_hash").alias("content_hash"),
    )
    if record_counts is not None:
        rows = rows.join(record_counts, "path", "left")
    return rows


def manifest_issues(manifest: DataFrame, declared_count: int) -> DataFrame:
    """One row: unsafe or repeated paths and a wrong artifact count."""
    per = manifest.groupBy("path").agg(F.count("*").alias("n"))
    return per.agg(
        F.sum("n").alias("artifacts"), F.count_if(F.col("n") > 1).alias("repeated"),
        F.count_if(~safe_relative(F.col("path"))).alias("unsafe"),
    ).select("artifacts", reasons(
        (F.col("artifacts") != declared_count, "artifact count differs"),
        (F.col("repeated") > 0, "paths repeat"), (F.col("unsafe") > 0, "paths are unsafe"),
    ).alias("issues"))
