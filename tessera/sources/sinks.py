"""Table and text sinks in canonical order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalar import fmt_metric


def write_csv(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Ledger as CSV parts whose concatenation is in order (a range sort, not one task)."""
    df.orderBy(*order).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str, order: Sequence[str]) -> None:
    df.orderBy(*order).write.mode("overwrite").json(path)


def write_parquet(df: DataFrame, path: str, partition: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition).parquet(path)


def write_layout(df: DataFrame, path: str, partition: Sequence[str], order: Sequence[str]) -> None:
    """Sorted Parquet files with disjoint ranges of ``order`` inside each partition, by a range shuffle over both.

    Only partitions that ``df`` has rows of are replaced, so a ledger is mended by the partition and a rerun changes nothing.
    A large partition spreads over many files; an empty table writes nothing.
    """
    spread = df.repartitionByRange(*partition, *order).sortWithinPartitions(*partition, *order)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def layout_manifest(written: DataFrame, partition: Sequence[str], order: str) -> DataFrame:
    """(partition, path, bytes, record_count, first, last) of each file behind a table read from a layout."""
    file = F.col("_metadata")
    rows = written.select(*partition, file["file_path"].alias("path"), file["file_size"].alias("bytes"), F.col(order).alias("_key"))
    return rows.groupBy(*partition, "path", "bytes").agg(
        F.count("*").alias("record_count"), F.min("_key").alias("first"), F.max("_key").alias("last")
    )


def write_text(df: DataFrame, path: str, text: str = "text") -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def bullets(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda i: F.concat(F.lit("- "), i)), "\n")


def render_brief(packs: DataFrame) -> DataFrame:
    """One markdown brief per pack.

    Needs ``pack_id, title, city_id, status, observed_requests, selected_option_id, failure_reason,
    limitations, next_evidence``.
    """
    outcome = F.when(
        F.col("status") == "completed", F.concat(F.lit("Selected option: "), F.col("selected_option_id"))
    ).otherwise(F.concat(F.lit("No recommendation: "), F.coalesce("failure_reason", F.lit("no reason recorded"))))
    text = F.concat_ws(
        "\n\n",
        F.concat(F.lit("# "), F.col("title")),
        F.concat(F.lit("City: "), F.col("city_id")),
        F.concat(F.lit("Observed requests: "), F.format_number("observed_requests", 0)),
        F.concat(F.lit("Status: "), F.col("status")), outcome,
        F.concat(F.lit("## Limitations\n"), bullets(F.col("limitations"))),
        F.concat(F.lit("## Evidence needed next\n"), bullets(F.col("next_evidence"))),
    )
    return packs.select("pack_id", text.alias("text"))


def render_table(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Markdown table lines of a comparison, one line per row, numbers in the metric format."""
    types = dict(df.dtypes)
    cells = [fmt_metric(F.col(c)) if types[c] in ("double", "float", "bigint", "int") else F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in columns]
    return df.select(F.col(key), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("text"))
