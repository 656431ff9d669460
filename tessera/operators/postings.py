"""Trigram posting lists for substring search over large tables.

An index is two Parquet tables in a shared folder: ``postings(gram, field, ident)``, range-partitioned and sorted by
gram so that a search reads the few row groups whose statistics hold its grams, and ``sizes(gram, field, rows)``. A search
takes the rarest grams of its term, intersects their lists, and leaves it to the caller to verify the substring on
the rows found; terms below three letters have no gram and scan. Candidates always contain every hit.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.scalar import let, search_key
from tessera.session import shared_folder

GRAM = 3
#: Lists that a search intersects; the substring itself is verified on the rows, so fewer lists only mean more rows to verify.
RAREST = 4
#: Candidates that may be broadcast: an upper bound of their number is known from the sizes.
BROADCAST_IDS = 500_000
#: Postings that one range of an index holds, and one task sorts.
RANGE_ROWS = 2_000_000


def grams(text: Column) -> Column:
    """Distinct runs of three characters; null or shorter text has none."""
    # the text is bound first: an expression inside the runs would be evaluated once for each of them
    def runs(bound: Column) -> Column:
        every = F.transform(
            F.sequence(F.lit(1), F.length(bound) - (GRAM - 1)), lambda at: F.substring(bound, at, F.lit(GRAM))
        )
        return F.array_distinct(F.when(F.length(bound) >= GRAM, every).otherwise(F.array().cast("array<string>")))

    return let(text, runs)


def folded(column: str) -> Column:
    """Text of a column as the case-insensitive search sees it."""
    return F.lower(F.col(column).cast("string"))


def joined(columns) -> Column:
    """Text of several columns as the normalised search sees it."""
    return search_key(F.concat_ws(" ", *[F.col(c) for c in columns]))


@dataclass(frozen=True)
class TextIndex:
    """Where an index lies, and the column whose values identify rows."""

    folder: str
    ident: str

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/{name}")

    def candidates(self, spark: SparkSession, fields, needle: str) -> DataFrame | None:
        """Ids of rows with all chosen grams of ``needle`` in one of ``fields``; None where the index cannot tell.

        The rarest grams are chosen for each field apart. The result is marked for broadcast if the shortest lists,
        which bound it, are short enough.
        """
        wanted = sorted({needle[i:i + GRAM] for i in range(len(needle) - GRAM + 1)})
        if not wanted:
            return None
        asked = F.col("gram").isin(wanted) & F.col("field").isin(list(fields))
        # one row for each gram of the term and field at most
        sizes = self._table(spark, "sizes").filter(asked).select("field", "rows", "gram").collect()
        chosen, bound = [], 0
        for field in fields:
            lists = sorted((r["rows"], r["gram"]) for r in sizes if r["field"] == field)
            if len(lists) == len(wanted):
                bound += lists[0][0]
                chosen.append((field, [gram for _, gram in lists[:RAREST]]))
        read = self._table(spark, "postings")
        hit = F.lit(False)
        needed = F.lit(0)
        for field, picked in chosen:
            hit = hit | ((F.col("field") == field) & F.col("gram").isin(picked))
            needed = F.when(F.col("field") == field, len(picked)).otherwise(needed)
        ids = (
            read.filter(F.col("gram").isin(sorted({g for _, picked in chosen for g in picked}))).filter(hit)
            .groupBy("field", "ident").agg(F.count_distinct("gram").alias("_n")).filter(F.col("_n") == needed)
            .select(F.col("ident").alias(self.ident)).distinct()
        )
        return F.broadcast(ids) if bound <= BROADCAST_IDS else ids

    def narrowed(self, rows: DataFrame, fields, needle: str) -> DataFrame:
        """Rows that may hold ``needle``; all of them where the index cannot tell."""
        found = self.candidates(rows.sparkSession, fields, needle)
        return rows if found is None else rows.join(found, self.ident, "left_semi")


def build_index(rows: DataFrame, ident: str, fields: Mapping[str, Column], folder: str | None = None) -> TextIndex:
    """Index the given texts of all rows; ``fields`` names each text as a search will ask for it.

    Rows with a null id cannot be found through an index and are left out of it; repeated ids share their grams, which
    a list names once for each row, so that nothing is made distinct over the whole table. A common gram spreads over many files, as ranges include the id.
    """
    spark = rows.sparkSession
    folder = folder or f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    texts = F.explode(F.array(*[F.struct(F.lit(name).alias("field"), text.alias("text")) for name, text in fields.items()]))
    named = rows.filter(F.col(ident).isNotNull()).select(F.col(ident).alias("ident"), texts.alias("t")).select("ident", "t.*")
    # grams at most; a number of ranges left to the engine would make the sort of each grow with the table
    most = named.agg(F.sum(F.greatest(F.length("text") - (GRAM - 1), F.lit(0)))).first()[0] or 0
    ranges = max(spark.sparkContext.defaultParallelism, most // RANGE_ROWS + 1)
    # rows of a small file lie in one split; dealt first, all tasks make grams
    listed = named.repartition(ranges, "ident", "field").select("ident", "field", F.explode(grams(F.col("text"))).alias("gram"))
    order = ("gram", "field", "ident")
    listed.select(*order).repartitionByRange(ranges, *order).sortWithinPartitions(*order).write.mode("overwrite").parquet(f"{folder}/postings")
    counted = spark.read.parquet(f"{folder}/postings").groupBy("gram", "field").agg(F.count("*").alias("rows"))
    counted.repartitionByRange("gram", "field").sortWithinPartitions("gram", "field").write.mode("overwrite").parquet(f"{folder}/sizes")
    return TextIndex(folder, ident)
