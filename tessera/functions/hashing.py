"""Content hashes: one contract for rows, artifact sets and named inputs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import merkle

PREFIX = "sha256:"


def digest(text: Column) -> Column:
    return F.concat(F.lit(PREFIX), F.sha2(text.cast("binary"), 256))


def content_hash(names: Sequence[str]) -> Column:
    """Hash of a row: keys sorted, nulls dropped, compact JSON."""
    return digest(F.to_json(F.struct(*[F.col(name) for name in sorted(names)])))


def set_hash(entries: Column, ident: str = "id", hashed: str = "hash") -> Column:
    """Hash over a short array of structs with an id and a hash, independent of their order."""
    ordered = F.sort_array(entries)
    return digest(F.array_join(F.transform(ordered, lambda e: F.concat(e[ident], F.lit("="), e[hashed])), ","))


def artifact_set_hash(df: DataFrame, group: Sequence[str], ident: str, hashed: str) -> DataFrame:
    """(group, artifacts, set_hash): order-free hash of the artifacts of each group, the root of a Merkle tree.

    No aggregate holds more than a leaf's lines or a node's children, so a group may have any size. A repeated
    artifact counts with its number.
    """
    line = F.concat(F.coalesce(F.col(ident).cast("string"), F.lit("")), F.lit("="), F.coalesce(F.col(hashed), F.lit("")))
    found = merkle.roots(merkle.set_leaves(df, group, line), group)
    return found.select(
        *group, F.col("rows").alias("artifacts"), F.concat(F.lit(PREFIX), "hash").alias("set_hash")
    )


def fingerprint(inputs: Mapping[str, DataFrame]) -> DataFrame:
    """One row: hash over named inputs, each the root of the tree of its rows, and their number of rows.

    Rows count as JSON with sorted keys, without nulls; an empty input has the hash of nothing.
    """
    parts = []
    for name in sorted(inputs):
        df = inputs[name]
        line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]))
        root = merkle.roots(merkle.set_leaves(df, [], line), [])
        parts.append(root.agg(
            F.coalesce(F.first("hash"), F.lit("")).alias("_h"), F.coalesce(F.first("rows"), F.lit(0)).alias("_n")
        ).withColumn("_name", F.lit(name)))
    rows = reduce(DataFrame.unionByName, parts)
    return rows.agg(
        F.count("*").alias("inputs"), F.sum("_n").alias("rows"), set_hash(F.collect_list(F.struct("_name", "_h")), "_name", "_h").alias("fingerprint")
    )


def short_key(text: Column, length: int = 12) -> Column:
    """First hex digits of the digest, the readable part of a run key."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, length)


def seed_of(text: Column) -> Column:
    """First eight hex digits of the digest as an integer seed."""
    return F.conv(short_key(text, 8), 16, 10).cast("long")
