"""Sharding by a permutation-filled lookup table, with DataFrame functions only on the main path."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ShardConfig:
    """``slots`` is prime and far larger than ``shards``; it bounds the size of what is broadcast."""

    shards: int = 64
    slots: int = 65_537
    seed: str = "shard"


@lru_cache(maxsize=8)
def lookup_table(names: tuple[str, ...], slots: int) -> tuple[int, ...]:
    """Shard index of every slot.

    Each shard's preference order is a permutation of the slots, ``offset + k * skip`` modulo a prime; shards take
    turns and each claims its most preferred free slot. Shares differ by one slot at most, and a shard that comes or
    goes moves few slots of the others.
    """
    if slots < max(2, len(names)) or any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError("slots must be a prime, at least as many as shards")
    if not names:
        raise ValueError("no shards")
    cursors = []
    for name in names:
        digest = hashlib.md5(name.encode()).digest()
        cursors.append((int.from_bytes(digest[:8], "big") % slots, int.from_bytes(digest[8:], "big") % (slots - 1) + 1))
    places, table, left = [c[0] for c in cursors], [-1] * slots, slots
    while left:
        for shard, (_, skip) in enumerate(cursors):
            while table[places[shard]] >= 0:
                places[shard] = (places[shard] + skip) % slots
            table[places[shard]] = shard
            left -= 1
            if not left:
                break
    return tuple(table)


def shard_names(config: ShardConfig) -> tuple[str, ...]:
    return tuple(f"{config.seed}-{k}" for k in range(config.shards))


def placement_key(doc_id: Column, text: Column) -> Column:
    """A document's id, or for one without, its text."""
    return F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.coalesce(text, F.lit(""))))


def slot_of(key: Column, slots: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots


def table_rows(spark: SparkSession, config: ShardConfig) -> DataFrame:
    """(slot, shard), ``slots`` rows."""
    entries = F.split(F.lit(",".join(map(str, lookup_table(shard_names(config), config.slots)))), ",")
    return spark.range(config.slots).select(
        F.col("id").alias("slot"), F.element_at(entries, (F.col("id") + 1).cast("int")).cast("int").alias("shard")
    )


def place(documents: DataFrame, config: ShardConfig = ShardConfig()) -> DataFrame:
    """The rows of ``documents`` with ``slot`` and ``shard`` (replacing columns of these names), by one broadcast join.

    The place depends on doc_id alone (on the text where it is null), so repeated rows and copies of a
    document share a shard, and reruns agree. An empty table gives an empty result.
    """
    own = [c for c in documents.columns if c not in ("slot", "shard")]
    keyed = documents.select(
        *[f"`{c}`" for c in own],
        slot_of(placement_key(F.col("doc_id"), F.col("text")), config.slots).alias("slot"),
    )
    table = F.broadcast(table_rows(documents.sparkSession, config))  # exactly ``slots`` rows
    return keyed.join(table, "slot").select(*[f"`{c}`" for c in own], "slot", "shard")


def write_shards(placed: DataFrame, path: str, files_per_shard: int = 8) -> None:
    """Parquet folders by shard, each of up to ``files_per_shard`` files, so a shard isn't one task's work."""
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(files_per_shard))
    placed.repartition("shard", spread).write.partitionBy("shard").parquet(path)


def place_sql(config: ShardConfig = ShardConfig()) -> str:
    table = ",".join(map(str, lookup_table(shard_names(config), config.slots)))
    return f"""
        WITH places AS (SELECT string_split('{table}', ',') AS shards),
        keyed AS (
            SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'text:' || coalesce(text, ''))), 1, 15)
                AS BIGINT) % {config.slots} AS slot
            FROM documents
        )
        SELECT doc_id, slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM keyed, places
    """
