"""Merkle trees over tables: one root per group, and a walk that finds where two tables differ.

A leaf holds the rows of one slot and hashes their lines in order; a node above hashes its children's slots and hashes.
The shape depends on slots alone and never on partitions or on how many rows there are, so trees of two tables can be
walked against each other. Every level is one grouped aggregate of at most ``2 ** FANOUT_BITS`` children per node.

Sets take the slot from a line's own digest, which spreads any input, and repeated lines become one line with their
number. Ordered rows take it from their position.

Where only roots are wanted, :func:`dealt` brings the rows of a branch of an ordered tree to one task before anything is
hashed; leaves and the levels up to the branch (:func:`branches`) then need no shuffle, and neither hashes nor leaves
are written anywhere.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.session import durable

#: Fixed shape, on which hashes depend: 64 children a node; sets have 24 bits of slots, ordered rows up to 36.
FANOUT_BITS = 6
SLOT_BITS = 24
SET_LEVELS = 4
ORDERED_LEVELS = 6

# Rows that one task takes of rows dealt by branch, and branches that each task should have at least, to be evenly filled.
BRANCH_TASK_ROWS = 200_000
TASK_BRANCHES = 16
# Levels above its leaves that a branch may have; hashes do not depend on it.
BRANCH_LEVELS = 2


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _slot_of(line: Column) -> Column:
    return F.conv(F.substring(sha(line), 1, SLOT_BITS // 4), 16, 10).cast("long")


def set_leaves(df: DataFrame, group: Sequence[str], line: Column) -> DataFrame:
    """(group, slot, hash, rows): leaves of the multiset of lines of each group; a null line counts as empty."""
    folded = df.select(*group, F.coalesce(line, F.lit("")).alias("_line")).groupBy(*group, "_line").agg(
        F.count("*").alias("_n")
    )
    text = F.concat_ws(" x", "_line", F.col("_n").cast("string"))
    return folded.groupBy(*group, _slot_of(F.col("_line")).alias("slot")).agg(
        sha(F.array_join(F.sort_array(F.collect_list(text)), "\n")).alias("hash"), F.sum("_n").alias("rows")
    )


def slot_at(position: Column, span: int) -> Column:
    """Slot of a position of ordered rows."""
    return F.floor(position / span).cast("long")


def ordered_leaves(df: DataFrame, group: Sequence[str], position: Column, order: Sequence[str], text: Column, span: int) -> DataFrame:
    """Leaves over rows in order: a slot is ``span`` positions, from 0 to below ``span * 2 ** 36``.

    Rows of a slot are ordered by ``order``, then by their text; each position should have few rows, as a slot is one
    aggregate.
    """
    rows = df.select(
        *group, slot_at(position, span).alias("slot"),
        F.struct(*order, F.unhex(sha(F.coalesce(text, F.lit("")))).alias("_h")).alias("_row"),
    )
    return rows.groupBy(*group, "slot").agg(
        sha(F.array_join(F.transform(F.sort_array(F.collect_list("_row")), lambda r: F.lower(F.hex(r["_h"]))), ",")).alias("hash"),
        F.count("*").alias("rows"),
    )


def dealt(df: DataFrame, group: Sequence[str], position: Column, span: int) -> tuple[DataFrame, int]:
    """``df`` with the ``branch`` of each row, dealt so that a branch is in one task, and a branch's levels above its leaves.

    Branches are as high as leaves enough of them (counted approximately, in one pass) for every task, so a group of
    any size is spread over tasks.
    """
    def branch(levels: int) -> Column:
        return F.shiftright(slot_at(position, span), FANOUT_BITS * levels)

    heights = range(1, BRANCH_LEVELS + 1)
    found = df.agg(
        F.count("*").alias("rows"), *[F.approx_count_distinct(F.xxhash64(*group, branch(k))).alias(f"at{k}") for k in heights]
    ).first()
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, found["rows"] // BRANCH_TASK_ROWS + 1)
    levels = max((k for k in heights if found[f"at{k}"] >= TASK_BRANCHES * tasks), default=0)
    return df.withColumn("branch", branch(levels)).repartition(tasks, *group, "branch"), levels


def gathered(rows: DataFrame, keys: Sequence[str], order: str, text: Column, flags: Sequence[str] = ()) -> DataFrame:
    """(keys, hash, rows, flags): the hash of the texts of each key's rows in order, their sum of ``rows``, whether all have a flag.

    For rows that :func:`dealt` brought together: a window sorts a task's rows once and takes each key as it comes, where
    an aggregate would hold, sort and merge its lists twice.
    """
    sorted_rows = W.partitionBy(*keys).orderBy(order)
    whole = sorted_rows.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return rows.withColumn("_text", text).select(
        *keys, F.collect_list("_text").over(whole).alias("_texts"), F.sum("rows").over(whole).alias("rows"),
        *[F.bool_and(c).over(whole).alias(c) for c in flags], F.row_number().over(sorted_rows).alias("_at"),
    ).filter("_at = 1").select(*keys, sha(F.array_join("_texts", ",")).alias("hash"), "rows", *flags)


def branches(leaves: DataFrame, group: Sequence[str], levels: int, flags: Sequence[str] = ()) -> DataFrame:
    """(group, slot, hash, rows, flags): the top of each branch of leaves with ``branch`` that :func:`dealt` brought together."""
    keys = [*group, "branch", "_up"]
    for _ in range(levels):
        children = leaves.withColumn("_up", F.shiftright("slot", FANOUT_BITS))
        leaves = gathered(children, keys, "slot", _child(), flags).withColumnRenamed("_up", "slot")
    return leaves.drop("branch")


def _child() -> Column:
    return F.concat_ws(":", "slot", "hash")


def tree(leaves: DataFrame, group: Sequence[str], levels: int) -> list[DataFrame]:
    """Levels of (group, slot, hash, rows) from the root of each group (slot 0) down to the leaves."""
    out = [durable(leaves)]
    child = F.struct("slot", _child().alias("_t"))
    for _ in range(levels):
        out.append(out[-1].groupBy(*group, F.shiftright("slot", FANOUT_BITS).alias("_up")).agg(
            sha(F.array_join(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["_t"]), ",")).alias("hash"),
            F.sum("rows").alias("rows"),
        ).withColumnRenamed("_up", "slot"))
    return out[::-1]


def roots(leaves: DataFrame, group: Sequence[str], levels: int = SET_LEVELS) -> DataFrame:
    """(group, hash, rows): the root of each group."""
    return tree(leaves, group, levels)[0].drop("slot")


def differing_slots(left: DataFrame, right: DataFrame, group: Sequence[str], levels: int = SET_LEVELS) -> DataFrame:
    """(group, slot, left_rows, right_rows): leaves that differ or that one side lacks (no rows there).

    The walk goes from the roots down and compares only children of nodes that differ.
    """
    open_nodes = None
    for a, b in zip(tree(left, group, levels), tree(right, group, levels), strict=True):
        if open_nodes is not None:
            a, b = (_below(side, open_nodes, group) for side in (a, b))
        open_nodes = durable(_unequal(a, b, group))
    return open_nodes


def _null_safe(left: Sequence[Column], right: Sequence[Column]) -> Column:
    match = F.lit(True)
    for a, b in zip(left, right, strict=True):
        match = match & a.eqNullSafe(b)
    return match


def _below(level: DataFrame, parents: DataFrame, group: Sequence[str]) -> DataFrame:
    keys = parents.select(*[F.col(g).alias(f"_p{i}") for i, g in enumerate(group)], F.col("slot").alias("_parent"))
    same = _null_safe([F.col(g) for g in group], [F.col(f"_p{i}") for i in range(len(group))])
    return level.join(keys, same & (F.shiftright("slot", FANOUT_BITS) == F.col("_parent")), "left_semi")


def _unequal(a: DataFrame, b: DataFrame, group: Sequence[str]) -> DataFrame:
    both = a.select(*group, "slot", F.col("hash").alias("_a"), F.lit(None).cast("string").alias("_b"),
                    F.col("rows").alias("_ra"), F.lit(0).cast("long").alias("_rb")).unionByName(
        b.select(*group, "slot", F.lit(None).cast("string").alias("_a"), F.col("hash").alias("_b"),
                 F.lit(0).cast("long").alias("_ra"), F.col("rows").alias("_rb"))
    )
    met = both.groupBy(*group, "slot").agg(
        F.max("_a").alias("_a"), F.max("_b").alias("_b"), F.sum("_ra").alias("left_rows"), F.sum("_rb").alias("right_rows")
    )
    return met.filter(~F.col("_a").eqNullSafe(F.col("_b"))).drop("_a", "_b")
