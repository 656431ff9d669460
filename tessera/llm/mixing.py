"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

The rates of documents nearest to one (in relative entropy over words) that meet a number of words for each source
are exponential tilts ``exp(multiplier of the source)``. Newton iterations on the convex dual find the
multipliers from grouped sums over the documents; rates become whole copies by cumulative rounding over
sizes, the remainder is settled by ever smaller documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.ranking import global_rank
from tessera.llm.graph import spread_join
from tessera.llm.tables import free_names, quoted, small
from tessera.session import durable

WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixConfig:
    """Sources in order weigh ``weights``, repeating, and share ``share`` times all words.

    No document is taken more than ``cap`` times. ``group_rows``: documents of equal size are ranked in
    parts of about that many. ``settle``: rounds of settling from one look at whether a group can still move to the next.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: int = 2
    tolerance: float = 1e-10
    iterations: int = 60
    group_rows: int = 256
    settle: int = 6


def _attach(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("source",), how: str = "inner") -> DataFrame:
    """Columns of ``right`` by keys that may be null."""
    renamed = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    match = F.lit(True)
    for key in keys:
        match = match & F.col(key).eqNullSafe(F.col(f"_{key}"))
    return left.join(renamed, match, how).drop(*[f"_{k}" for k in keys])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares by weight, none above the cap.

    Sources are ordered by code point with null last. The level that a unit of weight gets rises until no source
    is above its cap; each step is one sum over the sources.
    """
    ranked = global_rank(totals, [], [F.col("source").isNull(), F.col("source")], "place")
    weights = F.array(*[F.lit(float(w)) for w in config.weights])
    turn = ((F.col("place") - 1) % len(config.weights)).cast("int") + 1
    table = durable(ranked.select(
        "source", "source_size", F.element_at(weights, turn).alias("weight"),
        (F.col("source_size") * config.cap).cast("double").alias("most"),
    ))
    whole = table.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        capped = F.col("most") <= F.col("weight") * F.lit(level)
        row = table.agg(
            F.sum(F.when(capped, F.col("most"))).alias("held"), F.sum(F.when(~capped, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        risen = (config.share * whole - (row["held"] or 0.0)) / row["open"]
        if risen <= level * (1 + 1e-12):
            break
        level = risen
    return table.select(
        "source", "source_size", F.least(F.col("most"), F.col("weight") * F.lit(level)).alias("target")
    )


def multipliers(groups: DataFrame, aims: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(source, multiplier): Newton's method on the dual, from (source, weight, units) and targets.

    Each iteration sums words and tilted words of every source over the groups; the driver sees the largest
    relative gap alone.
    """
    state = aims.where("source_size > 0").select("source", "target", F.lit(0.0).alias("multiplier"))
    for _ in range(config.iterations):
        tilt = F.exp(F.col("multiplier"))
        sums = (
            _attach(groups, state)
            .groupBy("source", "target", "multiplier")
            .agg(F.sum(F.col("weight") * F.col("units") * tilt).alias("tilted"))
        )
        step = (F.col("target") - F.col("tilted")) / F.col("tilted")
        state = durable(sums.select(
            "source", "target", F.abs(F.col("tilted") / F.col("target") - 1).alias("gap"),
            (F.col("multiplier") + F.greatest(F.lit(-1.0), step)).alias("multiplier"),
        ))
        gap = state.agg(F.max("gap")).first()[0]
        state = state.drop("gap")
        if gap is None or gap <= config.tolerance:
            break
    return state.select("source", "multiplier")


def _settled(groups: DataFrame, config: MixConfig) -> DataFrame:
    """Adds ``extra``: how many units of each group are taken once more than ``base``.

    A window over a source's groups has a row for each distinct size, not for each document. A round walks down the
    sizes that fit into the remainder and takes each whole until one does not fit any more; that leaves less than half
    of the remainder. Rounds go on until no group can move.
    """
    by_source = Window.partitionBy("source")
    down = by_source.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, 0)
    due = F.sum(F.col("units") * F.col("part")).over(down)
    out = groups.withColumn("due", F.floor(due + 0.5)).withColumn(
        "extra", (F.col("due") - F.coalesce(F.lag("due").over(by_source.orderBy(F.desc("weight"))), F.lit(0))).cast("long")
    )
    above = by_source.orderBy(F.desc("weight")).rowsBetween(Window.unboundedPreceding, -1)

    def looked(table: DataFrame) -> DataFrame:
        """Adds ``left``, what a source misses, and ``room``, how many units of a group may move and fit into it."""
        taken = F.sum(F.col("weight") * (F.col("units") * F.col("base") + F.col("extra"))).over(by_source)
        table = table.withColumn("left", F.col("target") - taken)
        more = F.when(F.col("base") < config.cap, F.col("units") - F.col("extra")).otherwise(0)
        fits = (F.col("weight") > 0) & (F.col("weight") <= F.abs("left"))
        return table.withColumn("room", F.when(fits, F.when(F.col("left") > 0, more).otherwise(F.col("extra"))).otherwise(0))

    while True:
        for _ in range(config.settle):
            out = looked(out)
            used = F.coalesce(F.sum(F.col("weight") * F.col("room")).over(above), F.lit(0))
            whole = F.floor(F.greatest(F.abs("left") - used, F.lit(0)) / F.greatest(F.col("weight"), F.lit(1)))
            out = out.withColumn("moved", F.least(F.col("room"), whole)).withColumn(
                "extra", F.col("extra") + F.signum("left").cast("long") * F.col("moved")
            )
        out = durable(out.select("source", "weight", "units", "base", "target", "extra"))
        if looked(out).where("room > 0").isEmpty():
            break
    return out.select("source", "weight", "units", "base", "extra")


#: Copies of one row that are listed at once.
COPY_BLOCK = 4096


def _plan(light: DataFrame, config: MixConfig) -> tuple[DataFrame, DataFrame]:
    """(aims, copies by key) of durable rows (row_key, source, size).

    Rows of an equal key are ``rows`` units of their own: ``base`` copies go to each of them, one more to ``extra`` of
    them. Keys of a group of equal size take what the group is due in the order of their hash, so at most one key
    of a group is taken in part.
    """
    units = durable(light.groupBy("row_key", "source", F.col("size").alias("weight")).agg(F.count("*").alias("rows")))
    groups = durable(units.groupBy("source", "weight").agg(F.sum("rows").alias("units")))
    words = F.sum(F.col("weight") * F.col("units")).alias("source_size")
    aims = durable(targets(groups.groupBy("source").agg(words), config))
    tilts = multipliers(groups, aims, config)

    rate = F.least(F.lit(float(config.cap)), F.exp(F.coalesce(F.col("multiplier"), F.lit(0.0))))
    near = F.when(F.abs(rate - F.round(rate)) < 1e-6, F.round(rate)).otherwise(rate)
    rates = _attach(aims, tilts, how="left").select(
        "source", "target", F.floor(near).alias("base"), (near - F.floor(near)).alias("part")
    )
    plan = _settled(_attach(groups, rates), config)
    plan = plan.withColumn("parts", F.ceil(F.col("units") / config.group_rows).cast("long")).drop("units")
    dealt = _attach(units, plan, ("source", "weight")).select(
        "row_key", "source", "weight", "rows", "base", "extra",
        F.pmod(F.xxhash64("row_key"), F.col("parts")).alias("part"),
    )
    keys = ["source", "weight", "part"]
    counted = dealt.groupBy(*keys, "extra").agg(F.sum("rows").alias("n"))
    before = Window.partitionBy("source", "weight").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    quota = counted.select(
        *keys, F.greatest(F.lit(0), F.col("extra") - F.coalesce(F.sum("n").over(before), F.lit(0))).alias("quota")
    )
    ahead = Window.partitionBy(*keys).orderBy("row_key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = dealt.drop("extra").withColumn("ahead", F.coalesce(F.sum("rows").over(ahead), F.lit(0)))
    taken = F.least(F.col("rows"), F.greatest(F.lit(0), F.col("quota") - F.col("ahead")))
    by_key = _attach(ranked, quota, tuple(keys)).groupBy("row_key").agg(
        F.sum("rows").alias("rows"), F.max("base").cast("long").alias("base"), F.sum(taken).cast("long").alias("extra")
    )
    return aims, durable(by_key)


def mix(documents: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """(row_key, doc_id, size, source, source_size, target, copies) of every document row.

    ``copies`` is a whole number from 0 to ``cap``; words taken are ``copies * size``. Documents of equal size
    are taken in the order of a hash, so reruns agree. A null text has no words; a document without words is
    taken as often as its source's rate rounds down to. A null source is a source, the last. Repeated rows count each:
    as many of them get one copy more as their size is due, whichever they are. Other columns are ignored. An empty
    table gives an empty result.
    """
    light = durable(documents.select(
        "doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text", "source").alias("row_key"),
        F.monotonically_increasing_id().alias("row"),
    ))
    aims, by_key = _plan(light, config)
    joined = spread_join(light, by_key, "row_key")
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("rows"))
    whole = joined.where(~part).withColumn("copies", F.col("base") + (F.col("extra") > 0).cast("long"))
    split = joined.where(part)
    if not split.isEmpty():
        split = global_rank(split, ["row_key"], [F.col("row")], "place")
        split = split.withColumn("copies", F.col("base") + (F.col("place") <= F.col("extra")).cast("long"))
        whole = whole.unionByName(split.drop("place"))
    return _attach(whole, small(aims, 10_000)).select(
        "row_key", "doc_id", "size", "source", "source_size", "target", "copies"
    )


def mixed_documents(documents: DataFrame, config: MixConfig = MixConfig()) -> DataFrame:
    """The rows of ``documents``, all columns, each as often as the mix takes it.

    Rows are told apart by all columns but maps. Rows equal in these are one row with the copies of all of them.
    """
    comparable = [c for c, kind in documents.dtypes if "map<" not in kind and "variant" not in kind]
    identity = F.xxhash64(*quoted(comparable))
    light = durable(documents.select("source", word_count(F.col("text")).alias("size"), identity.alias("row_key")))
    by_key = _plan(light, config)[1].select(
        "row_key", (F.col("rows") > 1).alias("again"), (F.col("rows") * F.col("base") + F.col("extra")).alias("copies")
    ).where("copies > 0")
    key, own, again, copies, copy = free_names(documents.columns, "_key", "_own", "_again", "_copies", "_copy")
    by_key = by_key.select(F.col("row_key").alias(own), F.col("again").alias(again), F.col("copies").alias(copies))
    keyed = documents.withColumn(key, identity)
    once = keyed.join(by_key.where(~F.col(again)).hint("shuffle_hash"), F.col(key) == F.col(own))
    once = once.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*quoted(documents.columns))
    repeated = by_key.where(F.col(again))
    if repeated.isEmpty():
        return once
    # equal rows fold before they travel, and many copies of one are listed in blocks over all tasks
    some = keyed.join(small(repeated), F.col(key) == F.col(own), "left_semi").dropDuplicates([key])
    some = some.join(repeated, F.col(key) == F.col(own))
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col(copies) - 1) / COPY_BLOCK))
    in_block = F.least(F.lit(COPY_BLOCK), F.col(copies) - F.col(copy) * COPY_BLOCK).cast("int")
    listed = some.withColumn(copy, F.explode(blocks)).repartition(F.col(key), F.col(copy))
    listed = listed.withColumn(copy, F.explode(F.sequence(F.lit(1), in_block)))
    return once.unionByName(listed.select(*quoted(documents.columns)))
