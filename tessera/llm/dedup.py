"""MinHash near-duplicates by tensored banding, confirmed on full shingle sets.

Two collections of ``tables`` half keys, each of ``rows`` minhashes, give ``tables ** 2`` table keys
(one half of each collection), so a document needs ``2 * tables * rows`` minhashes where independent
tables would need ``2 * tables ** 2 * rows``. A pair of similarity s meets in some table with
probability ``(1 - (1 - s ** rows) ** tables) ** 2``: 0.99994 at 0.85 with the defaults.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.tables import free_names, quoted, small
from tessera.session import durable

#: Longs of a parity sketch; its 1024 bits separate pairs at the threshold up to some thousand shingles.
SKETCH_LONGS = 16


@dataclass(frozen=True)
class DedupConfig:
    """Links need ``100 * intersection >= percent * union`` of ``shingle``-word sets."""

    shingle: int = 5
    percent: int = 85
    rows: int = 3
    tables: int = 11
    seed: int = 1729


# --- sketches ---------------------------------------------------------------------------------


def shingle_sets(chunk: W.Chunk, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one for all its words."""
    starts = chunk.word_starts(W.SPACES)
    hashes = W.segment_hashes(chunk.data, W.WORDS_LOWER, starts)
    bounds = chunk.per_text(starts)
    windows = W.window_hashes(hashes, size)
    out = []
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        if end - begin >= size:
            out.append(np.unique(windows[begin:end - size + 1]))
        else:
            out.append(W.window_hashes(hashes[begin:end], int(end - begin)) if end > begin else hashes[:0])
    return out


def _sketch_sets(sets: list[np.ndarray], config: DedupConfig) -> dict[str, np.ndarray]:
    """Set size, 128-bit set hash, half keys and parity sketch of non-empty sets."""
    sizes = np.array([len(s) for s in sets])
    begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    values = np.concatenate(sets)
    count, halves = len(sets), 2 * config.tables
    factors = np.random.default_rng(config.seed).integers(0, 1 << 63, (halves, config.rows), dtype=np.uint64)
    factors = factors * np.uint64(2) + np.uint64(1)
    keys = np.empty((count, halves), np.uint64)
    for half in range(halves):
        key = np.zeros(count, np.uint64)
        for factor in factors[half]:
            key = W.mix(key) + np.minimum.reduceat(values * factor, begins)
        keys[:, half] = W.mix(key, half + 1)
    bit = (W.mix(values, 101) >> np.uint64(54)).astype(np.int64)
    owner = np.repeat(np.arange(count), sizes)
    parity = np.bincount(owner * 1024 + bit, minlength=count * 1024).reshape(count, 1024) & 1
    return {
        "n_shingles": sizes,
        "set_a": np.add.reduceat(W.mix(values, 11), begins).view(np.int64),
        "set_b": np.add.reduceat(W.mix(values, 12), begins).view(np.int64),
        "halves": keys.view(np.int64),
        "parity": np.packbits(parity.astype(np.uint8), axis=1).view(np.int64),
    }


def _lists(matrix: np.ndarray) -> pa.Array:
    count, width = matrix.shape
    offsets = pa.array(np.arange(0, count * width + 1, width) if width else np.zeros(count + 1), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel(), pa.int64()))


def sketches(documents: DataFrame, config: DedupConfig) -> DataFrame:
    """One row per row of (row_key, doc_id, text): keys, set size and hash, half keys and parity sketch."""
    halves = 2 * config.tables

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column("text"), 1 << 19):
                sets = shingle_sets(chunk, config.shingle)
                full = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
                out = {
                    "n_shingles": np.zeros(len(sets), np.int64), "set_a": np.zeros(len(sets), np.int64),
                    "set_b": np.zeros(len(sets), np.int64), "halves": np.zeros((len(sets), halves), np.int64),
                    "parity": np.zeros((len(sets), SKETCH_LONGS), np.int64),
                }
                if len(full):
                    for name, values in _sketch_sets([sets[i] for i in full], config).items():
                        out[name][full] = values
                own = batch.slice(chunk.first, chunk.count)
                yield pa.RecordBatch.from_arrays(
                    [own.column("row_key"), own.column("doc_id"),
                     *(pa.array(out[n]) for n in ("n_shingles", "set_a", "set_b")),
                     _lists(out["halves"]), _lists(out["parity"])],
                    names=["row_key", "doc_id", "n_shingles", "set_a", "set_b", "halves", "parity"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.mapInArrow(
        run,
        f"row_key long, doc_id {kind}, n_shingles long, set_a long, set_b long, "
        "halves array<long>, parity array<long>",
    )


def _full_sets(documents: DataFrame, config: DedupConfig) -> DataFrame:
    """(row_key, set): the sorted shingle hashes of each text as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column("text"), 1 << 19):
                sets = [s.tobytes() for s in shingle_sets(chunk, config.shingle)]
                keys = batch.column("row_key").slice(chunk.first, chunk.count)
                yield pa.RecordBatch.from_arrays([keys, pa.array(sets, pa.binary())], names=["row_key", "set"])

    return documents.select("row_key", "text").mapInArrow(run, "row_key long, set binary")


# --- links ------------------------------------------------------------------------------------


def _possible(left: str, right: str, percent: int):
    """False only where sizes or parity sketches prove that a pair is no link.

    An odd bit of the xor of two sketches needs an element that only one of the sets has, so the
    number of odd bits is at most the size of the symmetric difference, which a link keeps below
    ``(100 - percent) / (100 + percent)`` of the two sizes' sum.
    """
    a, b = F.col(f"{left}.n_shingles"), F.col(f"{right}.n_shingles")
    odd = reduce(
        lambda x, y: x + y,
        [F.bit_count(F.col(f"{left}.parity")[i].bitwiseXOR(F.col(f"{right}.parity")[i])) for i in range(SKETCH_LONGS)],
    )
    return (100 * F.least(a, b) >= percent * F.greatest(a, b)) & ((100 + percent) * odd <= (100 - percent) * (a + b))


def _confirmed(pairs: DataFrame, documents: DataFrame, config: DedupConfig) -> DataFrame:
    """The pairs (a, b) of row keys whose full sets are similar enough."""
    wanted = pairs.select(F.col("a").alias("row_key")).union(pairs.select("b")).distinct()
    texts = documents.join(small(durable(wanted)), "row_key", "left_semi")
    sets = _full_sets(texts, config).dropDuplicates(["row_key"])
    rows = pairs.join(sets.select(F.col("row_key").alias("a"), F.col("set").alias("set_a")), "a").join(
        sets.select(F.col("row_key").alias("b"), F.col("set").alias("set_b")), "b"
    ).select("a", "b", "set_a", "set_b")
    percent = config.percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _ordered(a, b) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over links (a, b), by alternating stars.

    The large star hangs every larger neighbour under a node's smallest one, the small star every
    smaller one; both repeat until each tree is a star, which takes a number of rounds logarithmic in the
    longest path. Edges are kept as a table in the checkpoint folder, none reaches the driver.
    """
    edges = durable(links.select(*_ordered(F.col("a"), F.col("b"))).where("a <> b").distinct())

    def star(edges: DataFrame, large: bool) -> DataFrame:
        down = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        sides = down.union(down.select("v", "u")) if large else down
        low = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        moved = sides.join(low, "u")
        if large:
            moved = moved.where("v > u").select("m", F.col("v").alias("x"))
        else:
            moved = moved.select("m", F.col("v").alias("x")).union(low.select("m", F.col("u").alias("x")))
        return moved.where("m <> x").select(*_ordered(F.col("m"), F.col("x")))

    def all_stars(edges: DataFrame) -> bool:
        """No node has two roots, or a root that hangs under another."""
        ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("under"), F.lit(0).alias("over")).union(
            edges.select("a", F.lit(0), F.lit(1))
        )
        mixed = ends.groupBy("node").agg(F.sum("under").alias("under"), F.max("over").alias("over"))
        return mixed.where("under > 1 or (under > 0 and over > 0)").isEmpty()

    while not all_stars(edges):
        edges = durable(star(star(edges, True), False).distinct())
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(
    documents: DataFrame, config: DedupConfig = DedupConfig(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, row_key) of every row of ``documents``.

    1. Rows of equal sets fold into classes, whose number of copies never matters again.
    2. Half keys that only one class has are dropped, and the others are tensored into table keys.
    3. In each table the class with the most shared half keys is compared with the others. This
       joins nearly every group of copies with as many comparisons as members.
    4. Pairs that still lie in different components and that sizes and parity sketches allow are
       confirmed too, so no table's pairs are left out.

    A null or empty text, or one without words, has an empty set and links with nothing, also not
    with its equals. A null doc_id is never a component's id while another row of it has one; a row
    without an id is kept where its component has none. Repeated rows have equal results. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64("doc_id", "text"))
    sketch = durable(sketches(rows, config))

    by_id = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    classes = durable(
        sketch.where("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles").agg(
            F.min(by_id).alias("least"), F.first("halves").alias("halves"), F.first("parity").alias("parity")
        ).select("set_a", "set_b", "n_shingles", "halves", "parity", F.col("least.row_key").alias("node"),
                 F.col("least.doc_id").alias("doc_id"))
    )

    halves = classes.select("node", F.posexplode("halves").alias("side", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("classes")).where("classes > 1")
    by_node = (
        halves.join(shared, "half")
        .groupBy("node")
        .agg(
            F.collect_list(F.when(F.col("side") < config.tables, F.col("half"))).alias("one"),
            F.collect_list(F.when(F.col("side") >= config.tables, F.col("half"))).alias("two"),
            F.sum("classes").alias("weight"),
        )
    )
    tables = by_node.select("node", "weight", "two", F.explode("one").alias("x")).select(
        "node", "weight", "x", F.explode("two").alias("y")
    ).select("node", "weight", F.xxhash64("x", "y").alias("table"))
    centres = tables.groupBy("table").agg(
        F.max(F.struct("weight", "node"))["node"].alias("centre"), F.count("*").alias("size")
    ).where("size > 1")
    members = durable(tables.join(centres.select("table", "centre"), "table").select("table", "node", "centre"))

    known = classes.select("node", "n_shingles", "parity")
    stars = members.where("node <> centre").select(*_ordered(F.col("node"), F.col("centre"))).distinct()
    pairs = (
        stars.join(known.select(F.col("node").alias("a"), F.struct("n_shingles", "parity").alias("l")), "a")
        .join(known.select(F.col("node").alias("b"), F.struct("n_shingles", "parity").alias("r")), "b")
        .where(_possible("l", "r", config.percent))
        .select("a", "b")
    )
    links = durable(_confirmed(durable(pairs), rows, config))
    roots = components(links)

    labelled = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    open_tables = labelled.groupBy("table").agg(F.min("root").alias("low"), F.max("root").alias("high")).where(
        "low <> high"
    )
    rest = labelled.join(open_tables, "table", "left_semi").join(known, "node").select(
        "table", "node", "root", "n_shingles", "parity"
    )
    others = (
        rest.alias("l").join(rest.alias("r"), F.col("l.table") == F.col("r.table"))
        .where((F.col("l.node") < F.col("r.node")) & (F.col("l.root") != F.col("r.root")))
        .where(_possible("l", "r", config.percent))
        .select(F.col("l.node").alias("a"), F.col("r.node").alias("b"))
        .distinct()
    )
    more = _confirmed(durable(others.join(pairs, ["a", "b"], "left_anti")), rows, config)
    roots = durable(components(links.union(more)))

    linked = classes.select("node", "doc_id").join(roots, "node")
    least = linked.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = roots.join(least, "root").select("node", "component_id")
    by_class = classes.join(named.withColumn("joined", F.lit(True)), "node", "left").select(
        "set_a", "set_b", "n_shingles",
        F.when(F.col("joined"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )
    keys = ["set_a", "set_b", "n_shingles"]
    return (
        sketch.select("doc_id", "row_key", *keys)
        .join(by_class.withColumn("found", F.lit(True)), keys, "left")
        .withColumn("component_id", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("doc_id")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
                "row_key")
    )


def representatives(documents: DataFrame, config: DedupConfig = DedupConfig()) -> DataFrame:
    """The rows of ``documents``, all columns, of which one of each group of near-duplicates stays.

    Of identical rows one stays; rows that share an id but not their text stay both, unless their group has a
    smaller id. A row without an id stays if its group has no id.
    """
    found = durable(near_duplicates(documents, config))
    key, gone, again = free_names(documents.columns, "_key", "_gone", "_again")
    dropped = durable(found.where(~F.col("kept")).select(F.col("row_key").alias(gone)).distinct())
    kept = documents.withColumn(key, F.xxhash64("doc_id", "text")).join(
        small(dropped), F.col(key) == F.col(gone), "left_anti"
    )
    repeated = found.where("kept and doc_id is not null").groupBy("row_key").count().where("count > 1")
    if not repeated.isEmpty():
        extra = small(durable(repeated.select(F.col("row_key").alias(again))))
        same = F.col(key) == F.col(again)
        kept = kept.join(extra, same, "left_anti").unionByName(
            kept.join(extra, same, "left_semi").dropDuplicates([key])
        )
    return kept.select(*quoted(documents.columns))
