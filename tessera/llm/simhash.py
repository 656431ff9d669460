"""SimHash near-duplicates by an inverted index over the byte positions of fingerprints.

Two fingerprints at ``distance`` bits differ in at most as many of their eight bytes, so they share at least
``8 - distance`` positional bytes, and of any ``distance + 4`` positions at least four. A posting list
holds the fingerprints that have the same bytes at four of the first ``distance + 4`` positions. For each pair
of a list the shared positional bytes are tallied, pairs with the guaranteed number stay, and their bits are
compared. Everything works on distinct fingerprints: copies count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.graph import components, spread_join
from tessera.session import durable

#: Hashes whose bits are counted at once, 4 MB of bits.
BLOCK = 1 << 16


@dataclass(frozen=True)
class SimhashConfig:
    """Fingerprints of ``shingle`` words link at ``distance`` (1 or 2) or fewer differing bits.

    ``shared``: positional bytes of a posting. ``list_rows``: up to as many fingerprints a list is paired; longer
    ones are linked through common neighbours.
    """

    shingle: int = 3
    seed: int = 42
    distance: int = 2
    shared: int = 4
    list_rows: int = 64

    @property
    def least_tally(self) -> int:
        return 8 - self.distance

    @property
    def masks(self) -> list[int]:
        """Signed masks of the positions of each posting."""
        places = combinations(range(self.distance + self.shared), self.shared)
        return [_signed(sum(0xFF << 56 - 8 * p for p in own)) for own in places]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


# --- fingerprints -----------------------------------------------------------------------------


def fingerprint(text: str | None, config: SimhashConfig = SimhashConfig()) -> int:
    """Unsigned 64-bit fingerprint: a bit is one where more than half of the shingle hashes, repeats included, have it."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    size = min(config.shingle, len(words))
    joined = memoryview(b" ".join(words))
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    ends = ends[size - 1:].tolist()
    seed, digest = config.seed, xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for begin in range(0, len(starts), BLOCK):
        own = zip(starts[begin:begin + BLOCK], ends[begin:begin + BLOCK], strict=True)
        hashes = np.array([digest(joined[s:e], seed) for s, e in own], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big")


def fingerprints(
    documents: DataFrame, config: SimhashConfig = SimhashConfig(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long. Null and wordless texts have zero."""
    rows = documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_signed(fingerprint(t.as_py(), config)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values, pa.int64())], names=["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp long")


# --- links ------------------------------------------------------------------------------------


def _tally(x: Column, y: Column) -> Column:
    """Positional bytes that two fingerprints share."""
    differing = x.bitwiseXOR(y)
    return sum(F.when(differing.bitwiseAND(F.lit(_signed(0xFF << 8 * p))) == 0, 1).otherwise(0) for p in range(8))


def links(distinct: DataFrame, config: SimhashConfig = SimhashConfig()) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) that connect all within ``distance`` bits of each other.

    Lists of up to ``list_rows`` fingerprints give each of their links. Fingerprints of a longer list are joined
    through the values within one bit of them: two at a distance of two bits or fewer have such a value in common, and all
    that have one in common (65 at most) are within two bits, so a star for each value connects the same fingerprints.
    """
    if config.distance not in (1, 2) or not 0 < config.shared <= config.least_tally:
        raise ValueError("distance must be 1 or 2, shared from 1 to 8 - distance")
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in config.masks])
    postings = distinct.select("fp", F.posexplode(keys).alias("posting", "bytes"))
    sizes = postings.groupBy("posting", "bytes").agg(F.count("*").alias("size")).where("size > 1")
    shared = durable(postings.join(sizes, ["posting", "bytes"]))

    lists = shared.where(F.col("size") <= config.list_rows).groupBy("posting", "bytes").agg(
        F.array_sort(F.collect_list("fp")).alias("fps")
    )
    sides = lists.select("fps", F.posexplode("fps").alias("at", "a"))
    pairs = sides.select("a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
    counted = pairs.where(_tally(F.col("a"), F.col("b")) >= config.least_tally)
    verified = counted.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= config.distance).distinct()

    crowded = shared.where(F.col("size") > config.list_rows).select("fp").distinct()
    if config.distance == 1:  # a value in common with one bit of difference, not two
        near = crowded.select("fp", F.explode(F.array(*[
            F.struct(F.lit(b).alias("bit"), F.col("fp").bitwiseAND(F.lit(_signed((1 << 64) - 1 - (1 << b)))).alias("value"))
            for b in range(64)
        ])).alias("near"))
    else:
        near = crowded.select("fp", F.explode(F.array(F.col("fp"), *[
            F.col("fp").bitwiseXOR(F.lit(_signed(1 << b))) for b in range(64)
        ])).alias("near"))
    stars = near.groupBy("near").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return verified.union(stars)


def near_duplicates(
    documents: DataFrame, config: SimhashConfig = SimhashConfig(), doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``documents``.

    ``component_id`` is the smallest id reachable over links, the row's own included. A null or empty text, or one
    without words, has fingerprint zero and links like any other; a text of fewer words than a shingle is one shingle. A
    null id is never a component's id while another row of it has one. Repeated rows have equal results. Other columns
    are ignored. An empty table gives an empty result.
    """
    rows = durable(fingerprints(documents, config, doc_id, text))
    classes = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = durable(components(links(classes.select("fp"), config)).withColumnRenamed("node", "fp"))
    linked = durable(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    named = spread_join(linked.select("fp", "root"), least, "root").select("fp", "component_id")
    return spread_join(rows, durable(named), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
