"""Toxicity by a factorization machine over hashed terms.

Terms are words and word beginnings, hashed. Besides a weight of its own each term has a vector, and the product of
two vectors is the weight of the two terms' meeting in one text, which no sum of single weights can express.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.session import durable


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample_per_class`` bounds the labelled texts learnt from, ``terms`` the model's size.

    ``beginnings`` are the bytes of a longer word that make a term of their own. Terms need a
    z-score of ``least_z`` between the classes. Each of ``rounds`` trains ``shards`` parts apart and takes their mean.
    """

    bits: int = 18
    beginnings: tuple[int, ...] = (3, 4, 5)
    sample_per_class: int = 6000
    least_z: float = 2.5
    factors: int = 4
    shards: int = 4
    rounds: int = 6
    epochs: int = 3
    batch: int = 64
    rate: float = 0.1
    decay: float = 1e-3
    threshold: float = 0.7
    seed: int = 5


_BREAKS = W.separator_table(bytes(b for b in range(128) if not chr(b).isalnum()))
_VALUES = W.value_table(_BREAKS, lower=True)
_LETTER = (~_BREAKS).astype(np.int64)


@dataclass(frozen=True)
class Machine:
    """Model: slot of each hash bucket (-1: none), bias, weights and vectors of the slots."""

    slots: np.ndarray
    bias: float
    weights: np.ndarray
    vectors: np.ndarray

    def margins(self, owner: np.ndarray, slots: np.ndarray, count: int) -> np.ndarray:
        """Log-odds of ``count`` texts from their distinct (owner, slot) pairs."""
        out = self.bias + np.bincount(owner, self.weights[slots], count)
        for factor in self.vectors[slots].T:
            total = np.bincount(owner, factor, count)
            out += 0.5 * (total * total - np.bincount(owner, factor * factor, count))
        return out


def buckets(chunk: W.Chunk, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every term occurrence of a chunk."""
    starts = chunk.word_starts(_BREAKS)
    owner = np.repeat(np.arange(chunk.count), np.diff(chunk.per_text(starts)))
    length = W.segment_sums(chunk.data, _LETTER, starts)
    owners, hashes = [owner], [W.segment_hashes(chunk.data, _VALUES, starts)]
    for size in config.beginnings:
        longer = length > size
        at = starts[longer]
        key = np.zeros(len(at), np.uint64)
        for k in range(size):
            key = W.mix(key + _VALUES[chunk.data[at + k]])
        owners.append(owner[longer])
        hashes.append(W.mix(key, size))
    bucket = (np.concatenate(hashes) & np.uint64((1 << config.bits) - 1)).astype(np.int64)
    return np.concatenate(owners), bucket


def _pairs(owner: np.ndarray, item: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, by owner."""
    both = np.unique(owner * width + item)
    return both // width, both % width


# --- training ---------------------------------------------------------------------------------


def training_rows(documents: DataFrame, labels: DataFrame, config: ToxicityConfig) -> DataFrame:
    """(text, toxic) of at most ``sample_per_class`` labelled documents of each class.

    Rows whose crc32(doc_id as text) leaves 1 by 3 are never among them. A document with several labels
    counts as toxic if any is. Of the rows that share an id one is taken, that of the least text hash.
    """
    known = (
        labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    parts = [
        known.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(config.sample_per_class)
        for kind in (0, 1)
    ]
    chosen = durable(parts[0].union(parts[1]).select(F.col("doc_id").alias("_id"), "toxic"))
    found = documents.select("doc_id", "text").join(
        F.broadcast(chosen), F.col("doc_id") == F.col("_id")  # at most twice ``sample_per_class`` rows
    ).select(F.col("_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("toxic").cast("int").alias("toxic"))
    return found.groupBy("_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("_id", "text", "toxic")


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _term_counts(rows: DataFrame, config: ToxicityConfig) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, 1 << config.bits), np.int64)
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for chunk in W.chunks(batch.column("text")):
                owner, bucket = _pairs(*buckets(chunk, config), 1 << config.bits)
                for kind in (0, 1):
                    counts[kind] += np.bincount(bucket[toxic[chunk.first + owner] == kind], minlength=1 << config.bits)
        seen = np.flatnonzero(counts.sum(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen), pa.array(counts[0][seen]), pa.array(counts[1][seen])], names=["bucket", "clean", "toxic"]
        )

    parts = rows.mapInArrow(run, "bucket long, clean long, toxic long")
    return parts.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def choose_terms(rows: DataFrame, config: ToxicityConfig) -> np.ndarray:
    """The buckets whose document shares differ surely between the classes, by ``least_z``; at most ``2 ** bits``."""
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return np.zeros(0, np.int64)

    def odds(column: str, size: int):
        return F.log((F.col(column) + 0.5) / (size - F.col(column) + 0.5))

    spread = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    z = F.abs(odds("toxic", sizes[1]) - odds("clean", sizes[0])) / spread
    best = _term_counts(rows, config).select("bucket", z.alias("z")).where(F.col("z") >= config.least_z)
    return np.array(
        [r[0] for r in best.orderBy(F.desc("z"), "bucket").collect()], np.int64  # bounded by the hash space
    )


def train_part(
    indptr: np.ndarray, slots: np.ndarray, toxic: np.ndarray, start: tuple, config: ToxicityConfig, seed: int
) -> tuple[float, np.ndarray, np.ndarray]:
    """Some epochs of adaptive gradient steps on texts in rows of slots."""
    bias, weights, vectors = start[0], start[1].copy(), start[2].copy()
    history = [1e-6, np.full(weights.shape, 1e-6), np.full(vectors.shape, 1e-6)]
    random = np.random.default_rng(seed)
    balance = np.where(toxic == 1, 0.5 / max(1, (toxic == 1).sum()), 0.5 / max(1, (toxic == 0).sum())) * len(toxic)
    for _ in range(config.epochs):
        order = random.permutation(len(toxic))
        for begin in range(0, len(order), config.batch):
            rows = order[begin:begin + config.batch]
            sizes = indptr[rows + 1] - indptr[rows]
            owner = np.repeat(np.arange(len(rows)), sizes)
            item = slots[np.repeat(indptr[rows] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())]
            machine = Machine(np.zeros(0), bias, weights, vectors)
            pull = 1 / (1 + np.exp(-np.clip(machine.margins(owner, item, len(rows)), -30, 30))) - toxic[rows]
            pull *= balance[rows] / len(rows)
            own = vectors[item]
            sums = np.stack([np.bincount(owner, f, len(rows)) for f in own.T], 1)
            used, place = np.unique(item, return_inverse=True)
            slope_w = np.bincount(place, pull[owner], len(used)) + config.decay * weights[used] / len(used)
            each = pull[owner][:, None] * (sums[owner] - own)
            slope_v = np.stack([np.bincount(place, f, len(used)) for f in each.T], 1) + config.decay * vectors[used]
            history[0] += pull.sum() ** 2
            history[1][used] += slope_w ** 2
            history[2][used] += slope_v ** 2
            bias -= config.rate * pull.sum() / np.sqrt(history[0])
            weights[used] -= config.rate * slope_w / np.sqrt(history[1][used])
            vectors[used] -= 0.2 * config.rate * slope_v / np.sqrt(history[2][used])
    return bias, weights, vectors


def fit(documents: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> Machine:
    """Train on a bounded sample of labelled documents, in parts whose parameters are averaged each round.

    Without labelled rows of both classes the machine scores every text the same.
    """
    rows = durable(training_rows(documents, labels, config))
    chosen = choose_terms(rows, config)
    slots = np.full(1 << config.bits, -1, np.int32)
    slots[chosen] = np.arange(len(chosen))
    random = np.random.default_rng(config.seed)
    state = (0.0, np.zeros(len(chosen)), random.normal(0, 0.01, (len(chosen), config.factors)))
    if not len(chosen):
        counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
        share = (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)
        return Machine(slots, float(np.log(share / (1 - share))), state[1], state[2])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column("text")):
                owner, item = slotted(chunk, slots, config)
                ends = np.searchsorted(owner, np.arange(chunk.count + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(item, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(chunk.first, chunk.count), lists,
                     batch.column("_id").cast(pa.string()).slice(chunk.first, chunk.count)], names=["toxic", "slots", "_id"]
                )

    shard = F.pmod(F.xxhash64("_id"), F.lit(config.shards))
    table = durable(
        rows.mapInArrow(features, "toxic int, slots array<int>, _id string").withColumn("shard", shard)
        .groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("_id", "toxic", "slots"))).alias("rows"))
    )  # a shard holds at most the bounded sample

    for round_ in range(config.rounds):
        def train(batches: Iterator[pa.RecordBatch], state=state, round_=round_) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for number, shard_rows in zip(batch.column("shard"), batch.column("rows"), strict=True):
                    own = shard_rows.values
                    lists = own.field("slots")
                    indptr = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                    bias, weights, vectors = train_part(
                        indptr, lists.flatten().to_numpy(), own.field("toxic").to_numpy(), state, config,
                        config.seed + 100 * round_ + number.as_py(),
                    )
                    flat = np.concatenate([[bias], weights, vectors.ravel()])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([len(own)]), pa.array([flat.tobytes()], pa.binary())], names=["n", "state"]
                    )

        parts = table.mapInArrow(train, "n long, state binary").collect()  # one row of fixed size per shard
        total = sum(p["n"] for p in parts)
        parts.sort(key=lambda p: bytes(p["state"]))  # one order of summing, so reruns agree
        flat = sum(np.frombuffer(bytes(p["state"])) * (p["n"] / total) for p in parts)
        state = (float(flat[0]), flat[1:1 + len(chosen)], flat[1 + len(chosen):].reshape(len(chosen), config.factors))
    return Machine(slots, *state)


def slotted(chunk: W.Chunk, slots: np.ndarray, config: ToxicityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (owner, slot) pairs of a chunk's texts, by owner."""
    owner, bucket = buckets(chunk, config)
    item = slots[bucket]
    known = item >= 0
    return _pairs(owner[known], item[known].astype(np.int64), 1 << 20)


# --- scoring ----------------------------------------------------------------------------------


def score(documents: DataFrame, machine: Machine, config: ToxicityConfig = ToxicityConfig()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``documents``, from its whole text alone.

    One pass without a shuffle; the model has at most ``2 ** bits`` slots. A null text is scored
    as an empty one. Repeated rows have equal results; other columns are ignored; held_out of a null
    doc_id is false. An empty table gives an empty result.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for chunk in W.chunks(batch.column("text")):
                margin = machine.margins(*slotted(chunk, machine.slots, config), chunk.count)
                out[chunk.first:chunk.first + chunk.count] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(out)], names=["doc_id", "held_out", "score"]
            )

    rows = documents.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text")
    kind = dict(documents.dtypes)["doc_id"]
    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= config.threshold).cast("int"))
