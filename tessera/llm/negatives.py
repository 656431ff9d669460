"""Hard negatives by angular triangle filtering.

Every row stores its angles to a few reference directions. The angle between an anchor and a row is at least the
difference and at most the sum of their angles to any reference, so the cosine lies in an interval; times both norms,
and widened by more than rounding can cost, it bounds the integer score. Rows lie in chunks sorted by label, nearest
reference and angle to it, so the rows that may reach a score are a window of a run; only rows whose bounds overlap the
scores asked for are scored, in integers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.tables import small
from tessera.session import durable

#: More than a stored angle (a float) and the arc cosine of a double can be off.
ANGLE_SLACK = 4e-6
#: Vectors of this squared length or more could leave the range of a score.
MOST_SQUARED = 2.0**60
#: Up to this bound of a score all partial sums are exact in doubles.
EXACT_DOUBLE = 2.0**52

ANCHOR = "anchor_id long, tag long"


@dataclass(frozen=True)
class NegativeConfig:
    """The first ``positives`` rows of an anchor's label; for each the first ``negatives`` rows of other labels whose
    score is from ``percent`` % of the positive's score to all of it.

    ``scale``: a component x counts as floor(scale * x). References are fitted to a sample of ``sample`` rows, which also
    gives each anchor its first scores to beat. A chunk has ``least_chunk`` to ``most_chunk`` rows, about
    ``chunks`` of them between these bounds.
    """

    positives: int = 5
    negatives: int = 5
    percent: int = 80
    scale: int = 256
    references: int = 8
    sample: int = 4096
    least_chunk: int = 4096
    most_chunk: int = 1 << 18
    chunks: int = 64


# --- vectors ----------------------------------------------------------------------------------


def _integers(column: pa.Array, dim: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, fine): floor(scale * x), padded with zeros to ``dim``, of the rows that are ``fine``."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.values.slice(column.offsets[0].as_py(), int(sizes.sum()))
    values = np.asarray(flat.cast(pa.float64()).to_numpy(zero_copy_only=False), np.float64)
    owner = np.repeat(np.arange(len(column)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    wide = np.zeros((len(column), dim))
    wide[owner, place] = values
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.floor(scale * wide)
        fine = np.isfinite(wide).all(axis=1) & ((whole * whole).sum(axis=1) < MOST_SQUARED)
    whole[~fine] = 0
    return whole.astype("<i4"), fine


def vectors(rows: DataFrame, dim: int, config: NegativeConfig) -> DataFrame:
    """(vec_id, label, q) of the distinct rows that take part; q holds the integer components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, fine = _integers(batch.column("embedding"), dim, config.scale)
            cells = pa.array([v.tobytes() for v in whole], pa.binary())
            out = [batch.column("vec_id"), batch.column("label"), cells]
            yield pa.RecordBatch.from_arrays(out, names=["vec_id", "label", "q"]).filter(pa.array(fine))

    return rows.mapInArrow(run, "vec_id long, label long, q binary").distinct()


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim)


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.sqrt((matrix * matrix).sum(axis=-1, keepdims=True))
    return matrix / np.where(norms > 0, norms, 1)


def reference_directions(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Unit directions: spherical means from the rows of the sample that lie farthest apart."""
    unit = np.unique(_unit(sample.astype(float)), axis=0)
    if not len(unit):
        return np.zeros((0, sample.shape[1]))
    chosen = [_unit(unit.mean(axis=0))]
    while len(chosen) < min(count, len(unit)):
        chosen.append(unit[np.argmin((unit @ np.array(chosen).T).max(axis=1))])
    centres = np.array(chosen)
    for _ in range(rounds):
        nearest = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, unit)
        moved = _unit(sums)
        centres = np.where((sums != 0).any(axis=1, keepdims=True), moved, centres)
    return centres


def _placed(rows: DataFrame, references: np.ndarray, dim: int) -> DataFrame:
    """Adds norm, angles to the references, the nearest one (cell) and the angle to it (own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), dim).astype(float)
            angles = np.arccos(np.clip(_unit(q) @ references.T, -1, 1)).astype(np.float32)
            cell = np.argmin(angles, axis=1)
            offsets = pa.array(np.arange(0, angles.size + 1, angles.shape[1]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.sqrt((q * q).sum(axis=1))),
                 pa.ListArray.from_arrays(offsets, pa.array(angles.ravel())), pa.array(cell, pa.int32()),
                 pa.array(angles[np.arange(len(cell)), cell])],
                names=[*batch.schema.names, "norm", "angles", "cell", "own"],
            )

    return rows.mapInArrow(
        run, "vec_id long, label long, q binary, norm double, angles array<float>, cell int, own float"
    )


# --- chunks of rows ---------------------------------------------------------------------------


class _Chunk:
    """Rows of one chunk in runs of equal label and cell, each sorted by its own angle."""

    def __init__(self, batches: list[pa.RecordBatch], dim: int):
        whole = pa.Table.from_batches(batches).combine_chunks()
        one = lambda n: whole.column(n).chunk(0)
        self.ids, self.labels, self.norms = (one(n).to_numpy(zero_copy_only=False) for n in ("vec_id", "label", "norm"))
        self.q = _matrix(one("q"), dim)
        self.angles = one("angles").flatten().to_numpy().reshape(len(self.ids), -1)
        cells, own = one("cell").to_numpy(), one("own").to_numpy()
        new = np.flatnonzero((np.diff(self.labels) != 0) | (np.diff(cells) != 0)) + 1
        edges = np.concatenate([[0], new, [len(own)]])
        self.runs = [
            (a, int(self.labels[a]), int(cells[a]), own[a:b], float(self.norms[a:b].max()))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)
        ]

    def rows(self, norm: float, angles: np.ndarray, label: int, same: bool, low: float, high: float) -> np.ndarray:
        """Rows whose score bounds overlap [low, high], of the anchor's label or of others."""
        parts = []
        for begin, own_label, cell, own, most in self.runs:
            if (own_label == label) != same:
                continue
            first, last = 0, len(own)
            if low > 0:
                reach = norm * most
                if low > reach * (1 + 1e-9):
                    continue
                turn = np.arccos(min(1.0, low / reach)) + ANGLE_SLACK
                first = int(np.searchsorted(own, angles[cell] - turn, side="left"))
                last = int(np.searchsorted(own, angles[cell] + turn, side="right"))
            if first < last:
                parts.append(np.arange(begin + first, begin + last))
        if not parts:
            return np.zeros(0, np.int64)
        at = np.concatenate(parts)
        theirs = self.angles[at]
        size = norm * self.norms[at]
        apart = np.maximum(np.abs(theirs - angles).max(axis=1).astype(float) - ANGLE_SLACK, 0)
        keep = size * np.cos(apart) + 1e-9 * size + 1e-6 >= low
        if high < np.inf:
            sums = (theirs + angles).astype(float)
            widest = np.minimum(np.minimum(sums, 2 * np.pi - sums).min(axis=1) + ANGLE_SLACK, np.pi)
            keep &= size * np.cos(widest) - 1e-9 * size - 1e-6 <= high
        return at[keep]

    def scores(self, q: np.ndarray, norm: float, at: np.ndarray) -> np.ndarray:
        return exact_scores(self.q[at], self.norms[at], q, norm)


def exact_scores(rows: np.ndarray, norms: np.ndarray, q: np.ndarray, norm: float) -> np.ndarray:
    """Integer inner products; doubles only where all their sums are whole numbers that they hold exactly."""
    if len(rows) and norm * norms.max() < EXACT_DOUBLE:
        return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return rows.astype(np.int64) @ q.astype(np.int64)


def _first(scores: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Order of rows: higher scores first, ties by smaller id."""
    return np.lexsort((ids, -scores))


def _visits(rows: DataFrame, anchors: DataFrame, chunks: int, dim: int, visit: Callable, schema: str) -> DataFrame:
    """``visit(chunk, anchor)`` for each routed anchor, in the task that holds the chunk; it yields lists of columns.

    A task keeps the rows of one chunk, and anchors stream by.
    """
    names = ["chunk", "kind", "label", "cell", "own", "vec_id", "q", "norm", "angles", "tag", "floors", "tops", "names"]
    none = F.lit(None)
    left = rows.select(
        "chunk", F.lit(0).alias("kind"), "label", "cell", "own", "vec_id", "q", "norm", "angles",
        none.cast("long").alias("tag"), *[none.cast("array<long>").alias(n) for n in ("floors", "tops", "names")],
    )
    right = anchors.withColumn("kind", F.lit(1)).select(*names)
    dealt = left.union(right).repartition(chunks, "chunk").sortWithinPartitions(
        "chunk", "kind", "label", "cell", "own", "vec_id"
    )
    width = len(schema.split(","))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        number, chunk = None, None
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            numbers = batch.column("chunk").to_numpy()
            cuts = np.flatnonzero((np.diff(kinds) != 0) | (np.diff(numbers) != 0)) + 1
            out = [[] for _ in range(width)]
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(kinds)], strict=True):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if numbers[a] != number:
                    held, number, chunk = [], numbers[a], None
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if chunk is None:
                    if not held:
                        continue
                    chunk = _Chunk(held, dim)
                    held = []
                q = _matrix(part.column("q"), dim)
                angles = part.column("angles").flatten().to_numpy().reshape(len(part), -1)
                columns = [part.column(n).to_pylist() for n in ("vec_id", "tag", "label", "norm", "floors", "tops", "names")]
                for i, (vec_id, tag, label, norm, floors, tops, ids) in enumerate(zip(*columns, strict=True)):
                    for own in visit(chunk, q[i], angles[i], norm, label, vec_id, floors, tops, ids):
                        count = len(own[-1])
                        for held_values, values in zip(out, [[vec_id] * count, [tag] * count, *own], strict=True):
                            held_values.extend(values)
            if out[0]:
                yield pa.RecordBatch.from_pydict(
                    dict(zip([s.split()[0] for s in schema.split(",")], [pa.array(v, pa.int64()) for v in out], strict=True))
                )

    return dealt.mapInArrow(run, schema)


def _reach(directory_angle: Callable[[str, int], Column], count: int) -> Column:
    """Least angle between an anchor and any row of a directory entry."""
    gaps = [
        F.greatest(F.col("angles")[r] - directory_angle("most", r), directory_angle("least", r) - F.col("angles")[r])
        for r in range(count)
    ]
    return F.greatest(F.lit(0.0), reduce(lambda a, b: F.greatest(a, b), gaps).cast("double") - ANGLE_SLACK)


def _routed(anchors: DataFrame, directory: DataFrame, chunks: int, count: int, same: bool) -> DataFrame:
    """Anchors, once for each chunk with an entry whose rows may reach the lowest score asked for."""
    # each anchor asks each chunk's entries, met by the chunk's number, and only what their bounds let through goes on
    met = anchors.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1)))).join(
        small(directory, 100_000), "chunk"
    )
    met = met.where((F.col("label") == F.col("entry_label")) == F.lit(same))
    turn = F.cos(_reach(lambda n, r: F.col(f"{n}_angles")[r], count))
    size = F.col("norm") * F.when(turn >= 0, F.col("most_norm")).otherwise(F.col("least_norm"))
    best = size * turn + 1e-9 * F.col("norm") * F.col("most_norm") + 1e-6
    met = met.where(F.array_min("floors").isNull() | (best >= F.array_min("floors")))
    return met.drop("entry_label", "most_norm", "least_norm", "most_angles", "least_angles", "cell").withColumns(
        {"cell": F.lit(0), "own": F.lit(0.0).cast("float")}
    ).dropDuplicates(["vec_id", "tag", "chunk"])


# --- the operator -----------------------------------------------------------------------------


def hard_negatives(
    embeddings: DataFrame, anchors: Column, config: NegativeConfig = NegativeConfig(),
    vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors``: a condition on vec_id (the column is so named) that says which rows are anchors. An anchor's positives are the
    first rows of its label under another id; each positive's negatives are the first rows of other labels within its window
    of scores. Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or with a null or non-finite component, take no part, nor do vectors whose
    scaled squared length is 2^60 or more, as their scores would leave a long. Vectors of unequal length count as padded with
    zeros; zero and empty vectors score zero. Rows repeated as a whole count once; rows that share an id alone are rows of
    their own. A positive with a negative score has no negatives. Other columns are ignored. An empty table gives an
    empty result.
    """
    rows = embeddings.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("long").alias("label"),
        F.col(f"`{embedding}`").alias("embedding"),
    ).where("vec_id is not null and label is not null and embedding is not null")
    dim = max(1, rows.agg(F.max(F.size("embedding"))).first()[0] or 0)
    distinct = durable(vectors(rows, dim, config))
    total = distinct.count()
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id", "label", "q").limit(config.sample).toArrow()
    sample_q = _matrix(sample.column("q").combine_chunks(), dim) if len(sample) else np.zeros((0, dim), np.int32)
    references = reference_directions(sample_q, config.references)
    if not len(references):
        references = np.eye(1, dim)
    count = len(references)
    chunk_rows = min(max(total // config.chunks, config.least_chunk), config.most_chunk)
    chunks = max(1, -(-total // chunk_rows))

    order = ["label", "cell", "own", "vec_id"]
    placed = _placed(distinct, references, dim).repartitionByRange(chunks, *order).sortWithinPartitions(*order)
    placed = durable(placed.withColumn("chunk", F.spark_partition_id()))
    by_entry = placed.groupBy("chunk", "label", "cell").agg(
        F.max("norm").alias("most_norm"), F.min("norm").alias("least_norm"),
        F.array(*[F.max(F.col("angles")[r]) for r in range(count)]).alias("most_angles"),
        F.array(*[F.min(F.col("angles")[r]) for r in range(count)]).alias("least_angles"),
    ).drop("cell").withColumnRenamed("label", "entry_label")
    directory = durable(by_entry)
    chunks = 1 + (directory.agg(F.max("chunk")).first()[0] or 0)

    known = {
        "ids": sample.column("vec_id").to_numpy(), "labels": sample.column("label").to_numpy(), "q": sample_q,
        "norms": np.sqrt((sample_q.astype(float) ** 2).sum(axis=1)),
    }
    asked = durable(placed.where(anchors).drop("chunk").withColumn("tag", F.xxhash64("label", "q")))
    empty = F.array().cast("array<long>")
    seeded = _seeded(asked.withColumns({"tops": empty, "names": empty}), known, config, dim, positives=True)

    def visit_positives(chunk, q, angles, norm, label, vec_id, floors, tops, ids):
        low = floors[0] if floors else -np.inf
        at = chunk.rows(norm, angles, label, True, low, np.inf)
        at = at[chunk.ids[at] != vec_id]
        scores = chunk.scores(q, norm, at)
        best = _first(scores, chunk.ids[at])[: config.positives]
        yield [chunk.ids[at[best]].tolist(), scores[best].tolist()]

    found = _visits(
        placed, _routed(seeded, directory, chunks, count, True), chunks, dim, visit_positives,
        f"{ANCHOR}, id long, score long",
    )
    by_anchor = Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "id")
    first = found.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= config.positives)
    positives = first.groupBy("anchor_id", "tag").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("p"))
    positives = durable(positives.select(
        F.col("anchor_id").alias("vec_id"), "tag", F.col("p.id").alias("names"), F.col("p.score").alias("tops")
    ))
    seeded = _seeded(asked.join(positives, ["vec_id", "tag"]), known, config, dim, positives=False)

    def visit_negatives(chunk, q, angles, norm, label, vec_id, floors, tops, ids):
        asked_for = [i for i, t in enumerate(tops) if t >= 0]
        if not asked_for:
            return
        at = chunk.rows(norm, angles, label, False, min(floors[i] for i in asked_for), max(tops[i] for i in asked_for))
        scores = chunk.scores(q, norm, at)
        order = _first(scores, chunk.ids[at])
        scores, names = scores[order], chunk.ids[at[order]]
        for i in asked_for:
            begin = int(np.searchsorted(-scores, -tops[i], side="left"))
            end = min(begin + config.negatives, int(np.searchsorted(-scores, -floors[i], side="right")))
            if begin < end:
                n = end - begin
                yield [[i] * n, [ids[i]] * n, [tops[i]] * n, names[begin:end].tolist(), scores[begin:end].tolist()]

    found = _visits(
        placed, _routed(seeded, directory, chunks, count, False), chunks, dim, visit_negatives,
        f"{ANCHOR}, place long, positive_id long, positive_score long, negative_id long, negative_score long",
    )
    by_positive = Window.partitionBy("anchor_id", "tag", "place").orderBy(F.desc("negative_score"), "negative_id")
    return found.withColumn("rank", F.row_number().over(by_positive)).where(F.col("rank") <= config.negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _seeded(anchors: DataFrame, known: dict, config: NegativeConfig, dim: int, positives: bool) -> DataFrame:
    """Adds ``floors``: scores that the sample alone proves each list's last place to reach, so lower ones are not asked for.

    For negatives the floor is at least the window's lower end.
    """
    columns = ["vec_id", "tag", "label", "q", "norm", "angles", "tops", "names"]

    def floors(q, label, vec_id, norm, tops):
        same = (known["labels"] == label) & (known["ids"] != vec_id)
        use = same if positives else known["labels"] != label
        scores = np.sort(exact_scores(known["q"][use], known["norms"][use], q, norm))[::-1]
        if positives:
            return [int(scores[config.positives - 1])] if len(scores) >= config.positives else []
        out = []
        for top in tops:
            lowest = -(-config.percent * top // 100)
            begin = int(np.searchsorted(-scores, -top, side="left"))
            last = begin + config.negatives - 1
            out.append(max(lowest, int(scores[last])) if last < len(scores) else lowest)
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("q"), dim)
            values = [batch.column(n).to_pylist() for n in ("label", "vec_id", "norm", "tops")]
            found = [floors(q[i], *own) for i, own in enumerate(zip(*values, strict=True))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=[*columns, "floors"]
            )

    return anchors.select(*columns).mapInArrow(
        run, "vec_id long, tag long, label long, q binary, norm double, angles array<float>, tops array<long>, "
        "names array<long>, floors array<long>"
    )
