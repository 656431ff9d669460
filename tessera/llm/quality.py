"""Document quality by hierarchical empirical Bayes.

A logistic classifier on a text's shape gives the evidence of a document. Its soft counts, summed by path and
by host, give each a posterior share of good documents, shrunk to the level above: path to host, host to
all. A document's score joins its evidence with its path's posterior, from which its own part is left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.tables import small
from tessera.session import durable

FEATURES = ("words", "distinct", "upper", "symbols", "marks", "digits", "word_length", "line_copies", "runs")


@dataclass(frozen=True)
class QualityConfig:
    """``ridge`` weighs the penalty on standardised features. ``concentration`` bounds how many documents a level above
    counts for; within it is estimated from the spread between groups. ``weight``: the share of the group's
    log-odds that a document takes over. ``broadcast_rows``: groups that are broadcast to their members; where there are
    more, only the ``large_groups`` that could be hot are, and the others meet their members in a shuffle.
    """

    ridge: float = 1.0
    iterations: int = 12
    concentration: tuple[float, float] = (2.0, 1000.0)
    weight: float = 0.5
    threshold: float = 0.5
    broadcast_rows: int = 100_000
    large_groups: int = 10_000


_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_DIGIT = np.zeros(256, np.int64)
_DIGIT[48:58] = 1
_SYMBOL = W.separator_table(b"#*$%&|<>{}\\^~=_@").astype(np.int64)
_MARK = W.separator_table(b"!?").astype(np.int64)
_CHARACTER = (W.STARTS_CHARACTER & ~W.SPACES).astype(np.int64)


def _total(per_byte: np.ndarray, chunk: W.Chunk) -> np.ndarray:
    at = np.flatnonzero(per_byte[chunk.data])
    return np.diff(chunk.per_text(at))


def shape(chunk: W.Chunk) -> np.ndarray:
    """A row of FEATURES for each text, all of bounded size; zeros for a text without words."""
    starts = chunk.word_starts(W.SPACES)
    bounds = chunk.per_text(starts)
    count = np.diff(bounds)
    owner = np.repeat(np.arange(chunk.count), count)
    hashes = W.segment_hashes(chunk.data, W.WORDS_LOWER, starts)
    salt = W.mix(np.arange(chunk.count, dtype=np.uint64), 3)
    keys = hashes ^ salt[owner]
    _, first = np.unique(keys, return_index=True)
    distinct = np.bincount(owner[first], minlength=chunk.count)
    runs = np.zeros(chunk.count)
    if len(keys) > 1:
        same = np.flatnonzero(keys[1:] == keys[:-1])
        runs = np.bincount(owner[same], minlength=chunk.count)
    characters = np.maximum(_total(_CHARACTER, chunk), 1)
    begins = chunk.offsets[:-1]
    after = np.flatnonzero(chunk.data == 10) + 1
    lines = np.unique(np.concatenate([begins[begins < len(chunk.data)], after[after < len(chunk.data)]]))
    line_owner = np.searchsorted(chunk.offsets, lines, side="right") - 1
    line_keys = W.segment_hashes(chunk.data, W.LINES, lines) ^ salt[line_owner]
    _, first_line = np.unique(line_keys, return_index=True)
    n_lines = np.bincount(line_owner, minlength=chunk.count)
    n_distinct = np.bincount(line_owner[first_line], minlength=chunk.count)
    words = np.maximum(count, 1)
    out = np.stack([
        np.log1p(count), distinct / words ** 0.9, _total(_UPPER, chunk) / characters, _total(_SYMBOL, chunk) / characters,
        _total(_MARK, chunk) / characters, _total(_DIGIT, chunk) / characters, np.minimum(characters / words, 30) / 10,
        1 - n_distinct / np.maximum(n_lines, 1), runs / words,
    ], 1)
    out[count == 0] = 0
    return out


def shapes(documents: DataFrame, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, features) of every row, in one pass over whole texts."""
    rows = documents.select("doc_id", host.cast("string").alias("host"), path.cast("string").alias("path"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column("text")):
                values = shape(chunk)
                width = values.shape[1]
                offsets = pa.array(np.arange(0, values.size + 1, width), pa.int32())
                own = batch.slice(chunk.first, chunk.count)
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("host"), own.column("path"),
                     pa.ListArray.from_arrays(offsets, pa.array(values.ravel()))],
                    names=["doc_id", "host", "path", "features"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"doc_id {kind}, host string, path string, features array<double>")


@dataclass(frozen=True)
class Classifier:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    base: float  # log-odds of the labelled rows

    def evidence(self) -> Column:
        """Log-odds of a good document by its features, less those of the labelled rows."""
        out = F.lit(float(self.weights[0]) - self.base)
        for k in range(len(self.centre)):
            value = (F.col("features")[k] - float(self.centre[k])) / float(self.scale[k])
            out = out + F.lit(float(self.weights[k + 1])) * value
        return F.greatest(F.lit(-20.0), F.least(F.lit(20.0), out))


def _sums(rows: DataFrame, per_rows, size: int) -> np.ndarray:
    """Sum over all rows of a vector of ``size`` from (features, good), by place."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
                total += per_rows(x, batch.column("good").to_numpy().astype(float))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(total)], names=["place", "value"])

    parts = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value"))
    out = np.zeros(size)
    for row in parts.collect():  # ``size`` rows
        out[row["place"]] = row["value"]
    return out


def fit(features: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig()) -> Classifier:
    """Logistic regression on all labelled rows but the held-out ones, by Newton steps on grouped sums."""
    known = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id"))).groupBy(
        F.col("doc_id").alias("_id")
    ).agg(F.min("quality").alias("good"))
    rows = durable(
        features.join(small(durable(known)), F.col("doc_id") == F.col("_id"))
        .select("features", F.col("good").cast("int").alias("good"))
    )
    width = len(FEATURES)
    moments = _sums(rows, lambda x, y: np.concatenate([[len(y), y.sum()], x.sum(0), (x * x).sum(0)]), 2 + 2 * width)
    n, good = moments[0], moments[1]
    base = float(np.log((good + 0.5) / (n - good + 0.5)))
    weights = np.zeros(width + 1)
    weights[0] = base
    if not n:
        return Classifier(np.zeros(width), np.ones(width), weights, base)
    centre = moments[2:2 + width] / n
    scale = np.sqrt(np.maximum(moments[2 + width:] / n - centre ** 2, 1e-12))
    penalty = np.full(width + 1, config.ridge)
    penalty[0] = 1e-6
    for _ in range(config.iterations):
        def slopes(x, y, weights=weights):
            z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            return np.concatenate([z.T @ (y - p), ((z * (p * (1 - p))[:, None]).T @ z).ravel()])

        got = _sums(rows, slopes, (width + 1) * (width + 2))
        gradient = got[:width + 1] - penalty * weights
        bend = got[width + 1:].reshape(width + 1, width + 1) + np.diag(penalty)
        step = np.linalg.solve(bend, gradient)
        weights = weights + step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(centre, scale, weights, base)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3 == 1


def _concentration(groups: DataFrame, size: str, good: str, prior: Column, config: QualityConfig) -> float:
    """How many documents the level above counts for, by the method of moments over the groups below it.

    The squared deviation of a group's share from its prior has the mean
    ``prior * (1 - prior) * (1 + (size - 1) * rho) / size``; rho is found from sums over all groups.
    """
    spread = prior * (1 - prior)
    n, share = F.col(size), F.col(good) / F.col(size)
    row = groups.where(n > 1).agg(
        F.sum(n * (share - prior) ** 2), F.sum(spread), F.sum((n - 1) * spread)
    ).first()
    low, high = config.concentration
    if row[0] is None or not row[2]:
        return high
    rho = min(1.0, max(1e-9, (row[0] - row[1]) / row[2]))
    return min(high, max(low, 1 / rho - 1))


def _attach(
    rows: DataFrame, groups: DataFrame, same: Column, members: str, total: int, config: QualityConfig
) -> DataFrame:
    """Rows with the columns of their group, whatever share of all rows one group holds.

    ``members`` names the column with a group's number of rows, ``total`` is their sum. Groups with at least one row of
    every ``large_groups`` are that many at most, so they are broadcast; each other group is a small part of a shuffle.
    """
    if groups.limit(config.broadcast_rows + 1).count() <= config.broadcast_rows:
        return rows.join(F.broadcast(groups), same)
    heavy = F.col(members) * config.large_groups >= total
    large = F.broadcast(groups.where(heavy))
    return rows.join(large, same).unionByName(rows.join(large, same, "left_anti").join(groups.where(~heavy), same))


def hierarchical_quality(
    documents: DataFrame, labels: DataFrame, host: Column, path: Column, config: QualityConfig = QualityConfig()
) -> DataFrame:
    """(doc_id, host, path, held_out, evidence, host_share, path_share, score, kept) of every document row.

    A null host or path is a group of its own. Null and empty texts have neutral features (all zero). Labels that
    disagree count as bad; without labels every document has the evidence 0. Repeated rows are scored each. A group's sums
    are partial sums first, and hosts and paths with many rows are broadcast to them, so a host with a third of all rows is
    no task's load. A document's own part is left out of its path's sum, not of the shares of its host and of all. Further
    columns of ``documents`` may have any name. An empty table gives an empty result.
    """
    table = durable(shapes(documents, host, path))
    model = fit(table, labels, config)
    own = 1 / (1 + F.exp(-(F.col("evidence") + model.base)))
    scored = table.withColumn("evidence", model.evidence()).select(
        "doc_id", "host", "path", "evidence", own.alias("own")
    )

    paths = durable(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("own").alias("good")))
    hosts = paths.groupBy("host").agg(
        F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.count("*").alias("host_paths")
    )
    whole = hosts.agg(F.sum("host_n"), F.sum("host_good"), F.sum("host_paths")).first()
    share = min(1 - 1e-6, max(1e-6, (whole[1] or 0.5) / (whole[0] or 1)))
    strong = _concentration(hosts, "host_n", "host_good", F.lit(share), config)
    hosts = durable(hosts.withColumn("host_share", (F.col("host_good") + strong * share) / (F.col("host_n") + strong)))
    shares = hosts.select(F.col("host").alias("_host"), "host_share", "host_paths")
    of_host = F.col("host").eqNullSafe(F.col("_host"))
    below = _attach(paths, shares, of_host, "host_paths", whole[2] or 0, config).drop("_host", "host_paths")
    near = _concentration(below, "n", "good", F.col("host_share"), config)
    below = durable(below).withColumnsRenamed({"host": "_host", "path": "_path"})

    without = (F.col("good") - F.col("own") + near * F.col("host_share")) / (F.col("n") - 1 + near)
    path_share = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), without))
    logit = lambda p: F.log(p / (1 - p))
    prior = logit(F.lit(share)) + config.weight * (logit(F.col("path_share")) - logit(F.lit(share)))
    same = F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
    return (
        _attach(scored, below, same, "n", whole[0] or 0, config)
        .withColumn("path_share", path_share)
        .withColumn("score", 1 / (1 + F.exp(-(F.col("evidence") + prior))))
        .select(
            "doc_id", "host", "path", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "evidence",
            "host_share", "path_share", "score", (F.col("score") >= config.threshold).alias("kept"),
        )
    )
