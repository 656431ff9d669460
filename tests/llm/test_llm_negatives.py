import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<double>"
CONFIG = negatives.NegativeConfig(sample=50, least_chunk=40, chunks=7)


def plain_version(rows, config=CONFIG, step=10):
    """Sorted result over all pairs, in exact integers."""
    fine = {}
    for vec_id, label, x in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = tuple(math.floor(config.scale * c) for c in x)
        if sum(c * c for c in q) < 2**60:
            fine[vec_id, label, q] = None
    width = max((len(k[2]) for k in fine), default=0)
    fine = {(i, lab, (*q, *[0] * (width - len(q)))) for i, lab, q in fine}
    out = []
    for a, label, q in fine:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r)), b, lab) for b, lab, r in fine if b != a or lab != label)
        positives = [(b, -s) for s, b, lab in scored if lab == label and b != a][: config.positives]
        for b, top in positives:
            window = [(c, -s) for s, c, lab in scored if lab != label and config.percent * top <= -100 * s <= 100 * top]
            out += [(a, b, k + 1, c, top, s) for k, (c, s) in enumerate(window[: config.negatives])]
    return sorted(out)


def found(spark, rows, config=CONFIG, step=10, schema=SCHEMA):
    frame = spark.createDataFrame(rows, schema).repartition(6)
    got = negatives.hard_negatives(frame, F.col("vec_id") % step == 0, config)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def clustered(seed, count=600, dim=6):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(5, dim))
    which = rnd.integers(0, 5, count)
    x = centres[which] + 0.3 * rnd.normal(size=(count, dim))
    return [(i, int((which[i] + (rnd.random() < 0.4)) % 4), x[i].tolist()) for i in range(count)]


@pytest.mark.parametrize("seed", [1, 2])
def test_agrees_with_brute_force_on_clusters(spark, seed):
    rows = clustered(seed)
    expected = plain_version(rows)
    assert len(expected) > 500 and found(spark, rows) == expected


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = clustered(3, 200)
    rows += rows[:40] + rows[:40]  # whole rows again
    rows += [(1000 + k, k % 2, [0.5] * 6) for k in range(300)]  # one vector that many rows share
    rows += [(10, None, [1.0] * 6), (None, 1, [1.0] * 6), (20, 1, None), (30, 1, [1.0, None]), (40, 1, [float("nan")]),
             (50, 1, [float("inf")] * 6), (60, 0, [0.0] * 6), (70, 1, []), (80, 2, [1.0, -2.0]), (90, 2, [1e9] * 6),
             (110, 1, [3e5, -3e5, 3e5]), (111, 1, [3e5, -3e5, 3e5, 0.01]), (113, 2, [2.9e5, -2.9e5, 3e5, 0.02]),
             (120, 3, [-1.0] * 6), (121, 3, [1.0] * 6)]
    expected = plain_version(rows)
    assert {60, 70, 80, 110} & {r[0] for r in expected} >= {80, 110}
    assert found(spark, rows) == expected


def test_bounds_never_lose_a_row():
    rnd = np.random.default_rng(5)
    for scale in (3, 300, 3e7):
        q = np.floor(rnd.normal(size=(400, 5)) * scale).astype("<i4")
        q[:50] = q[0]  # angles of zero, where arc cosines are least exact
        q[50:60] = -q[0]
        refs = negatives.reference_directions(q[::7], 8)
        angles = np.arccos(np.clip(negatives._unit(q.astype(float)) @ refs.T, -1, 1)).astype(np.float32)
        norms = np.sqrt((q.astype(float) ** 2).sum(axis=1))
        cell = angles.argmin(axis=1)
        order = np.lexsort((angles[np.arange(400), cell], cell))
        chunk = object.__new__(negatives._Chunk)
        chunk.ids, chunk.labels, chunk.norms, chunk.q, chunk.angles = np.arange(400)[order], np.zeros(400, int), norms[order], q[order], angles[order]
        own, cells = angles[order][np.arange(400), cell[order]], cell[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [400]])
        chunk.runs = [(int(a), 0, int(cells[a]), own[a:b], float(chunk.norms[a:b].max())) for a, b in zip(edges[:-1], edges[1:])]
        for a in (0, 55, 100, 399):
            exact = q[order].astype(object) @ q[a].astype(object)
            for low, high in ((np.quantile(exact.astype(float), 0.9), np.inf), (int(exact.max()), np.inf), (0, int(np.median(exact.astype(float))))):
                kept = set(chunk.rows(norms[a], angles[a], 0, True, low, high).tolist())
                assert {i for i in range(400) if low <= exact[i] <= high} <= kept
            assert (negatives.exact_scores(q[order], norms[order], q[a], norms[a]) == exact.astype(np.int64)).all()


def test_windows_score_fewer_rows_than_all():
    rnd = np.random.default_rng(1)
    centres = negatives._unit(rnd.normal(size=(8, 32)))
    q = np.floor(256 * negatives._unit(np.repeat(centres, 100, axis=0) + 0.03 * rnd.normal(size=(800, 32)))).astype("<i4")
    refs = negatives.reference_directions(q[::5], 8)
    angles = np.arccos(np.clip(negatives._unit(q.astype(float)) @ refs.T, -1, 1))
    gap = np.abs(angles[0] - angles).max(axis=1)
    assert np.cos(gap[100:]).max() < np.cos(gap[1:100]).min() + 0.5 and (gap[100:] > gap[1:100].max()).mean() > 0.9


def test_clashing_columns_and_empty_tables(spark):
    rows = [(i, i % 2, [1.0, float(i)], i) for i in range(1, 9)]
    schema = "vec_id long, label int, embedding array<float>, chunk long"
    assert found(spark, rows, step=2, schema=schema) == plain_version([r[:3] for r in rows], step=2)
    assert found(spark, [], schema=SCHEMA) == [] and found(spark, [(1, 1, [1.0])]) == []
    assert found(spark, [(10, 1, [1.0])]) == []
