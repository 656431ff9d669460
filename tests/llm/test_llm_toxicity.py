import random
import zlib

import numpy as np

from tessera.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int, toxic int"


def corpus(n=1500):
    """Toxic where an insult meets a group, harmless where either stands alone."""
    rnd = random.Random(1)
    plain = [f"word{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        words = rnd.choices(plain, k=rnd.randint(3, 60))
        kind = k % 4
        if kind in (1, 3):
            words.insert(rnd.randrange(len(words)), "zorgish")
        if kind in (2, 3):
            words.insert(rnd.randrange(len(words)), "Vlenders")
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(kind == 3)))
    return docs, labels


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def test_pairs_are_learnt_and_held_out_rows_are_not_used(spark):
    docs, labels = corpus()
    config = T.ToxicityConfig(rounds=8, epochs=4)
    frame = spark.createDataFrame(docs, DOCS)
    truth = {d: t for d, _, t in labels}
    poisoned = [(d, q, 1 - t if held(d) else t) for d, q, t in labels]
    machine = T.fit(frame, spark.createDataFrame(poisoned, LABELS), config)
    got = T.score(frame, machine, config).collect()
    assert len(got) == len(docs) and all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in got)
    tested = [r for r in got if r["held_out"]]
    right = np.mean([r["predicted"] == truth[r["doc_id"]] for r in tested])
    assert right > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in got)


def test_margin_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    machine = T.Machine(np.zeros(0), 0.3, rng.normal(size=9), rng.normal(size=(9, 4)))
    items = [[0, 3, 8], [], [5]]
    owner = np.repeat(np.arange(3), [3, 0, 1])
    got = machine.margins(owner, np.array([0, 3, 8, 5]), 3)
    for k, own in enumerate(items):
        pairs = sum(machine.vectors[a] @ machine.vectors[b] for i, a in enumerate(own) for b in own[i + 1:])
        assert np.isclose(got[k], 0.3 + machine.weights[own].sum() + pairs)


def test_nulls_empty_and_unlabelled(spark):
    rows = [(1, None, 2), (None, "some text", 3), (2, "", 1), (2, "", 1), (3, "z " * 50_000, 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    machine = T.fit(frame, spark.createDataFrame([(None, None, 1), (1, None, None)], LABELS))
    got = T.score(frame, machine).collect()
    assert len(got) == 5 and len({r["score"] for r in got}) == 1 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert T.score(frame.limit(0), machine).collect() == []
    assert T.fit(frame.limit(0), spark.createDataFrame([], LABELS)).weights.size == 0


def test_one_row_of_a_labelled_id_is_learnt_from(spark):
    one, two = [k for k in range(20) if not held(k)][:2]
    rows = [(one, f"copy {k} of it") for k in range(500)] + [(two, "other"), (two, "other"), (None, "x")]
    labels = spark.createDataFrame([(one, 1, 1), (one, 1, 0), (two, 1, 0), (None, 1, 1)], LABELS)
    config = T.ToxicityConfig()
    got = [tuple(r) for r in T.training_rows(spark.createDataFrame(rows, DOCS), labels, config).collect()]
    again = [tuple(r) for r in T.training_rows(spark.createDataFrame(rows[::-1], DOCS).repartition(7), labels, config).collect()]
    assert sorted(got) == sorted(again) and sorted(r[0] for r in got) == [one, two]
    assert dict((r[0], r[2]) for r in got) == {one: 1, two: 0}
