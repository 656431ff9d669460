import collections
import math
import random

import numpy as np
import pytest

from tessera.llm import language as L

DOCS = "doc_id long, text string"


def corpus():
    rnd = random.Random(2)
    pool = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rnd.choices(pool, weights=range(40, 0, -1), k=rnd.randint(1, 60)))) for k in range(200)]
    for k in range(0, 200, 4):
        docs[k] = (k, " ".join(["the good text of the target"] * rnd.randint(1, 6)))
    return docs


def plain(docs, target, config, vocabulary):
    """Losses of each text by dictionaries."""
    models = []
    known = lambda w: w if w in vocabulary else None
    pairs = collections.Counter()
    for _, text in docs:
        words = [known(w) for w in text.lower().split()]
        pairs.update(p for p in zip(words, words[1:]) if None not in p)
    assert len(pairs) < config.bigrams
    for chosen in ([d for d in docs if d[0] in target], docs):
        one, two = collections.Counter(), collections.Counter()
        for _, text in chosen:
            words = [known(w) for w in text.lower().split()]
            one.update(words)
            two.update(p for p in zip(words, words[1:]) if p in pairs)
        total = sum(one.values()) + config.smoothing * (len(vocabulary) + 1)
        share = lambda w, one=one, total=total: (one[w] + config.smoothing) / total
        taken = collections.Counter()
        for (v, _), n in two.items():
            taken[v] += max(n - config.discount, 0) / one[v]
        models.append((one, two, share, taken))

    def loss(text, model):
        one, two, share, taken = model
        out, before = 0.0, None
        for k, w in enumerate(text.lower().split()):
            w = known(w)
            p = (1 - taken[before]) * share(w) if k and before else share(w)
            if k and before and two[before, w]:
                p += max(two[before, w] - config.discount, 0) / one[before]
            out -= math.log(p)
            before = w
        return out / max(1, len(text.split()))

    return {d: (loss(t, models[0]), loss(t, models[1])) for d, t in docs}


def test_losses_agree_with_dictionaries(spark):
    docs = corpus()
    target = [(k,) for k in range(0, 200, 4)]
    config = L.LanguageConfig(vocabulary=30, block=200)
    frame = spark.createDataFrame(docs, DOCS).repartition(3)
    counts = collections.Counter(w for _, t in docs for w in t.lower().split())
    edge = sorted(counts.values())[-30]
    assert sum(n >= edge for n in counts.values()) == 30  # no tie at the edge of the vocabulary
    models = L.fit(frame, spark.createDataFrame(target, "doc_id long"), config)
    assert len(models.words) == 30
    got = {r["doc_id"]: r for r in L.score(frame, models).collect()}
    expected = plain(docs, {k for k, in target}, config, {w for w, n in counts.items() if n >= edge})
    for doc, (a, b) in expected.items():
        assert got[doc]["target_loss"] == pytest.approx(a) and got[doc]["background_loss"] == pytest.approx(b)
    assert np.mean([got[k]["difference"] for k in range(0, 200, 4)]) < np.mean([got[k]["difference"] for k in range(1, 200, 4)]) - 1


def test_probabilities_sum_to_one(spark):
    docs = corpus()
    models = L.fit(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(0,), (4,)], "doc_id long"), L.LanguageConfig(vocabulary=20))
    size = len(models.words) + 1
    for before in range(size):
        ids = np.empty(2 * size, np.int64)
        ids[0::2], ids[1::2] = before, np.arange(size)
        follows = np.tile([False, True], size)
        mass = np.exp(-models.losses(ids, follows)[1::2]).sum(0)
        assert mass == pytest.approx([1, 1])


def test_nulls_empty_and_repeats(spark):
    rows = [(1, "a b a b", "x"), (1, "a b a b", "x"), (None, None, "y"), (3, " \n", "z"), (4, "q " * 30_000, "z")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, difference string")
    ids = spark.createDataFrame([(1,), (None,), (1,)], "doc_id long")
    got = L.cross_entropy_difference(frame, ids).collect()
    assert len(got) == 5 and all(math.isfinite(r["difference"]) for r in got)
    assert all(r["difference"] == 0 and r["n_tokens"] == 0 for r in got if r["doc_id"] in (None, 3))
    assert L.cross_entropy_difference(frame, ids.limit(0)).count() == 5
    assert L.cross_entropy_difference(frame.limit(0), ids).collect() == []


def test_every_word_and_pair_counts(spark):
    rnd = random.Random(5)
    docs = corpus() + [(200 + k, " ".join(f"x{int(80_000 * rnd.random() ** 1.5)}" for _ in range(400))) for k in range(300)]
    docs.append((500, "alone"))
    target = {*range(0, 200, 4), *range(200, 260)}
    vocabulary = {w for _, t in docs for w in t.lower().split()}
    assert len(vocabulary) > 32_768
    frame, ids = spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame([(k,) for k in target], "doc_id long")
    expected = plain(docs, target, L.LanguageConfig(), vocabulary)
    for config in (L.LanguageConfig(), L.LanguageConfig(block=5_000, glance=50_000)):
        got = {r["doc_id"]: r for r in L.cross_entropy_difference(frame, ids, config).collect()}
        assert got.keys() == expected.keys()
        for doc, (a, b) in expected.items():
            assert got[doc]["target_loss"] == pytest.approx(a) and got[doc]["background_loss"] == pytest.approx(b)
            assert got[doc]["difference"] == pytest.approx(a - b)


def test_texts_travel_in_parcels(spark):
    docs = [(k, f"text {k} of words that many texts share " * 9 if k % 5 else "", k % 2 == 0, k % 3) for k in range(60)]
    rows = spark.createDataFrame(docs, "doc_id long, text string, wanted boolean, block int").coalesce(1)
    parcels = L._parcels(rows)
    assert parcels.count() == 3  # a batch has one for each block, whatever its rows

    def run(batches):
        for block, held in L._by_block(batches).items():
            for rows in L._unparcelled(held):
                yield rows.append_column("block", L.pa.array([block] * len(rows), L.pa.int32()))

    back = parcels.mapInArrow(run, "doc_id long, text string, wanted boolean, block int")
    assert sorted(map(tuple, back.collect())) == docs
