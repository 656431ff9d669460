import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import quality as Q
from tessera.llm import words as W

DOCS, LABELS = "doc_id long, text string, host string, path string", "doc_id long, quality int, toxic int"


def corpus():
    rnd = random.Random(5)
    docs, labels = [], []
    for k in range(900):
        host = "good" if k % 3 == 0 else rnd.choice(["bad", "mid", None])
        junk = rnd.random() < {"good": 0.02, "bad": 0.8, "mid": 0.3, None: 0.3}[host]
        words = rnd.choices(["BUY!!", "NOW###", "$$$"], k=40) if junk else [f"w{rnd.randint(0, 900)}" for _ in range(60)]
        docs.append((k, " ".join(words), host, rnd.choice(["a", "b", None])))
        labels.append((k, int(not junk), 0))
    return docs, labels


def run(spark, docs, labels, config=Q.QualityConfig()):
    frame = spark.createDataFrame(docs, DOCS)
    return Q.hierarchical_quality(frame, spark.createDataFrame(labels, LABELS), F.col("host"), F.col("path"), config).collect()


def test_held_out_accuracy_and_site_posteriors(spark):
    docs, labels = corpus()
    docs += [(5000, "w1 " * 30, "lone", "x"), (5001, None, "good", "a"), (5002, "", None, None)]
    got = run(spark, docs, labels)
    truth = {d: q for d, q, _ in labels}
    tested = [r for r in got if r["held_out"] and r["doc_id"] in truth]
    assert len(got) == len(docs) and len(tested) > 200
    assert np.mean([r["kept"] == bool(truth[r["doc_id"]]) for r in tested]) > 0.98
    share = {r["host"]: r["host_share"] for r in got}
    whole = np.mean(list(truth.values()))
    assert share["good"] > 0.9 and share["bad"] < 0.4
    assert abs(share["lone"] - whole) < abs(share["good"] - whole) + 0.05  # one document moves its host little
    neutral = [r for r in got if r["doc_id"] in (5001, 5002)]
    assert all(0 < r["score"] < 1 for r in neutral)


def test_repeated_rows_no_labels_and_empty(spark):
    docs = [(1, "a b c", "h", "p"), (1, "a b c", "h", "p"), (None, None, None, None)]
    got = run(spark, docs, [])
    assert len(got) == 3 and all(r["evidence"] == pytest.approx(0) for r in got)
    assert run(spark, [], []) == []


def test_shape_is_bounded():
    texts = ["", None, "!", "A A A A", "x" * 100_000, "a b\na b\na b", "w " * 50_000]
    (chunk,) = W.chunks(pa.array(texts, pa.string()))
    values = Q.shape(chunk)
    assert values.shape == (7, len(Q.FEATURES)) and np.isfinite(values).all()
    assert not values[:2].any() and values[3][Q.FEATURES.index("runs")] == 0.75
    assert values[5][Q.FEATURES.index("line_copies")] == pytest.approx(2 / 3)


def plain_features(text):
    """FEATURES of a text without line breaks at its ends."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return [0.0] * len(Q.FEATURES)
    lower, joined = [w.lower() for w in words], "".join(words)
    lines = text.split("\n")

    def share(pattern):
        return len(re.findall(pattern, joined)) / len(joined)

    return [
        math.log1p(len(words)), len(set(lower)) / len(words) ** 0.9, share("[A-Z]"), share(r"[#*$%&|<>{}\\^~=_@]"), share("[!?]"),
        share("[0-9]"), min(len(joined) / len(words), 30) / 10, 1 - len(set(lines)) / len(lines),
        sum(a == b for a, b in zip(lower, lower[1:])) / len(words),
    ]


def plain_scores(docs, labels, config):
    """(doc_id, evidence, host share, path share, score) of each row, sorted."""
    x = np.array([plain_features(text) for _, text, _, _ in docs])
    held = [zlib.crc32(str(d).encode()) % 3 == 1 for d, *_ in docs]
    quality = {d: q for d, q, _ in labels}
    known = [i for i, (d, *_) in enumerate(docs) if d in quality and not held[i]]
    y = np.array([quality[docs[i][0]] for i in known], float)
    base = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    centre = x[known].mean(0)
    scale = np.sqrt(np.maximum((x[known] ** 2).mean(0) - centre ** 2, 1e-12))
    z = np.hstack([np.ones((len(x), 1)), (x - centre) / scale])
    penalty = np.full(z.shape[1], config.ridge)
    penalty[0] = 1e-6
    weights = np.zeros(z.shape[1])
    for _ in range(200):
        p = 1 / (1 + np.exp(-z[known] @ weights))
        bend = (z[known] * (p * (1 - p))[:, None]).T @ z[known] + np.diag(penalty)
        step = np.linalg.solve(bend, z[known].T @ (y - p) - penalty * weights)
        weights += step * min(1.0, 1 / np.abs(step).max())
    evidence = np.clip(z @ weights - base, -20, 20)
    own = 1 / (1 + np.exp(-(evidence + base)))

    def groups(keys):
        out = {}
        for key, value in zip(keys, own):
            n, good = out.get(key, (0, 0.0))
            out[key] = (n + 1, good + value)
        return out

    def strength(found, prior):
        top = sum(n * (g / n - prior[k]) ** 2 for k, (n, g) in found.items() if n > 1)
        spread = sum(prior[k] * (1 - prior[k]) for k, (n, _) in found.items() if n > 1)
        wide = sum((n - 1) * prior[k] * (1 - prior[k]) for k, (n, _) in found.items() if n > 1)
        low, high = config.concentration
        return high if not wide else min(high, max(low, 1 / min(1.0, max(1e-9, (top - spread) / wide)) - 1))

    share = own.mean()
    hosts, paths = groups([h for *_, h, _ in docs]), groups([(h, p) for *_, h, p in docs])
    strong = strength(hosts, dict.fromkeys(hosts, share))
    host_share = {h: (g + strong * share) / (n + strong) for h, (n, g) in hosts.items()}
    near = strength(paths, {k: host_share[k[0]] for k in paths})
    out = []
    for (d, _, h, p), e, o in zip(docs, evidence, own):
        n, good = paths[h, p]
        rate = min(1 - 1e-6, max(1e-6, (good - o + near * host_share[h]) / (n - 1 + near)))
        odds = [math.log(v / (1 - v)) for v in (share, rate)]
        out.append((d, e, host_share[h], rate, 1 / (1 + math.exp(-(e + odds[0] + config.weight * (odds[1] - odds[0]))))))
    return sorted(out)


def noisy_corpus():
    """Labels that shapes tell only in part, so that the fit has a finite optimum away from its bounds."""
    rnd = random.Random(11)
    docs, labels = [], []
    for k in range(400):
        host = "hot" if k % 2 else f"h{k % 23}"
        junk = rnd.random() < (0.7 if host == "hot" else 0.3)
        words = [rnd.choice(["Buy!", "now#", "A", "a", f"w{rnd.randint(0, 60)}"]) if rnd.random() < (0.5 if junk else 0.3) else f"v{rnd.randint(0, 300)}"
                 for _ in range(rnd.randint(5, 60))]
        for at in range(7, len(words), 9):
            words[at] += "\nsame line\nsame line\n" + words[at]
        docs.append((k, " ".join(words), host, rnd.choice(["a", "b", None])))
        labels.append((k, int(junk != (rnd.random() < 0.1)) ^ 1, 0))
    return docs, labels


@pytest.mark.parametrize("config", [
    Q.QualityConfig(), Q.QualityConfig(broadcast_rows=5, large_groups=4), Q.QualityConfig(broadcast_rows=0, large_groups=1),
])
def test_scores_match_a_plain_version_with_half_of_all_rows_at_one_host(spark, config):
    docs, labels = noisy_corpus()
    got = sorted((r["doc_id"], r["evidence"], r["host_share"], r["path_share"], r["score"]) for r in run(spark, docs, labels, config))
    wanted = plain_scores(docs, labels, config)
    assert [g[0] for g in got] == [w[0] for w in wanted]
    assert np.allclose(np.array(got, float), np.array(wanted, float), rtol=1e-4, atol=1e-4)


def test_very_long_texts_and_clashing_names(spark):
    rows = [(1, "word " * 200_000, "h", "p", 1.0, "x", "y"), (2, "Buy! " * 3, "h", "p", 2.0, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string, n double, _host string, features string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], LABELS)
    got = Q.hierarchical_quality(docs, labels, F.col("host"), F.col("path")).collect()
    assert {r["doc_id"] for r in got} == {1, 2} and all(r["host"] == "h" and 0 < r["score"] < 1 for r in got)
