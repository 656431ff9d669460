import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import infill
from tessera.llm import words as W

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def texts():
    rnd = random.Random(4)
    alphabet = ["a", "bc", "é", "漢字", "🙂x", " ", "\n", "\t ", "<", "P>", ">"]
    out = ["", None, " ", "\n\n", "one", " one", "one ", "é", "a <P> b", "<S>", "x<M>y", "<" * 9, "nul\x00 byte"]
    out += ["".join(rnd.choices(alphabet, k=rnd.randrange(1, 60))) for _ in range(150)]
    # lines of very different token lengths force many segments
    out.append(" ".join("w" * rnd.choice((1, 1, 1, 400)) for _ in range(30_000)) + "  ")
    out.append("long " * 5_000 + "x" * 100_000 + " é" * 5_000)
    return out


def plain_version(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    key = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(key[8 * i:8 * i + 8], 16) for i in range(4)]
    low, high = sorted((h[0] % (len(tokens) + 1), h[1] % (len(tokens) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return len(tokens), "plain", None, None, text
    prefix, middle, suffix = ("".join(tokens[a:b]) for a, b in ((0, low), (low, high), (high, None)))
    if h[3] % 100 < 80:
        return len(tokens), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return len(tokens), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("error", [1, 7, 127])
def test_index_finds_every_boundary_within_its_error(error):
    own = [t or "" for t in texts()]
    for chunk in W.chunks(pa.array(own), 1 << 16):
        places, first = infill.boundaries(chunk)
        begins, residuals = infill.fit(places, first, error)
        assert np.abs(residuals).max() <= error and set(first[:-1]) <= set(begins)
        for i in range(chunk.count):
            tokens = TOKEN.findall(own[chunk.first + i])
            expected = np.cumsum([0, *map(len, tokens)])
            assert (places[first[i]:first[i + 1]] == expected).all()


def test_stored_index_gives_exact_boundaries(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = infill.index_boundaries(docs, infill.InfillConfig(error=3))
    found = index.where("doc_id <> 163").select(
        "doc_id", F.transform(F.sequence(F.lit(0), F.col("boundaries.n").cast("int")),
                              lambda k: infill.boundary(F.col("boundaries"), k.cast("long"))).alias("at"),
    ).where(F.size("at") < 12_000)
    for row in found.collect():
        tokens = TOKEN.findall(dict(rows)[row["doc_id"]] or "")
        assert row["at"] == [0, *np.cumsum([len(t) for t in tokens]).tolist()]


def test_agrees_with_plain_version_and_restores(spark):
    rows = [(i * 7, t, i) for i, t in enumerate(texts())] + [(None, "a b c", -1), (None, None, -2), (14, "a b c", -3), (14, "a b c", -3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, boundaries long").repartition(7)
    out = infill.fill_in_middle(docs)
    assert out.columns == ["doc_id", "text", "boundaries", "infill"]
    cut = F.col("infill")
    got = out.select("*", infill.restored(cut["output"], cut["form"]).alias("back")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r["infill"]) == plain_version(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["infill"]["form"] for r in got} == {"plain", "psm", "spm"}


def test_clashing_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a b", 5, 6, "f")], "doc_id long, text string, low int, high int, infill string")
    assert infill.fill_in_middle(docs).columns == ["doc_id", "text", "low", "high", "infill"]
    assert infill.fill_in_middle(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        infill.index_boundaries(docs, infill.InfillConfig(error=128))
