import random
import time

import brute

from tessera.llm import decontam

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def tables():
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choices("abcé1", k=rnd.randint(1, 3)))
    items = [(k, " ".join(word() for _ in range(rnd.choice((0, 1, 3, 9, 10, 11, 25, 40))))) for k in range(30)]
    items += [(30, items[5][1]), (31, None), (None, " ".join(word() for _ in range(14))), (33, "ΟΔΟΣ'Α ΣΑΣ " * 4)]
    docs = [(0, ""), (1, None), (2, "--- ... !"), (3, "οδος'α Σας " * 9), (4, "οδοσ α σας " * 9)]
    for k in range(5, 90):
        parts = [" ".join(word() for _ in range(rnd.randint(0, 25)))]
        for _ in range(rnd.randint(0, 3)):
            own = (rnd.choice(items)[1] or "").split()
            cut = rnd.randint(0, max(0, len(own) - 8))
            piece = own[cut:cut + rnd.randint(5, 30)]
            parts += [rnd.choice(("-", " ", "\n.")).join(piece).swapcase(), " ".join(word() for _ in range(rnd.randint(0, 9)))]
        docs.append((k, ", ".join(parts)))
    return docs, items


def test_hits_agree_with_brute_force(spark):
    docs, items = tables()
    found = brute.windows(items)
    for config in (decontam.DecontamConfig(), decontam.DecontamConfig(broadcast_rows=2)):
        got = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), config).collect()
        assert len(got) == len(docs)
        for r in got:
            have = (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])
            assert have == brute.contamination(dict(docs)[r["doc_id"]], found), r["doc_id"]
        assert 10 < sum(r["contaminated"] for r in got) < len(docs)


def test_windows_across_blocks_of_a_text(spark, monkeypatch):
    docs, items = tables()
    found = brute.windows(items)
    for block in (1, 7, 16):
        monkeypatch.setattr(decontam, "BLOCK", block)
        got = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
        assert all((r["n_words"], r["n_hit"], r["n_items"]) == brute.contamination(dict(docs)[r["doc_id"]], found)[:3] for r in got)


def test_a_long_contaminated_text(spark):
    rnd = random.Random(8)
    text = " ".join("".join(rnd.choices("abcdefg", k=5)) for _ in range(60_000))
    frame = spark.createDataFrame([(1, text + " and more of it"), (2, "clean")], DOCS)
    items = spark.createDataFrame([(7, text)], ITEMS)
    begun = time.time()
    (row,) = decontam.contamination(frame, items).where("contaminated").collect()
    assert (row["n_words"], row["n_hit"], row["n_items"]) == (60_004, 60_000, 1)
    cut = {r["doc_id"]: r["text"] for r in decontam.without_spans(frame, items).collect()}
    assert cut == {1: " and more of it", 2: "clean"}
    assert time.time() - begun < 90


def test_clean_documents_and_spans(spark):
    passage = "One of the Benchmark's items, told in more than ten words here."
    docs = [(1, f"Before. {passage} After!", "x"), (2, "nothing at all", "y"), (None, passage, "z"), (2, "nothing at all", "y"), (4, None, "n")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, words string")
    items = spark.createDataFrame([(7, passage), (7, passage)], ITEMS)
    clean = decontam.clean_documents(frame, items)
    assert clean.columns == frame.columns
    assert sorted(r["words"] for r in clean.collect()) == ["n", "y", "y"]
    cut = {r["words"]: r["text"] for r in decontam.without_spans(frame, items).collect()}
    assert cut == {"x": "Before. After!", "y": "nothing at all", "z": ".", "n": None}


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b")], DOCS), spark.createDataFrame([(1, "a")], ITEMS)
    no_docs, no_items = docs.limit(0), items.limit(0)
    assert decontam.contamination(no_docs, items).collect() == []
    (row,) = decontam.contamination(docs, no_items).collect()
    assert (row["n_words"], row["n_hit"], row["contaminated"]) == (2, 0, False)
    assert decontam.clean_documents(docs, no_items).count() == 1 and decontam.clean_documents(no_docs, items).count() == 0
