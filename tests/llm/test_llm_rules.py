import random

import brute

from tessera.llm import rules

SCHEMA = "doc_id long, text string"


def texts():
    rnd = random.Random(4)
    pool = ["one", "two", "Three", "été", "#x", "*", "日本語"]
    out = ["", None, "  \n\t ", "short text", "\n".join(["the same line here"] * 6), "word " * 5000]
    for _ in range(120):
        line = [" ".join(rnd.choices(pool[: rnd.randint(2, 7)], k=rnd.randint(0, 12))) for _ in range(rnd.randint(1, 8))]
        out.append(rnd.choice(["\n", "\n\n", "\r\n", " "]).join(line + rnd.choices(line, k=rnd.randint(0, 4))))
        out.append(" ".join(f"w{rnd.randint(0, rnd.choice((20, 500)))}" for _ in range(rnd.randint(5, 80))))
    return out


def test_measures_and_verdict_agree_with_brute_force(spark):
    config = rules.RuleConfig()
    rows = list(enumerate(texts()))
    got = rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for row in got:
        r = row["rules"]
        found = (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n5_words"], row["base_failed"], row["kept"])
        assert found == brute.rules(dict(rows)[row["doc_id"]], config)
    assert {r["kept"] for r in got} == {True, False}


def test_repeated_rows_nulls_and_clashing_names(spark):
    good = " ".join(f"w{i}" for i in range(40))
    rows = [(None, good, "mine", True, 1), (1, good, None, False, 2), (1, good, None, False, 2), (2, None, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, rules string, kept boolean, n_words int")
    got = rules.quality_rules(frame)
    assert sorted(got.columns) == sorted(["doc_id", "text", "n_words", "rules", "base_failed", "kept"])
    found = sorted((r["doc_id"] or 0, r["kept"], r["n_words"]) for r in got.collect() if r["text"])
    assert found == [(0, True, 1), (1, True, 2), (1, True, 2)]
    assert rules.quality_rules(spark.createDataFrame([], SCHEMA)).collect() == []
