"""Benchmark decontamination with DataFrame functions only.

Every benchmark window of L words holds an aligned gram: of any L consecutive words of a document, one
gram of ``(L + 1) // 2`` words starts at a multiple of its length. So only the aligned grams of a document are
hashed and looked up, a fifth of its positions for ten-word windows, and the windows around the few grams found
are compared word by word with the benchmark's.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import free_names, quoted, small
from tessera.session import durable

#: Not a word, once A-Z are a-z.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The same in a text as it is.
BREAK_AS_IS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
#: Words of a document in one row while its windows are compared.
BLOCK = 1 << 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class DecontamConfig:
    """Broadcasts are used up to a counted number of rows; larger sides are joined by shuffle."""

    window: int = 10
    broadcast_rows: int = 500_000


def _words(lowered: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(lowered, F.lit("")), BREAK), "")


def _folded(text: Column) -> Column:
    """Lower case of all letters; a sigma's form, which depends on its neighbours, is made one."""
    return F.replace(F.lower(text), F.lit("\u03c2"), F.lit("\u03c3"))


def exact_words(text: Column) -> Column:
    """Words with A-Z in lower case and all else as it is."""
    return _words(F.translate(text, UPPER, LOWER))


def folded_words(text: Column) -> Column:
    """As many words, folded further: equal exact words are equal here too, and this is faster."""
    return _words(_folded(text))


def windows(benchmark: DataFrame, config: DecontamConfig) -> DataFrame:
    """(item_id, size, words): every window of every item; an item shorter than a window is one."""
    n = F.size("words")
    size = F.least(n, F.lit(config.window))
    return (
        benchmark.select("item_id", exact_words(F.col("text")).alias("words"))
        .where(n > 0)
        .select("item_id", size.alias("size"), "words", n.alias("n"))
        # windows are cut before rows are made of them, so no row carries the whole item
        .select("item_id", "size", F.explode(F.transform(
            F.sequence(F.lit(1), F.col("n") - F.col("size") + 1), lambda at: F.slice("words", at, F.col("size"))
        )).alias("words"))
    )


def _gram_hash(size: Column | int, words: Column, at: Column, gram: int) -> Column:
    return F.xxhash64(F.lit(size) if isinstance(size, int) else size, F.slice(words, at, F.lit(gram)))


def find_windows(
    documents: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()
) -> tuple[DataFrame, DataFrame]:
    """Rows (row_key, start, size, item_id) of every window occurrence, and the documents with their row_key.

    ``documents`` needs doc_id and text, ``benchmark`` item_id and text. Words count from 0.
    """
    items = durable(windows(benchmark.select("item_id", "text"), config))
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` values
    keyed = documents.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_key"))
    if not sizes:
        found = items.select(F.lit(0).cast("long").alias("row_key"), F.lit(0).alias("start"), "size", "item_id")
        return found.where(F.lit(False)), keyed

    folded = F.transform(F.col("words"), _folded)

    def first_grams(size: int) -> Column:
        gram = (size + 1) // 2
        return F.transform(F.sequence(F.lit(1), F.lit(gram)), lambda o: _gram_hash(size, folded, o, gram))

    anchors = None
    for size in sizes:
        own = items.where(F.col("size") == size).select(F.explode(first_grams(size)).alias("gram"))
        anchors = own if anchors is None else anchors.union(own)
    anchors = durable(anchors.distinct())

    def aligned(size: int) -> Column:
        gram = (size + 1) // 2
        count = F.size("words")
        places = F.when(count >= size, F.sequence(F.lit(1), count - gram + 1, F.lit(gram)))
        return F.transform(
            F.coalesce(places, F.array().cast("array<int>")),
            lambda p: F.struct(
                F.lit(size).alias("size"), p.alias("place"), _gram_hash(size, F.col("words"), p, gram).alias("gram")
            ),
        )

    grams = keyed.select("row_key", folded_words(F.col("text")).alias("words")).select(
        "row_key", F.explode(F.concat(*[aligned(s) for s in sizes])).alias("g")
    ).select("row_key", "g.size", "g.place", "g.gram")
    places = durable(
        grams.join(small(anchors, config.broadcast_rows), "gram", "left_semi")
        .groupBy("row_key").agg(F.collect_set(F.struct("size", "place")).alias("places"))
    )

    texts = keyed.join(small(places, config.broadcast_rows // 5), "row_key").dropDuplicates(["row_key"])
    candidates = _candidates(texts.select("row_key", exact_words(F.col("text")).alias("words"), "places"), config.window)
    found = candidates.join(small(items, config.broadcast_rows // 5), ["size", "words"]).select(
        "row_key", (F.col("begin") - 1).alias("start"), "size", "item_id"
    )
    return durable(found.distinct()), keyed


def _candidates(texts: DataFrame, window: int) -> DataFrame:
    """(row_key, size, begin, words): the windows around the grams found at ``places``.

    A text is first cut into blocks of words that overlap by what a window needs, and a row holds a block, so the work is
    linear in a text and memory does not grow with it.
    """
    n = F.size("words")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda k: F.struct(
        (k * BLOCK).alias("after"), F.greatest(F.lit(0), k * BLOCK - window).alias("skipped"),
    ))
    blocks = F.transform(blocks, lambda b: F.struct(
        b["skipped"].alias("skipped"),
        F.slice("words", b["skipped"] + 1, F.lit(BLOCK + 3 * window)).alias("words"),
        F.filter("places", lambda p: (p["place"] > b["after"]) & (p["place"] <= b["after"] + BLOCK)).alias("places"),
    ))
    block = texts.select("row_key", F.explode(blocks).alias("b")).select("row_key", "b.skipped", "b.words", "b.places")

    def around(p: Column) -> Column:
        size, place = p["size"], p["place"] - F.col("skipped")
        first = F.greatest(F.lit(1), place - F.floor((size + 1) / 2).cast("int") + 1)
        fitting = F.filter(F.sequence(first, place), lambda b: b + size - 1 <= F.size("words"))
        return F.transform(fitting, lambda b: F.struct(
            size.alias("size"), (b + F.col("skipped")).alias("begin"), F.slice("words", b, size).alias("words")
        ))

    return block.select("row_key", F.explode(F.flatten(F.transform("places", around))).alias("c")).select(
        "row_key", "c.size", "c.begin", "c.words"
    )


def contamination(
    documents: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()
) -> DataFrame:
    """(doc_id, row_key, n_words, n_hit, n_items, items_sha256, contaminated, hits) of every document row.

    ``hits`` lists the positions of hit words (null if none). Null and empty texts have no words and no
    hits; items without words have no window; an item without an id makes hits but is not listed. Repeated rows have
    equal results, repeated items count once. Other columns are ignored. Either table may be empty.
    """
    found, keyed = find_windows(documents, benchmark, config)
    per_text = found.groupBy("row_key").agg(
        F.collect_set(F.struct("start", "size")).alias("spans"),
        F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"),
    ).select(
        "row_key", "items",
        F.array_distinct(F.flatten(F.transform(
            "spans", lambda s: F.sequence(s["start"], s["start"] + s["size"] - 1)
        ))).alias("hits"),
    )
    counted = keyed.select("doc_id", "row_key", F.size(folded_words(F.col("text"))).cast("long").alias("n_words"))
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    n_hit = F.coalesce(F.size("hits"), F.lit(0)).cast("long")
    return counted.join(per_text, "row_key", "left").select(
        "doc_id", "row_key", "n_words",
        F.when(F.col("hits").isNull(), F.lit(0)).otherwise(n_hit).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col("hits").isNotNull().alias("contaminated"), "hits",
    )


def clean_documents(
    documents: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()
) -> DataFrame:
    """The rows of ``documents``, all columns, that hold no benchmark window."""
    found, _ = find_windows(documents, benchmark, config)
    key, hit = free_names(documents.columns, "_key", "_hit")
    hits = durable(found.select(F.col("row_key").alias(hit)).distinct())
    return documents.withColumn(key, F.xxhash64("doc_id", "text")).join(
        small(hits, config.broadcast_rows), F.col(key) == F.col(hit), "left_anti"
    ).select(*quoted(documents.columns))


def without_spans(
    documents: DataFrame, benchmark: DataFrame, config: DecontamConfig = DecontamConfig()
) -> DataFrame:
    """The rows of ``documents`` with every hit word cut out of ``text``, with the separators before it.

    Null and empty texts, and texts without a hit, stay as they are; repeated rows are cut alike. Other columns are
    kept. Either table may be empty.
    """
    key, hit, places = free_names(documents.columns, "_key", "_hit", "_places")
    hits = contamination(documents, benchmark, config).where("contaminated").select(
        F.col("row_key").alias(hit), F.col("hits").alias(places)
    ).dropDuplicates([hit])
    pieces = F.regexp_extract_all("text", F.lit(f"{BREAK_AS_IS}*[^{BREAK_AS_IS[1:]}+"), F.lit(0))
    pieces_of = free_names([*documents.columns, key, hit, places], "_pieces")[0]
    count = F.size(pieces_of)
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(numbers, F.col(places)), lambda i: F.get(F.col(pieces_of), i))
    tail = F.regexp_extract("text", f"{BREAK_AS_IS}*$", 0)
    cut = F.when(F.col(places).isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, ""), tail))
    return (
        documents.withColumn(key, F.xxhash64("doc_id", "text"))
        .join(hits, F.col(key) == F.col(hit), "left")
        .withColumn(pieces_of, F.when(F.col(places).isNotNull(), pieces))
        .withColumn("text", cut)
        .select(*quoted(documents.columns))
    )
