"""Duplicate and similarity audit of texts, rule scans, and claim checks against JSON evidence."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce
from hashlib import sha256
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessera.functions.hashing import digest
from tessera.functions.scalar import collapse_space
from tessera.session import durable

# Words that carry no topic in a title or question.
STOPWORDS = (
    "a", "and", "are", "as", "at", "be", "by", "for", "from", "in", "into", "is", "of", "on", "or",
    "the", "to", "under", "with",
)
# Token pattern and similarity level of the audit.
TOKEN_PATTERN = "([a-z0-9]+(?:-[a-z0-9]+)*)"
THRESHOLD = 0.90
# Longs of a token set's parity sketch.
PARITY = 4
PARITIES = tuple(f"parity_{k}" for k in range(PARITY))
# The frequency sketch, 1 MB: rows of counters, and bits of a token's hash that choose one.
SKETCH_ROWS = 2
COUNTER_BITS = 16
COUNTERS = 1 << COUNTER_BITS
# Rounding to six digits lifts a similarity by at most 5e-7; the rest guards against float error.
SLACK = 1e-6
# Least threshold at which sets are cut into parts: below it a part holds too few tokens to tell sets apart.
PARTS_FROM = 0.8
# Odd multipliers that spread a part's sum, its band and its number over 64 bits.
SPREAD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))
# Class keys that may be broadcast, some 60 MB, and those a task remembers as dealt with.
BROADCAST_ROWS = 2_000_000
SEEN_KEYS = 1_000_000
# Rows of a batch that leave a task.
BATCH_ROWS = 1000
# Token sets that one place of the comparison holds, about.
PLACE_SETS = 256
# Rare tokens of a set, and pairs of sets, that give the search for the closest pairs its first bound.
SEED_TOKENS = 4
SEED_PAIRS = 4096


def token_set(*texts: Column) -> Column:
    """Distinct lower-case tokens of the joined texts, without short tokens and stopwords."""
    joined = F.lower(F.concat_ws(" ", *texts))
    tokens = F.regexp_extract_all(joined, F.lit(TOKEN_PATTERN), 1)
    kept = F.filter(F.array_distinct(tokens), lambda t: F.length(t) > 1)
    return F.array_except(kept, F.array(*[F.lit(w) for w in STOPWORDS]))


def duplicate_groups(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Groups of rows whose text is equal up to case and spacing: size, first id, group hash.

    A group may hold any share of the rows, so it is summarised and not collected; its members are
    listed by :func:`duplicate_members`.
    """
    keyed = df.select(ident, digest(collapse_space(F.col(text))).alias("group_hash"))
    return (
        keyed.groupBy("group_hash")
        .agg(F.count("*").alias("members"), F.min(ident).alias("first_id"))
        .filter(F.col("members") > 1)
    )


def duplicate_members(df: DataFrame, ident: str, text: str) -> DataFrame:
    """Every row that has an equal one, next to the first id of its group."""
    keyed = df.select(ident, digest(collapse_space(F.col(text))).alias("group_hash"))
    groups = duplicate_groups(df, ident, text)
    return keyed.join(groups, "group_hash").select("first_id", ident, "members")


def token_rows(df: DataFrame, ident: str, texts: Sequence[str]) -> DataFrame:
    """(id, class_id, key, size, tokens): each row's distinct tokens in order, and a 128-bit digest of them.

    ``key`` is the digest's first half as a number. The tokens are those of :func:`token_set`, found in one scan of the
    lower-case text that no later filter or projection repeats.
    """
    pattern, stop = re.compile(TOKEN_PATTERN.encode()), frozenset(w.encode() for w in STOPWORDS)
    letters = b"-0123456789abcdefghijklmnopqrstuvwxyz"
    blank = bytes(c if c in letters else 32 for c in range(256))

    def tokens_of(text: bytes) -> list[bytes]:
        words = set(text.translate(blank).split())
        odd = {w for w in words if b"-" in w}  # a hyphen joins tokens only where letters or digits are on both sides
        if odd:
            words = (words - odd).union(*map(pattern.findall, odd))
        return sorted({w for w in words if len(w) > 1} - stop)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), BATCH_ROWS):
                batch = whole.slice(begin, BATCH_ROWS)
                found = [tokens_of(x) for x in batch.column("text").cast(pa.binary()).to_pylist()]
                digests = b"".join(sha256(b" ".join(tokens)).digest()[:16] for tokens in found)
                sizes = np.array([len(tokens) for tokens in found], np.int32)
                columns = {
                    "id": batch.column("id"), "class_id": pa.array([digests[k:k + 16] for k in range(0, len(digests), 16)], pa.binary()),
                    "key": pa.array(np.frombuffer(digests, ">i8")[::2].astype(np.int64)), "size": pa.array(sizes),
                    "tokens": pa.ListArray.from_arrays(
                        pa.array(np.append(0, np.cumsum(sizes)), pa.int32()),
                        pa.array([t for tokens in found for t in tokens], pa.binary()).cast(pa.string()),
                    ),
                }
                yield pa.RecordBatch.from_pydict(columns)

    lowered = df.select(F.col(ident).alias("id"), F.lower(F.concat_ws(" ", *[F.col(t) for t in texts])).alias("text"))
    return lowered.mapInArrow(
        run, f"id {dict(lowered.dtypes)['id']}, class_id binary, key long, size int, tokens array<string>"
    )


def _facts(df: DataFrame, ident: str, texts: Sequence[str]) -> DataFrame:
    """(id, class_id, key, size, hashes) of each row, written once: every later step reads numbers, no text."""
    rows = token_rows(df, ident, texts)
    return durable(rows.select("id", "class_id", "key", "size", _hashes().alias("hashes")))


def token_classes(rows: DataFrame) -> DataFrame:
    """(class_id, size, members, first_id): rows folded by equal token sets. No token travels."""
    return rows.groupBy("class_id").agg(
        F.any_value("size").alias("size"), F.count("*").alias("members"), F.min("id").alias("first_id")
    )


# --- prefixes ---------------------------------------------------------------------------------


def _hashes() -> Column:
    return F.transform("tokens", lambda t: F.xxhash64(t))


def _hashed(rows: DataFrame) -> DataFrame:
    hashes = F.col("hashes") if "hashes" in rows.columns else _hashes().alias("hashes")
    return rows.select("class_id", "key", "size", hashes)


def _counters(hashes: np.ndarray) -> list[np.ndarray]:
    """The counter of each row of the sketch that a token's hash falls on."""
    raw = hashes.view(np.uint64)
    return [((raw >> np.uint64(COUNTER_BITS * r)) & np.uint64(COUNTERS - 1)).astype(np.int64) for r in range(SKETCH_ROWS)]


def frequency_sketch(rows: DataFrame) -> np.ndarray:
    """Count-min sketch of how many rows hold a token: ``SKETCH_ROWS`` x ``COUNTERS`` sums, built in one pass.

    A task adds up its own counters first, so as many rows as the sketch has counters leave it at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros((SKETCH_ROWS, COUNTERS), np.int64)
        for batch in batches:
            hashes = batch.column("hashes").flatten().to_numpy()
            for line, at in zip(own, _counters(hashes), strict=True):
                line += np.bincount(at, minlength=COUNTERS)
        used = np.flatnonzero(own.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(own.ravel()[used])], names=["counter", "n"])

    counted = _hashed(rows).select("hashes").mapInArrow(run, "counter long, n long")
    summed = counted.groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SKETCH_ROWS * COUNTERS, np.int64)
    out[summed.column("counter").to_numpy()] = summed.column("n").to_numpy()
    return out.reshape(SKETCH_ROWS, COUNTERS)


def prefixes(rows: DataFrame, sketch: np.ndarray, threshold: float, most: int | None = None) -> DataFrame:
    """(class_id, key, size, length, parity_*, prefix) of each distinct non-empty set; ``most`` bounds the length.

    ``prefix`` holds the hashes of the ``length`` tokens that the sketch counts as rarest, ties by hash. Any order of
    all tokens makes the filter exact, a good one makes it sharp; equal hashes of two tokens only add candidates. A
    set is ordered where its row lies, so what travels to fold the copies is prefixes and a parity sketch.
    """
    low = threshold - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy().astype(np.int64)
            hashes = batch.column("hashes").flatten().to_numpy()
            owner = np.repeat(np.arange(len(sizes)), sizes)
            estimate = reduce(np.minimum, (line[at] for line, at in zip(sketch, _counters(hashes), strict=True)))
            order = np.lexsort((hashes, estimate, owner))
            place = np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            # a needed overlap one too small by rounding makes a prefix one longer, which loses nothing
            length = sizes - np.maximum(np.ceil(sizes * low - 1e-9).astype(np.int64), 1) + 1
            length = length if most is None else np.minimum(length, most)
            taken = hashes[order[place < length[owner]]]
            bit = (hashes.view(np.uint64) >> np.uint64(64 - 6)).astype(np.int64)
            word = (hashes.view(np.uint64) >> np.uint64(52)).astype(np.int64) & (PARITY - 1)
            odd = np.bincount((owner * PARITY + word) * 64 + bit, minlength=len(sizes) * PARITY * 64) & 1
            packed = np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(sizes), PARITY)
            edges = pa.array(np.concatenate([[0], np.cumsum(length)]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("class_id"), batch.column("key"), batch.column("size"), pa.array(length, pa.int32()),
                 *(pa.array(packed[:, k]) for k in range(PARITY)), pa.ListArray.from_arrays(edges, pa.array(taken))],
                names=["class_id", "key", "size", "length", *PARITIES, "prefix"],
            )

    longs = ", ".join(f"{n} long" for n in PARITIES)
    found = _hashed(rows.filter("size > 0")).mapInArrow(
        run, f"class_id binary, key long, size int, length int, {longs}, prefix array<long>"
    )
    return found.groupBy("class_id").agg(*[F.any_value(n).alias(n) for n in ("key", "size", "length", *PARITIES, "prefix")])


def _differing() -> Column:
    """A lower bound of how many tokens only one of the two sets has: each odd bit of the sketches' xor needs one."""
    return reduce(
        lambda x, y: x + y, [F.bit_count(F.col(f"{n}_a").bitwiseXOR(F.col(f"{n}_b"))) for n in PARITIES]
    )


# --- pairs ------------------------------------------------------------------------------------


def _candidates(ordered: DataFrame, threshold: float) -> DataFrame:
    """(key_a, key_b) of the pairs that prefixes, sizes and parity sketches allow to reach the threshold."""
    low = threshold - SLACK
    # sizes of a pair differ by at most the threshold, so they fall into the same or the next size band; joining on the
    # band as well splits a token that very many sets share. A set calls at its own band and visits the next.
    band = F.floor(F.log(F.col("size").cast("double")) / -log(low)).cast("int")
    rows = ordered.select(
        "class_id", "key", "size", "length", *PARITIES, F.posexplode("prefix").alias("at", "token"), band.alias("own"),
    ).select("*", F.explode(F.array(F.col("own"), F.col("own") + 1)).alias("band"))
    names = ("class_id", "key", "size", "length", "at", "own", *PARITIES)
    left, right = (
        rows.select("token", "band", *[F.col(n).alias(f"{n}_{side}") for n in names]) for side in ("a", "b")
    )
    sizes = ("size_a", "size_b", "length_a", "length_b")
    home = F.col("own_a") == F.col("band")
    ordered_once = (F.col("own_b") < F.col("own_a")) | (F.col("class_id_a") < F.col("class_id_b"))
    shared_prefix = (
        left.join(right, ["token", "band"])
        .filter(
            home & ordered_once & (F.col("class_id_a") != F.col("class_id_b"))
            & (F.col("size_a") >= F.col("size_b") * low)
            & (F.col("size_b") >= F.col("size_a") * low)
            & (_differing() * (1 + low) <= (F.col("size_a") + F.col("size_b")) * (1 - low) + 1e-6)
        )
        .groupBy("class_id_a", "class_id_b", "key_a", "key_b", *sizes)
        .agg(F.count("*").alias("common"), F.min("at_a").alias("at_a"), F.min("at_b").alias("at_b"))
    )
    overlap = F.ceil(F.lit(low / (1 + low)) * (F.col("size_a") + F.col("size_b")) - 1e-6)
    following = F.least(F.col("size_a") - F.col("at_a"), F.col("size_b") - F.col("at_b"))
    rest = F.greatest(F.col("size_a") - F.col("length_a"), F.col("size_b") - F.col("length_b"))
    return shared_prefix.filter((following >= overlap) & (F.col("common") + rest >= overlap)).select("key_a", "key_b")


def part_signatures(rows: DataFrame, threshold: float) -> DataFrame:
    """(signature, key, size): each distinct set cut into parts by the hashes of its tokens, a signature for each part.

    Two sets at the threshold differ in ``most`` tokens at most, a number that follows from their sizes. Cut into one part
    more than that, they are equal in some part, and part, tokens and number of parts make the signature. Sizes
    are banded so that such sets lie in one band or in neighbours: a set is cut as its own band asks, and as the next one does.
    """
    low = threshold - SLACK

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, seen = [1, floor(1 / low) + 1], set()
        for batch in batches:
            all_keys = batch.column("key").to_pylist()
            new = np.zeros(len(all_keys), bool)
            for at, key in enumerate(all_keys):
                if key not in seen:
                    new[at] = True
                    seen.add(key)
            if len(seen) > SEEN_KEYS:  # copies are folded later too
                seen.clear()
            kept = batch.filter(pa.array(new))
            sizes = kept.column("size").to_numpy().astype(np.int64)
            if not len(sizes):
                continue
            while edges[-2] <= sizes.max():  # the last band may be visited, so its upper end is needed too
                edges.append(floor(edges[-1] / low) + 1)
            ends = np.array(edges[1:], np.int64) - 1
            parts = np.floor((1 - low) / (1 + low) * 2 * ends + 1e-9).astype(np.int64) + 1
            own = np.searchsorted(ends, sizes)
            hashes = kept.column("hashes").flatten().to_numpy().view(np.uint64)
            halves = [(hashes & np.uint64(0xFFFFFFFF)).astype(float), (hashes >> np.uint64(32)).astype(float)]
            deal = (hashes * SPREAD[0]) >> np.uint64(32)
            for band in (own, own + 1):
                count = np.where(parts[band] > 1, parts[band], 0)  # sets that may differ in no token are of one class
                begin = np.cumsum(count) - count
                owner = np.repeat(np.arange(len(sizes)), np.where(count > 0, sizes, 0))
                cut = np.repeat(count > 0, sizes)
                place = begin[owner] + ((deal[cut] * count[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
                # sums of 32-bit halves are exact in a double
                sums = [np.bincount(place, half[cut], count.sum()).astype(np.uint64) for half in halves]
                holder = np.repeat(np.arange(len(sizes)), count)
                number = (np.arange(count.sum()) - begin[holder]).astype(np.uint64)
                mixed = (sums[0] + (sums[1] << np.uint64(32))) * SPREAD[1] + number * SPREAD[2] + band[holder].astype(np.uint64)
                mixed = (mixed ^ (mixed >> np.uint64(29))) * SPREAD[0]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mixed.view(np.int64)), kept.column("key").take(pa.array(holder)), kept.column("size").take(pa.array(holder))],
                    names=["signature", "key", "size"],
                )

    return _hashed(rows.filter("size > 0")).select("key", "size", "hashes").mapInArrow(run, "signature long, key long, size int")


def _part_candidates(rows: DataFrame, threshold: float) -> DataFrame:
    """(key_a, key_b) of the pairs of sets with an equal part and sizes that allow the threshold."""
    low = threshold - SLACK
    dealt = part_signatures(rows, threshold).repartition("signature").distinct()
    same = W.partitionBy("signature")
    shared = durable(
        dealt.withColumn("least", F.min("key").over(same)).withColumn("greatest", F.max("key").over(same))
        .filter("least <> greatest").select("signature", "key", "size")
    )
    left, right = (
        shared.select("signature", F.col("key").alias(f"key_{side}"), F.col("size").alias(f"size_{side}")) for side in ("a", "b")
    )
    return left.join(right, "signature").filter(
        (F.col("key_a") < F.col("key_b")) & (F.col("size_a") >= F.col("size_b") * low) & (F.col("size_b") >= F.col("size_a") * low)
    ).select("key_a", "key_b").distinct()


def _measured(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(class_a, class_b, similarity, shared_terms) of pairs of keys, from the 64-bit hashes of their whole token sets.

    Sets of one neighbourhood, named by its least key, are placed together, so that a set travels once to each place that
    its pairs lead to and not once for each pair. A large neighbourhood is dealt into places of about ``PLACE_SETS`` sets,
    small ones share a place; a cell is where two places meet. Only sets in some pair travel.
    """
    pairs = durable(pairs)
    least = F.least("key_a", "key_b").alias("label")
    ends = pairs.select(F.col("key_a").alias("key"), least).union(pairs.select("key_b", least))
    labels = durable(ends.groupBy("key").agg(F.min("label").alias("label")))
    sets = labels.count()
    parts = labels.groupBy("label").agg(F.ceil(F.count("*") / PLACE_SETS).alias("parts"))
    placed = durable(labels.join(parts, "label").select("key", F.when(
        F.col("parts") > 1, F.xxhash64("label", F.pmod(F.xxhash64("key"), F.col("parts")))
    ).otherwise(F.pmod(F.xxhash64("label"), F.lit(sets // PLACE_SETS + 1))).alias("place")))
    for side in ("a", "b"):
        pairs = pairs.join(placed.select(F.col("key").alias(f"key_{side}"), F.col("place").alias(f"place_{side}")), f"key_{side}")
    cell = F.xxhash64(F.least("place_a", "place_b"), F.greatest("place_a", "place_b")).alias("cell")
    met = durable(pairs.select(cell, "key_a", "key_b"))
    members = met.select("cell", F.col("key_a").alias("key")).union(met.select("cell", "key_b")).distinct()
    wanted = labels.select("key")
    own = _hashed(rows).join(F.broadcast(wanted) if sets <= BROADCAST_ROWS else wanted, "key", "left_semi")
    whole = own.groupBy("class_id", "key").agg(F.any_value("hashes").alias("hashes"))
    return _compared(members.join(whole, "key"), met).select(
        F.least("id_a", "id_b").alias("class_a"), F.greatest("id_a", "id_b").alias("class_b"),
        F.round(F.col("shared_terms") / F.col("joined"), 6).alias("similarity"), "shared_terms",
    )


def _compared(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id_a, id_b, shared_terms, joined): sizes of intersection and union of the ``pairs`` (cell, key_a, key_b).

    A task holds the ``sets`` (cell, key, class_id, hashes) of one cell while the pairs of the cell pass by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}
        for batch in batches:
            found = []
            cells, kinds, keys, others = (batch.column(n).to_pylist() for n in ("cell", "kind", "key", "other"))
            ids, values, edges = batch.column("class_id"), batch.column("hashes").values.to_numpy(), batch.column("hashes").offsets.to_numpy()
            for row, (cell, kind, key, other) in enumerate(zip(cells, kinds, keys, others, strict=True)):
                if cell != at:
                    at, held = cell, {}
                if kind == 0:
                    held.setdefault(key, []).append((ids[row].as_py(), values[edges[row]:edges[row + 1]].copy()))
                    continue
                for id_a, hashes_a in held[key]:
                    for id_b, hashes_b in held[other]:
                        both = np.concatenate([hashes_a, hashes_b])
                        both.sort()
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        found.append((id_a, id_b, shared, len(both) - shared))
            if found:
                kinds_of = (pa.binary(), pa.binary(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds_of, strict=True)],
                    names=["id_a", "id_b", "shared_terms", "joined"],
                )

    rows = sets.select("cell", F.lit(0).alias("kind"), "key", F.lit(None).cast("long").alias("other"), "class_id", "hashes").union(
        pairs.select("cell", F.lit(1), "key_a", "key_b", F.lit(None).cast("binary"), F.lit(None).cast("array<long>"))
    )
    return rows.repartition("cell").sortWithinPartitions("cell", "kind").mapInArrow(
        run, "id_a binary, id_b binary, shared_terms int, joined int"
    )


def class_pairs(rows: DataFrame, threshold: float = THRESHOLD, sketch: np.ndarray | None = None) -> DataFrame:
    """All pairs of distinct token sets of :func:`token_rows` with Jaccard at or above the threshold, exactly.

    From ``PARTS_FROM`` on, candidates are the sets with an equal part (:func:`part_signatures`). A part holds some
    (1 + threshold) / (1 - threshold) / 2 tokens, so hardly any but similar sets meet, however often a token occurs.

    Below, candidates share a token among the rarest few of each set (prefix filter) and have close sizes. A frequency
    sketch, not a count of all tokens, tells the rare ones. Parity sketches drop, inside that join, pairs that
    differ in too many tokens. Before the token sets themselves are compared, two bounds drop pairs that cannot reach
    the needed overlap: what can still follow the first shared token, and what the prefixes share plus the longer rest.
    """
    if not SLACK < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    if threshold >= PARTS_FROM:
        found = _part_candidates(rows, threshold)
    else:
        sketch = frequency_sketch(rows) if sketch is None else sketch
        found = _candidates(durable(prefixes(rows, sketch, threshold)), threshold)
    return _measured(found, rows).filter(F.col("similarity") >= threshold)


def similar_pairs(df: DataFrame, ident: str, texts: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """High-similarity pairs between distinct token sets, with how many row pairs each stands for."""
    rows = _facts(df, ident, texts)
    return _described_pairs(durable(token_classes(rows)), class_pairs(rows, threshold))


def _described_pairs(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    info = classes.select("class_id", "first_id", "members")
    both = pairs.join(
        info.select(F.col("class_id").alias("class_a"), F.col("first_id").alias("id_a"), F.col("members").alias("members_a")),
        "class_a",
    ).join(
        info.select(F.col("class_id").alias("class_b"), F.col("first_id").alias("id_b"), F.col("members").alias("members_b")),
        "class_b",
    )
    return both.select(
        F.least("id_a", "id_b").alias("first_a"), F.greatest("id_a", "id_b").alias("first_b"),
        "similarity", "shared_terms",
        (F.col("members_a") * F.col("members_b")).alias("row_pairs"),
    )


def similarity_totals(df: DataFrame, ident: str, texts: Sequence[str], threshold: float = THRESHOLD) -> DataFrame:
    """Counts behind the audit: distinct sets, row pairs at the threshold, highest similarity of any pair.

    Pairs inside a class are counted by formula, never enumerated. Sets without tokens have
    similarity zero to everything. Where no pair reaches the threshold, the highest similarity comes from the search
    for the closest pair; it is zero where there is no pair.
    """
    rows = _facts(df, ident, texts)
    classes = durable(token_classes(rows))
    across = durable(_described_pairs(classes, class_pairs(rows, threshold))).agg(
        F.coalesce(F.sum("row_pairs"), F.lit(0)).alias("between"), F.max("similarity").alias("top")
    )
    copies = F.when(F.col("size") > 0, F.col("members") * (F.col("members") - 1) / 2).otherwise(0)
    inside = classes.agg(
        F.count("*").alias("token_sets"), F.sum("members").alias("rows"),
        F.sum(copies).cast("long").alias("within"),
    )
    joined = durable(inside.withColumn("_k", F.lit(1)).join(F.broadcast(across.withColumn("_k", F.lit(1))), "_k"))
    known = joined.first()
    if known["within"]:
        best = 1.0
    elif known["top"] is not None:
        best = known["top"]
    else:
        nearest = _search(rows, classes, 1).agg(F.max("similarity")).first()[0]
        best = 0.0 if nearest is None else nearest
    return joined.select(
        "rows", "token_sets", (F.col("within") + F.col("between")).alias("high_similarity_pairs"),
        F.lit(best).alias("maximum_similarity"),
    )


# --- the closest pairs ------------------------------------------------------------------------


def _first_bound(rows: DataFrame, sketch: np.ndarray, k: int) -> float | None:
    """A similarity that at least ``k`` pairs of classes reach, or None where the look was too short.

    Sets that share one of their ``SEED_TOKENS`` rarest tokens are paired with the first set that has it; the most
    promising of these pairs by sizes and parity sketches are compared, and the k-th best is the bound. It only
    says where the exact search begins, so looking at no more than ``SEED_PAIRS`` of them costs no result.
    """
    ordered = durable(prefixes(rows, sketch, 0.5, SEED_TOKENS))
    names = ("class_id", "key", "size", *PARITIES)
    rare = ordered.select(*names, F.explode("prefix").alias("token"))
    heads = rare.groupBy("token").agg(F.min(F.struct(*names)).alias("head"), F.count("*").alias("n")).filter("n > 1")
    met = rare.select("token", *[F.col(n).alias(f"{n}_b") for n in names]).join(heads, "token")
    met = met.select("*", *[F.col("head")[n].alias(f"{n}_a") for n in names])
    total = F.col("size_a") + F.col("size_b")
    apart = F.greatest(_differing(), F.abs(F.col("size_a") - F.col("size_b")))
    promise = (total - apart) / (total + apart)
    pairs = met.filter("class_id_a <> class_id_b").groupBy("class_id_a", "class_id_b", "key_a", "key_b").agg(F.max(promise).alias("promise"))
    best = pairs.orderBy(F.desc("promise"), "class_id_a", "class_id_b").limit(max(SEED_PAIRS, 4 * k))
    seeds = _measured(best.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct(), rows)
    top = seeds.select("similarity").filter("similarity > 0").orderBy(F.desc("similarity")).limit(k)
    row = top.agg(F.count("*").alias("n"), F.min("similarity").alias("least")).first()
    return row["least"] if row["n"] >= k else None


def _search(rows: DataFrame, classes: DataFrame, k: int, enough: Callable | None = None) -> DataFrame:
    """All class pairs down to some similarity that at least ``k`` of them reach (or all that share a token).

    The first threshold is the k-th best of the seeds, which proves that no pair below it can be among the first k.
    Where the seeds are too few it falls by halves until ``enough`` pairs, k by default, are found, or until it lies
    below the least similarity that two sets with a common token can have.
    """
    sketch = frequency_sketch(rows)
    threshold = _first_bound(rows, sketch, k)
    if threshold is not None:
        return durable(class_pairs(rows, threshold, sketch))
    largest = classes.agg(F.max("size")).first()[0] or 0
    least = max(1 / (2 * largest + 1), 2 * SLACK)
    threshold = 0.5
    while True:
        threshold = max(threshold, least)
        found = durable(class_pairs(rows, threshold, sketch))
        if threshold <= least or (found.count() >= k if enough is None else enough(found)):
            return found
        threshold /= 2


def closest_sets(df: DataFrame, ident: str, texts: Sequence[str], k: int = 20) -> DataFrame:
    """The ``k`` closest pairs of distinct token sets that share a token, by similarity and first ids: no floor.

    Columns: first_a, first_b, similarity, shared_terms (their number), row_pairs (that have these two sets).
    """
    rows = _facts(df, ident, texts)
    classes = durable(token_classes(rows))
    found = _described_pairs(classes, _search(rows, classes, k))
    return found.orderBy(F.desc("similarity"), "first_a", "first_b").limit(k)


def closest_pairs(df: DataFrame, ident: str, texts: Sequence[str], k: int = 20) -> DataFrame:
    """The ``k`` closest row pairs by similarity and ids, over all pairs of rows: no floor.

    Only the first members of a class can appear in the first ``k`` pairs, so every class passes on
    ``k + 1`` of its ids at most and copies are paired within those. Where fewer than ``k`` pairs have a common
    token, pairs without one follow by their ids; the first of these lie among the least 2k + 2 ids.
    """
    rows = _facts(df, ident, texts)
    classes = durable(token_classes(rows))
    leading = rows.select("id", "class_id").withColumn(
        "_r", F.row_number().over(W.partitionBy("class_id").orderBy("id"))
    ).filter(F.col("_r") <= k + 1)
    listed = durable(leading.groupBy("class_id").agg(F.sort_array(F.collect_list("id")).alias("ids")))
    filled = classes.filter(F.col("size") > 0).select("class_id")
    within = (
        listed.join(filled, "class_id", "left_semi").filter(F.size("ids") > 1)
        .select(F.lit(1.0).alias("similarity"), F.explode(F.flatten(F.transform(
            F.sequence(F.lit(1), F.size("ids") - 1),
            lambda i: F.transform(
                F.slice("ids", i + 1, F.size("ids")), lambda b: F.struct(F.element_at("ids", i).alias("a"), b.alias("b"))
            ),
        ))).alias("p"))
    )

    def row_pairs(pairs: DataFrame) -> DataFrame:
        return (
            pairs.join(listed.select(F.col("class_id").alias("class_a"), F.col("ids").alias("ids_a")), "class_a")
            .join(listed.select(F.col("class_id").alias("class_b"), F.col("ids").alias("ids_b")), "class_b")
            .select("similarity", F.explode(F.flatten(F.transform(
                "ids_a",
                lambda a: F.transform(
                    F.col("ids_b"), lambda b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
                ),
            ))).alias("p"))
        )

    copies = within.count()
    if copies >= k:
        across = row_pairs(class_pairs(rows, 1.0))
    else:
        found = _search(rows, classes, k - copies, lambda p: row_pairs(p).count() + copies >= k)
        across = row_pairs(found)
    ranked = durable(
        within.unionByName(across).orderBy(F.desc("similarity"), "p.a", "p.b").limit(k)
        .select(F.col("p.a").alias("id_a"), F.col("p.b").alias("id_b"), "similarity")
    )
    if ranked.count() < k:
        first = rows.select("id").orderBy("id").limit(2 * k + 2).agg(F.sort_array(F.collect_list("id")).alias("ids"))
        apart = first.select(F.explode(F.flatten(F.transform(
            F.sequence(F.lit(1), F.size("ids")),
            lambda i: F.transform(
                F.slice("ids", i + 1, F.size("ids")), lambda b: F.struct(F.element_at("ids", i).alias("a"), b.alias("b"))
            ),
        ))).alias("p")).select(F.col("p.a").alias("id_a"), F.col("p.b").alias("id_b"), F.lit(0.0).alias("similarity"))
        others = apart.join(F.broadcast(ranked.select("id_a", "id_b")), ["id_a", "id_b"], "left_anti")
        ranked = ranked.unionByName(others)
    return ranked.orderBy(F.desc("similarity"), "id_a", "id_b").limit(k)


def signature(axes: Sequence[str]) -> Column:
    """Hash of the substantive axes of a design, in the given order."""
    return digest(F.to_json(F.struct(*[F.col(a) for a in axes])))


def signature_collisions(df: DataFrame, ident: str, axes: Sequence[str]) -> DataFrame:
    """Signatures carried by more than one row, summarised."""
    return (
        df.select(ident, signature(axes).alias("signature"))
        .groupBy("signature")
        .agg(F.count("*").alias("members"), F.min(ident).alias("first_id"))
        .filter(F.col("members") > 1)
    )


def completeness(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows meet each rule, and how many rows there are."""
    counted = df.agg(
        F.count("*").alias("rows"), *[F.count_if(rule).alias(name) for name, rule in rules.items()]
    )
    return counted.unpivot("rows", list(rules), "rule", "satisfied").select(
        "rule", "satisfied", "rows", (F.col("satisfied") == F.col("rows")).alias("complete")
    )


def audit_library(
    df: DataFrame, ident: str, axes: Sequence[str], exact: Sequence[str], similar: Sequence[str],
    rules: Mapping[str, Column],
) -> DataFrame:
    """One-row verdict: no collisions, no equal texts, no high pairs, every rule met by all rows."""
    parts = [signature_collisions(df, ident, axes).agg(F.count("*").alias("n")).select(
        F.lit("signature-collisions").alias("check"), "n")]
    for text in exact:
        parts.append(duplicate_groups(df, ident, text).agg(F.count("*").alias("n")).select(
            F.lit(f"duplicate-{text}").alias("check"), "n"))
    parts.append(similarity_totals(df, ident, similar).select(
        F.lit("high-similarity-pairs").alias("check"), F.col("high_similarity_pairs").alias("n")))
    parts.append(completeness(df, rules).filter(~F.col("complete")).agg(F.count("*").alias("n")).select(
        F.lit("incomplete-rules").alias("check"), "n"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows.agg(
        F.sort_array(F.collect_list(F.when(F.col("n") > 0, F.concat_ws("=", "check", "n")))).alias("failures")
    ).withColumn("audit_passed", F.size("failures") == 0)


# --- rule scans ----------------------------------------------------------------------------------

def forbidden_hits(docs: DataFrame, ident: str, text: str, rules: Mapping[str, str]) -> DataFrame:
    """Every (rule, document) in which the literal occurs. Rules are a fixed literal, not a join."""
    listed = F.array(*[
        F.struct(F.lit(r).alias("rule_id"), F.lit(literal).alias("literal")) for r, literal in rules.items()
    ])
    hits = F.filter(listed, lambda r: F.contains(F.col(text), r["literal"]))
    return docs.select(ident, F.explode(hits).alias("r")).select(F.col("r.rule_id").alias("rule_id"), ident)


def scan_forbidden(docs: DataFrame, ident: str, text: str, rules: Mapping[str, str]) -> DataFrame:
    """One row per rule: passed only when no document holds the literal."""
    listed = F.array(*[F.lit(r) for r in rules])
    one = docs.sparkSession.range(1).select(F.explode(listed).alias("rule_id"))
    found = forbidden_hits(docs, ident, text, rules).groupBy("rule_id").agg(
        F.count("*").alias("documents"), F.min(ident).alias("first_document")
    )
    return one.join(found, "rule_id", "left").select(
        "rule_id", F.coalesce("documents", F.lit(0)).cast("long").alias("documents"), "first_document",
        F.col("documents").isNull().alias("passed"),
    )


def scan_required(docs: DataFrame, ident: str, text: str, rules: DataFrame) -> DataFrame:
    """One row per required phrase (``rule_id, document, phrase``): the document must contain it."""
    found = rules.join(
        docs.select(F.col(ident).alias("document"), F.col(text).alias("_text")), "document", "left"
    )
    return found.select(
        "rule_id", "document", F.coalesce(F.contains("_text", F.col("phrase")), F.lit(False)).alias("passed")
    )


# --- claims --------------------------------------------------------------------------------------

def pointer_path(pointer: Column) -> Column:
    """JSON pointer as a variant path; list positions become array steps."""
    parts = F.filter(F.split(pointer, "/"), lambda p: p != "")
    step = F.transform(
        parts,
        lambda p: F.when(p.rlike("^(0|[1-9][0-9]*)$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(
            F.concat(F.lit("['"), F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")), F.lit("']"))
        ),
    )
    return F.concat(F.lit("$"), F.array_join(step, ""))


def evaluate_claims(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """Resolve claims against JSON evidence and compare with the expected value, type included.

    ``claims(claim_id, operation, source_order, document, pointer, expected JSON text)`` holds one
    row per source; ``evidence(document, content)`` holds JSON text. Operations: single, count, sum,
    subtract, choose-two. Whole numbers stay exact up to 38 digits (19 for choose-two). A claim that cannot be
    resolved is a failed row with a reason.
    """
    sourced = claims.join(evidence, "document", "left").withColumn(
        "_value", F.try_variant_get(F.try_parse_json("content"), pointer_path(F.col("pointer")), "variant")
    )
    kind = F.schema_of_variant("_value")
    number = F.try_variant_get("_value", "$", "double")
    numeric = kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)")
    whole = kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))")
    length = F.coalesce(
        F.size(F.try_variant_get("_value", "$", "array<variant>")),
        F.size(F.map_keys(F.try_variant_get("_value", "$", "map<string,variant>"))),
    )
    rows = sourced.withColumns({
        "_kind": F.when(F.col("_value").isNotNull(), kind),
        "_number": F.when(numeric, number),
        "_exact": F.when(whole, F.try_variant_get("_value", "$", "decimal(38,0)")),
        "_whole": F.coalesce(whole, F.lit(False)),
        "_length": F.when(kind.startswith("ARRAY") | kind.startswith("OBJECT"), length),
        "_text": F.to_json("_value"),
    })
    per = rows.groupBy("claim_id", "operation", "expected").agg(
        F.count("*").alias("sources"),
        F.count("_kind").alias("resolved"),
        F.count("_number").alias("numbers"),
        F.bool_and("_whole").alias("whole"),
        F.sum("_number").alias("total"),
        F.try_sum("_exact").alias("exact_total"),
        F.min_by(F.struct("_number", "_exact"), "source_order").alias("first"),
        F.max_by(F.struct("_number", "_exact"), "source_order").alias("last"),
        F.max("_length").alias("length"),
        F.max("_text").alias("text"),
        F.max("_kind").alias("kind"),
    )
    op = F.col("operation")

    def as_number(value: Column, exact: Column) -> Column:
        return F.when(F.col("whole"), exact.cast("decimal(38,0)").cast("string")).otherwise(value.cast("string"))

    first, last = F.col("first._exact"), F.col("last._exact")
    # half of the even one of two neighbours, so that no product is larger than the result
    even = F.pmod(first, F.lit(2).cast("decimal(38,0)")) == 0
    half = F.expr("CAST(CASE WHEN pmod(first._exact, 2) = 0 THEN first._exact ELSE first._exact - 1 END AS decimal(38,0)) DIV 2")
    other = F.when(even, first - 1).otherwise(first)
    pairs = F.try_multiply(half.cast("decimal(19,0)"), other.cast("decimal(19,0)"))
    all_numbers = F.col("numbers") == F.col("sources")
    scalar = F.col("kind").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|STRING|BOOLEAN)")
    value = (
        F.when((op == "single") & (F.col("sources") == 1) & scalar, F.col("text"))
        .when((op == "count") & (F.col("sources") == 1), F.col("length").cast("string"))
        .when((op == "sum") & all_numbers, as_number(F.col("total"), F.col("exact_total")))
        .when((op == "subtract") & all_numbers & (F.col("sources") == 2), as_number(F.col("first._number") - F.col("last._number"), first - last))
        .when(
            (op == "choose-two") & all_numbers & (F.col("sources") == 1) & F.col("whole") & (first >= 0),
            pairs.cast("decimal(38,0)").cast("string"),
        )
    )
    known = op.isin("single", "count", "sum", "subtract", "choose-two")
    reason = (
        F.when(~known, "unknown operation")
        .when(F.col("resolved") < F.col("sources"), "JSON pointer component is absent")
        .when(F.col("value").isNull(), "sources do not fit the operation")
        .when(F.col("value") != F.col("expected"), "resolved value differs from the expected value")
    )
    return per.withColumn("value", value).select(
        "claim_id", "operation", "expected", "value", reason.isNull().alias("passed"), reason.alias("reason")
    )


def check_renderings(renderings: DataFrame, claims: DataFrame, docs: DataFrame) -> DataFrame:
    """Each rendering (``claim_id, ordinal, document, template``) must occur in its document.

    ``{value}`` is the plain value and ``{value:,}`` groups thousands.
    """
    plain = F.regexp_replace(F.col("value"), '^"|"$', "")
    grouped = F.format_number(F.try_to_number(plain, F.lit("S999999999999999999")), 0)
    rendered = F.replace(
        F.replace(F.col("template"), F.lit("{value:,}"), F.coalesce(grouped, plain)), F.lit("{value}"), plain
    )
    return (
        renderings.join(claims.select("claim_id", "value"), "claim_id")
        .join(docs.select("document", "text"), "document", "left")
        .withColumn("rendered", rendered)
        .select(
            F.concat_ws(":rendering-", "claim_id", "ordinal").alias("check"), "document", "rendered",
            F.coalesce(F.contains("text", F.col("rendered")), F.lit(False)).alias("passed"),
        )
    )


def audit_summary(checks: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Totals of passed and failed checks; they add up by construction."""
    return checks.groupBy(*by).agg(
        F.count("*").alias("checks_total"), F.count_if("passed").alias("checks_passed"),
        F.count_if(~F.col("passed")).alias("checks_failed"),
    )
