"""Language-model scoring by cross-entropy difference.

A target and a background bigram model of the same order, smoothing and discount share one vocabulary and one set
of bigrams; a text's score is the mean of its tokens' loss under the target model less that under the background.

Every word and every pair counts. The count tables stay distributed: texts are dealt into blocks, each block asks the
homes of its distinct pairs for their counts in the whole corpus and is scored with the answers, which hold numbers only
for pairs and words that other blocks have too. :func:`fit` makes
models of bounded size for a broadcast instead, where a configuration asks for it.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.tables import free_shuffles, small
from tessera.session import durable


@dataclass(frozen=True)
class LanguageConfig:
    """``vocabulary`` and ``bigrams`` bound the models of :func:`fit`: the commonest words of the corpus, and the
    commonest pairs of them; the rest backs off. Without bounds all words and pairs are kept.
    """

    vocabulary: float = math.inf
    bigrams: float = math.inf
    discount: float = 0.5
    smoothing: float = 0.5
    #: Tokens whose pairs are counted at once in a task, and about so many in a block of texts.
    block: int = 2_000_000
    #: Bytes of text that are looked at for words too common to have one home.
    glance: int = 20_000_000


@dataclass(frozen=True)
class Models:
    """``words`` and ``pairs`` are sorted; losses are natural logs, a column for target and one for background."""

    words: np.ndarray
    unigram: np.ndarray
    backoff: np.ndarray
    pairs: np.ndarray
    pair_gain: np.ndarray

    def losses(self, ids: np.ndarray, follows: np.ndarray) -> np.ndarray:
        """Loss of each token under both models; ``follows`` is false at the first token of a text."""
        unknown = len(self.words)
        before = np.where(follows, np.concatenate([[unknown], ids[:-1]]), unknown)
        logs = self.unigram[ids] + self.backoff[before]
        key = before * (unknown + 1) + ids
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        hit = self.pairs[at] == key if len(self.pairs) else np.zeros(len(ids), bool)
        logs[hit] = np.logaddexp(logs[hit], self.pair_gain[at[hit]])
        return -logs


def _ids(chunk: W.Chunk, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of each token, whether one comes before it in its text, text bounds); unknown words share the last id."""
    starts = chunk.word_starts(W.SPACES)
    hashes = W.segment_hashes(chunk.data, W.WORDS_LOWER, starts).view(np.int64)
    bounds = chunk.per_text(starts)
    at = np.searchsorted(vocabulary, hashes)
    at[at == len(vocabulary)] = 0
    known = vocabulary[at] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
    follows = np.ones(len(hashes), bool)
    begins = bounds[:-1]
    follows[begins[begins < len(hashes)]] = False
    return np.where(known, at, len(vocabulary)), follows, bounds


def _counted(keys: np.ndarray, target: np.ndarray, names: tuple[str, str, str]) -> Iterator[pa.RecordBatch]:
    """Rows (key, in all, in the target) of the distinct keys."""
    found, place = np.unique(keys, return_inverse=True)
    everywhere = np.bincount(place, minlength=len(found))
    wanted = np.bincount(place[target], minlength=len(found))
    for begin in range(0, len(found), 100_000):
        part = slice(begin, begin + 100_000)
        yield pa.RecordBatch.from_arrays(
            [pa.array(found[part]), pa.array(everywhere[part]), pa.array(wanted[part])], names=list(names)
        )


def _count(rows: DataFrame, keys_of, config: LanguageConfig) -> DataFrame:
    """(key, background, target): how often each key occurs in all texts and in those of the target."""
    names = ("key", "background", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, marks, size = [], [], 0
        for batch in batches:
            wanted = batch.column("wanted").to_numpy(zero_copy_only=False)
            for chunk in W.chunks(batch.column("text"), 1 << 20):
                keys, owner = keys_of(chunk)
                held.append(keys)
                marks.append(wanted[chunk.first + owner])
                size += len(keys)
                if size >= config.block:
                    yield from _counted(np.concatenate(held), np.concatenate(marks), names)
                    held, marks, size = [], [], 0
        if size:
            yield from _counted(np.concatenate(held), np.concatenate(marks), names)

    parts = rows.mapInArrow(run, "key long, background long, target long")
    return parts.groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


def _arrays(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and (target, background) counts of a bounded table."""
    table = df.orderBy("key").toArrow()
    counts = np.stack([table.column("target").to_numpy(), table.column("background").to_numpy()], 1)
    return table.column("key").to_numpy(), counts.astype(float).reshape(-1, 2)


def _commonest(df: DataFrame, most: float) -> DataFrame:
    return df if most == math.inf else df.orderBy(F.desc("background"), "key").limit(int(most))


def _prepared(documents: DataFrame, target_ids: DataFrame) -> DataFrame:
    wanted = small(durable(target_ids.select(F.col("doc_id").alias("_id")).where("_id is not null").distinct()))
    return documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(
        wanted, F.col("doc_id") == F.col("_id"), "left"
    ).select("doc_id", "text", F.col("_id").isNotNull().alias("wanted"))


def _words(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, its text)."""
    starts = chunk.word_starts(W.SPACES)
    owner = np.repeat(np.arange(chunk.count), np.diff(chunk.per_text(starts)))
    return W.segment_hashes(chunk.data, W.WORDS_LOWER, starts).view(np.int64), owner


def fit(documents: DataFrame, target_ids: DataFrame, config: LanguageConfig = LanguageConfig()) -> Models:
    """Both models, from all tokens of ``documents`` and of those whose doc_id is in ``target_ids``.

    The driver holds them, so ``config`` should bound them unless the corpus is small.
    """
    rows = _prepared(documents, target_ids)

    counted = durable(_count(rows, _words, config))
    totals = counted.agg(F.coalesce(F.sum("target"), F.lit(0)), F.coalesce(F.sum("background"), F.lit(0))).first()
    vocabulary, own = _arrays(_commonest(counted, config.vocabulary))
    unknown = np.array(totals, float) - own.sum(0)
    counts = np.vstack([own, unknown])
    share = (counts + config.smoothing) / (counts.sum(0) + config.smoothing * len(counts))

    def pairs(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
        ids, follows, bounds = _ids(chunk, vocabulary)
        size = len(vocabulary)
        owner = np.repeat(np.arange(chunk.count), np.diff(bounds))
        both = np.flatnonzero(follows[1:] & (ids[1:] < size) & (ids[:-1] < size)) + 1
        return ids[both - 1].astype(np.int64) * (size + 1) + ids[both], owner[both]

    keys, seen = _arrays(_commonest(_count(rows, pairs, config), config.bigrams))
    before = keys // (len(vocabulary) + 1)
    kept = np.maximum(seen - config.discount, 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(kept > 0, kept / counts[before], 0)
        taken = np.stack([np.bincount(before, g, len(counts)) for g in gain.T], 1)
        return Models(vocabulary, np.log(share), np.log(np.maximum(1 - taken, 1e-9)), keys, np.log(gain))


def score(documents: DataFrame, models: Models) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) of every row of ``documents``.

    Losses are means per token; below zero the text is closer to the target. One pass over whole texts; the
    models are bounded and broadcast. A null or empty text has no tokens, and losses and difference of 0. Repeated rows
    have equal results; other columns are ignored. An empty table gives an empty result; without
    target documents the target model is uniform.
    """
    shared = documents.sparkSession.sparkContext.broadcast(models)  # as large as ``config`` of fit() lets them be

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for chunk in W.chunks(batch.column("text"), 1 << 20):
                ids, follows, bounds = _ids(chunk, known.words)
                size = np.diff(bounds)
                owner = np.repeat(np.arange(chunk.count), size)
                losses = known.losses(ids, follows)
                means = [np.bincount(owner, part, chunk.count) / np.maximum(size, 1) for part in losses.T]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(chunk.first, chunk.count), pa.array(size.astype(np.int64)),
                     *map(pa.array, means), pa.array(means[0] - means[1])],
                    names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"],
                )

    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double"
    )


# --- models as large as the corpus ----------------------------------------------------------------


FACTOR = np.uint64(W.BASE)


@dataclass(frozen=True)
class Dealing:
    """``blocks`` of texts ask ``homes`` of pairs. Pairs live with their first word, those of ``hot`` words apart."""

    blocks: int
    homes: int
    hot: np.ndarray

    def home(self, first: np.ndarray, key: np.ndarray) -> np.ndarray:
        return np.where(np.isin(first, self.hot), key, W.mix(first)) % np.uint64(self.homes)


class Block:
    """The distinct pairs of some texts by home, first word and key. A text's last word has a pair with its end.

    A key has 48 bits, to tell apart the followers of one word; that of the end is 0.
    """

    def __init__(self, batches: list[pa.RecordBatch], dealing: Dealing) -> None:
        words, sizes = [], []
        for batch in batches:
            for chunk in W.chunks(batch.column("text"), 1 << 20):
                own, owner = _words(chunk)
                words.append(own.view(np.uint64))
                sizes.append(np.bincount(owner, minlength=chunk.count))
        word = np.concatenate(words) if words else np.zeros(0, np.uint64)
        self.sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
        self.owner = np.repeat(np.arange(len(self.sizes)), self.sizes)
        follower = np.zeros(len(word), np.uint64)
        self.inside = np.zeros(len(word), bool)  # another word of the text comes before
        self.inside[1:] = self.owner[1:] == self.owner[:-1]
        follower[:-1] = np.where(self.inside[1:], word[1:], 0)
        pairs, at, place = np.unique(word * FACTOR + follower, return_index=True, return_inverse=True)
        first = word[at]
        keys = np.where(follower[at] == 0, 0, W.mix(pairs) >> np.uint64(16))
        home = dealing.home(first, W.mix(pairs))
        order = np.lexsort((keys, first, home))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.pair = rank[place]  # of each token and what follows it
        self.first, self.keys, self.home = first[order], keys[order], home[order].astype(np.int64)
        opens = np.ones(len(order), bool)
        opens[1:] = (self.first[1:] != self.first[:-1]) | (self.home[1:] != self.home[:-1])
        self.runs = np.flatnonzero(opens)  # where a first word begins at a home
        self.run = np.cumsum(opens) - 1

    def counts(self, wanted: np.ndarray) -> np.ndarray:
        """How often each pair occurs in the target's texts, and in all."""
        everywhere = np.bincount(self.pair, minlength=len(self.keys))
        return np.stack([np.bincount(self.pair[wanted[self.owner]], minlength=len(self.keys)), everywhere], 1)


def _packed(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _planes(values: np.ndarray) -> bytes:
    """Eight-byte numbers with their first bytes in front, then their second and so on: small ones compress to little."""
    return values.ravel().view(np.uint8).reshape(-1, 8).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _sums(pairs: np.ndarray, keys: np.ndarray, runs: np.ndarray, discount: float) -> np.ndarray:
    """What the pairs of each run add up to: count in the target and in all, and both after the discount."""
    kept = np.where((keys == 0)[:, None], 0, np.maximum(pairs - discount, 0))
    return np.add.reduceat(np.hstack([pairs, kept]).astype(float), runs, axis=0)


def _corrected(data: bytes, pairs: np.ndarray, words: np.ndarray) -> None:
    """Put the corpus's numbers in place of a block's own, where an answer says that they differ."""
    raw, at = zlib.decompress(data), 0
    for own, kind in ((pairs, np.uint64), (words, np.float64)):
        mask = np.unpackbits(np.frombuffer(raw, np.uint8, -(-len(own) // 8), at), count=len(own)).astype(bool)
        at += -(-len(own) // 8)
        size = 8 * own.shape[1] * int(mask.sum())
        own[mask] = _from_planes(raw[at:at + size]).view(kind).reshape(own.shape[1], -1).T
        at += size


def _answer(pairs: np.ndarray, own_pairs: np.ndarray, words: np.ndarray, own_words: np.ndarray) -> bytes:
    """One bit for each pair and word of a block, and the corpus's numbers of those that occur elsewhere too."""
    parts = []
    for everywhere, own, kind in ((pairs, own_pairs, np.uint64), (words, own_words, np.float64)):
        mask = (everywhere != own).any(axis=1)
        parts += [np.packbits(mask).tobytes(), _planes(np.ascontiguousarray(everywhere[mask].T.astype(kind)))]
    return zlib.compress(b"".join(parts), 1)


def _by_block(batches: Iterator[pa.RecordBatch]) -> dict[int, list[pa.RecordBatch]]:
    """The rows of each block in a partition, which holds one block or few."""
    held: dict[int, list[pa.RecordBatch]] = {}
    for batch in batches:
        blocks = batch.column("block").to_numpy(zero_copy_only=False)
        for block in np.unique(blocks).tolist():
            held.setdefault(block, []).append(batch.filter(pa.array(blocks == block)))
    return held


def _parcels(rows: DataFrame) -> DataFrame:
    """(block, parcel): the rows (doc_id, text, wanted, block) of a batch that go to one block, packed together.

    Texts travel twice; many at once compress to far less than row by row in a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression="zstd")
        for batch in batches:
            for block, parts in _by_block([batch]).items():
                sink = pa.BufferOutputStream()
                own = parts[0].select(["doc_id", "text", "wanted"])
                with pa.ipc.new_stream(sink, own.schema, options=options) as stream:
                    stream.write_batch(own)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "parcel"]
                )

    return rows.mapInArrow(run, "block int, parcel binary")


def _unparcelled(batches: list[pa.RecordBatch]) -> list[pa.RecordBatch]:
    """The rows in the parcels of a block."""
    parcels = [p.as_py() for b in batches for p in b.column("parcel") if p.is_valid]
    return [rows for p in parcels for rows in pa.ipc.open_stream(p)]


def _dealing(documents: DataFrame, config: LanguageConfig) -> Dealing:
    """Sizes from the bytes of all texts. Words common in a glance at them only choose where pairs are counted."""
    size = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(least, math.ceil(size / 6 / config.block))
    homes = max(least, math.ceil(blocks / 4))
    glance = documents if size <= config.glance else documents.sample(config.glance / size, seed=5)
    rows = glance.select(F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("wanted"))
    counted = durable(_count(rows, _words, config))
    total = counted.agg(F.sum("background")).first()[0] or 0
    common = counted.where(F.col("background") * 4 * homes > total).select("key").toArrow()  # under 4 * homes
    return Dealing(blocks, homes, common.column("key").to_numpy().astype(np.int64).view(np.uint64))


def _asked(texts: DataFrame, dealing: Dealing) -> DataFrame:
    """(home, block, first, runs, keys, counts): the pairs that a block has at a home, as arrays."""
    names = ["home", "block", "first", "runs", "keys", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, parcels in _by_block(batches).items():
            rows = _unparcelled(parcels)
            own = Block(rows, dealing)
            counts = own.counts(np.concatenate([b.column("wanted").to_numpy(zero_copy_only=False) for b in rows]))
            lengths = np.diff(np.append(own.runs, len(own.keys))).astype(np.uint32)
            homes, begins = np.unique(own.home, return_index=True)
            out = []
            for home, low, high in zip(homes.tolist(), begins, np.append(begins[1:], len(own.keys)), strict=True):
                part = slice(*np.searchsorted(own.runs, (low, high)))
                out.append((
                    home, block, own.first[own.runs[part]].tobytes(), zlib.compress(lengths[part].tobytes(), 1), _packed(own.keys[low:high]),
                    zlib.compress(counts[low:high].astype(np.uint32).T.tobytes(), 1),
                ))
            kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)] if out else []
            if out:
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return texts.mapInArrow(run, "home int, block int, first binary, runs binary, keys binary, counts binary")


def _answered(asked: DataFrame, dealing: Dealing, config: LanguageConfig) -> DataFrame:
    """(block, home, answer) for what each block asked, and rows (word, words, four sums) without a block.

    The four numbers of a word are its count in the target and in all, and what its pairs keep of them after the
    discount. Those of a hot word are partial here. A home's other words are summed in a row without a word.
    """
    schema = pa.schema([
        ("block", pa.int32()), ("home", pa.int32()), ("answer", pa.binary()), ("word", pa.int64()), ("words", pa.int64()),
        *[(f"sum{k}", pa.float64()) for k in range(4)],
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in batches for row in batch.to_pylist()]
        if not rows:
            return
        starts = [np.frombuffer(r["first"], np.uint64) for r in rows]
        first = np.concatenate([
            np.repeat(f, np.frombuffer(zlib.decompress(r["runs"]), np.uint32)) for f, r in zip(starts, rows, strict=True)
        ])
        keys = np.concatenate([_unpacked(r["keys"]) for r in rows])
        found, at, place = np.unique(first * FACTOR + keys, return_index=True, return_inverse=True)
        counts = np.concatenate([np.frombuffer(zlib.decompress(r["counts"]), np.uint32).reshape(2, -1).T for r in rows])
        pairs = np.stack([np.bincount(place, c, len(found)) for c in counts.T], 1)
        kept = np.where((keys[at] == 0)[:, None], 0, np.maximum(pairs - config.discount, 0))
        words, of = np.unique(first[at], return_inverse=True)
        sums = np.stack([np.bincount(of, c, len(words)) for c in (*pairs.T, *kept.T)], 1)
        done = 0
        for row, start in zip(rows, starts, strict=True):
            part = slice(done, done := done + len(row["keys"]) // 6)
            lengths = np.frombuffer(zlib.decompress(row["runs"]), np.uint32).astype(np.int64)
            own = _sums(counts[part], keys[part], np.cumsum(lengths) - lengths, config.discount)
            answer = _answer(pairs[place[part]], counts[part], sums[np.searchsorted(words, start)], own)
            yield pa.RecordBatch.from_pylist([{"block": row["block"], "home": row["home"], "answer": answer}], schema)
        hot = np.isin(words, dealing.hot)
        rest = {"words": int((~hot).sum())} | {f"sum{k}": float(x) for k, x in enumerate(sums[~hot].sum(0))}
        yield pa.RecordBatch.from_pylist([rest, *(
            {"word": int(w)} | {f"sum{k}": float(x) for k, x in enumerate(own)}
            for w, own in zip(words[hot].view(np.int64), sums[hot], strict=True)
        )], schema)

    return asked.mapInArrow(
        run, "block int, home int, answer binary, word long, words long, sum0 double, sum1 double, sum2 double, sum3 double"
    )


def _scored(rows: DataFrame, kind: str, dealing: Dealing, hot: np.ndarray, sums: np.ndarray, totals: np.ndarray,
            config: LanguageConfig) -> DataFrame:
    """Scores of the texts in ``rows`` (block, parcel, home, answer), a union of parcels and answers; ``kind`` is doc_id's type.

    ``totals`` are the tokens of target and background with the smoothing of all words; ``sums`` those of ``hot`` words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_block(batches).values():
            texts = _unparcelled(held)
            own = Block(texts, dealing)
            wanted = [b.column("wanted").to_numpy(zero_copy_only=False).astype(bool) for b in texts]
            pairs = own.counts(np.concatenate(wanted) if wanted else np.zeros(0, bool)).astype(float)
            words = _sums(pairs, own.keys, own.runs, config.discount) if len(own.runs) else np.zeros((0, 4))
            for batch in held:
                for home, answer in zip(batch.column("home").to_pylist(), batch.column("answer"), strict=True):
                    if home is None:
                        continue
                    low, high = np.searchsorted(own.home, (home, home + 1))
                    part = slice(*np.searchsorted(own.runs, (low, high)))
                    _corrected(answer.as_py(), pairs[low:high], words[part])
            if len(hot):
                at = np.minimum(np.searchsorted(hot, own.first[own.runs]), len(hot) - 1)
                known = hot[at] == own.first[own.runs]
                words[known] = sums[at[known]]
            share = (words[:, :2] + config.smoothing) / totals
            with np.errstate(divide="ignore", invalid="ignore"):
                backoff = np.maximum(1 - np.where(words[:, :2] > 0, words[:, 2:] / words[:, :2], 0), 1e-9)
                gain = np.maximum(pairs - config.discount, 0) / np.maximum(words[own.run, :2], 1)
            chance = share[own.run[own.pair]]
            later = np.flatnonzero(own.inside)
            before = own.pair[later - 1]
            chance[later] = chance[later] * backoff[own.run[before]] + gain[before]
            means = [
                np.bincount(own.owner, loss, len(own.sizes)) / np.maximum(own.sizes, 1) for loss in -np.log(chance).T
            ]
            done = 0
            for batch in texts:
                part = slice(done, done := done + len(batch))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(own.sizes[part].astype(np.int64)), pa.array(means[0][part]),
                     pa.array(means[1][part]), pa.array(means[0][part] - means[1][part])],
                    names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"],
                )

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_tokens long, target_loss double, background_loss double, difference double"
    )


def cross_entropy_difference(
    documents: DataFrame, target_ids: DataFrame, config: LanguageConfig = LanguageConfig()
) -> DataFrame:
    """Fit both models and score every document by them: the columns of :func:`score`.

    Without bounds in ``config`` every word and pair counts, and a task holds the texts of one block with the counts of
    its pairs, or the pairs of one home. Equal rows are in one block.
    """
    if (config.vocabulary, config.bigrams) != (math.inf, math.inf):
        return score(documents, fit(documents, target_ids, config))
    dealing = _dealing(documents, config)
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(dealing.blocks)).cast("int").alias("block")
    parcels = _parcels(_prepared(documents, target_ids).select("doc_id", "text", "wanted", block))
    answers = durable(_answered(
        _asked(parcels.repartitionById(dealing.blocks, "block"), dealing).repartitionById(dealing.homes, "home"),
        dealing, config,
    ))
    free_shuffles(documents.sparkSession)  # texts and questions are done with before texts and answers travel
    numbers = [F.sum(c).alias(c) for c in ("words", "sum0", "sum1", "sum2", "sum3")]
    found = answers.where("block is null").groupBy("word").agg(*numbers).collect()  # hot words and one row
    common = sorted((np.int64(r["word"]).view(np.uint64), r) for r in found if r["word"] is not None)
    sums = np.array([[r[f"sum{k}"] for k in range(4)] for _, r in common]).reshape(-1, 4)
    size = len(common) + sum(r["words"] for r in found if r["word"] is None)
    tokens = np.array([[r["sum0"], r["sum1"]] for r in found]).reshape(-1, 2).sum(0)
    both = parcels.select("block", "parcel", F.lit(None).cast("int").alias("home"), F.lit(None).cast("binary").alias("answer"))
    back = answers.where("block is not null").select("block", F.lit(None).cast("binary").alias("parcel"), "home", "answer")
    return _scored(
        both.unionByName(back).repartitionById(dealing.blocks, "block"), dict(documents.dtypes)["doc_id"], dealing,
        np.array([w for w, _ in common], np.uint64), sums, tokens + config.smoothing * (size + 1), config,
    )
