"""Quality rules: how much of a text lies in repeated n-grams and repeated lines."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.tables import free_names, quoted


@dataclass(frozen=True)
class RuleConfig:
    """``coverage``: (n, largest share of the word characters inside n-grams found twice or more).

    Base rule: fewer than ``least_words`` words, or more than ``repeat_percent`` per cent of the words
    in repeated ``repeat_size``-word windows. The coverage limits lie above what running text that quotes itself
    reaches; the shortest n-grams, which common phrases repeat, have the highest.
    """

    least_words: int = 10
    repeat_size: int = 5
    repeat_percent: int = 20
    coverage: tuple[tuple[int, float], ...] = ((3, 0.50), (5, 0.30), (8, 0.30), (12, 0.30))
    line_coverage: float = 0.30


_CHARACTER = (W.STARTS_CHARACTER & ~W.SPACES).astype(np.int64)


def _later_copies(keys: np.ndarray) -> np.ndarray:
    """True at every key that stood earlier."""
    _, first = np.unique(keys, return_index=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return later


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True at every key that occurs twice or more."""
    order = np.argsort(keys)
    ordered = keys[order]
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = ordered[1:] == ordered[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = same[1:] | same[:-1]
    return out


def _sums(per_item: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    return np.bincount(owner, weights=per_item, minlength=count).astype(np.int64)


def measure_chunk(chunk: W.Chunk, sizes: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts of each text of a chunk; ``n<size>_words`` and ``n<size>_chars`` for repeated windows."""
    data, count = chunk.data, chunk.count
    starts = chunk.word_starts(W.SPACES)
    bounds = chunk.per_text(starts)
    owner = np.repeat(np.arange(count), np.diff(bounds))
    hashes = W.segment_hashes(data, W.WORDS_AS_THEY_ARE, starts)
    letters = W.segment_sums(data, _CHARACTER, starts)
    salt = W.mix(np.arange(count, dtype=np.uint64), 7)
    symbol_at = np.flatnonzero(W.IS_SYMBOL[data])
    out = {
        "n_words": np.diff(bounds),
        "word_chars": _sums(letters, owner, count),
        "n_symbols": np.diff(chunk.per_text(symbol_at)),
    }
    for size in sizes:
        windows = W.window_hashes(hashes, size)
        inside = W.within(bounds, size, len(hashes))
        at = np.flatnonzero(inside)
        twice = at[_repeated(windows[at] ^ salt[owner[at]])]
        edge = np.zeros(len(hashes) + 1, np.int64)
        edge[twice] += 1
        np.subtract.at(edge, twice + size, 1)
        covered = np.cumsum(edge[:-1]) > 0
        out[f"n{size}_words"] = _sums(covered, owner, count)
        out[f"n{size}_chars"] = _sums(letters * covered, owner, count)
    begins = chunk.offsets[:-1]
    after = np.flatnonzero(data == 10) + 1
    lines = np.unique(np.concatenate([begins[begins < len(data)], after[after < len(data)]]))
    line_owner = np.searchsorted(chunk.offsets, lines, side="right") - 1
    line_hash = W.segment_hashes(data, W.LINES, lines)
    has_word = W.segment_sums(data, (~W.SPACES).astype(np.int64), lines) > 0
    lines, line_owner, line_hash = lines[has_word], line_owner[has_word], line_hash[has_word]
    copies = _later_copies(line_hash ^ salt[line_owner])
    in_line = np.diff(np.append(np.searchsorted(starts, lines), len(starts)))
    line_letters = np.add.reduceat(letters, np.searchsorted(starts, lines)) if len(lines) else np.zeros(0)
    line_letters = np.where(in_line > 0, line_letters, 0)
    out["n_dup_lines"] = _sums(copies, line_owner, count)
    out["dup_line_chars"] = _sums(copies * line_letters, line_owner, count)
    return out


def measure(
    documents: DataFrame, config: RuleConfig = RuleConfig(), text: str = "text", name: str = "rules"
) -> DataFrame:
    """The rows of ``documents`` with their measures, in one pass over the whole texts, without a shuffle.

    Adds a struct column ``name`` (in place of one so named). Null and empty texts have no words: all counts are zero.
    Repeated rows are measured each.
    """
    kept = [c for c in documents.columns if c != name]
    sizes = tuple(sorted({config.repeat_size, *(n for n, _ in config.coverage)}))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "dup_line_chars",
              *(f"n{n}_{what}" for n in sizes for what in ("words", "chars"))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [measure_chunk(c, sizes) for c in W.chunks(batch.column(batch.schema.get_field_index(text)))]
            values = [
                pa.array(np.concatenate([p[n] for p in parts]) if parts else np.zeros(0, np.int64), pa.int64())
                for n in counts
            ]
            columns = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != name]
            yield pa.RecordBatch.from_arrays([*columns, pa.StructArray.from_arrays(values, counts)], names=[*kept, name])

    fields = ", ".join(f"{n}: bigint" for n in counts)
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*quoted(kept)).schema)
    return documents.mapInArrow(run, f"{own}, `{name}` struct<{fields}>")


def verdicts(config: RuleConfig = RuleConfig(), name: str = "rules") -> tuple[Column, Column]:
    """(base_failed, kept) from the measures."""
    rule = F.col(name)
    words = rule["n_words"]
    base = (words < config.least_words) | (
        100 * rule[f"n{config.repeat_size}_words"] > config.repeat_percent * words
    )
    letters = rule["word_chars"]
    covered = rule["dup_line_chars"] > config.line_coverage * letters
    for size, share in config.coverage:
        covered = covered | (rule[f"n{size}_chars"] > share * letters)
    return base, ~base & ~covered


def quality_rules(documents: DataFrame, config: RuleConfig = RuleConfig(), text: str = "text") -> DataFrame:
    """Measures and verdict of each document: the rows given, with ``rules``, ``base_failed`` and ``kept``.

    These three replace columns so named. An empty table gives an empty result. See :func:`measure` for nulls and
    repeated rows.
    """
    base, kept = verdicts(config)
    return measure(documents, config, text).withColumns({"base_failed": base, "kept": kept})


def kept_documents(documents: DataFrame, config: RuleConfig = RuleConfig(), text: str = "text") -> DataFrame:
    """The rows of ``documents``, all columns as they are, that the rules keep."""
    (name,) = free_names(documents.columns, "rules")
    return measure(documents, config, text, name).where(verdicts(config, name)[1]).select(*quoted(documents.columns))
