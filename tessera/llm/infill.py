"""Fill-in-middle documents, cut at token boundaries that a learned rank index finds.

The index of a text maps a rank k to the code point where its first k tokens end. It is a piecewise-linear fit to
all boundaries: a segment predicts by its line, is split in half while any of its predictions is off by more than the
error bound, and the residuals, one byte each, correct a prediction to the exact boundary. An index depends on the
text alone, so once stored it serves any number of draws.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm import words as W
from tessera.llm.tables import free_names, quoted

INDEX = "struct<n: bigint, ranks: array<bigint>, places: array<bigint>, residuals: array<tinyint>>"


@dataclass(frozen=True)
class InfillConfig:
    """``percent`` of the texts are rearranged, ``suffix_first_percent`` of these with the suffix in front.

    ``error``: the largest residual of the index, at most 127. ``prefix``, ``suffix`` and ``middle`` mark the parts.
    """

    seed: int = 42
    percent: int = 50
    suffix_first_percent: int = 80
    error: int = 127
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


# --- the index --------------------------------------------------------------------------------


def boundaries(chunk: W.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(places, first): code points at which the tokens of each text end, 0 in front, those of text i from first[i].

    A token is a word with the white space before it; white space at a text's end is a token of its own.
    """
    data, count = chunk.data, chunk.count
    inside = ~W.SPACES[data]
    begins, ends = chunk.offsets[:-1], chunk.offsets[1:]
    full = ends > begins
    follows = np.zeros(len(data), bool)
    follows[:-1] = inside[1:]
    follows[ends[full] - 1] = False
    stops = np.flatnonzero(inside & ~follows) + 1
    owner = np.searchsorted(chunk.offsets, stops, side="left") - 1
    words = np.bincount(owner, minlength=count)
    trailing = np.zeros(count, bool)
    trailing[full] = ~inside[ends[full] - 1]
    first = np.concatenate([[0], np.cumsum(1 + words + trailing)])
    at = np.empty(first[-1], np.int64)
    at[first[:-1]] = begins
    before = np.cumsum(words) - words
    at[first[owner] + 1 + np.arange(len(stops)) - before[owner]] = stops
    at[first[1:][trailing] - 1] = ends[trailing]
    characters = np.concatenate([[0], np.cumsum(W.STARTS_CHARACTER[data])])
    return characters[at] - np.repeat(characters[begins], np.diff(first)), first


def _predicted(k: np.ndarray, low: np.ndarray, high: np.ndarray, places: np.ndarray) -> np.ndarray:
    return places[low] + (k - low) * (places[high] - places[low]) // np.maximum(high - low, 1)


def fit(places: np.ndarray, first: np.ndarray, error: int) -> tuple[np.ndarray, np.ndarray]:
    """(segment begins, residuals) of all texts; a segment ends where the next one of its text begins.

    Segments are split in half, all that are off at once, until none errs by more than ``error``; two points always fit.
    """
    low, high = first[:-1].copy(), first[1:] - 1
    done = []
    residuals = np.zeros(len(places), np.int8)
    while len(low):
        size = high - low + 1
        edge = np.cumsum(size) - size
        k = np.arange(size.sum()) - np.repeat(edge - low, size)
        off = places[k] - _predicted(k, np.repeat(low, size), np.repeat(high, size), places)
        good = np.maximum.reduceat(np.abs(off), edge) <= error
        within = np.repeat(good, size)
        residuals[k[within]] = off[within]
        done.append(low[good])
        low, high = low[~good], high[~good]
        half = (low + high) // 2
        low, high = np.concatenate([low, half]), np.concatenate([half, high])
    return np.sort(np.concatenate(done)) if done else np.zeros(0, np.int64), residuals


def _index(chunk: W.Chunk, error: int) -> pa.StructArray:
    places, first = boundaries(chunk)
    begins, residuals = fit(places, first, error)
    lasts = first[1:] - 1
    knots = np.unique(np.concatenate([begins, lasts]))
    owner = np.searchsorted(first, knots, side="right") - 1
    # a text's last boundary ends its last segment and closes the list of ranks
    edges = pa.array(np.searchsorted(knots, first), pa.int32())
    ranks = pa.ListArray.from_arrays(edges, pa.array(knots - first[owner]))
    starts = pa.ListArray.from_arrays(edges, pa.array(places[knots]))
    stored = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(residuals))
    return pa.StructArray.from_arrays(
        [pa.array(np.diff(first) - 1), ranks, starts, stored], ["n", "ranks", "places", "residuals"]
    )


def index_boundaries(
    documents: DataFrame, config: InfillConfig = InfillConfig(), text: str = "text", name: str = "boundaries"
) -> DataFrame:
    """The rows of ``documents`` with their rank index as struct ``name`` (in place of a column so named).

    One pass without a shuffle; a text of n tokens costs n + 1 bytes and some longs a segment. Null and empty texts
    have no token and one boundary.
    """
    if not 0 < config.error < 128:
        raise ValueError("error must be from 1 to 127")
    kept = [c for c in documents.columns if c != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(batch.schema.get_field_index(text))):
                own = batch.slice(chunk.first, chunk.count)
                columns = [own.column(i) for i, c in enumerate(own.schema.names) if c != name]
                yield pa.RecordBatch.from_arrays([*columns, _index(chunk, config.error)], names=[*kept, name])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.select(*quoted(kept)).schema)
    return documents.mapInArrow(run, f"{own}, `{name}` {INDEX}")


def boundary(index: Column, rank: Column) -> Column:
    """Code points of a text's first ``rank`` tokens: the segment's prediction and the stored residual."""
    ranks, places = index["ranks"], index["places"]
    knots = F.size(ranks)
    found = F.size(F.filter(ranks, lambda r: r <= rank))
    low = F.greatest(F.lit(1), F.least(found, knots - 1))
    high = F.least(low + 1, knots)
    at = lambda values, i: F.element_at(values, i)
    rise = (rank - at(ranks, low)) * (at(places, high) - at(places, low))
    run = F.greatest(at(ranks, high) - at(ranks, low), F.lit(1))
    predicted = at(places, low) + F.floor((rise - F.pmod(rise, run)) / run).cast("long")
    # a knot begins its segment, so its residual is zero on either line
    return predicted + at(index["residuals"], (rank + 1).cast("int"))


# --- the transformation -----------------------------------------------------------------------


def fill_in_middle(
    documents: DataFrame, config: InfillConfig = InfillConfig(), doc_id: str = "doc_id", text: str = "text",
    name: str = "infill",
) -> DataFrame:
    """The rows of ``documents`` with struct ``name``: n, form, prefix_chars, middle_chars and output.

    Two draws of a row's hash cut its tokens in prefix, middle and suffix, two more choose the form; rows of equal id
    are cut at equal draws. ``form`` is plain (output is the text as it is, the counts are null), psm (prefix, suffix,
    middle) or spm (suffix, prefix, middle). A null text counts as empty; empty texts and texts that hold a mark stay
    plain. A null id hashes as an empty one. ``name`` replaces a column so named, others are kept. An empty table
    gives an empty result.
    """
    kept = [c for c in documents.columns if c != name]
    (index,) = free_names(kept, "boundaries")
    rows = index_boundaries(documents.select(*quoted(kept)), config, text, index)
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    key = F.sha2(F.concat(F.lit(f"{config.seed}:"), F.coalesce(F.col(f"`{doc_id}`").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    units = F.col(index)["n"]
    first, second = draws[0] % (units + 1), draws[1] % (units + 1)
    marked = whole.contains(config.prefix) | whole.contains(config.suffix) | whole.contains(config.middle)
    plain = (whole == "") | marked | (draws[2] % 100 >= config.percent)
    form = F.when(plain, "plain").when(draws[3] % 100 < config.suffix_first_percent, "spm").otherwise("psm")
    low, high, made = free_names([*rows.columns, name], "low", "high", "form")
    # ranks are columns of their own, as the search of a segment compares each with them
    rows = rows.withColumns({made: form, low: F.least(first, second), high: F.greatest(first, second)})
    moved = F.col(made) != "plain"
    rows = rows.withColumns({k: F.when(moved, boundary(F.col(index), F.col(k))) for k in (low, high)})
    lower, upper = F.col(low).cast("int"), F.col(high).cast("int")
    prefix = F.concat(F.lit(config.prefix), F.substring(whole, F.lit(1), lower))
    middle = F.concat(F.lit(config.middle), F.substring(whole, lower + 1, upper - lower))
    suffix = F.concat(F.lit(config.suffix), F.substring(whole, upper + 1, F.length(whole) - upper))
    output = (
        F.when(F.col(made) == "plain", whole)
        .when(F.col(made) == "psm", F.concat(prefix, suffix, middle))
        .otherwise(F.concat(suffix, prefix, middle))
    )
    cut = F.struct(
        units.alias("n"), F.col(made).alias("form"), F.col(low).alias("prefix_chars"),
        (F.col(high) - F.col(low)).alias("middle_chars"), output.alias("output"),
    )
    return rows.select(*quoted(kept), cut.alias(name))


def restored(output: Column, form: Column, config: InfillConfig = InfillConfig()) -> Column:
    """The text, rebuilt from an output and its form alone."""

    def parts(one: str, two: str) -> tuple[Column, Column, Column]:
        begin = len(one) + 1
        second = F.locate(two, output)
        third = F.locate(config.middle, output)
        return (
            F.substring(output, F.lit(begin), second - begin),
            F.substring(output, second + len(two), third - second - len(two)),
            F.substring(output, third + len(config.middle), F.length(output)),
        )

    prefix, suffix, middle = parts(config.prefix, config.suffix)
    back, front, centre = parts(config.suffix, config.prefix)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(prefix, middle, suffix))
        .otherwise(F.concat(front, centre, back))
    )
