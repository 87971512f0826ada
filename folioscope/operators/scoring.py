"""Class scores of rows in one pass, whatever the number of classes.

A scorer turns the Arrow arrays of its input columns into one row of class scores per row. Weights
lie in blocks of bounded size; every block is a broadcast of its own, and a task that needs several
goes through them one after the other for each chunk of rows and keeps one at a time. So rows are
read once, nothing is staged in between, and no worker holds more than a block and the scores of a
chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import ship

ship(__name__)

# Scores of one chunk of rows: 32 MB.
CHUNK_CELLS = 4_000_000
# List values, such as the words of texts, of one chunk of rows.
CHUNK_VALUES = 1_000_000
# Weights looked up at a time.
LOOKUPS = 2_000_000


@dataclass(frozen=True)
class Scorer:
    """`scores(arrays)` gives rows x n_classes scores for the Arrow arrays of `inputs`; any function will do."""

    inputs: list[Column]
    n_classes: int
    scores: Callable[[list[pa.Array]], np.ndarray]


@dataclass(frozen=True)
class Blocks:
    """Weights of ranges of classes as (first class, end, broadcast)."""

    parts: list[tuple[int, int, object]]

    def each(self) -> Iterator[tuple[int, int, object]]:
        for first, end, shared in self.parts:
            yield first, end, shared.value
            if len(self.parts) > 1:
                vars(shared).pop("_value", None)  # the executor keeps the block's file; the loaded copy goes


def row_ranges(lists: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """(first row, row after the last) of consecutive rows with at most `most` values; a longer row is alone."""
    bounds, start = lists.offsets.to_numpy(zero_copy_only=False), 0
    while start < len(lists):
        stop = max(start + 1, int(np.searchsorted(bounds, int(bounds[start]) + most, side="right")) - 1)
        yield start, stop
        start = stop


def _chunks(arrays: list[pa.Array], n_classes: int) -> Iterator[list[pa.Array]]:
    """Rows with bounded scores and bounded lists."""
    step = max(1, CHUNK_CELLS // max(n_classes, 1))
    for start in range(0, len(arrays[0]), step):
        parts = [[a.slice(start, step) for a in arrays]]
        for number in (i for i, a in enumerate(arrays) if pa.types.is_list(a.type)):
            parts = [[a.slice(x, y - x) for a in part] for part in parts for x, y in row_ranges(part[number], CHUNK_VALUES)]
        yield from parts


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values of all lists in a row, length of each); a NULL list is empty."""
    lengths = np.nan_to_num(pc.list_value_length(lists).to_numpy(zero_copy_only=False)).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False), lengths


def all_scores(scorer: Scorer) -> Column:
    """ARRAY<DOUBLE> of scores by class index."""
    n_classes, function = scorer.n_classes, scorer.scores

    @F.arrow_udf("array<double>")
    def scores(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            for chunk in _chunks(list(arrays), n_classes):
                ends = np.arange(len(chunk[0]) + 1, dtype="int32") * n_classes
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(function(chunk).ravel()))

    return scores(*_several(scorer.inputs))


def shares(values: np.ndarray) -> np.ndarray:
    """Probabilities of rows of log scores."""
    if not values.size:
        return values
    e = np.exp(values - values.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def all_probabilities(*scorers: Scorer) -> Column:
    """ARRAY<DOUBLE> of the probabilities by class index, those of several scorers side by side.

    One function for all of them: each function over a batch has a Python worker of its own per task.
    """
    functions, counts = [s.scores for s in scorers], [len(s.inputs) for s in scorers]
    n_classes = sum(s.n_classes for s in scorers)

    @F.arrow_udf("array<double>")
    def probabilities(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for arrays in batches:
            for chunk in _chunks(list(arrays), n_classes):
                found, at = [], 0
                for function, count in zip(functions, counts):
                    found.append(shares(function(chunk[at:at + count])))
                    at += count
                ends = np.arange(len(chunk[0]) + 1, dtype="int32") * n_classes
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.hstack(found).ravel()))

    return probabilities(*_several([c for s in scorers for c in s.inputs]))


def _several(inputs: list[Column]) -> list[Column]:
    """At least two columns, so that a function always gets its batches as tuples."""
    return inputs if len(inputs) > 1 else [*inputs, F.lit(0)]


def best_of(values: np.ndarray, k: int) -> np.ndarray:
    """The k best classes of each row, best first; ties go to the lower index."""
    k = min(k, values.shape[1])
    if not k:
        return np.empty((len(values), 0), dtype=np.int32)
    least = np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]
    out = np.empty((len(values), k), dtype=np.int32)
    for row, (own, bound) in enumerate(zip(values, least)):
        fit = np.flatnonzero(own >= bound)
        out[row] = fit[np.argsort(-own[fit], kind="stable")[:k]]
    return out


def best_classes(df: DataFrame, scorer: Scorer, k: int, label_col: str | None = None) -> DataFrame:
    """Add `best`, the k best classes as (class_idx, score), and with a label column the `true_rank` of the label.

    Scores of all classes exist for a chunk of rows inside a task only. Ties go to the lower class; a label
    that is NULL or no class has no rank.
    """
    n_classes, function = scorer.n_classes, scorer.scores
    label = F.lit(None) if label_col is None else F.col(label_col)

    @F.arrow_udf("struct<best: array<struct<class_idx: int, score: double>>, true_rank: int>")
    def ranked(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for *inputs, labels in batches:
            found, scores, ranks, width = [np.empty(0, np.int32)], [np.empty(0)], [], min(k, n_classes)
            for *arrays, own in _chunks([*inputs, labels], n_classes):
                values = function(arrays)
                best = best_of(values, k)
                found.append(best.ravel())
                scores.append(np.take_along_axis(values, best, axis=1).ravel())
                for row, label in zip(values, own.to_pylist()):
                    known = label is not None and 0 <= label < n_classes
                    ranks.append(int((row > row[label]).sum() + (row[:label] == row[label]).sum()) + 1 if known else None)
            cells = pa.StructArray.from_arrays(
                [pa.array(np.concatenate(found), pa.int32()), pa.array(np.concatenate(scores))], names=["class_idx", "score"])
            ends = pa.array(np.arange(len(labels) + 1, dtype="int32") * width)
            yield pa.StructArray.from_arrays(
                [pa.ListArray.from_arrays(ends, cells), pa.array(ranks, pa.int32())], names=["best", "true_rank"])

    done = df.withColumn("__ranked", ranked(*scorer.inputs, label.cast("int")))
    done = done.withColumns({"best": F.col("__ranked")["best"], "true_rank": F.col("__ranked")["true_rank"]}).drop("__ranked")
    return done if label_col is not None else done.drop("true_rank")


def recommended(best: DataFrame, id_col: str) -> DataFrame:
    """(id, rank, class_idx) from `best_classes`."""
    return best.select(id_col, F.posexplode("best").alias("__pos", "__cell")).select(
        id_col, (F.col("__pos") + 1).alias("rank"), F.col("__cell")["class_idx"].alias("class_idx"))


# -- naive Bayes -----------------------------------------------------------------------------------

# Sparse weights of a range of classes for one or several models: (prior, floor, starts, classes, gain).
# A word a class has not seen costs `floor`; only words it has seen have a cell, with what the word gains
# over that. `prior`, `floor` and `gain` have a row per model; the cells of word w are slice
# [starts[w], starts[w + 1]) of `classes` and `gain`.
TermBlock = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def term_scores(block: TermBlock, words: np.ndarray, lengths: np.ndarray, model: int) -> np.ndarray:
    """Scores of rows whose words stand in a row."""
    prior, floor, starts, classes, gain = block
    n, width = len(lengths), prior.shape[1]
    out = prior[model] + lengths[:, None] * floor[model]
    degree = starts[words + 1] - starts[words]
    ends = np.cumsum(lengths)
    looked = np.concatenate(([0], np.cumsum(degree)))[np.concatenate(([0], ends))]
    row = 0
    while row < n:
        # Whole rows with a bounded number of cells; a longer row is alone.
        stop = max(row + 1, int(np.searchsorted(looked, looked[row] + LOOKUPS, side="right")) - 1)
        part = slice(ends[row] - lengths[row], ends[stop - 1])
        count = degree[part]
        source = np.arange(count.sum()) + np.repeat(starts[words[part]] - (np.cumsum(count) - count), count)
        place = np.repeat(np.repeat(np.arange(stop - row), lengths[row:stop]), count) * width + classes[source]
        sums = np.bincount(place, weights=gain[model][source], minlength=(stop - row) * width)
        out[row:stop] += sums.reshape(stop - row, width)
        row = stop
    return out


def term_block(n_models: int, width: int, smoothing: float, docs: np.ndarray, words: np.ndarray, totals: np.ndarray, n_classes: int,
               cell_class: np.ndarray, cell_word: np.ndarray, cell_model: np.ndarray, cell_count: np.ndarray) -> TermBlock:
    """Weights of a block from its counts.

    `docs` and `words` count by (model, class) and `totals` by model; model 0 has all rows, model f leaves
    out fold f. A cell counts the occurrences of a word in a class, those of fold f under model f and all
    others under model 0.
    """
    size = docs.shape[1]
    key = cell_word.astype(np.int64) * size + cell_class
    keys, place = np.unique(key, return_inverse=True)
    every = np.bincount(place, weights=cell_count, minlength=len(keys))
    gain = np.empty((n_models, len(keys)))
    for model in range(n_models):
        left_out = cell_model == model
        without = 0 if model == 0 else np.bincount(place[left_out], weights=cell_count[left_out], minlength=len(keys))
        gain[model] = np.log1p((every - without) / smoothing)
    return (
        np.log(docs + smoothing) - np.log(totals[:, None] + smoothing * n_classes),
        np.log(smoothing) - np.log(words + smoothing * max(width, 1)),
        np.searchsorted(keys, np.arange(width + 2, dtype=np.int64) * size), (keys % size).astype(np.int32), gain)
