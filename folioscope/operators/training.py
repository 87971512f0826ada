"""Softmax regression on words by passes of gradient descent, with the dev metric after every pass.

A pass adds up the gradient of all training rows: each task keeps one sum for its rows and gives out
the cells that are not zero, which are combined per cell. Weights are a written table per pass, so a
lost executor costs the pass that is running.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators import classifiers
from folioscope.operators.scoring import CHUNK_CELLS, Blocks, Scorer, best_classes, flat_lists
from folioscope.runtime import ship, stage

ship(__name__)

_WEIGHTS = "label_idx int, idx int, weight double"


@dataclass(frozen=True)
class Trained:
    """Weights (label_idx, idx, weight) of the best pass, word 0 being the constant; (pass, n, accuracy) of all passes."""

    weights: DataFrame
    history: list[tuple[int, int, float | None]]
    best_pass: int
    n_classes: int
    width: int


def _ranges(n_classes: int, width: int) -> list[tuple[int, int]]:
    step = max(1, classifiers.BLOCK_CELLS // (width + 1))
    return [(a, min(a + step, n_classes)) for a in range(0, n_classes, step)]


def _blocks(weights: DataFrame, n_classes: int, width: int) -> Blocks:
    parts = []
    for a, b in _ranges(n_classes, width):
        cells = weights.filter(F.col("label_idx").between(a, b - 1)).toArrow()  # at most BLOCK_CELLS rows
        dense = np.zeros((b - a, width + 1))
        dense[cells["label_idx"].to_numpy() - a, cells["idx"].to_numpy()] = cells["weight"].to_numpy()
        parts.append((a, b, weights.sparkSession.sparkContext.broadcast(dense)))
    return Blocks(parts)


def _logits(blocks: Blocks, n_classes: int, words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Constant plus the mean weight of a row's words."""
    row, share = np.repeat(np.arange(len(lengths)), lengths), 1.0 / np.maximum(lengths, 1)
    out = np.empty((len(lengths), n_classes))
    for a, b, dense in blocks.each():
        for c in range(b - a):
            out[:, a + c] = dense[c, 0] + np.bincount(row, weights=dense[c][words], minlength=len(lengths)) * share
    return out


def softmax_scorer(weights: DataFrame, n_classes: int, width: int, sequence: Column) -> Scorer:
    blocks = _blocks(weights, n_classes, width)

    def scores(arrays: list[pa.Array]) -> np.ndarray:
        return _logits(blocks, n_classes, *flat_lists(arrays[0]))

    return Scorer([sequence], n_classes, scores)


def gradient(rows: DataFrame, weights: DataFrame, label_col: str, n_classes: int, width: int, sequence_col: str) -> DataFrame:
    """(label_idx, idx, g): sum over all rows of (probability - truth) times the word's share of the row.

    One pass over the rows for every BLOCK_CELLS weights; a task holds one block's sums.
    """
    blocks = _blocks(weights, n_classes, width)
    # One sum per task, and few tasks per core, so that the sums stay small against the rows.
    slots = 4 * rows.sparkSession.sparkContext.defaultParallelism
    narrow = rows.select(F.col(sequence_col).alias("sequence"), F.col(label_col).cast("int").alias("label")).coalesce(slots)
    found = None
    for first, end in _ranges(n_classes, width):

        def run(batches: Iterator[pa.RecordBatch], first: int = first, end: int = end) -> Iterator[pa.RecordBatch]:
            total = np.zeros((end - first, width + 1))
            step = max(1, CHUNK_CELLS // max(n_classes, 1))
            for batch in batches:
                for start in range(0, batch.num_rows, step):
                    part = batch.slice(start, step)
                    words, lengths = flat_lists(part.column(0))
                    rest = _logits(blocks, n_classes, words, lengths)
                    rest = np.exp(rest - rest.max(axis=1, keepdims=True))
                    rest /= rest.sum(axis=1, keepdims=True)
                    rest[np.arange(len(rest)), part.column(1).to_numpy()] -= 1
                    shared = rest / np.maximum(lengths, 1)[:, None]
                    owner = np.repeat(np.arange(len(rest)), lengths)
                    for c in range(first, end):
                        total[c - first] += np.bincount(words, weights=shared[owner, c], minlength=width + 1)
                        total[c - first, 0] += rest[:, c].sum()
            label, idx = np.nonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array((label + first).astype(np.int32)), pa.array(idx.astype(np.int32)), pa.array(total[label, idx])],
                names=["label_idx", "idx", "g"])

        part = narrow.mapInArrow(run, "label_idx int, idx int, g double")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("label_idx", "idx").agg(F.sum("g").alias("g"))


def train_softmax(train: DataFrame, dev: DataFrame, label_col: str, n_classes: int, width: int, sequence_col: str = "sequence",
                  passes: int = 2, rate: float = 8.0, decay: float = 1e-4, patience: int | None = None) -> Trained:
    """Fixed-step descent from zero weights on word indices 1..width; rows without a label are left out.

    After each pass the accuracy on `dev` is taken (NULL where it has no labelled row). Training stops after `passes`, or
    when the accuracy has not risen for `patience` passes; the weights of the best pass, the earliest of equals, are kept.
    """
    spark = train.sparkSession
    rows, held_out = (df.filter(F.col(label_col).isNotNull()) for df in (train, dev))
    n = rows.count()
    weights = spark.createDataFrame([], _WEIGHTS)
    history, best = [], (None, 0, weights)
    for number in range(1, passes + 1):
        step = gradient(rows, weights, label_col, n_classes, width, sequence_col)
        moved = weights.select("label_idx", "idx", (F.col("weight") * (1 - rate * decay)).alias("weight")).unionByName(
            step.select("label_idx", "idx", (F.col("g") * (-rate / max(n, 1))).alias("weight")))
        weights = stage(moved.groupBy("label_idx", "idx").agg(F.sum("weight").alias("weight")), "weights")
        scored = best_classes(held_out, softmax_scorer(weights, n_classes, width, F.col(sequence_col)), 1, label_col)
        seen, hit = scored.agg(F.count(F.lit(1)), F.avg((F.col("true_rank") == 1).cast("double"))).first()
        history.append((number, seen, hit))
        if best[1] == 0 or (hit is not None and (best[0] is None or hit > best[0])):
            best = (hit, number, weights)
        if patience is not None and number - best[1] >= patience:
            break
    return Trained(best[2], history, best[1], n_classes, width)
