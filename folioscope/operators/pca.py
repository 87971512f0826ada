"""Principal components by subspace iteration.

An iteration multiplies the covariance with a basis by one pass over the rows: each task adds up
centred row times projected row, so what moves has the size of the basis. The basis of each iteration
is a written table. Components have length 1 and their largest loading is positive.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.vectors import as_double
from folioscope.operators.scoring import flat_lists
from folioscope.runtime import ship, stage

ship(__name__)

# Directions iterated beside the wanted ones, change of a component at which it counts as found, most iterations.
SPARE, TOLERANCE, MAX_PASSES = 8, 1e-9, 300
# Vectors up to this width get a basis as wide as they are, which is exact after one pass.
EXACT_WIDTH = 512


@dataclass(frozen=True)
class Components:
    """`directions` (k x width) and the variance of the rows along each; `passes` over the rows it took."""

    mean: np.ndarray
    directions: np.ndarray
    variance: np.ndarray
    passes: int


def with_signs(directions: np.ndarray) -> np.ndarray:
    """The largest loading of every direction (the first of equals) made positive."""
    largest = np.abs(directions).argmax(axis=1)
    return directions * np.where(directions[np.arange(len(directions)), largest] < 0, -1.0, 1.0)[:, None]


def covariance_times(rows: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance of `rows` (vector) times `basis` (width x b); the table that is written has width x b rows."""
    shared = rows.sparkSession.sparkContext.broadcast((mean, basis))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = shared.value
        total = np.zeros(basis.shape)
        for batch in batches:
            centred = flat_lists(batch.column(0))[0].reshape(batch.num_rows, -1) - mean
            total += centred.T @ (centred @ basis)
        dim, column = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(dim.ravel().astype(np.int32)), pa.array(column.ravel().astype(np.int32)), pa.array(total.ravel())],
            names=["dim", "col", "x"])

    slots = 4 * rows.sparkSession.sparkContext.defaultParallelism
    parts = rows.coalesce(slots).mapInArrow(run, "dim int, col int, x double")
    table = stage(parts.groupBy("dim", "col").agg(F.sum("x").alias("x")), "basis").toArrow()
    out = np.zeros(basis.shape)
    out[table["dim"].to_numpy(), table["col"].to_numpy()] = table["x"].to_numpy() / max(n, 1)
    return out


def fit_components(df: DataFrame, vector_col: str, k: int = 5, tolerance: float = TOLERANCE, max_passes: int = MAX_PASSES) -> Components:
    """The first k principal components of equally long vectors; NULL vectors are left out.

    Vectors wider than EXACT_WIDTH take several passes, the more the closer a component's variance is to
    that of later ones.
    """
    rows = df.filter(F.col(vector_col).isNotNull()).select(as_double(F.col(vector_col)).alias("vector"))
    if rows.isEmpty():
        return Components(np.zeros(0), np.zeros((0, 0)), np.zeros(0), 0)
    n, mean = rows.agg(F.count(F.lit(1)), vector_to_array(Summarizer.mean(array_to_vector("vector")))).first()
    mean = np.array(mean)
    width = len(mean)
    k, size = min(k, width), width if width <= EXACT_WIDTH else min(k + SPARE, width)
    basis = np.linalg.qr(np.random.default_rng(0).normal(size=(width, size)))[0]
    found, passes = np.zeros((k, width)), 0
    while True:
        product = covariance_times(rows, mean, basis, n)
        passes += 1
        variance, turn = np.linalg.eigh(basis.T @ product)
        order = np.argsort(-variance)
        before, found = found, with_signs((basis @ turn[:, order[:k]]).T)
        if size == width or passes == max_passes or np.abs(found - before).max() <= tolerance:
            return Components(mean, found, variance[order[:k]], passes)
        basis = np.linalg.qr(product @ turn[:, order])[0]


def project(df: DataFrame, vector_col: str, components: Components, out_col: str = "components") -> DataFrame:
    """Add ARRAY<DOUBLE> of the centred vectors' lengths along the components."""
    shared = df.sparkSession.sparkContext.broadcast((components.mean, components.directions.T))

    @F.arrow_udf("array<double>")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        mean, directions = shared.value
        for vectors in batches:
            known = vectors.is_valid().to_numpy(zero_copy_only=False)
            values = (flat_lists(vectors)[0].reshape(int(known.sum()), -1) - mean) @ directions if known.any() else np.zeros((0, 0))
            ends = np.concatenate(([0], np.cumsum(known) * directions.shape[1])).astype("int32")
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel()), mask=pa.array(~known))

    return df.withColumn(out_col, lengths(as_double(F.col(vector_col))))
