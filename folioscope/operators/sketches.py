"""Mergeable summaries with a stated error: distinct counts and frequent values.

States are kept per partition of the data (a day, a batch, a source), saved, and merged later without
reading the rows again. The exact forms are in `relational`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import ship

ship(__name__)

# Logarithm of the number of cells of a distinct-count state: relative error about 1.04 / sqrt(2 ** 14), 0.8 %.
DISTINCT_BITS = 14
# Counters of a frequent-values summary: a value is missed, or undercounted, by at most rows / (COUNTERS + 1).
COUNTERS = 1000


def distinct_states(df: DataFrame, col: str, *groups: str, bits: int = DISTINCT_BITS) -> DataFrame:
    """(groups..., state): what is needed to count the distinct values of `col`, NULL left out."""
    return df.groupBy(*groups).agg(F.hll_sketch_agg(col, bits).alias("state"))


def merge_distinct(states: DataFrame, *groups: str) -> DataFrame:
    return states.groupBy(*groups).agg(F.hll_union_agg("state").alias("state"))


def distinct_estimates(states: DataFrame, *groups: str) -> DataFrame:
    """(groups..., n): estimated number of distinct values."""
    return states.select(*groups, F.hll_sketch_estimate("state").alias("n"))


def reduce_counters(values: pa.Array, counts: np.ndarray, counters: int) -> tuple[pa.Array, np.ndarray, int]:
    """At most `counters` of the values with what is left of their counts, and how much was taken from each."""
    if len(counts) <= counters:
        return values, counts, 0
    taken = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
    kept = np.flatnonzero(counts > taken)
    return values.take(pa.array(kept)), counts[kept] - taken, taken


def frequent_summaries(df: DataFrame, col: str, counters: int = COUNTERS) -> DataFrame:
    """(value, low, missed): one summary per task of the strings in `col` (NULL left out), `missed` under the NULL value.

    `low` never exceeds a value's count in the rows of the task, and falls short of it by at most `missed`,
    which is at most rows / (counters + 1).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts, missed = pa.array([], pa.string()), np.empty(0, dtype=np.int64), 0
        for batch in batches:
            found = pa.concat_arrays([values, batch.column(0).drop_null().cast(pa.string())]).dictionary_encode()
            weight = np.concatenate((counts, np.ones(len(found) - len(counts), dtype=np.int64)))
            total = np.bincount(found.indices.to_numpy(), weights=weight, minlength=len(found.dictionary)).astype(np.int64)
            values, counts, taken = reduce_counters(found.dictionary, total, counters)
            missed += taken
        yield pa.RecordBatch.from_arrays(
            [pa.concat_arrays([values, pa.array([None], pa.string())]), pa.array(np.append(counts, 0)),
             pa.array(np.append(np.zeros(len(counts), dtype=np.int64), missed))], names=["value", "low", "missed"])

    return df.select(F.col(col).cast("string").alias("value")).mapInArrow(run, "value string, low bigint, missed bigint")


def merge_frequent(summaries: DataFrame) -> DataFrame:
    """(value, low, missed) of all summaries together; errors add up under the NULL value."""
    return summaries.groupBy("value").agg(F.sum("low").alias("low"), F.sum("missed").alias("missed"))


def frequent_values(merged: DataFrame, least: int) -> DataFrame:
    """(value, low, high): all values that may occur at least `least` times, with bounds of their count.

    No value of that count is missing as long as `least` exceeds the error of the summaries.
    """
    missed = merged.filter("value IS NULL").agg(F.coalesce(F.sum("missed"), F.lit(0))).scalar()
    return merged.filter("value IS NOT NULL").select("value", "low", (F.col("low") + missed).alias("high")).filter(F.col("high") >= least)
