"""Ranking metrics: accuracy, recall, top-k coverage, its area, k90, bootstrap intervals.

Everything after `true_ranks` works on the histogram of true ranks, whose size is the number of
classes, whatever the number of scored rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.vectors import argmax, ranked_classes, true_rank
from folioscope.runtime import broadcast_if_small, stage

# Step of the coverage grid, accuracy that k90 asks for, number of resamples.
COVERAGE_STEP = 10
K90_ACCURACY = 0.9
RESAMPLES = 1000
# Draws of one resample that a task makes at a time.
DRAWS_AT_ONCE = 1 << 17


def true_ranks(scored: DataFrame, *keep: str, scores_col: str = "scores", label_col: str = "label_idx") -> DataFrame:
    """(keep..., label_idx, predicted, true_rank), row by row, without a shuffle."""
    scores = F.col(scores_col)
    return scored.select(
        *keep,
        F.col(label_col).alias("label_idx"),
        argmax(scores).alias("predicted"),
        true_rank(scores, F.col(label_col)).alias("true_rank"),
    )


def join_predictions(predictions: DataFrame, truth: DataFrame, id_col: str) -> DataFrame:
    """(id, ..., scores): long predictions (id, class_idx, score) packed per id and joined to their truth.

    A pack holds one entry per class; packing and join share one shuffle by id.
    """
    packed = predictions.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct("class_idx", "score"))).alias("__cells")
    )
    scores = F.transform("__cells", lambda cell: cell["score"])
    return packed.select(id_col, scores.alias("scores")).join(truth, id_col)


def recommendations(scored: DataFrame, id_col: str, k: int, scores_col: str = "scores") -> DataFrame:
    """(id, rank, class_idx): the k best classes of every row."""
    best = F.slice(ranked_classes(F.col(scores_col)), 1, k)
    return scored.select(id_col, F.posexplode(best).alias("__pos", "class_idx")).select(
        id_col, (F.col("__pos") + 1).alias("rank"), "class_idx"
    )


def rank_histogram(ranks: DataFrame, *groups: str) -> DataFrame:
    """(groups..., true_rank, n), staged: every metric reads it several times, scoring runs once."""
    return stage(ranks.groupBy(*groups, "true_rank").agg(F.count(F.lit(1)).alias("n")), "rank-histogram")


def accuracy(histogram: DataFrame, *groups: str) -> DataFrame:
    hits = F.sum(F.when(F.col("true_rank") == 1, F.col("n")).otherwise(0))
    return histogram.groupBy(*groups).agg((hits / F.sum("n")).alias("accuracy"))


def coverage_curve(histogram: DataFrame, n_classes: Column | int, *groups: str, step: int = COVERAGE_STEP,
                   offset: int = 1) -> DataFrame:
    """(groups..., k, coverage, accuracy) for k = 0, step, 2*step, ... below the number of classes.

    `accuracy` is the share of rows whose true class is among the k best, `coverage` is
    (k + offset) / n_classes. Each rank counts from its first grid point on; a running sum over
    the grid does the rest.
    """
    classes = F.lit(n_classes) if isinstance(n_classes, int) else n_classes
    grid = (
        histogram.groupBy(*groups)
        .agg(F.sum("n").alias("total"))
        .withColumn("k", F.explode(F.sequence(F.lit(0), (classes - 1).cast("int"), F.lit(step))))
    )
    first_k = (F.ceil(F.col("true_rank") / step) * step).cast("int")
    gained = histogram.groupBy(*groups, first_k.alias("k")).agg(F.sum("n").alias("gain"))
    running = Window.partitionBy(*groups).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.sum("gain").over(running), F.lit(0))
    return grid.join(gained, [*groups, "k"], "left").select(
        *groups,
        "k",
        ((F.col("k") + offset) / classes).alias("coverage"),
        (covered / F.col("total")).alias("accuracy"),
    )


def curve_metrics(curve: DataFrame, *groups: str, target: float = K90_ACCURACY) -> DataFrame:
    """(groups..., auc, k90): trapezoid area and the first k above the target accuracy (or NULL)."""
    along = Window.partitionBy(*groups).orderBy("k")
    dx = F.col("coverage") - F.lag("coverage").over(along)
    mean_y = (F.col("accuracy") + F.lag("accuracy").over(along)) / 2
    return curve.withColumn("__area", dx * mean_y).groupBy(*groups).agg(
        F.sum("__area").alias("auc"),
        F.min(F.when(F.col("accuracy") > target, F.col("k"))).alias("k90"),
    )


def performance(histogram: DataFrame, n_classes: Column | int, *groups: str, step: int = COVERAGE_STEP,
                digits: int = 3) -> DataFrame:
    """(groups..., accuracy, auc, k90), accuracy and area rounded."""
    curve = coverage_curve(histogram, n_classes, *groups, step=step)
    joined = accuracy(histogram, *groups).join(curve_metrics(curve, *groups), list(groups))
    return joined.select(*groups, F.round("accuracy", digits).alias("accuracy"), F.round("auc", digits).alias("auc"), "k90")


def recall_table(ranks: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(label, number, num_correct, percent, rank) for every class of the dictionary.

    `percent` is NULL for a class without rows; classes are ranked by size, ties by name.
    """
    found = ranks.groupBy("label_idx").agg(
        F.count(F.lit(1)).alias("number"),
        F.count_if(F.col("predicted") == F.col("label_idx")).alias("num_correct"),
    )
    none = F.lit(0).cast("bigint")
    counted = dictionary.join(found, "label_idx", "left").select(
        "label", F.coalesce("number", none).alias("number"), F.coalesce("num_correct", none).alias("num_correct")
    )
    by_size = Window.orderBy(F.desc("number"), "label")  # one row per class
    return counted.withColumn("percent", F.try_divide("num_correct", "number")).withColumn(
        "rank", F.row_number().over(by_size)
    )


def bootstrap_histogram(histogram: DataFrame, resamples: int, *groups: str, n_draws: int | None = None,
                        seed: int = 0, draw: Callable[[int, np.ndarray, int], np.ndarray] | None = None) -> DataFrame:
    """(groups..., b, true_rank, n): draws with replacement from the rank histogram.

    Drawing rows and counting their ranks is one multinomial draw, so the cost is resamples x classes,
    independent of the number of scored rows. With `draw`, position draw(b, i, n) of the n rows in
    order of true rank is the i-th one taken (for draws that other engines can repeat); that costs
    resamples x draws. Resamples spread over tasks: their number is given, or the few bytes of the
    histograms would be put into one task.
    """
    tasks = min(resamples, 4 * histogram.sparkSession.sparkContext.defaultParallelism)
    packed = histogram.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("true_rank", "n"))).alias("__bars")  # one entry per class
    )
    trials = (
        packed.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(resamples))))
        .repartition(tasks, "b")
        .withColumn("__ns", F.transform("__bars", lambda bar: bar["n"]))
    )

    def repeated(b: int, n: np.ndarray, size: int) -> np.ndarray:
        ends, counts = n.cumsum(), np.zeros(len(n), dtype="int64")
        for start in range(0, size, DRAWS_AT_ONCE):
            rows = draw(b, np.arange(start, min(start + DRAWS_AT_ONCE, size)), int(ends[-1]))
            counts += np.bincount(np.searchsorted(ends, rows, side="right"), minlength=len(n))
        return counts

    @F.pandas_udf("array<bigint>")
    def multinomial(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for numbers, counts in batches:
            drawn = []
            for b, n in zip(numbers, counts):
                n = np.asarray(n, dtype="int64")
                size = int(n.sum()) if n_draws is None else n_draws
                if draw is None:
                    drawn.append(np.random.default_rng((seed, int(b))).multinomial(size, n / n.sum()))
                else:
                    drawn.append(repeated(int(b), n, size))
            yield pd.Series(drawn, index=numbers.index, dtype="object")

    drawn = trials.withColumn("__drawn", multinomial("b", "__ns"))
    bars = F.arrays_zip(F.transform("__bars", lambda bar: bar["true_rank"]).alias("true_rank"), F.col("__drawn").alias("n"))
    counts = (
        drawn.select(*groups, "b", F.explode(bars).alias("bar"))
        .select(*groups, "b", F.col("bar")["true_rank"].alias("true_rank"), F.col("bar")["n"].alias("n"))
        .filter(F.col("n") > 0)
    )
    return stage(counts, "resampled-histograms")


def metric_rows(table: DataFrame, *keys: str) -> DataFrame:
    """(keys..., metric, value) from a performance table."""
    doubles = table.select(*keys, *[F.col(m).cast("double").alias(m) for m in ("accuracy", "auc", "k90")])
    return doubles.unpivot(list(keys), ["accuracy", "auc", "k90"], "metric", "value")


def sorted_differences(values: DataFrame, *groups: str) -> DataFrame:
    """(groups..., b, difference): resample minus estimate (b = 0), smallest first per group."""
    estimate = values.filter(F.col("b") == 0).select(*groups, F.col("value").alias("__estimate"))
    return (
        values.filter(F.col("b") > 0)
        .join(broadcast_if_small(stage(estimate, "estimates")), list(groups))
        .select(*groups, "b", (F.col("value") - F.col("__estimate")).alias("difference"))
        .orderBy(*groups, "difference", "b")
    )


def intervals(values: DataFrame, *groups: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """(groups..., estimate, lower, upper): basic bootstrap interval per group.

    The interval is estimate minus the high and low quantiles of (resample - estimate). Quantiles
    shift with the data, so one aggregate over the resamples gives both ends.
    """
    resample = F.when(F.col("b") > 0, F.col("value"))
    grouped = values.groupBy(*groups).agg(
        F.max(F.when(F.col("b") == 0, F.col("value"))).alias("estimate"),
        F.percentile(resample, F.array(F.lit(low), F.lit(high))).alias("__q"),
    )
    return grouped.select(
        *groups,
        "estimate",
        (2 * F.col("estimate") - F.col("__q")[1]).alias("lower"),
        (2 * F.col("estimate") - F.col("__q")[0]).alias("upper"),
    )
