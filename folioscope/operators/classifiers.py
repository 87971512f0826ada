"""Text and vector classifiers, batch scoring and feature projection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioscope.functions.vectors import as_double, concat_features
from folioscope.operators.row_index import with_row_index
from folioscope.operators.scoring import (
    CHUNK_VALUES, Blocks, Scorer, all_probabilities, all_scores, flat_lists, row_ranges, shares, term_block, term_scores,
)
from folioscope.runtime import new_path, ship, stage

ship(__name__)

# Weights of one block of classes, held by a worker at a time: 64 MB of doubles.
BLOCK_CELLS = 8_000_000
# Classes that are scored between two looks at the bound.
NORM_STEP = 128


@dataclass(frozen=True)
class NaiveBayes:
    """Multinomial naive Bayes as counts: (label_idx, fold, docs, words) and (label_idx, idx, fold, n).

    With folds 1..n_folds the same counts hold n_folds more models, each without the rows of its fold.
    """

    classes: DataFrame
    counts: DataFrame
    n_classes: int
    width: int
    smoothing: float
    n_folds: int = 0


def fit_naive_bayes(train: DataFrame, label_col: str, n_classes: int, width: int, sequence_col: str = "sequence",
                    smoothing: float = 1.0, fold: Column | None = None, n_folds: int = 0) -> NaiveBayes:
    """Counts of word indices 1..width by class; a class without training rows keeps its slot.

    With `fold` (0..n_folds-1) the counts are kept by fold, which is all that cross-fitting needs: one
    pass over the training rows whatever the number of folds.
    """
    label = F.col(label_col).cast("int").alias("label_idx")
    part = (F.lit(0) if fold is None else fold.cast("int") + 1).alias("fold")
    rows = train.filter(F.col(label_col).isNotNull()).select(label, part, F.col(sequence_col).alias("sequence"))
    classes = rows.groupBy("label_idx", "fold").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("sequence").cast("bigint")).alias("words"))
    counts = rows.select("label_idx", "fold", F.explode("sequence").alias("idx")).groupBy("label_idx", "idx", "fold").agg(
        F.count(F.lit(1)).alias("n"))
    return NaiveBayes(stage(classes, "class-sizes"), stage(counts, "class-words"), n_classes, width, smoothing, n_folds)


def class_ranges(sizes: dict[int, int], n_classes: int, cells: int) -> list[tuple[int, int]]:
    """Consecutive classes with about `cells` weights each; `sizes` are the weights of the classes that have any."""
    ranges, first, held = [], 0, 0
    for c in range(n_classes):
        own = sizes.get(c, 0) + 1
        if held and held + own > cells:
            ranges.append((first, c))
            first, held = c, 0
        held += own
    return [*ranges, (first, n_classes)] if n_classes else []


def naive_bayes_scorer(model: NaiveBayes, sequence: Column, fold: Column | None = None) -> Scorer:
    """Log prior plus log likelihoods; rows of a fold (0..n_folds-1, else NULL) are scored without it.

    Only words a class has seen have a weight, so blocks hold as many cells as there are counts. A class
    without training rows scores as one with no documents and no words; its prior is the smoothing alone.
    """
    context = model.classes.sparkSession.sparkContext
    models, n_classes, width = model.n_folds + 1, model.n_classes, model.width
    table = model.classes.toArrow()  # one row per class and fold
    label, part = table["label_idx"].to_numpy(), table["fold"].to_numpy()
    docs, words = np.zeros((models, n_classes)), np.zeros((models, n_classes))
    for out, name in ((docs, "docs"), (words, "words")):
        np.add.at(out[0], label, table[name].to_numpy())
        out[1:] = out[0]
        np.subtract.at(out[1:], (part[part > 0] - 1, label[part > 0]), table[name].to_numpy()[part > 0])
    per_class = {r.label_idx: r.n * models for r in model.counts.groupBy("label_idx").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for a, b in class_ranges(per_class, n_classes, BLOCK_CELLS):
        cells = model.counts.filter(F.col("label_idx").between(a, b - 1)).toArrow()  # about BLOCK_CELLS / models rows
        block = term_block(
            models, width, model.smoothing, docs[:, a:b], words[:, a:b], docs.sum(axis=1), n_classes,
            cells["label_idx"].to_numpy() - a, *(cells[c].to_numpy() for c in ("idx", "fold", "n")))
        parts.append((a, b, context.broadcast(block)))
    blocks = Blocks(parts)

    def scores(arrays: list[pa.Array]) -> np.ndarray:
        words, lengths = flat_lists(arrays[0])
        number = arrays[1].to_numpy(zero_copy_only=False)
        out = np.empty((len(lengths), n_classes))
        for a, b, block in blocks.each():
            for own in np.unique(number):
                mine = number == own
                out[mine, a:b] = term_scores(block, words[np.repeat(mine, lengths)], lengths[mine], int(own))
        return out

    number = F.lit(0) if fold is None else F.coalesce(fold.cast("int") + 1, F.lit(0))
    return Scorer([sequence, number], n_classes, scores)


def score_naive_bayes(model: NaiveBayes, df: DataFrame, sequence_col: str = "sequence", fold: Column | None = None) -> DataFrame:
    """Add `scores` (log prior plus log likelihoods) and `probabilities`, both n_classes long, in one pass.

    For many classes take `best_classes` instead, which leaves the scores inside the task.
    """
    scored = df.withColumn("scores", all_scores(naive_bayes_scorer(model, F.col(sequence_col), fold)))
    return scored.withColumn("probabilities", softmax(F.col("scores")))


def softmax(scores: Column) -> Column:
    """Probabilities of log scores, row by row in Arrow batches."""

    @F.arrow_udf("array<double>")
    def probabilities(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            values = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            yield pa.ListArray.from_arrays(lists.offsets, pa.array(shares(values).ravel()))

    return probabilities(scores)


def term_features(sequences: DataFrame, width: int, sequence_col: str = "sequence") -> DataFrame:
    """Add `features`, sparse counts of the word indices 1..width, for MLlib models.

    The rows are written with their counts, in the form MLlib keeps a vector in, and read back as vectors, so that a model
    that goes over them several times does not count again.
    """
    udt = VectorUDT()

    @F.arrow_udf(udt.sqlType())
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            for a, b in row_ranges(lists, CHUNK_VALUES):
                part = lists.slice(a, b - a)
                lengths = flat_lists(part)[1]
                words = pc.fill_null(part.flatten(), 0).to_numpy(zero_copy_only=False).astype(np.int64)
                row = np.repeat(np.arange(len(part)), lengths)
                known = (words >= 1) & (words <= width)
                cells, n = np.unique(row[known] * width + words[known] - 1, return_counts=True)
                ends = np.searchsorted(cells, np.arange(len(part) + 1) * width).astype(np.int32)
                columns = {
                    "type": pa.array(np.zeros(len(part), dtype=np.int8)), "size": pa.array(np.full(len(part), width, dtype=np.int32)),
                    "indices": pa.ListArray.from_arrays(ends, pa.array((cells % max(width, 1)).astype(np.int32))),
                    "values": pa.ListArray.from_arrays(ends, pa.array(n.astype(np.float64)))}
                yield pa.StructArray.from_arrays(list(columns.values()), names=list(columns))

    spark, path = sequences.sparkSession, new_path(sequences.sparkSession, "term-features")
    sequences.withColumn("features", counted(F.col(sequence_col))).write.parquet(path)
    fields = [field for field in sequences.schema.fields if field.name != "features"]
    return spark.read.schema(StructType([*fields, StructField("features", udt)])).parquet(path)


def fit_softmax(train: DataFrame, label_col: str, features_col: str = "features", max_iter: int = 100, reg: float = 1e-4):
    """Multinomial logistic regression, the discriminative option. Stops at convergence."""
    return LogisticRegression(
        featuresCol=features_col, labelCol=label_col, family="multinomial", maxIter=max_iter, regParam=reg,
        predictionCol="__prediction", probabilityCol="__probability", rawPredictionCol="__raw",
    ).fit(train)


def score(model, df: DataFrame) -> DataFrame:
    """Add `scores` (unnormalised, for ranking) and `probabilities` of an MLlib model as ARRAY<DOUBLE> by class index."""
    return model.transform(df).withColumns(
        {"scores": vector_to_array("__raw"), "probabilities": vector_to_array("__probability")}
    ).drop("__raw", "__probability", "__prediction")


def fit_centroids(train: DataFrame, vector_col: str, label_col: str) -> DataFrame:
    """(label_idx, centroid): mean vector per class, combined before the shuffle."""
    return (
        train.groupBy(F.col(label_col).alias("label_idx"))
        .agg(Summarizer.mean(array_to_vector(as_double(F.col(vector_col)))).alias("__mean"))
        .select("label_idx", vector_to_array("__mean").alias("centroid"))
    )


def centroid_scorer(centroids: DataFrame, n_classes: int, vector: Column, width: int) -> Scorer:
    """Dot product with every class centroid; a class without centroid scores -inf, behind all others."""
    context = centroids.sparkSession.sparkContext
    table = stage(centroids, "centroids")
    step = max(1, BLOCK_CELLS // max(width, 1))
    parts = []
    for a in range(0, n_classes, step):
        b = min(a + step, n_classes)
        known = table.filter(F.col("label_idx").between(a, b - 1)).toArrow()  # at most b - a rows
        matrix, missing = np.zeros((b - a, width)), np.ones(b - a, dtype=bool)
        at = known["label_idx"].to_numpy() - a
        if len(at):
            matrix[at] = known["centroid"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            missing[at] = False
        parts.append((a, b, context.broadcast((matrix.T, missing))))
    blocks = Blocks(parts)

    def scores(arrays: list[pa.Array]) -> np.ndarray:
        rows = flat_lists(arrays[0])[0].reshape(len(arrays[0]), -1)
        out = np.empty((len(rows), n_classes))
        for a, b, (weights, missing) in blocks.each():
            out[:, a:b] = rows @ weights
            out[:, a:b][:, missing] = -np.inf
        return out

    return Scorer([as_double(vector)], n_classes, scores)


def score_centroids(df: DataFrame, centroids: DataFrame, n_classes: int, vector_col: str,
                    out_col: str = "scores") -> DataFrame:
    """Add the dot product with every class centroid as ARRAY<DOUBLE> by class index, in one pass.

    Vectors must be present and of equal width.
    """
    first = df.select(F.size(vector_col)).head(1)
    width = first[0][0] if first else 0
    return df.withColumn(out_col, all_scores(centroid_scorer(centroids, n_classes, F.col(vector_col), width)))


def bounded_best_classes(df: DataFrame, centroids: DataFrame, n_classes: int, vector_col: str, k: int, counter=None) -> DataFrame:
    """Add `best`, the k best classes by dot product as (class_idx, score), without scoring all classes.

    Centroids are taken in the order of falling length, NORM_STEP at a time. No product exceeds the
    product of both lengths, so a row is done once that bound is below its k-th score so far. Ties go to
    the lower class; classes without centroid come last, at -inf. `counter` (an accumulator) adds up the
    rows that met each step. Vectors must be present and of equal width.
    """
    context = df.sparkSession.sparkContext
    length = F.sqrt(F.aggregate("centroid", F.lit(0.0), lambda total, x: total + x * x))
    ordered = with_row_index(centroids.withColumn("length", length), F.desc("length"), F.asc("label_idx"), name="no")
    ordered = stage(ordered, "centroids-by-length")
    first = df.select(F.size(vector_col)).head(1)
    known = {r.label_idx for r in ordered.select("label_idx").collect()}  # one row per class
    rest = np.array([c for c in range(n_classes) if c not in known][:k], dtype=np.int64)
    size, parts = max(1, BLOCK_CELLS // max(first[0][0] if first else 0, 1)), []
    for a in range(0, len(known), size):
        block = ordered.filter(F.col("no").between(a, a + size - 1)).sort("no").toArrow()  # at most BLOCK_CELLS weights
        weights = np.array(block["centroid"].to_pylist(), dtype=np.float64)
        parts.append((a, a + len(weights), context.broadcast((weights, block["length"].to_numpy(), block["label_idx"].to_numpy()))))
    blocks, step, most = Blocks(parts), NORM_STEP, min(k, n_classes)

    def best(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.sqrt((x * x).sum(axis=1))
        scores = np.full((len(x), most + len(rest)), -np.inf)
        labels = np.full(scores.shape, n_classes, dtype=np.int64)
        labels[:, most:] = rest
        open_ = np.arange(len(x))
        for _, _, (weights, lengths, names) in blocks.each():
            for at in range(0, len(names), step):
                # A little over the bound, for rounding.
                open_ = open_[own[open_] * lengths[at] * (1 + 1e-9) >= scores[open_, most - 1]]
                if not len(open_):
                    break
                if counter is not None:
                    counter.add(len(open_))
                found = x[open_] @ weights[at:at + step].T
                every = np.hstack((scores[open_], found))
                whose = np.hstack((labels[open_], np.broadcast_to(names[at:at + step], found.shape)))
                order = np.lexsort((whose, -every), axis=-1)[:, :scores.shape[1]]
                scores[open_], labels[open_] = np.take_along_axis(every, order, axis=1), np.take_along_axis(whose, order, axis=1)
        return labels[:, :most], scores[:, :most]

    @F.arrow_udf("array<struct<class_idx: int, score: double>>")
    def ranked(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for vectors in batches:
            x = flat_lists(vectors)[0].reshape(len(vectors), -1)
            found = [best(x[at:at + 4096]) for at in range(0, len(x), 4096)] if most and len(x) else []
            cells = [np.concatenate([f[side].ravel() for f in found]) if found else np.empty(0) for side in (0, 1)]
            ends = pa.array(np.arange(len(vectors) + 1, dtype="int32") * (most if found else 0))
            yield pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                [pa.array(cells[0].astype(np.int32)), pa.array(cells[1], pa.float64())], names=["class_idx", "score"]))

    return df.withColumn("best", ranked(as_double(F.col(vector_col))))


def class_rows(scored: DataFrame, *keys: str, scores_col: str = "scores", value: str = "score") -> DataFrame:
    """Long form: one row per key and class that has a score."""
    rows = scored.select(*keys, F.posexplode(scores_col).alias("class_idx", value))
    return rows.filter(F.col(value) > F.lit(float("-inf")))


def multi_task(features: DataFrame, train: Column, tasks: dict[str, tuple[str, int]], width: int, id_col: str) -> DataFrame:
    """(task, id, class_idx, prob): one classifier per target, all scored in one pass over the shared feature table.

    `tasks` maps task name to (label-index column, number of classes); rows without a label are
    scored but not fitted.
    """
    tables = []
    for task, (label_col, n_classes) in tasks.items():
        model = fit_naive_bayes(features.filter(train), label_col, n_classes, width)
        probabilities = all_probabilities(naive_bayes_scorer(model, F.col("sequence")))
        tables.append(F.struct(F.lit(task).alias("task"), probabilities.alias("probabilities")))
    rows = features.select(id_col, F.explode(F.array(*tables)).alias("__t"))
    return rows.select("__t.task", id_col, F.posexplode("__t.probabilities").alias("class_idx", "prob"))


def stacked_vectors(base: DataFrame, extras: list[DataFrame], id_col: str, vector_col: str = "vector") -> DataFrame:
    """Feature vectors joined by id and laid side by side."""
    joined = base.select(id_col, F.col(vector_col).alias("__v0"))
    for number, extra in enumerate(extras, start=1):
        joined = joined.join(extra.select(id_col, F.col(vector_col).alias(f"__v{number}")), id_col)
    columns = [F.col(f"__v{number}") for number in range(len(extras) + 1)]
    return joined.select(id_col, concat_features(*columns).alias(vector_col))
