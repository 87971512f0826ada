"""Expressions on ARRAY<DOUBLE> columns: norms, one-hot targets, class scores and ranks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def l2_normalise(vector: Column) -> Column:
    """Unit-length vector; a zero vector stays zero instead of turning into NaN."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(vector, lambda x: x / norm)).otherwise(vector)


def zero_vector(width: int) -> Column:
    return F.array_repeat(F.lit(0.0), width)


def one_hot(index: Column, width: int) -> Column:
    """0/1 array of explicit width; all zeros for a NULL index."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(width - 1)),
        lambda i: F.when(i == index, F.lit(1)).otherwise(F.lit(0)),
    )


def argmax(scores: Column) -> Column:
    """Index of the first largest score."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def ranked_classes(scores: Column) -> Column:
    """Class indices, best score first; ties go to the lower index."""
    keyed = F.transform(scores, lambda p, i: F.struct((-p).alias("key"), i.alias("class_idx")))
    return F.transform(F.array_sort(keyed), lambda s: s["class_idx"])


def top_k(scores: Column, k: int) -> Column:
    return F.slice(ranked_classes(scores), 1, k)


def true_rank(scores: Column, label_idx: Column) -> Column:
    """1-based rank of the true class among all classes, without sorting or shuffling."""
    own = F.get(scores, label_idx)
    ahead = F.filter(scores, lambda p, i: (p > own) | ((p == own) & (i < label_idx)))
    return F.when(own.isNotNull(), F.size(ahead) + 1).cast("int")


def concat_features(*vectors: Column) -> Column:
    return F.concat(*vectors)
