"""Train / dev / test assignment and shuffling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.row_index import with_row_index
from folioscope.runtime import stage

# Rows per chunk and shares of each chunk that go to dev and test.
CHUNK_ROWS = 50_000
DEV_SHARE = 0.1
TEST_SHARE = 0.1
# Most key ranges a task may hold: 16 bytes each, three per chunk.
MAX_BOUNDS = 4_000_000


def _placed(df: DataFrame, order_cols, chunk_rows: int, dev_share: float, test_share: float) -> DataFrame:
    """Rows with `chunk`, `split` and `starts`, which marks the first row of every run of one split.

    Chunk sizes follow from the row count alone, so no window over the chunk is needed.
    """
    indexed = with_row_index(df, *order_cols)
    total = indexed.agg(F.count(F.lit(1))).scalar()
    chunk = F.floor(F.col("row_idx") / chunk_rows)
    pos = F.col("row_idx") % chunk_rows
    size = F.least(F.lit(chunk_rows).cast("bigint"), total - chunk * chunk_rows)
    n_dev = F.bround(size * F.lit(dev_share), 0)
    n_test = F.bround(size * F.lit(test_share), 0)
    return indexed.withColumns({
        "chunk": chunk,
        "split": F.when(pos < n_dev, "dev").when(pos < n_dev + n_test, "test").otherwise("train"),
        "starts": (pos == 0) | (pos == n_dev) | (pos == n_dev + n_test),
    })


def positional_split(
    df: DataFrame,
    *order_cols,
    chunk_rows: int = CHUNK_ROWS,
    dev_share: float = DEV_SHARE,
    test_share: float = TEST_SHARE,
) -> DataFrame:
    """Add `chunk` and `split`: in every chunk of consecutive rows the first share is dev, the next test.

    The rows given are sorted and staged; for wide rows use `split_by_key`.
    """
    return _placed(df, order_cols, chunk_rows, dev_share, test_share).drop("starts", "row_idx")


def split_by_key(
    df: DataFrame,
    key: str,
    chunk_rows: int = CHUNK_ROWS,
    dev_share: float = DEV_SHARE,
    test_share: float = TEST_SHARE,
    max_bounds: int = MAX_BOUNDS,
) -> DataFrame:
    """`positional_split` in the order of one unique integer key, without moving the rows of `df`.

    Only the keys are sorted. Each run of one split is a key range (three per chunk), so the
    split is found by binary search among the range starts; with too many ranges the keys are
    joined back instead, to the same effect: all rows of a repeated key go where the last of them
    falls, NULL keys count as one key before all others.
    """
    placed = _placed(df.select(key), [F.asc_nulls_first(key)], chunk_rows, dev_share, test_share)
    bounds = stage(placed.filter("starts").select(key, "split", "chunk"), "split-bounds")
    if bounds.count() > max_bounds:
        last = stage(placed.groupBy(key).agg(F.max_by("split", "row_idx").alias("split")), "split-keys")
        return df.join(last.withColumnRenamed(key, "__key"), F.col(key).eqNullSafe(F.col("__key"))).drop("__key")
    names = ["train", "dev", "test"]
    # Of several runs that begin at one key the last one counts; within a chunk dev comes first, train last.
    ordered = bounds.withColumn("__code", F.array_position(F.lit(["dev", "test", "train"]), F.col("split")))
    table = ordered.orderBy(F.asc_nulls_first(key), "chunk", "__code").select(key, "split").toArrow()
    codes = np.array([names.index(name) for name in table["split"].to_pylist()], dtype="int32")
    starts = table[key].drop_null().to_numpy()
    nulls = len(codes) - len(starts)
    # Below the first start, and for NULL, the last run that began at NULL goes on.
    codes = np.concatenate((codes[max(nulls - 1, 0):nulls] if nulls else codes[:1], codes[nulls:]))
    shared = df.sparkSession.sparkContext.broadcast((starts, codes))

    @F.arrow_udf("int")
    def run_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        starts, splits = shared.value
        for keys in batches:
            at = np.zeros(len(keys), dtype="int64")
            known = np.flatnonzero(keys.is_valid().to_numpy(zero_copy_only=False))
            at[known] = np.searchsorted(starts, keys.drop_null().to_numpy(zero_copy_only=False), side="right")
            yield pa.array(splits[at])

    return df.withColumn("split", F.get(F.array(*[F.lit(n) for n in names]), run_of(F.col(key))))


def hash_bucket(key: Column, buckets: int, seed: int = 0) -> Column:
    """Repeatable bucket of a key that other engines can recompute."""
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % buckets


def hash_split(df: DataFrame, key_col: str, seed: int = 0, buckets: int = 10) -> DataFrame:
    """Add `split` from a hash of the key: the same 80/10/10 intent with no shuffle at all."""
    bucket = hash_bucket(F.col(key_col), buckets, seed)
    return df.withColumn("split", F.when(bucket == 0, "dev").when(bucket == 1, "test").otherwise("train"))


def shuffle_rows(df: DataFrame, key_col: str, seed: int = 0) -> DataFrame:
    """All rows in a repeatable random order."""
    return df.orderBy(F.xxhash64(F.col(key_col), F.lit(seed)), key_col)
