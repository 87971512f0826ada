"""Appends that can be run again: a table of batches with a log of those that are complete.

A batch is written to a folder of its own and then named in the log in one step; readers see the
folders the log names. A batch that is in the log is not written again, and what a failed run has left
is in no log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


LOG = "batch string, folder string, n bigint"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _files(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _entry(table: str, batch: str) -> str:
    return f"{table}/log/batch-{batch}.json"


def committed(spark: SparkSession, table: str, batch: str) -> bool:
    return _files(spark, table).exists(_path(spark, _entry(table, batch)))


def _commit(spark: SparkSession, table: str, batch: str, folder: str, n: int) -> bool:
    """Name the folder in the log; False if another run of the batch came first.

    The entry is written aside and moved: a move onto an entry that exists fails, so one run wins.
    """
    aside = f"{table}/aside/{uuid.uuid4().hex}"
    spark.createDataFrame([(batch, folder, n)], LOG).coalesce(1).write.json(aside)
    files = _files(spark, table)
    written = [f.getPath() for f in files.listStatus(_path(spark, aside)) if f.getPath().getName().endswith(".json")][0]
    files.mkdirs(_path(spark, f"{table}/log"))
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.valueOf("NONE")
    try:
        context.rename(written, _path(spark, _entry(table, batch)), options)
    except Exception:
        if committed(spark, table, batch):
            return False
        raise
    finally:
        files.delete(_path(spark, aside), True)
    return True


def append_batch(df: DataFrame, table: str, batch: str | int) -> bool:
    """Add the rows of `df` as batch `batch`, once; False if the batch is in the table already.

    Safe to run again after a failure at any point, and next to another run of the same batch.
    """
    spark, batch = df.sparkSession, str(batch)
    if committed(spark, table, batch):
        return False
    folder = f"data/batch-{batch}-{uuid.uuid4().hex}"
    df.write.parquet(f"{table}/{folder}")
    n = spark.read.schema(df.schema).parquet(f"{table}/{folder}").count()
    return _commit(spark, table, batch, folder, n)


def log_of(spark: SparkSession, table: str) -> DataFrame:
    """(batch, folder, n) of the complete batches."""
    if not _files(spark, table).exists(_path(spark, f"{table}/log")):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{table}/log")


def read_batches(spark: SparkSession, table: str, schema) -> DataFrame:
    """Rows of all complete batches."""
    folders = [r.folder for r in log_of(spark, table).select("folder").collect()]  # one row per batch
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{table}/{f}" for f in folders])


def remove_unfinished(spark: SparkSession, table: str) -> int:
    """Delete data folders no batch names; call it while no append runs."""
    named = {r.folder.rsplit("/", 1)[-1] for r in log_of(spark, table).collect()}
    files, data = _files(spark, table), _path(spark, f"{table}/data")
    left = [f.getPath() for f in files.listStatus(data) if f.getPath().getName() not in named] if files.exists(data) else []
    for path in left:
        files.delete(path, True)
    return len(left)


def run_logged_append(cleaned: DataFrame, table: str, checkpoint: str) -> None:
    """Append every micro-batch of a stream; a micro-batch that is replayed after a failure is not added twice."""
    def save(rows: DataFrame, epoch: int) -> None:
        append_batch(rows, table, epoch)

    (
        cleaned.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        .start().awaitTermination()
    )
