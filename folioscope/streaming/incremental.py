"""Incremental word counts and incremental cleaned appends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import tokens
from folioscope.operators.row_index import with_row_index


def stream_table(spark: SparkSession, path: str, schema, glob: str = "*.parquet", max_files: int = 100) -> DataFrame:
    """Parquet files of a folder as a stream, at most `max_files` per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", glob)
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def run_word_counts(docs: DataFrame, out: str, checkpoint: str, text_col: str = "text") -> None:
    """Keep running word counts; each micro-batch saves only the words whose count changed.

    The state holds one number per distinct word. A retried batch overwrites its own folder.
    """
    counts = docs.select(F.explode(tokens(F.col(text_col))).alias("word")).groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    (
        counts.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def latest_word_counts(spark: SparkSession, out: str) -> DataFrame:
    """Counts as of the last batch: they only grow, so the largest saved one is the latest."""
    saved = spark.read.schema("word STRING, n BIGINT, epoch INT").parquet(out)
    return saved.groupBy("word").agg(F.max("n").alias("n"))


def run_vocabulary(docs: DataFrame, out: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Keep count and first appearance of every word; each micro-batch saves only the words that changed.

    The state holds one row per distinct word; words are counted within a task first. A retried batch
    overwrites its own folder.
    """
    words = docs.select(F.col(id_col).alias("id"), F.posexplode(tokens(F.col(text_col))).alias("pos", "word"))
    state = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first_seen"))

    def save(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    (
        state.writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def latest_vocabulary(spark: SparkSession, out: str, id_type: str = "BIGINT") -> DataFrame:
    """(word, n, idx) as of the last batch: frequency rank, ties by first appearance.

    Counts only grow, so the saved row with the largest count is a word's latest.
    """
    schema = f"word STRING, n BIGINT, first_seen STRUCT<id: {id_type}, pos: INT>, epoch INT"
    saved = spark.read.schema(schema).parquet(out)
    latest = saved.groupBy("word").agg(F.max(F.struct("n", "epoch", "first_seen")).alias("s"))
    ranked = with_row_index(latest.select("word", "s.n", "s.first_seen"), F.desc("n"), F.asc("first_seen"))
    return ranked.select("word", "n", (F.col("row_idx") + 1).cast("int").alias("idx"))


def run_append(cleaned: DataFrame, out: str, checkpoint: str) -> None:
    """Append every micro-batch of a cleaned stream to a Parquet table, exactly once."""
    (
        cleaned.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
