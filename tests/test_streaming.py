"""Streams over several files end in the same tables as batch runs."""

from pyspark.sql import functions as F

from folioscope.operators.vocabulary import fit_vocabulary, token_counts
from folioscope.plans import streams
from folioscope.runtime import new_path
from folioscope.streaming.incremental import (
    latest_vocabulary, latest_word_counts, run_append, run_vocabulary, run_word_counts, stream_table,
)


def test_word_counts_over_several_batches(spark, docs):
    source, out, state = (new_path(spark, n) for n in ("docs", "counts", "state"))
    docs.repartition(4).write.parquet(source)
    run_word_counts(stream_table(spark, source, docs.schema, max_files=1), out, state)
    docs.limit(3).write.mode("append").parquet(source)
    run_word_counts(stream_table(spark, source, docs.schema, max_files=1), out, state)
    everything = spark.read.parquet(source)
    assert everything.count() == 11
    got = {tuple(r) for r in latest_word_counts(spark, out).collect()}
    assert got == {tuple(r) for r in token_counts(everything).collect()}


def test_vocabulary_follows_the_batches(spark, docs):
    """Words of later batches, earlier first appearances and a restart."""
    source, out, state = (new_path(spark, n) for n in ("docs", "vocabulary", "state"))
    for part in ("doc_id > 5", "doc_id <= 5 AND doc_id > 1", "doc_id = 1"):
        docs.filter(part).repartition(2).write.mode("append").parquet(source)
        run_vocabulary(stream_table(spark, source, docs.schema, max_files=1), out, state)
        want = {tuple(r) for r in fit_vocabulary(spark.read.parquet(source)).collect()}
        assert {tuple(r) for r in latest_vocabulary(spark, out).collect()} == want


def test_append_continues_where_it_stopped(spark, docs):
    source, out, state = (new_path(spark, n) for n in ("docs", "clean", "state"))
    docs.repartition(3).write.parquet(source)

    def run():
        stream = stream_table(spark, source, docs.schema, max_files=1)
        run_append(stream.filter(F.length("text") > 0), out, state)

    run()
    run()
    assert spark.read.parquet(out).count() == 6
    docs.filter("doc_id = 7").write.mode("append").parquet(source)
    run()
    assert spark.read.parquet(out).count() == 7


def test_documents_may_be_a_folder_of_files(spark):
    """One table as one file and as a folder of several: the same rows reach the streams."""
    folder = new_path(spark, "tables")
    rows = [(i, f"word{i % 3} The cat", "en", f"src{i % 4}", 15) for i in range(1, 40)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars INT")
    docs.repartition(3).write.parquet(f"{folder}/documents.parquet")
    assert {tuple(r) for r in streams.incremental_counts(spark, folder).collect()} == {tuple(r) for r in token_counts(docs).collect()}
    assert streams.incremental_append(spark, folder).count() > 0


def test_vocabulary_batches_are_written_by_many_tasks(spark, monkeypatch):
    paths, folder = {}, new_path(spark, "tables")
    docs = spark.createDataFrame([(i, f"word{i % 5} the word{i}") for i in range(90)], "doc_id BIGINT, text STRING")
    docs.repartition(8).write.option("parquet.block.size", 1).parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(streams, "new_path", lambda spark, name: paths.setdefault(name, new_path(spark, name)))
    monkeypatch.setattr(streams, "load", lambda spark, d, name: spark.read.parquet(f"{d}/{name}.parquet").repartition(5))
    assert {tuple(r) for r in streams.incremental_vocabulary(spark, folder).collect()} == {tuple(r) for r in fit_vocabulary(docs).collect()}
    assert len(spark.read.parquet(paths["stream-docs"]).inputFiles()) > 3
