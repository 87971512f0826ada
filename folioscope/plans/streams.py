"""Streaming queries (T)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import relational as ops
from folioscope.plans import sql
from folioscope.plans.registry import query
from folioscope.plans.tables import article_fields_of, journals, load, numbered_factor
from folioscope.runtime import new_path
from folioscope.streaming.incremental import (
    latest_vocabulary, latest_word_counts, run_append, run_vocabulary, run_word_counts, stream_table,
)


def _document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table as a stream, be it one file or a folder of files: a pattern stands for both."""
    schema = load(spark, sf_dir, "documents").schema
    return stream_table(spark, f"{sf_dir}/documents.parque[t]", schema, glob="*")


@query("t1_incremental_counts", sql.with_(sql.TOKENS, body="SELECT word, count(*) AS n FROM tok GROUP BY word"))
def incremental_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = new_path(spark, "word-counts")
    run_word_counts(_document_stream(spark, sf_dir), out, new_path(spark, "word-counts-state"))
    return latest_word_counts(spark, out)


@query("t1_incremental_vocabulary", sql.with_(sql.TOKENS, sql.vocabulary(), body="SELECT word, n, idx FROM vocab"))
def incremental_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary index kept up to date over three batches of documents, with a restart before each but the first."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    source, out, state = (new_path(spark, name) for name in ("stream-docs", "vocabulary", "vocabulary-state"))
    for part in range(3):
        docs.filter(F.pmod("doc_id", F.lit(3)) == part).write.mode("append").parquet(source)
        run_vocabulary(stream_table(spark, source, docs.schema), out, state)
    return latest_vocabulary(spark, out)


@query("t2_incremental_append", sql.with_(sql.ARTICLES, body="""
SELECT a.pmid, lower(a.journal_abbrev) AS journal_abbrev, a.year, md5(a.abstract) AS abstract_md5, j.n AS journal_row,
  CASE WHEN j.n % 5 <> 0 THEN round(CAST(j.n AS DOUBLE) * CAST(0.9 AS DOUBLE) + CAST(0.5 AS DOUBLE), 3) END AS impact_factor
FROM articles a JOIN journals j ON lower(a.journal_abbrev) = lower(j.abbreviation)
WHERE a.pmid % 7 <> 0 AND a.year >= 2008 AND length(a.abstract) > 0 AND j.n % 7 <> 3"""))
def incremental_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each micro-batch of records is checked for required fields, age and text, gets the first matching
    journal with its impact factor, and is appended. The journal table lists every journal twice."""
    known = journals(spark, sf_dir).filter(~F.contains(F.lower("full_name"), F.lit("review"))).select(
        F.col("n").alias("journal_row"), "abbreviation", numbered_factor(F.col("n")).alias("impact_factor"))
    again = known.select(
        (F.col("journal_row") + 1000).alias("journal_row"), F.upper("abbreviation").alias("abbreviation"),
        F.lit(99.0).alias("impact_factor"))
    records = article_fields_of(_document_stream(spark, sf_dir))
    rows = ops.article_columns(ops.with_required_fields(records))
    good = rows.filter(ops.recent(F.col("year")) & (F.length("abstract") > 0))
    cleaned = ops.first_match_lookup(
        good, "journal_abbrev", known.unionByName(again), "abbreviation", ["journal_row"], ["journal_row", "impact_factor"])
    out = new_path(spark, "cleaned")
    run_append(cleaned, out, new_path(spark, "cleaned-state"))
    return spark.read.schema(cleaned.schema).parquet(out).select(
        "pmid", "journal_abbrev", "year", F.md5("abstract").alias("abstract_md5"), "journal_row",
        F.round("impact_factor", 3).alias("impact_factor"))
