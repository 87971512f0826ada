"""Dictionary, ranking and split queries (W, J9, F8)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.vectors import argmax, concat_features, one_hot, ranked_classes, top_k
from folioscope.operators import sketches, splits
from folioscope.operators.relational import top_n
from folioscope.operators.vocabulary import fit_vocabulary, label_dictionary
from folioscope.plans import sql
from folioscope.plans.registry import query
from folioscope.plans.tables import load, texts
from folioscope.runtime import stage

_SCORES = """cells AS (SELECT vec_id, label, unnest(embedding) AS p, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS class_idx
  FROM embeddings),
placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, class_idx) AS INTEGER) AS rank FROM cells)"""


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector components taken as class scores."""
    return load(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").alias("scores"))


@query("w1_label_encoding", """
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS label_idx FROM (SELECT DISTINCT source AS label FROM documents)""")
def label_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_dictionary(load(spark, sf_dir, "documents"), "source")


@query("w2_vocabulary_index", sql.with_(sql.TOKENS, sql.vocabulary(), body="SELECT word, n, idx FROM vocab"))
def vocabulary_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit_vocabulary(texts(spark, sf_dir))


@query("w3_top_journals", """
SELECT source, n, CAST(row_number() OVER (ORDER BY n DESC, source) AS INTEGER) AS sort_order
FROM (SELECT source, count(*) AS n FROM documents GROUP BY source) ORDER BY n DESC, source LIMIT 5""")
def top_journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five most popular journals with their chart order."""
    return top_n(load(spark, sf_dir, "documents"), "source", 5)


@query("w3_top_words", sql.with_(sql.TOKENS, body="""
SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, word) AS INTEGER) AS sort_order
FROM (SELECT word, count(*) AS n FROM tok GROUP BY word) ORDER BY n DESC, word LIMIT 100"""))
def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from folioscope.functions.text import tokens

    words = texts(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("word"))
    return top_n(words, "word", 100)


@query("w3_frequent_words", sql.with_(sql.TOKENS, body="""
SELECT word, count(*) AS n, true AS found, true AS within FROM tok GROUP BY word HAVING count(*) * 200 >= (SELECT count(*) FROM tok)"""))
def frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that make up at least 0.5 % of all words: the summary finds each and bounds its count."""
    from folioscope.functions.text import tokens

    words = texts(spark, sf_dir).select(F.explode(tokens(F.col("text"))).alias("word"))
    summary = stage(sketches.merge_frequent(sketches.frequent_summaries(words, "word")), "frequent-words")
    counts = stage(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")), "word-counts")
    least = F.col("n") * 200 >= counts.agg(F.sum("n")).scalar()
    found = sketches.frequent_values(summary, 1).withColumnRenamed("value", "word")
    return counts.filter(least).join(found, "word", "left").select(
        "word", "n", F.col("low").isNotNull().alias("found"),
        F.coalesce(F.col("n").between(F.col("low"), F.col("high")), F.lit(False)).alias("within"))


@query("w5_positional_split", sql.with_(sql.split("documents", "doc_id", 300), body="SELECT doc_id, chunk, split FROM splits"))
def positional_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id")
    return splits.positional_split(docs, "doc_id", chunk_rows=300)


@query("w5_positional_split_lines", sql.with_(
    "keyed AS (SELECT l_orderkey * 8 + l_linenumber AS line_id, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem)",
    "numbered AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM keyed)",
    sql.split("numbered", "rn"),
    body="SELECT chunk, split, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS order_sum FROM splits JOIN numbered USING (rn) GROUP BY chunk, split"))
def positional_split_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default chunk size on the largest table, ordered by several columns."""
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = splits.positional_split(load(spark, sf_dir, "lineitem").select(*keys), *keys)
    return lines.groupBy("chunk", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("order_sum"))


@query("w6_shuffle", "SELECT doc_id, lang, source FROM documents")
def shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.shuffle_rows(load(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", seed=7)


@query("w7_hash_split", """
SELECT doc_id, CASE b WHEN 0 THEN 'dev' WHEN 1 THEN 'test' ELSE 'train' END AS split
FROM (SELECT doc_id, CAST('0x' || substr(md5(doc_id || ':0'), 1, 8) AS BIGINT) % 10 AS b FROM documents)""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.hash_split(load(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query("w8_rank_classes", sql.with_(_SCORES, body="SELECT vec_id, rank, class_idx FROM placed"))
def rank_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _scores(spark, sf_dir).select("vec_id", F.posexplode(ranked_classes(F.col("scores"))).alias("pos", "class_idx"))
    return ranked.select("vec_id", (F.col("pos") + 1).alias("rank"), "class_idx")


@query("w9_argmax", sql.with_(_SCORES, body="SELECT vec_id, class_idx AS predicted FROM placed WHERE rank = 1"))
def best_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scores(spark, sf_dir).select("vec_id", argmax(F.col("scores")).alias("predicted"))


@query("w10_top_k", sql.with_(_SCORES, body="""
SELECT vec_id, string_agg(class_idx, ',' ORDER BY rank) AS best FROM placed WHERE rank <= 10 GROUP BY vec_id"""))
def best_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = F.transform(top_k(F.col("scores"), 10), lambda c: c.cast("string"))
    return _scores(spark, sf_dir).select("vec_id", F.array_join(best, ",").alias("best"))


@query("j9_feature_concat", """
SELECT vec_id, CAST(generate_subscripts(f, 1) - 1 AS INTEGER) AS dim, round(unnest(f), 6) AS value
FROM (SELECT vec_id, list_concat(CAST(embedding AS DOUBLE[]), [CAST(label AS DOUBLE), CAST(vec_id AS DOUBLE) / 4]) AS f FROM embeddings)""")
def feature_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    left = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("a"))
    right = vectors.select("vec_id", F.array(F.col("label").cast("double"), F.col("vec_id").cast("double") / 4).alias("b"))
    joined = left.join(right, "vec_id").select("vec_id", F.posexplode(concat_features(F.col("a"), F.col("b"))).alias("dim", "value"))
    return joined.withColumn("value", F.round("value", 6))


@query("f8_one_hot", """
SELECT vec_id, class_idx, CASE WHEN class_idx = label THEN 1 ELSE 0 END AS hot
FROM embeddings CROSS JOIN (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS class_idx)""")
def one_hot_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings")
    return vectors.select("vec_id", F.posexplode(one_hot(F.col("label"), 10)).alias("class_idx", "hot"))
