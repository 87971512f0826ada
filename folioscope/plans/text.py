"""Token, sequence and embedding queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import MAX_SEQUENCE_LENGTH, MAX_WORDS, tokens
from folioscope.functions.vectors import as_double, l2_normalise
from folioscope.operators import vocabulary as voc
from folioscope.operators.splits import split_by_key
from folioscope.plans import sql
from folioscope.plans.registry import query
from folioscope.plans.tables import load, texts
from folioscope.runtime import stage

WIDTH = 64


def word_vectors(spark: SparkSession, sf_dir: str, vocabulary: DataFrame) -> DataFrame:
    """Stand-in pretrained vectors: the i-th most frequent word has vector i - 1."""
    vectors = load(spark, sf_dir, "embeddings").select((F.col("vec_id") + 1).cast("int").alias("idx"), "embedding")
    return vocabulary.select("word", "idx").join(vectors, "idx").select("word", F.col("embedding").alias("vector"))


EMBEDDING_SQL = f"""
embtab AS (
  SELECT v.word, v.idx, dims.dim, coalesce(u.v, 0.0) AS value
  FROM (SELECT word, idx FROM vocab WHERE idx <= {MAX_WORDS}) v
  CROSS JOIN (SELECT unnest(range(1, {WIDTH + 1})) AS dim) dims
  LEFT JOIN (SELECT vec_id + 1 AS idx, dim, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM (
      SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings)) u
    ON u.idx = v.idx AND u.dim = dims.dim)"""


@query("f4_tokenise", sql.with_(sql.TOKENS, body="""
SELECT doc_id, count(*) AS n_words, md5(string_agg(word, ' ' ORDER BY pos)) AS words_md5 FROM tok GROUP BY doc_id"""))
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and fingerprint of the words of every text that has any; NULL texts and texts without words have no row."""
    words = texts(spark, sf_dir).select("doc_id", tokens(F.col("text")).alias("words"))
    return words.filter(F.size("words") > 0).select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"), F.md5(F.array_join("words", " ")).alias("words_md5")
    )


@query("a7_token_counts", sql.with_(sql.TOKENS, body="SELECT word, count(*) AS n FROM tok GROUP BY word"))
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.token_counts(texts(spark, sf_dir))


# Words and their ranks come from the training split alone.
VOCABULARY_SQL = ",\n".join([
    sql.TOKENS, sql.split("documents", "doc_id"),
    "train_tok AS (SELECT tok.* FROM tok JOIN splits USING (doc_id) WHERE split = 'train')", sql.vocabulary("train_tok")])


@query("m1_fit_vocabulary", sql.with_(VOCABULARY_SQL, body="SELECT word, n, idx FROM vocab"))
def fit_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabulary of the training split, saved as a table and read back."""
    train = split_by_key(texts(spark, sf_dir), "doc_id").filter(F.col("split") == "train")
    return stage(voc.fit_vocabulary(train), "vocabulary")


_SEQ = f"""seq AS (
  SELECT d.doc_id, coalesce(s.ids, []) AS ids
  FROM documents d LEFT JOIN (
    SELECT doc_id, list(idx ORDER BY pos) AS ids FROM tok JOIN vocab USING (word) WHERE idx < {MAX_WORDS} GROUP BY doc_id) s
  USING (doc_id))"""


def _seq_sql(body: str) -> str:
    return sql.with_(VOCABULARY_SQL, _SEQ, body=body)


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voc.text_sequences(texts(spark, sf_dir), fit_vocabulary(spark, sf_dir), MAX_WORDS)


def _joined(sequence: str):
    return F.array_join(F.transform(sequence, lambda i: i.cast("string")), ",")


@query("f5_text_sequences", _seq_sql("SELECT doc_id, len(ids) AS length, md5(list_aggregate(ids, 'string_agg', ',')) AS ids_md5 FROM seq"))
def text_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = sequences(spark, sf_dir)
    return ids.select(
        "doc_id", F.size("sequence").cast("bigint").alias("length"),
        F.when(F.size("sequence") > 0, F.md5(_joined("sequence"))).alias("ids_md5"),
    )


_PADDED = """SELECT doc_id, list_aggregate(CASE WHEN len(ids) >= {L} THEN list_slice(ids, len(ids) - {L} + 1, len(ids))
  ELSE list_concat(ids, list_resize(CAST([] AS INTEGER[]), {L} - len(ids), 0)) END, 'string_agg', ',') AS padded FROM seq"""


@query("f7_pad_truncate", _seq_sql(_PADDED.format(L=MAX_SEQUENCE_LENGTH)))
def pad_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = voc.padded_sequences(sequences(spark, sf_dir))
    return padded.select("doc_id", _joined("sequence").alias("padded"))


@query("m3_sequence_features", sql.with_(VOCABULARY_SQL, f"""seq AS (
  SELECT doc_id, list(idx ORDER BY pos) AS ids FROM tok JOIN vocab USING (word) WHERE idx < {MAX_WORDS} GROUP BY doc_id)""",
    "labels_ AS (SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx FROM documents)",
    body=f"""SELECT doc_id, label_idx, {MAX_SEQUENCE_LENGTH}::BIGINT AS length,
  CAST(coalesce(list_sum(list_slice(ids, greatest(len(ids) - {MAX_SEQUENCE_LENGTH} + 1, 1), len(ids))), 0) AS BIGINT) AS id_sum
FROM labels_ LEFT JOIN seq USING (doc_id)"""))
def sequence_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Padded sequence and journal label of every document."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    features = voc.padded_sequences(sequences(spark, sf_dir)).join(docs, "doc_id")
    coded = voc.encode_labels(features, voc.staged_label_dictionary(docs, "source"), "source")
    total = F.aggregate("sequence", F.lit(0).cast("bigint"), lambda s, i: s + i)
    return coded.select("doc_id", "label_idx", F.size("sequence").cast("bigint").alias("length"), total.alias("id_sum"))


@query("f6_l2_normalise", """
SELECT vec_id, dim, round(v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)), 6) AS value
FROM (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings)""")
def normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vector table scan with unit-length vectors."""
    unit = l2_normalise(as_double(F.col("embedding")))
    cells = load(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit).alias("dim", "value"))
    return cells.withColumn("value", F.round("value", 6))


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_table_of(spark, sf_dir, fit_vocabulary(spark, sf_dir))


def embedding_table_of(spark: SparkSession, sf_dir: str, vocabulary: DataFrame) -> DataFrame:
    vectors = word_vectors(spark, sf_dir, vocabulary)
    return stage(voc.embedding_table(vocabulary, vectors, WIDTH, MAX_WORDS), "embeddings")


@query("j7_default_zero_vector", sql.with_(VOCABULARY_SQL, EMBEDDING_SQL, body="""
SELECT word, idx, round(max(abs(value)), 6) AS largest, count(*) AS width, max(abs(value)) = 0 AS is_zero FROM embtab GROUP BY word, idx"""))
def default_zero_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    largest = F.array_max(F.transform("vector", lambda x: F.abs(x)))
    return embeddings(spark, sf_dir).select(
        "word", "idx", F.round(largest, 6).alias("largest"), F.size("vector").cast("bigint").alias("width"),
        (largest == 0).alias("is_zero"),
    )


@query("m2_embedding_table", sql.with_(VOCABULARY_SQL, EMBEDDING_SQL, body="""
SELECT idx, CAST(dim - 1 AS INTEGER) AS dim, round(value, 6) AS value FROM embtab WHERE value <> 0"""))
def embedding_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Non-zero cells of the embedding table."""
    cells = embeddings(spark, sf_dir).select("idx", F.posexplode("vector").alias("dim", "value"))
    return cells.filter(F.col("value") != 0).withColumn("value", F.round("value", 6))


@query("m4_document_vectors", sql.with_(VOCABULARY_SQL, EMBEDDING_SQL,
    "cnt AS (SELECT doc_id, word, count(*) AS c FROM tok GROUP BY doc_id, word)", body="""
SELECT doc_id, CAST(dim - 1 AS INTEGER) AS dim, round(coalesce(v, 0.0::DOUBLE), 6) AS value
FROM documents CROSS JOIN (SELECT DISTINCT dim FROM embtab)
LEFT JOIN (SELECT doc_id, dim, sum(c * value) / sum(c) AS v FROM cnt JOIN embtab USING (word) GROUP BY doc_id, dim) USING (doc_id, dim)"""))
def document_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voc.document_vectors(texts(spark, sf_dir), embeddings(spark, sf_dir), WIDTH)
    cells = vectors.select("doc_id", F.posexplode("vector").alias("dim", "value"))
    return cells.withColumn("value", F.round("value", 6))
