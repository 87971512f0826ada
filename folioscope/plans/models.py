"""Classifier and projection queries."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.numeric import IMPACT_BAND_BOUNDS, impact_band
from folioscope.functions.text import MAX_WORDS
from folioscope.functions.vectors import argmax, as_double, concat_features, l2_normalise
from folioscope.operators import classifiers as clf
from folioscope.operators import evaluation as ev
from folioscope.operators import scoring
from folioscope.operators import training
from folioscope.operators.pca import fit_components, project
from folioscope.operators.scoring import flat_lists
from folioscope.operators import vocabulary as voc
from folioscope.operators.splits import split_by_key
from folioscope.plans import sql, text
from folioscope.plans.registry import query
from folioscope.plans.tables import articles, load, texts
from folioscope.runtime import ship, stage

ship(__name__)

BANDS = len(IMPACT_BAND_BOUNDS) + 1

# -- vector classifiers ------------------------------------------------------------------------


def split_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("label_idx"), "embedding")
    return split_by_key(vectors, "vec_id")


def n_vector_classes(spark: SparkSession, sf_dir: str) -> int:
    return load(spark, sf_dir, "embeddings").agg(F.max("label") + 1).first()[0]


def centroid_scores(rows: DataFrame, n_classes: int, vector_col: str) -> DataFrame:
    """Scores of all rows by the class centroids of the training rows."""
    train = rows.filter(F.col("split") == "train")
    return clf.score_centroids(rows, clf.fit_centroids(train, vector_col, "label_idx"), n_classes, vector_col)


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, split, label_idx, scores) of the plain centroid classifier."""
    rows = split_vectors(spark, sf_dir)
    return centroid_scores(rows, n_vector_classes(spark, sf_dir), "embedding")


def vector_model_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(model, vec_id, split, label_idx, predicted, true_rank) of three vector classifiers.

    'baseline' uses raw vectors, 'multitask' unit vectors, 'embedding' raw vectors with the
    baseline scores as additional features.
    """
    n_classes = n_vector_classes(spark, sf_dir)
    base = stage(centroid_scores(split_vectors(spark, sf_dir), n_classes, "embedding"), "scores")
    unit = base.drop("scores").withColumn("unit", l2_normalise(as_double(F.col("embedding"))))
    finite = F.transform("scores", lambda x: F.when(x > F.lit(float("-inf")), x).otherwise(F.lit(0.0)))
    stacked = base.select(
        "vec_id", "split", "label_idx", concat_features(as_double(F.col("embedding")), finite).alias("stacked")
    )
    scored = {
        "baseline": base,
        "multitask": centroid_scores(unit, n_classes, "unit"),
        "embedding": centroid_scores(stacked, n_classes, "stacked"),
    }
    parts = [ev.true_ranks(df, "vec_id", "split").withColumn("model", F.lit(name)) for name, df in scored.items()]
    return reduce(DataFrame.unionByName, parts)


@query("m7_centroid_scores", sql.with_(sql.VECTOR_MODELS, body="""
SELECT vec_id, split, CAST(c AS INTEGER) AS class_idx, round(s, 6) AS score FROM sb"""))
def centroid_scores_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every vector for every class."""
    long = clf.class_rows(vector_scores(spark, sf_dir), "vec_id", "split")
    return long.withColumn("score", F.round("score", 6))


@query("m10_recommendations", sql.with_(sql.VECTOR_MODELS, body="""
SELECT vec_id, CAST(r AS INTEGER) AS rank, CAST(c AS INTEGER) AS class_idx FROM ordered WHERE model = 'baseline' AND r <= 3"""))
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best classes of every item."""
    return ev.recommendations(vector_scores(spark, sf_dir), "vec_id", 3)


@query("m10_bounded_recommendations", sql.with_(sql.VECTOR_MODELS, body="""
SELECT vec_id, CAST(r AS INTEGER) AS rank, CAST(c AS INTEGER) AS class_idx FROM ordered WHERE model = 'baseline' AND r <= 3"""))
def bounded_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best classes of every item, classes by falling length until no other can reach them."""
    rows = split_vectors(spark, sf_dir)
    centroids = clf.fit_centroids(rows.filter(F.col("split") == "train"), "embedding", "label_idx")
    best = clf.bounded_best_classes(rows, centroids, n_vector_classes(spark, sf_dir), "embedding", 3)
    return scoring.recommended(best, "vec_id")


def nearest_scorer(spark: SparkSession, rows: DataFrame, n_classes: int) -> scoring.Scorer:
    """A scorer of the user's own: minus the squared distance to the mean vector of each class."""
    means = clf.fit_centroids(rows.filter(F.col("split") == "train"), "embedding", "label_idx").toArrow().to_pylist()  # one row per class
    table = {r["label_idx"]: np.array(r["centroid"]) for r in means}

    def scores(arrays: list[pa.Array]) -> np.ndarray:
        vectors = flat_lists(arrays[0])[0].reshape(len(arrays[0]), -1)
        out = np.full((len(vectors), n_classes), -np.inf)
        for c, mean in table.items():
            out[:, c] = -((vectors - mean) ** 2).sum(axis=1)
        return out

    return scoring.Scorer([as_double(F.col("embedding"))], n_classes, scores)


@query("m10_user_scorer", sql.with_(sql.VECTOR_MODELS, body="""
SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, c) AS INTEGER) AS rank, CAST(c AS INTEGER) AS class_idx,
  round(s, 6) AS score
FROM (SELECT v.vec_id, w.c, -sum((v.v - w.w) * (v.v - w.w)) AS s FROM base v JOIN cb w USING (dim) GROUP BY 1, 2)
QUALIFY rank <= 3"""))
def recommend_by_user_scorer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best classes by a scoring function the library does not know."""
    rows = split_vectors(spark, sf_dir)
    best = scoring.best_classes(rows, nearest_scorer(spark, rows, n_vector_classes(spark, sf_dir)), 3)
    return best.select("vec_id", F.posexplode("best").alias("pos", "cell")).select(
        "vec_id", (F.col("pos") + 1).alias("rank"), F.col("cell")["class_idx"].alias("class_idx"),
        F.round(F.col("cell")["score"], 6).alias("score"))


@query("m12_pca")
def pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First five principal components of all vectors; the largest loading of each is positive."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    projected = project(vectors, "embedding", fit_components(vectors, "embedding", 5))
    parts = [F.round(F.col("components")[i], 6).alias(f"pc{i + 1}") for i in range(5)]
    return projected.select("vec_id", "label", *parts)


@query("m12_pca_energy", """
WITH cells AS (SELECT vec_id, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS dim FROM embeddings),
centred AS (SELECT vec_id, dim, v - avg(v) OVER (PARTITION BY dim) AS v FROM cells)
SELECT vec_id, round(sum(v * v), 6) AS energy FROM centred GROUP BY vec_id""")
def pca_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared length of every vector along all components together: that of the centred vector."""
    vectors = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    projected = project(vectors, "embedding", fit_components(vectors, "embedding", width))
    energy = F.aggregate("components", F.lit(0.0), lambda s, x: s + x * x)
    return projected.select("vec_id", F.round(energy, 6).alias("energy"))


# -- text classifiers --------------------------------------------------------------------------


@dataclass(frozen=True)
class TextFeatures:
    """Word indices of all labelled articles under the training vocabulary, and the sizes of both dictionaries."""

    rows: DataFrame  # doc_id, split, topic_idx, band, journal_idx, sequence
    vocabulary: DataFrame
    width: int
    n_topics: int
    journals: DataFrame
    n_journals: int


def text_features(spark: SparkSession, sf_dir: str) -> TextFeatures:
    """Labels and splits are made on narrow rows; every text is tokenised twice, for the words and for their indices."""
    rows = articles(spark, sf_dir).select(
        F.col("pmid").alias("doc_id"), "category", "journal_abbrev", impact_band(F.col("impact_factor")).alias("band"))
    rows = stage(rows, "article-labels")
    topics, journals = (voc.staged_label_dictionary(rows, c) for c in ("category", "journal_abbrev"))
    coded = voc.encode_labels(rows, topics, "category", "topic_idx")
    coded = voc.encode_labels(coded, journals, "journal_abbrev", "journal_idx")
    coded = stage(split_by_key(coded.select("doc_id", "topic_idx", "band", "journal_idx"), "doc_id"), "labels")
    docs = texts(spark, sf_dir)
    train = docs.join(coded.filter(F.col("split") == "train").select("doc_id"), "doc_id", "left_semi")
    vocabulary = stage(voc.fit_vocabulary(train), "vocabulary")
    sequences = voc.text_sequences(docs, vocabulary, MAX_WORDS + 1)
    featured = stage(coded.join(sequences, "doc_id"), "features")
    width = vocabulary.filter(F.col("idx") <= MAX_WORDS).count()
    return TextFeatures(featured, vocabulary, width, topics.count(), journals, journals.count())


TEXT_SQL = ",\n".join([
    sql.ARTICLES, sql.TOKENS, sql.split("documents", "doc_id"),
    "train_tok AS (SELECT tok.* FROM tok JOIN splits USING (doc_id) WHERE split = 'train')",
    sql.vocabulary("train_tok"),
    f"top AS (SELECT word FROM vocab WHERE idx <= {MAX_WORDS})",
    "cnt AS (SELECT doc_id, word, count(*) AS c FROM tok JOIN top USING (word) GROUP BY doc_id, word)",
    f"""targets AS (
  SELECT pmid AS doc_id, split, CAST(dense_rank() OVER (ORDER BY category) - 1 AS INTEGER) AS topic_idx,
         CAST({sql.BAND} AS INTEGER) AS band, CAST(dense_rank() OVER (ORDER BY journal_abbrev) - 1 AS INTEGER) AS journal_idx
  FROM articles JOIN splits ON pmid = doc_id)""",
])


def naive_bayes_sql(label: str, name: str, n_classes: str) -> str:
    """CTEs ending in {name} (doc_id, split, y, c, raw, prob): multinomial naive Bayes in closed form.

    Classes without training rows take part with no documents and no words.
    """
    return f"""{name}_k AS (SELECT CAST({n_classes} AS DOUBLE) AS k, (SELECT count(*) FROM top) AS v,
  (SELECT count(*) FROM targets WHERE split = 'train' AND {label} IS NOT NULL) AS total),
{name}_y AS (SELECT CAST(unnest(range(0, (SELECT CAST(k AS BIGINT) FROM {name}_k))) AS INTEGER) AS y),
{name}_n AS (SELECT y, count(doc_id) AS docs FROM {name}_y LEFT JOIN (SELECT doc_id, {label} AS y FROM targets WHERE split = 'train') USING (y) GROUP BY y),
{name}_cw AS (SELECT {label} AS y, word, sum(c) AS c FROM cnt JOIN targets USING (doc_id)
  WHERE split = 'train' AND {label} IS NOT NULL GROUP BY 1, 2),
{name}_t AS (SELECT y, coalesce(sum(c), 0) AS c FROM {name}_y LEFT JOIN {name}_cw USING (y) GROUP BY y),
{name}_pi AS (SELECT y, ln(docs + 1.0::DOUBLE) - ln(total + k) AS pi FROM {name}_n CROSS JOIN {name}_k),
{name}_th AS (SELECT t.y, w.word, ln(coalesce(cw.c, 0) + 1.0::DOUBLE) - ln(t.c + CAST(v AS DOUBLE)) AS theta
  FROM {name}_t t CROSS JOIN top w CROSS JOIN {name}_k LEFT JOIN {name}_cw cw ON cw.y = t.y AND cw.word = w.word),
{name}_dw AS (SELECT doc_id, th.y, sum(cnt.c * theta) AS s FROM cnt JOIN {name}_th th USING (word) GROUP BY 1, 2),
{name}_raw AS (SELECT d.doc_id, d.split, d.{label} AS label_idx, p.y AS c, p.pi + coalesce(s, 0) AS raw
  FROM targets d CROSS JOIN {name}_pi p LEFT JOIN {name}_dw dw ON dw.doc_id = d.doc_id AND dw.y = p.y),
{name}_e AS (SELECT *, exp(raw - max(raw) OVER (PARTITION BY doc_id)) AS e FROM {name}_raw),
{name} AS (SELECT doc_id, split, label_idx, c, raw, e / sum(e) OVER (PARTITION BY doc_id) AS prob,
  row_number() OVER (PARTITION BY doc_id ORDER BY raw DESC, c) AS r FROM {name}_e)"""


_TOPIC_SQL = naive_bayes_sql("topic_idx", "nbt", "(SELECT count(DISTINCT lang) FROM documents)")
_BAND_SQL = naive_bayes_sql("band", "nbb", str(BANDS))
_JOURNAL_SQL = naive_bayes_sql("journal_idx", "nbj", "(SELECT count(DISTINCT source) FROM documents)")


def term_scores(features: TextFeatures, label_col: str, n_classes: int, rows: DataFrame | None = None) -> DataFrame:
    """Scores of all rows by naive Bayes on the training rows that have the label."""
    rows = features.rows if rows is None else rows
    model = clf.fit_naive_bayes(rows.filter(F.col("split") == "train"), label_col, n_classes, features.width)
    return clf.score_naive_bayes(model, rows)


def best_by_terms(features: TextFeatures, label_col: str, n_classes: int, k: int) -> DataFrame:
    """All rows with the k best classes of naive Bayes and the rank of the label; made for thousands of classes."""
    model = clf.fit_naive_bayes(features.rows.filter(F.col("split") == "train"), label_col, n_classes, features.width)
    return scoring.best_classes(features.rows, clf.naive_bayes_scorer(model, F.col("sequence")), k, label_col)


def _classified(scored: DataFrame, label_col: str) -> DataFrame:
    best = F.array_max("scores")
    return scored.select(
        "doc_id", "split", F.col(label_col).alias("label_idx"), argmax(F.col("scores")).alias("predicted"),
        F.round(best, 4).alias("score"),
    )


_BEST = "SELECT doc_id, split, label_idx, CAST(c AS INTEGER) AS predicted, round(raw, 4) AS score FROM {} WHERE r = 1"


@query("m5_topic_classifier", sql.with_(TEXT_SQL, _TOPIC_SQL, body=_BEST.format("nbt")))
def topic_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = text_features(spark, sf_dir)
    return _classified(term_scores(features, "topic_idx", features.n_topics), "topic_idx")


# The second topic is taken out of the training rows.
ABSENT_TOPIC = 1


@query("m5_missing_class", sql.with_(
    TEXT_SQL.replace("targets AS (", "all_targets AS ("),
    f"""targets AS (SELECT * REPLACE (CASE WHEN topic_idx = {ABSENT_TOPIC} AND split = 'train' THEN 'dev' ELSE split END AS split) FROM all_targets)""",
    _TOPIC_SQL, body=_BEST.format("nbt")))
def missing_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic classifier fitted without any row of one topic: the others keep their indices."""
    features = text_features(spark, sf_dir)
    moved = F.when((F.col("topic_idx") == ABSENT_TOPIC) & (F.col("split") == "train"), "dev").otherwise(F.col("split"))
    rows = features.rows.withColumn("split", moved)
    return _classified(term_scores(features, "topic_idx", features.n_topics, rows), "topic_idx")


@query("m5_softmax_topic")
def softmax_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multinomial logistic regression on the same words."""
    features = text_features(spark, sf_dir)
    rows = clf.term_features(features.rows.select("doc_id", "split", "topic_idx", "sequence"), features.width)
    model = clf.fit_softmax(rows.filter(F.col("split") == "train"), "topic_idx")
    return _classified(clf.score(model, rows), "topic_idx")


@query("m6_impact_band_classifier", sql.with_(TEXT_SQL, _BAND_SQL, body=_BEST.format("nbb")))
def impact_band_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classified(term_scores(text_features(spark, sf_dir), "band", BANDS), "band")


@query("m7_journal_classifier", sql.with_(TEXT_SQL, _JOURNAL_SQL, body=_BEST.format("nbj")))
def journal_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = text_features(spark, sf_dir)
    best = best_by_terms(features, "journal_idx", features.n_journals, 1)
    first = F.get("best", F.lit(0))
    return best.select(
        "doc_id", "split", F.col("journal_idx").alias("label_idx"), first["class_idx"].alias("predicted"),
        F.round(first["score"], 4).alias("score"))


@query("m7_journal_ranks", sql.with_(TEXT_SQL, _JOURNAL_SQL, body="""
SELECT doc_id, split, label_idx, CAST(r AS INTEGER) AS true_rank FROM nbj WHERE c = label_idx"""))
def journal_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of every article's journal among all journals."""
    features = text_features(spark, sf_dir)
    best = best_by_terms(features, "journal_idx", features.n_journals, 1)
    return best.select("doc_id", "split", F.col("journal_idx").alias("label_idx"), "true_rank")


@query("m10_journal_recommendations", sql.with_(TEXT_SQL, _JOURNAL_SQL, body="""
SELECT doc_id, CAST(r AS INTEGER) AS rank, source AS journal FROM nbj
JOIN (SELECT source, row_number() OVER (ORDER BY source) - 1 AS c FROM (SELECT DISTINCT source FROM documents)) USING (c) WHERE r <= 3"""))
def journal_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best journals, by name, for every abstract."""
    features = text_features(spark, sf_dir)
    best = scoring.recommended(best_by_terms(features, "journal_idx", features.n_journals, 3), "doc_id")
    return voc.decode_labels(best, features.journals, "class_idx", "journal").select("doc_id", "rank", "journal")


@query("m8_multi_task", sql.with_(TEXT_SQL, _TOPIC_SQL, _BAND_SQL, _JOURNAL_SQL, body="""
SELECT 'category' AS task, doc_id, CAST(c AS INTEGER) AS class_idx, round(prob, 6) AS prob FROM nbt
UNION ALL SELECT 'if', doc_id, CAST(c AS INTEGER), round(prob, 6) FROM nbb
UNION ALL SELECT 'journal', doc_id, CAST(c AS INTEGER), round(prob, 6) FROM nbj"""))
def multi_task(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic, impact band and journal scores from one feature table."""
    features = text_features(spark, sf_dir)
    tasks = {
        "category": ("topic_idx", features.n_topics), "if": ("band", BANDS), "journal": ("journal_idx", features.n_journals),
    }
    scores = clf.multi_task(features.rows, F.col("split") == "train", tasks, features.width, "doc_id")
    return scores.withColumn("prob", F.round("prob", 6))


def with_helper_probabilities(features: TextFeatures, folds: int = 0) -> DataFrame:
    """Add `hidden`: topic and impact-band probabilities side by side, scored in one pass over the rows.

    With `folds` every training row is scored by helpers that have not seen its fold, so that what is
    trained on the probabilities does not learn from helpers that know the answers; the folds share one
    set of counts.
    """
    train = features.rows.filter(F.col("split") == "train")
    fold = F.pmod("doc_id", F.lit(folds)) if folds else None
    own = F.when(F.col("split") == "train", fold) if folds else None

    def helper(label_col: str, n_classes: int) -> scoring.Scorer:
        model = clf.fit_naive_bayes(train, label_col, n_classes, features.width, fold=fold, n_folds=folds)
        return clf.naive_bayes_scorer(model, F.col("sequence"), own)

    both = scoring.all_probabilities(helper("topic_idx", features.n_topics), helper("band", BANDS))
    return features.rows.withColumn("hidden", both)


_HIDDEN = """hidden AS (SELECT doc_id, CAST(c AS BIGINT) AS dim, prob AS v FROM nbt
  UNION ALL SELECT doc_id, c + (SELECT count(DISTINCT lang) FROM documents), prob FROM nbb)"""


@query("m11_hidden_features", sql.with_(TEXT_SQL, _TOPIC_SQL, _BAND_SQL, _HIDDEN, body="""
SELECT doc_id, CAST(dim AS INTEGER) AS dim, round(v, 6) AS value FROM hidden"""))
def hidden_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    hidden = with_helper_probabilities(text_features(spark, sf_dir))
    cells = hidden.select("doc_id", F.posexplode("hidden").alias("dim", "value"))
    return cells.withColumn("value", F.round("value", 6))


def stacked_scores(spark: SparkSession, sf_dir: str, features: TextFeatures, folds: int = 0) -> DataFrame:
    """(doc_id, split, label_idx, scores): journal centroids over document vectors plus helper probabilities.

    All features of a row come from its word indices: one vocabulary, one token pass, no join.
    """
    table = text.embedding_table_of(spark, sf_dir, features.vocabulary)
    rows = voc.with_mean_vectors(with_helper_probabilities(features, folds), table, text.WIDTH, "sequence", "base")
    rows = stage(rows.select(
        "doc_id", "split", F.col("journal_idx").alias("label_idx"), concat_features("base", "hidden").alias("vector")), "stacked")
    return centroid_scores(rows, features.n_journals, "vector")


_STACKED_SQL = f"""{text.EMBEDDING_SQL.strip()},
allcnt AS (SELECT doc_id, word, count(*) AS c FROM tok GROUP BY doc_id, word),
docvec AS (SELECT doc_id, CAST(dim AS BIGINT) AS dim, sum(c * value) / sum(c) AS v FROM allcnt JOIN embtab USING (word) GROUP BY doc_id, dim),
stackv AS (SELECT doc_id, d.dim, coalesce(v, 0.0::DOUBLE) AS v FROM documents CROSS JOIN (SELECT DISTINCT dim FROM docvec) d
  LEFT JOIN docvec USING (doc_id, dim) UNION ALL SELECT doc_id, dim + 1000, v FROM hidden),
stc AS (SELECT journal_idx AS c, dim, avg(v) AS w FROM stackv JOIN targets USING (doc_id) WHERE split = 'train' GROUP BY 1, 2),
sts AS (SELECT doc_id, c, sum(v * w) AS s FROM stackv JOIN stc USING (dim) GROUP BY 1, 2)"""


@query("m9_stacked_classifier", sql.with_(TEXT_SQL, _TOPIC_SQL, _BAND_SQL, _HIDDEN, _STACKED_SQL, body="""
SELECT doc_id, split, CAST(c AS INTEGER) AS class_idx, round(s, 6) AS score FROM sts JOIN targets USING (doc_id)"""))
def stacked_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journal scores on text features extended by topic and impact-band predictions."""
    long = clf.class_rows(stacked_scores(spark, sf_dir, text_features(spark, sf_dir)), "doc_id", "split")
    return long.withColumn("score", F.round("score", 6))


def folded_naive_bayes_sql(label: str, name: str, n_classes: str, folds: int) -> str:
    """`naive_bayes_sql` with one more model per fold (m = 1..folds) that leaves the fold's rows out; training
    rows take the model of their fold, all others the whole one (m = 0)."""
    return f"""{name}_m AS (SELECT CAST(unnest(range(0, {folds + 1})) AS INTEGER) AS m),
{name}_y AS (SELECT CAST(unnest(range(0, {n_classes})) AS INTEGER) AS y),
{name}_k AS (SELECT CAST(count(*) AS DOUBLE) AS k, (SELECT count(*) FROM top) AS v FROM {name}_y),
{name}_tr AS (SELECT doc_id, {label} AS y, 1 + doc_id % {folds} AS fold FROM targets WHERE split = 'train' AND {label} IS NOT NULL),
{name}_tot AS (SELECT m, count(doc_id) AS total FROM {name}_m LEFT JOIN {name}_tr ON fold <> m GROUP BY m),
{name}_n AS (SELECT m, c.y, count(doc_id) AS docs FROM {name}_m CROSS JOIN {name}_y c LEFT JOIN {name}_tr t ON t.y = c.y AND fold <> m GROUP BY m, c.y),
{name}_cwf AS (SELECT y, fold, word, sum(c) AS c FROM cnt JOIN {name}_tr USING (doc_id) GROUP BY ALL),
{name}_cw AS (SELECT m, y, word, sum(c) AS c FROM {name}_cwf JOIN {name}_m ON fold <> m GROUP BY ALL),
{name}_t AS (SELECT m, y, coalesce(sum(c), 0) AS c FROM {name}_n LEFT JOIN {name}_cw USING (m, y) GROUP BY m, y),
{name}_pi AS (SELECT m, y, ln(docs + 1.0::DOUBLE) - ln(total + k) AS pi FROM {name}_n JOIN {name}_tot USING (m) CROSS JOIN {name}_k),
{name}_th AS (SELECT t.m, t.y, w.word, ln(coalesce(cw.c, 0) + 1.0::DOUBLE) - ln(t.c + CAST(v AS DOUBLE)) AS theta
  FROM {name}_t t CROSS JOIN top w CROSS JOIN {name}_k LEFT JOIN {name}_cw cw ON cw.m = t.m AND cw.y = t.y AND cw.word = w.word),
{name}_d AS (SELECT doc_id, split, {label} AS label_idx, CASE WHEN split = 'train' THEN 1 + doc_id % {folds} ELSE 0 END AS m FROM targets),
{name}_dw AS (SELECT doc_id, th.y, sum(cnt.c * theta) AS s FROM cnt JOIN {name}_d USING (doc_id) JOIN {name}_th th USING (m, word) GROUP BY 1, 2),
{name}_raw AS (SELECT d.doc_id, d.split, d.label_idx, p.y AS c, p.pi + coalesce(s, 0) AS raw
  FROM {name}_d d JOIN {name}_pi p USING (m) LEFT JOIN {name}_dw dw ON dw.doc_id = d.doc_id AND dw.y = p.y),
{name}_e AS (SELECT *, exp(raw - max(raw) OVER (PARTITION BY doc_id)) AS e FROM {name}_raw),
{name} AS (SELECT doc_id, split, label_idx, c, raw, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM {name}_e)"""


FOLDS = 5


@query("m9_out_of_fold", sql.with_(
    TEXT_SQL, folded_naive_bayes_sql("topic_idx", "nbt", "(SELECT count(DISTINCT lang) FROM documents)", FOLDS),
    folded_naive_bayes_sql("band", "nbb", str(BANDS), FOLDS), _HIDDEN, _STACKED_SQL, body="""
SELECT doc_id, split, CAST(c AS INTEGER) AS class_idx, round(s, 6) AS score FROM sts JOIN targets USING (doc_id)"""))
def out_of_fold_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stacked classifier on helper predictions of models that have not seen the row (cross-fitting)."""
    scores = stacked_scores(spark, sf_dir, text_features(spark, sf_dir), FOLDS)
    return clf.class_rows(scores, "doc_id", "split").withColumn("score", F.round("score", 6))


# Passes, step and decay of the trained classifiers.
PASSES, RATE, DECAY = 2, 8.0, 1e-4


def descent_sql(label: str, name: str, n_classes: str) -> str:
    """CTEs ending in {name} (pass, doc_id, split, label_idx, c, raw, r) and {name}_acc (pass, n, accuracy on dev)."""
    parts = [f"""{name}_x AS (SELECT doc_id, word, CAST(c AS DOUBLE) / CAST(sum(c) OVER (PARTITION BY doc_id) AS DOUBLE) AS v FROM cnt),
{name}_tr AS (SELECT doc_id, {label} AS y FROM targets WHERE split = 'train' AND {label} IS NOT NULL),
{name}_n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM {name}_tr),
{name}_y AS (SELECT CAST(unnest(range(0, {n_classes})) AS INTEGER) AS c),
{name}_p0 AS (SELECT doc_id, c, 1.0::DOUBLE / CAST((SELECT count(*) FROM {name}_y) AS DOUBLE) AS p FROM targets CROSS JOIN {name}_y),
{name}_w0 AS (SELECT c, '' AS word, 0.0::DOUBLE AS w FROM {name}_y)"""]
    for number in range(1, PASSES + 1):
        a, b = f"{name}_{{}}{number - 1}", f"{name}_{{}}{number}"
        parts.append(f"""{b.format('r')} AS (SELECT doc_id, c, p - CASE WHEN y = c THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS r
  FROM {a.format('p')} JOIN {name}_tr USING (doc_id)),
{b.format('g')} AS (SELECT c, word, sum(r * v) AS g FROM {b.format('r')} JOIN {name}_x USING (doc_id) GROUP BY 1, 2
  UNION ALL SELECT c, '', sum(r) FROM {b.format('r')} GROUP BY 1),
{b.format('w')} AS (SELECT c, word, sum(w) AS w FROM (SELECT c, word, w * (1 - {RATE}::DOUBLE * {DECAY}::DOUBLE) AS w FROM {a.format('w')}
  UNION ALL SELECT c, word, -{RATE}::DOUBLE * g / n FROM {b.format('g')} CROSS JOIN {name}_n) GROUP BY 1, 2),
{b.format('s')} AS (SELECT doc_id, c, sum(v * w) AS s FROM {name}_x JOIN {b.format('w')} USING (word) GROUP BY 1, 2),
{b.format('z')} AS (SELECT t.doc_id, split, {label} AS label_idx, w.c, w.w + coalesce(s, 0) AS raw FROM targets t CROSS JOIN {b.format('w')} w
  LEFT JOIN {b.format('s')} s ON s.doc_id = t.doc_id AND s.c = w.c WHERE w.word = ''),
{b.format('e')} AS (SELECT *, exp(raw - max(raw) OVER (PARTITION BY doc_id)) AS e FROM {b.format('z')}),
{b.format('p')} AS (SELECT *, e / sum(e) OVER (PARTITION BY doc_id) AS p FROM {b.format('e')})""")
    every = " UNION ALL ".join(f"SELECT {i} AS pass, * FROM {name}_z{i}" for i in range(1, PASSES + 1))
    parts.append(f"""{name} AS (SELECT *, row_number() OVER (PARTITION BY pass, doc_id ORDER BY raw DESC, c) AS r FROM ({every})),
{name}_acc AS (SELECT pass, count(*) AS n, avg(CASE WHEN c = label_idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
  FROM {name} WHERE r = 1 AND split = 'dev' AND label_idx IS NOT NULL GROUP BY pass)""")
    return ",\n".join(parts)


_TOPIC_DESCENT = descent_sql("topic_idx", "gdt", "(SELECT count(DISTINCT lang) FROM documents)")
_BAND_DESCENT = descent_sql("band", "gdb", str(BANDS))


def trained(features: TextFeatures, label_col: str, n_classes: int, passes: int = PASSES, patience: int | None = None) -> training.Trained:
    split = F.col("split")
    return training.train_softmax(
        features.rows.filter(split == "train"), features.rows.filter(split == "dev"), label_col, n_classes, features.width,
        passes=passes, rate=RATE, decay=DECAY, patience=patience)


@query("m13_training_passes", sql.with_(TEXT_SQL, _TOPIC_DESCENT, _BAND_DESCENT, body="""
SELECT 'category' AS task, CAST(pass AS INTEGER) AS pass, n, round(accuracy, 6) AS accuracy FROM gdt_acc
UNION ALL SELECT 'if', CAST(pass AS INTEGER), n, round(accuracy, 6) FROM gdb_acc"""))
def training_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy on the dev rows after every pass of training, for both helper classifiers."""
    features = text_features(spark, sf_dir)
    tasks = {"category": ("topic_idx", features.n_topics), "if": ("band", BANDS)}
    rows = [(task, *row) for task, (label, n) in tasks.items() for row in trained(features, label, n).history]
    found = spark.createDataFrame(rows, "task STRING, pass INT, n BIGINT, accuracy DOUBLE")
    return found.withColumn("accuracy", F.round("accuracy", 6))


@query("m5_descent_topic", sql.with_(TEXT_SQL, _TOPIC_DESCENT, body="""
SELECT doc_id, split, label_idx, CAST(c AS INTEGER) AS predicted, round(raw, 6) AS score FROM gdt
WHERE r = 1 AND pass = (SELECT pass FROM gdt_acc ORDER BY accuracy DESC, pass LIMIT 1)"""))
def descent_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics by the weights of the pass that did best on the dev rows."""
    features = text_features(spark, sf_dir)
    model = trained(features, "topic_idx", features.n_topics)
    scorer = training.softmax_scorer(model.weights, model.n_classes, model.width, F.col("sequence"))
    first = F.get("best", F.lit(0))
    return scoring.best_classes(features.rows, scorer, 1).select(
        "doc_id", "split", F.col("topic_idx").alias("label_idx"), first["class_idx"].alias("predicted"), F.round(first["score"], 6).alias("score"))


@query("m13_dev_validation", sql.with_(TEXT_SQL, _TOPIC_SQL, _BAND_SQL, body="""
SELECT 'category' AS task, split, count(*) AS n, round(avg(CASE WHEN c = label_idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy
FROM nbt WHERE r = 1 GROUP BY split
UNION ALL SELECT 'if', split, count(*), round(avg(CASE WHEN c = label_idx THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6)
FROM nbb WHERE r = 1 AND label_idx IS NOT NULL GROUP BY split"""))
def dev_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy of both helper classifiers on every split."""
    features = text_features(spark, sf_dir)
    topic = _classified(term_scores(features, "topic_idx", features.n_topics), "topic_idx")
    band = _classified(term_scores(features, "band", BANDS), "band").filter(F.col("label_idx").isNotNull())
    both = topic.withColumn("task", F.lit("category")).unionByName(band.withColumn("task", F.lit("if")))
    hit = (F.col("predicted") == F.col("label_idx")).cast("double")
    return both.groupBy("task", "split").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"))
