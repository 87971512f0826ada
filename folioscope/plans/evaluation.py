"""Evaluation queries (E, A8, D5, W4, W12, J8, J10)."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.operators import evaluation as ev
from folioscope.operators import relational as ops
from folioscope.operators import vocabulary as voc
from folioscope.plans import models, sql
from folioscope.plans.registry import query
from folioscope.plans.tables import articles, load
from folioscope.runtime import ship, stage

ship(__name__)

# Fixed value: rows drawn for every resample of the vector models.
N_DRAWS = 1001
# Multiplier and mask of `_mixed`; products stay below 2^63.
MIX, MASK = 73_244_475, 2**32 - 1
# Areas are multiples of small decimal fractions; fewer digits would put exact ties on the rounding edge.
DIGITS = 8


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return models.vector_model_ranks(spark, sf_dir)


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ev.rank_histogram(_ranks(spark, sf_dir), "model", "split")


@query("e1_true_rank", sql.with_(sql.VECTOR_MODELS, body="""
SELECT model, vec_id, split, label_idx, CAST(predicted AS INTEGER) AS predicted, CAST(true_rank AS INTEGER) AS true_rank FROM ranks"""))
def true_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the true class of every row under three models."""
    return _ranks(spark, sf_dir)


@query("j8_prediction_truth", sql.with_(sql.VECTOR_MODELS, body="""
SELECT vec_id, label_idx, CAST(predicted AS INTEGER) AS predicted, CAST(true_rank AS INTEGER) AS true_rank FROM ranks WHERE model = 'baseline'"""))
def prediction_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored predictions, one packed row of scores per item, joined to the labels by id."""
    predictions = stage(models.vector_scores(spark, sf_dir).select("vec_id", "scores"), "predictions")
    truth = load(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("label_idx"))
    return ev.true_ranks(predictions.join(truth, "vec_id"), "vec_id")


@query("d5_accuracy", sql.with_(sql.VECTOR_MODELS, body="""
SELECT model, split, round(avg(CASE WHEN true_rank = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS accuracy FROM ranks GROUP BY model, split"""))
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = ev.accuracy(_histogram(spark, sf_dir), "model", "split")
    return result.withColumn("accuracy", F.round("accuracy", 6))


@query("a8_mean_hits", sql.with_(sql.VECTOR_MODELS, body="""
SELECT model, split, round(avg(CASE WHEN true_rank <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS hits_at_5 FROM ranks GROUP BY model, split"""))
def mean_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = (F.col("true_rank") <= 5).cast("double")
    return _ranks(spark, sf_dir).groupBy("model", "split").agg(F.round(F.avg(hit), 6).alias("hits_at_5"))


@query("e2_recall", sql.with_(sql.VECTOR_MODELS, body="""
SELECT label, number, num_correct, round(CASE WHEN number > 0 THEN num_correct / CAST(number AS DOUBLE) END, 6) AS percent,
       CAST(row_number() OVER (ORDER BY number DESC, label) AS INTEGER) AS rank
FROM (SELECT l.label, count(r.vec_id) AS number, count(CASE WHEN r.predicted = r.label_idx THEN 1 END) AS num_correct
      FROM (SELECT DISTINCT label FROM embeddings) l
      LEFT JOIN (SELECT * FROM ranks WHERE model = 'baseline' AND split = 'test') r ON r.label_idx = l.label GROUP BY l.label)"""))
def recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall per class on the test split, classes ranked by support."""
    vectors = load(spark, sf_dir, "embeddings")
    ranks = ev.true_ranks(models.vector_scores(spark, sf_dir), "vec_id", "split").filter(F.col("split") == "test")
    table = ev.recall_table(ranks, voc.label_dictionary(vectors, "label"))
    return table.withColumn("percent", F.round("percent", 6))


@query("e2_journal_recall", sql.with_(models.TEXT_SQL, models._JOURNAL_SQL, body="""
SELECT label, number, num_correct, round(CASE WHEN number > 0 THEN num_correct / CAST(number AS DOUBLE) END, 6) AS percent,
       CAST(row_number() OVER (ORDER BY number DESC, label) AS INTEGER) AS rank
FROM (SELECT l.label, count(r.doc_id) AS number, count(CASE WHEN r.c = r.label_idx THEN 1 END) AS num_correct
      FROM (SELECT source AS label, row_number() OVER (ORDER BY source) - 1 AS idx FROM (SELECT DISTINCT source FROM documents)) l
      LEFT JOIN (SELECT * FROM nbj WHERE r = 1 AND split = 'test') r ON r.label_idx = l.idx GROUP BY l.label)"""))
def journal_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall per journal of the text classifier, with journal names."""
    features = models.text_features(spark, sf_dir)
    scored = models.term_scores(features, "journal_idx", features.n_journals)
    ranks = ev.true_ranks(scored, "doc_id", "split", label_col="journal_idx").filter(F.col("split") == "test")
    return ev.recall_table(ranks, features.journals).withColumn("percent", F.round("percent", 6))


@query("j10_inverse_lookup", """
SELECT doc_id, CAST(dense_rank() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx, source AS journal FROM documents""")
def inverse_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source")
    names = voc.staged_label_dictionary(docs, "source")
    coded = voc.encode_labels(docs, names, "source").drop("source")
    return voc.decode_labels(coded, names, "label_idx", "journal")


@query("e3_coverage", sql.with_(sql.VECTOR_MODELS, sql.curve("model, split", "ranks", 1), body="""
SELECT model, split, k, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM curve"""))
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_classes = models.n_vector_classes(spark, sf_dir)
    curve = ev.coverage_curve(_histogram(spark, sf_dir), n_classes, "model", "split", step=1)
    return curve.withColumns({"coverage": F.round("coverage", 6), "accuracy": F.round("accuracy", 6)})


_JOURNAL_RANKS = """ranks AS (SELECT doc_id, split, r AS true_rank FROM nbj WHERE c = label_idx),
ncls AS (SELECT count(DISTINCT source) AS nc FROM documents)"""


@query("e3_journal_coverage", sql.with_(models.TEXT_SQL, models._JOURNAL_SQL, _JOURNAL_RANKS, sql.curve("split", "ranks", 10), body="""
SELECT split, k, round(coverage, 6) AS coverage, round(accuracy, 6) AS accuracy FROM curve"""))
def journal_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage of the journal text classifier on the default grid."""
    features = models.text_features(spark, sf_dir)
    n_classes = features.n_journals
    scored = models.term_scores(features, "journal_idx", n_classes)
    hist = ev.rank_histogram(ev.true_ranks(scored, "split", label_col="journal_idx"), "split")
    curve = ev.coverage_curve(hist, n_classes, "split")
    return curve.withColumns({"coverage": F.round("coverage", 6), "accuracy": F.round("accuracy", 6)})


@query("e4_coverage_auc", sql.with_(sql.VECTOR_MODELS, sql.curve("model, split", "ranks", 1), body="""
SELECT model, split, round(sum((coverage - x0) * (accuracy + y0) / 2), 8) AS auc
FROM (SELECT *, lag(coverage) OVER w AS x0, lag(accuracy) OVER w AS y0 FROM curve WINDOW w AS (PARTITION BY model, split ORDER BY k))
GROUP BY model, split"""))
def coverage_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = ev.coverage_curve(_histogram(spark, sf_dir), models.n_vector_classes(spark, sf_dir), "model", "split", step=1)
    return ev.curve_metrics(curve, "model", "split").select("model", "split", F.round("auc", DIGITS).alias("auc"))


@query("e5_k90", sql.with_(sql.VECTOR_MODELS, sql.curve("model, split", "ranks", 1), body="""
SELECT model, split, min(CASE WHEN accuracy > 0.9 THEN k END) AS k90 FROM curve GROUP BY model, split"""))
def k90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smallest evaluated k above 90 %."""
    curve = ev.coverage_curve(_histogram(spark, sf_dir), models.n_vector_classes(spark, sf_dir), "model", "split", step=1)
    return ev.curve_metrics(curve, "model", "split").select("model", "split", "k90")


# -- bootstrap ---------------------------------------------------------------------------------

def _stepped(b: int, i: np.ndarray, n: int) -> np.ndarray:
    """Rows of n that resample b takes in its draws i, in steps of one length; any engine can repeat this.

    As many steps as rows take every row once wherever step and n have no common factor, so this is for
    fixed numbers of draws.
    """
    return (b * 7919 + i * 104729 + b * i * 31) % n


def _mixed(x: np.ndarray) -> np.ndarray:
    """32-bit mixing of whole numbers."""
    x = (x ^ (x >> 16)) * MIX & MASK
    x = (x ^ (x >> 16)) * MIX & MASK
    return x ^ (x >> 16)


def _mixed_sql(x: str, name: str) -> str:
    """Columns ending in {name}: `_mixed` of the column x."""
    return f"""(xor({x}, {x} >> 16) * {MIX}) & {MASK} AS {name}_1, (xor({name}_1, {name}_1 >> 16) * {MIX}) & {MASK} AS {name}_2,
  xor({name}_2, {name}_2 >> 16) AS {name}"""


def _scattered(b: int, i: np.ndarray, n: int) -> np.ndarray:
    """Rows of n (up to 2^32) that resample b takes in its draws i, with replacement; any engine can repeat this."""
    return _mixed(_mixed(i) + b) % n


def _with_resamples(ranks: DataFrame, n_draws: int | None = N_DRAWS,
                    draw: Callable[[int, np.ndarray, int], np.ndarray] = _stepped) -> DataFrame:
    """(model, b, true_rank, n) of the test split; b = 0 holds the estimate itself.

    Without `n_draws` a resample has as many rows as the model has in the test split.
    """
    test = ev.rank_histogram(ranks.filter(F.col("split") == "test"), "model")
    resampled = ev.bootstrap_histogram(test, ev.RESAMPLES, "model", n_draws=n_draws, draw=draw)
    return test.withColumn("b", F.lit(0)).unionByName(resampled)


def _performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    n_classes = models.n_vector_classes(spark, sf_dir)
    return ev.performance(_with_resamples(_ranks(spark, sf_dir)), n_classes, "model", "b", step=1, digits=DIGITS)


_BOOT = f"""test AS (SELECT model, true_rank, row_number() OVER (PARTITION BY model ORDER BY true_rank, vec_id) - 1 AS idx
  FROM ranks WHERE split = 'test'),
n AS (SELECT count(*) AS n FROM test WHERE model = 'baseline'),
picks AS (SELECT b, (b * 7919 + i * 104729 + b * i * 31) % n AS idx FROM n CROSS JOIN
  (SELECT CAST(unnest(range(1, {ev.RESAMPLES + 1})) AS BIGINT) AS b) CROSS JOIN (SELECT unnest(range(0, {N_DRAWS})) AS i)),
boot AS (SELECT model, CAST(b AS INTEGER) AS b, true_rank, count(*) AS n FROM picks JOIN test USING (idx) GROUP BY ALL
  UNION ALL SELECT model, 0, true_rank, count(*) FROM test GROUP BY ALL)"""
_BOOT_PARTS = [_BOOT, sql.counted_curve("model, b", "boot", 1), sql.metrics("model, b", "boot", DIGITS), """vals AS (SELECT model, b, 'accuracy' AS metric, accuracy AS value FROM perf
  UNION ALL SELECT model, b, 'auc', auc FROM perf UNION ALL SELECT model, b, 'k90', CAST(k90 AS DOUBLE) FROM perf),
est AS (SELECT model, metric, value AS estimate FROM vals WHERE b = 0),
diffs AS (SELECT model, metric, b, value - estimate AS difference, estimate FROM vals JOIN est USING (model, metric) WHERE b > 0),
ivals AS (SELECT model, metric, any_value(estimate) AS estimate, any_value(estimate) - quantile_cont(difference, 0.95) AS lower,
  any_value(estimate) - quantile_cont(difference, 0.05) AS upper FROM diffs GROUP BY model, metric)"""]
_BOOT_SQL = sql.with_(sql.VECTOR_MODELS, *_BOOT_PARTS, body="{}")
# As many draws as rows, made with replacement.
_WHOLE_BOOT = f"""test AS (SELECT model, true_rank, row_number() OVER (PARTITION BY model ORDER BY true_rank, vec_id) - 1 AS idx
  FROM ranks WHERE split = 'test'),
n AS (SELECT model, count(*) AS n FROM test GROUP BY model),
draws AS (SELECT model, n, {_mixed_sql("i", "m")} FROM (SELECT model, n, unnest(range(0, n)) AS i FROM n)),
numbered AS (SELECT model, n, b, m + b AS s FROM draws CROSS JOIN (SELECT CAST(unnest(range(1, {ev.RESAMPLES + 1})) AS BIGINT) AS b)),
picks AS (SELECT model, b, {_mixed_sql("s", "p")}, p % n AS idx FROM numbered),
boot AS (SELECT model, CAST(b AS INTEGER) AS b, true_rank, count(*) AS n FROM picks JOIN test USING (model, idx) GROUP BY ALL
  UNION ALL SELECT model, 0, true_rank, count(*) FROM test GROUP BY ALL)"""


@query("e6_bootstrap", _BOOT_SQL.format("SELECT model, b, accuracy, auc, k90 FROM perf"))
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _performance(spark, sf_dir)


@query("e6_bootstrap_multinomial")
def bootstrap_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scale form: one multinomial draw of the rank histogram per resample."""
    hist = ev.rank_histogram(_ranks(spark, sf_dir).filter(F.col("split") == "test"), "model")
    drawn = ev.bootstrap_histogram(hist, ev.RESAMPLES, "model")
    return ev.performance(drawn, models.n_vector_classes(spark, sf_dir), "model", "b", step=1)


@query("w12_sorted_differences", _BOOT_SQL.format("SELECT model, metric, b, round(difference, 8) AS difference FROM diffs"))
def sorted_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = ev.metric_rows(_performance(spark, sf_dir), "model", "b")
    return ev.sorted_differences(values, "model", "metric").withColumn("difference", F.round("difference", DIGITS))


@query("e7_intervals", _BOOT_SQL.format("""
SELECT metric, estimate, round(lower, 8) AS lower, round(upper, 8) AS upper FROM ivals WHERE model = 'baseline'"""))
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bootstrap interval of every metric of one model."""
    values = ev.metric_rows(_performance(spark, sf_dir).filter(F.col("model") == "baseline"), "b")
    found = ev.intervals(values, "metric")
    return found.withColumns({"lower": F.round("lower", DIGITS), "upper": F.round("upper", DIGITS)})


_COMPARISON = """
SELECT model, metric, estimate, round(lower, 8) AS lower, round(upper, 8) AS upper FROM ivals WHERE metric IN ('accuracy', 'auc')"""


def _comparison(performance: DataFrame) -> DataFrame:
    values = ev.metric_rows(performance, "model", "b").filter(F.col("metric") != "k90")
    found = ev.intervals(values, "model", "metric")
    return found.withColumns({"lower": F.round("lower", DIGITS), "upper": F.round("upper", DIGITS)})


@query("e8_model_comparison", _BOOT_SQL.format(_COMPARISON))
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _comparison(_performance(spark, sf_dir))


@query("e8_text_model_comparison", sql.with_(
    models.TEXT_SQL, models._TOPIC_SQL, models._BAND_SQL, models._JOURNAL_SQL, models._HIDDEN, models._STACKED_SQL,
    """stacked AS (SELECT doc_id, c, row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, c) AS r FROM sts),
ranks AS (SELECT 'baseline' AS model, doc_id AS vec_id, split, r AS true_rank FROM nbj WHERE c = label_idx
  UNION ALL SELECT 'embedding', doc_id, split, r FROM stacked JOIN targets USING (doc_id) WHERE c = journal_idx),
ncls AS (SELECT count(DISTINCT source) AS nc FROM documents)""", _WHOLE_BOOT, *_BOOT_PARTS[1:], body=_COMPARISON))
def text_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The journal classifiers that read texts: naive Bayes on words against the stacked model.

    Every resample is as large as the test split, so the intervals narrow as it grows.
    """
    features = models.text_features(spark, sf_dir)
    scored = {
        "baseline": ev.true_ranks(
            models.term_scores(features, "journal_idx", features.n_journals), "doc_id", "split", label_col="journal_idx"),
        "embedding": ev.true_ranks(models.stacked_scores(spark, sf_dir, features), "doc_id", "split"),
    }
    parts = [ranks.withColumn("model", F.lit(name)) for name, ranks in scored.items()]
    resampled = _with_resamples(parts[0].unionByName(parts[1]), n_draws=None, draw=_scattered)
    return _comparison(ev.performance(resampled, features.n_journals, "model", "b", step=1, digits=DIGITS))


@query("e9_chart_tables", sql.with_(sql.ARTICLES, body="""
SELECT 'topic share' AS chart, category AS item, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS value FROM articles GROUP BY category
UNION ALL SELECT 'journal count', journal_abbrev, CAST(n AS DOUBLE) FROM (
  SELECT journal_abbrev, count(*) AS n FROM articles GROUP BY 1 ORDER BY n DESC, journal_abbrev LIMIT 5)
UNION ALL SELECT 'journals', 'distinct', CAST(count(DISTINCT journal_abbrev) AS DOUBLE) FROM articles"""))
def chart_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures behind the overview charts in one table (histogram: see A5)."""
    rows = articles(spark, sf_dir)
    topics = ops.share_of_total(rows, "category").select(
        F.lit("topic share").alias("chart"), F.col("category").alias("item"), F.round("share", 6).alias("value")
    )
    popular = ops.top_n(rows, "journal_abbrev", 5).select(
        F.lit("journal count").alias("chart"), F.col("journal_abbrev").alias("item"), F.col("n").cast("double").alias("value")
    )
    distinct = rows.agg(F.countDistinct("journal_abbrev").cast("double").alias("value")).select(
        F.lit("journals").alias("chart"), F.lit("distinct").alias("item"), "value"
    )
    return topics.unionByName(popular).unionByName(distinct)
