"""From raw documents to packed training sequences: five stages, each written and read again.

Language ID drops documents without a determined language, line dedup cuts repeated passages of
lines (documents of which nothing is left go), SimHash near-dedup keeps one document of each group,
mixing takes documents to target weights, packing lays their tokens into sequences.

Every stage takes NULLs in any column, empty and very long texts, repeated rows and further columns
(a column named like one the operators add for themselves, `__llm_*` or `__mix_*`, is not allowed),
and an empty table comes out empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import language_id, line_dedup, mixing, packing, simhash
from folioscope.llm.common import documents
from folioscope.llm.queries import DOMAIN, WEIGHTS
from folioscope.runtime import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A language that is less likely than all others together is not determined.
LEAST_SCORE = 0.5
# Share of all tokens that goes into the mixture, each document at most once.
TOKEN_SHARE = 0.9


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; NULL texts and texts without letters go.

    Where no row is labelled there is no language to determine, and all texts with a letter stay.
    """
    model = language_id.fit(docs)
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found = docs.withColumn("__llm_p", language_id.predict(spark, model, F.col("text")))
    clear = (F.col("__llm_p.lang_pred") != language_id.UNDETERMINED) & (F.col("__llm_p.score") >= LEAST_SCORE)
    return found.filter(clear).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; n_chars follows the text."""
    rest = line_dedup.without_repeated_lines(docs)
    cut = rest.filter((F.col("__llm_removed") == 0) | (F.trim("text") != ""))
    changed = F.when(F.col("__llm_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", changed).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of every group of SimHashes (four-word shingles) linked within four bits.

    NULL and empty texts have the fingerprint of no words and are one group; of rows that repeat an id
    and text one stays.
    """
    return simhash.one_per_component(docs, shingle=4, radius=4)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their leaf's budget takes them."""
    mixed = mixing.mix(docs, F.expr(DOMAIN), share=TOKEN_SHARE, max_epochs=1, weights=WEIGHTS)
    taken = mixed.filter("__mix_times > 0")
    return taken.withColumn("__llm_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__mix_times")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its sequence and offset."""
    return packing.pack(docs).drop("h")


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates),
    ("mixing", mixture), ("best_fit_packing", packed),
]

# Language ID has no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over the documents table."""
    docs = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
