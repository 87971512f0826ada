"""Line dedup over overlapping three-line windows, in DataFrame functions only.

Every run of three consecutive lines is hashed; windows that occur more than once anywhere keep
their first occurrence (by id, then position), and the lines covered by later occurrences are
merged into spans and removed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import keyed_texts, same_document

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(lines: Column, size: int) -> Column:
    """96-bit hashes of all windows; NULL for a window of empty lines only."""
    def hashed(i: Column) -> Column:
        own = [F.get(lines, i + k) for k in range(size)]
        blank = F.length(F.concat(*own)) == 0
        return F.when(~blank, F.struct(F.xxhash64(*own).alias("a"), F.hash(*own).alias("b")))

    return F.when(F.size(lines) >= size, F.transform(F.sequence(F.lit(0), F.size(lines) - size), hashed))


def repeated_spans(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, starts, ends): the removed line spans of every document that has any, ends exclusive.

    A window equals another when its lines do, character by character. The occurrence with the
    smallest (doc_id, text hash, position) stays, NULL ids come last; windows of empty lines and
    documents with fewer lines than a window never count. Rows that repeat id and text are one
    document.
    """
    texts = keyed_texts(docs, id_col, text_col).withColumn("lines", _lines(F.col("text")))
    places = (
        texts.select("doc_id", "h", F.posexplode(_windows(F.col("lines"), size)).alias("pos", "w"))
        .filter("w IS NOT NULL").select("w.a", "w.b", "doc_id", "h", "pos")
    )
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "h", "pos")
    # Counted and reduced before the shuffle, so a line block of every document costs a row per task.
    repeated = places.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).filter("n > 1")
    later = places.join(repeated, ["a", "b"]).filter(~place.eqNullSafe(F.col("first")))
    covered = later.groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("pos")).alias("p"))
    p = F.col("p")
    begins = F.filter(p, lambda x, i: (i == 0) | (x > F.get(p, i - 1) + size))
    finals = F.filter(p, lambda x, i: (i == F.size(p) - 1) | (F.get(p, i + 1) > x + size))
    return covered.select("doc_id", "h", begins.alias("starts"), F.transform(finals, lambda x: x + size).alias("ends"))


def _without(lines: Column, starts: Column, ends: Column) -> Column:
    """The lines outside the spans: the gap before each span and the rest after the last."""
    def gap(k: Column) -> Column:
        begin = F.when(k == 0, F.lit(0)).otherwise(F.get(ends, k - 1))
        end = F.coalesce(F.get(starts, k), F.size(lines))
        return F.slice(lines, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(starts)), gap))


def without_repeated_lines(docs: DataFrame, size: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with the text left after removal and the columns __llm_lines, __llm_removed and __llm_spans.

    A document that loses all its lines has the empty text; one that loses none keeps its text as it
    is (NULL stays NULL).
    """
    spans = repeated_spans(docs, size, id_col, text_col).select(
        F.col("doc_id").alias("__llm_id"), F.col("h").alias("__llm_sh"), F.col("starts").alias("__llm_starts"),
        F.col("ends").alias("__llm_ends"))
    keyed = docs.withColumn("__llm_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    joined = keyed.join(
        spans, keyed[id_col].eqNullSafe(spans["__llm_id"]) & (keyed["__llm_h"] == spans["__llm_sh"]), "left")
    lines = _lines(F.coalesce(F.col(text_col), F.lit("")))
    starts, ends = F.col("__llm_starts"), F.col("__llm_ends")
    removed = F.aggregate(F.zip_with(starts, ends, lambda s, e: (e - s).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return joined.withColumns({
        text_col: F.when(starts.isNull(), F.col(text_col)).otherwise(F.array_join(_without(lines, starts, ends), "\n")),
        "__llm_lines": F.size(lines).cast("bigint"),
        "__llm_removed": F.coalesce(removed, F.lit(0).cast("bigint")),
        "__llm_spans": F.when(starts.isNull(), F.lit(0)).otherwise(F.size(starts)).cast("bigint"),
    }).drop("__llm_h", "__llm_sh", "__llm_id", "__llm_starts", "__llm_ends")
