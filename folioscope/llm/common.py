"""Shared pieces: document access, row keys, chunking and the text forms several operators use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.runtime import new_path, shared_dir

# The ASCII white space all contracts name, as a character class.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, h): NULL text becomes the empty text, `h` hashes the text.

    (doc_id, h) names a document even where ids repeat or are NULL; rows that agree in both are
    copies of one document and get the same result. Further columns are left behind, whatever
    their names.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return narrow.withColumn("h", F.xxhash64("text"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, h); a NULL id matches a NULL id."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["h"] == right["h"])


def surviving_rows(docs: DataFrame, first: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of `docs` for every row of `first` (doc_id, h, n); n counts the rows of `docs` that agree in both.

    Only rows that repeat an id and text are brought together.
    """
    keyed = docs.withColumn("__llm_h", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))

    def rows(wanted: DataFrame) -> DataFrame:
        return keyed.join(
            wanted, keyed[id_col].eqNullSafe(wanted["doc_id"]) & (keyed["__llm_h"] == wanted["h"]), "left_semi")

    repeated = rows(first.filter("n > 1")).dropDuplicates([id_col, "__llm_h"])
    return rows(first.filter("n = 1")).unionByName(repeated).drop("__llm_h")


def pieces(text: Column, size: int) -> Column:
    """`text` cut into consecutive parts of `size` code points (one empty part for an empty text)."""
    cuts = F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / size).cast("int") - 1, F.lit(0)))
    return F.when(F.length(text) <= size, F.array(text)).otherwise(
        F.transform(cuts, lambda k: F.substring(text, k * size + 1, F.lit(size)))
    )


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage_once(df: DataFrame, label: str) -> DataFrame:
    """A staged table, well compressed, of a plan that is run this once: its shuffle files go with the job."""
    spark = df.sparkSession
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        path = new_path(spark, label)
        df.write.option("compression", "zstd").parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def release(staged: DataFrame) -> None:
    """Delete the files of a staged table that nothing reads any more, because what was made of it is written."""
    spark = staged.sparkSession
    context, shared = spark.sparkContext, shared_dir(spark).split(":")[-1].lstrip("/")
    for folder in {name.rsplit("/", 1)[0] for name in staged.inputFiles()}:
        if folder.split(":")[-1].lstrip("/").startswith(shared + "/"):
            target = context._jvm.org.apache.hadoop.fs.Path(folder)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)
