"""Delimited, text and Parquet sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioscope.runtime import measured_bytes, new_path
from folioscope.sources.quoted import read_quoted

ARTICLE_SCHEMA = (
    "abstract STRING, pmid BIGINT, category STRING, journal_abbrev STRING, impact_factor DOUBLE"
)
IMPACT_SCHEMA = "full_name STRING, issn STRING, impact_factor DOUBLE"

# Quotes, tabs and line breaks inside a value survive a round trip; blanks at its ends too.
_DELIMITED = {
    "header": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}
# Writers leave a NULL bare and put an empty string in quotes; with a null mark no text contains,
# the reader tells them apart.
_NULL_MARK = "\u0000"


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", multiline: bool = True) -> DataFrame:
    """Header table with an explicit schema; a file of any size is read by many tasks.

    With line breaks inside values the files are read twice, once to find which breaks end a record;
    pass multiline=False for tables of plain one-line values to read them once.
    """
    if multiline:
        return read_quoted(spark, path, schema, {**_DELIMITED, "nullValue": _NULL_MARK}, sep)
    return spark.read.options(**_DELIMITED).csv(path, schema=schema, sep=sep, nullValue=_NULL_MARK)


def write_delimited(df: DataFrame, path: str, sep: str = "\t", mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**_DELIMITED).csv(path, sep=sep)


def write_few_files(df: DataFrame, path: str, file_bytes: int, sep: str = "\t") -> None:
    """`write_delimited` to as few files as `file_bytes` of values per file allow: one for a small table.

    A file is written by one task, so their number has to follow the size of the table.
    """
    files = max(1, -(-(measured_bytes(df) or 0) // file_bytes))
    write_delimited(df.coalesce(files), path, sep)


def read_lines(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """One row per line, or per record when the record separator is given."""
    reader = spark.read
    if separator is not None:
        reader = reader.option("lineSep", separator)
    return reader.text(path)


def write_lines(df: DataFrame, path: str, separator: str | None = None) -> None:
    writer = df.write.mode("overwrite")
    if separator is not None:
        writer = writer.option("lineSep", separator)
    writer.text(path)


def write_if_absent(df: DataFrame, path: str) -> None:
    """Skip the step when its output table already exists."""
    df.write.mode("ignore").parquet(path)


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a table that may already hold earlier batches."""
    df.write.mode("append").parquet(path)


def save_dictionary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def load_dictionary(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def rewrite_table(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Save a mid-run version of a table under a new path: Spark must not overwrite what it reads."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path
