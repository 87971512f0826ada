"""Tagged article records: 'TAG - value' lines, continuation lines indented by six blanks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.sources.tabular import read_lines

# Fixed values of the record format.
RECORD_SEPARATOR = "\n\n"
CONTINUATION = "\n      "
TAG_WIDTH = 4
VALUE_START = 7


def parse_record(record: Column) -> Column:
    """Record text as MAP<tag, ARRAY<value>>; a repeated tag keeps all its values in order."""
    unfolded = F.replace(record, F.lit(CONTINUATION), F.lit(" "))
    pairs = F.transform(
        F.filter(F.split(unfolded, "\n"), lambda line: F.length(line) >= TAG_WIDTH),
        lambda line: F.struct(
            F.rtrim(F.substr(line, F.lit(1), F.lit(TAG_WIDTH))).alias("tag"),
            F.substr(line, F.lit(VALUE_START)).alias("value"),
        ),
    )
    tags = F.array_distinct(F.transform(pairs, lambda p: p["tag"]))
    values = F.transform(
        tags,
        lambda tag: F.transform(F.filter(pairs, lambda p: p["tag"] == tag), lambda p: p["value"]),
    )
    return F.map_from_arrays(tags, values)


def read_article_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with its field map; records are split by the scan itself."""
    return (
        read_lines(spark, path, RECORD_SEPARATOR)
        .filter(F.length(F.trim("value")) > 0)
        .select(parse_record(F.col("value")).alias("fields"))
    )
