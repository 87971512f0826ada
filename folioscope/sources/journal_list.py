"""Journal master list: tagged lines, four of which describe one journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.row_index import with_row_index

# Tags of the journal master list, in record order, and our column names.
JOURNAL_TAGS = {
    "JournalTitle": "full_name",
    "MedAbbr": "abbreviation",
    "ISSN (Print)": "issn_print",
    "ISSN (Online)": "issn_online",
}


def is_tagged(line: Column) -> Column:
    """The line carries one of the four journal tags."""
    hit = F.lit(False)
    for tag in JOURNAL_TAGS:
        hit = hit | F.contains(line, F.lit(tag))
    return hit


def tagged_lines(lines: DataFrame, line_col: str = "value") -> DataFrame:
    return lines.filter(is_tagged(F.col(line_col)))


def _value_after(line: Column, tag: str) -> Column:
    """Text after 'tag:' without the one character that follows the colon."""
    return F.substr(line, F.lit(len(tag) + 3))


def assemble_records(lines: DataFrame, order_col: str, line_col: str = "value") -> DataFrame:
    """Every four consecutive tagged lines become one journal row."""
    kept = tagged_lines(lines, line_col).select(order_col, line_col)
    numbered = with_row_index(kept, order_col)
    line = F.col(line_col)
    width = len(JOURNAL_TAGS)
    cells = [
        F.max(F.when(F.startswith(line, F.lit(tag + ":")), _value_after(line, tag))).alias(name)
        for tag, name in JOURNAL_TAGS.items()
    ]
    return numbered.groupBy(F.floor(F.col("row_idx") / width).alias("record_no")).agg(*cells)


def parse_record_rows(records: DataFrame, record_col: str = "value") -> DataFrame:
    """Journal rows from a file read with its record separator: no numbering, no shuffle."""
    text = F.col(record_col)
    cells = []
    for tag, name in JOURNAL_TAGS.items():
        literal = tag.replace("(", r"\(").replace(")", r"\)")
        cells.append(F.regexp_extract(text, rf"(?m)^{literal}:.?(.*)$", 1).alias(name))
    return records.filter(is_tagged(text)).select(*cells)


def with_any_issn(journals: DataFrame) -> DataFrame:
    """Journals with a print or an online ISSN."""
    return journals.filter((F.col("issn_print") != "") | (F.col("issn_online") != ""))
