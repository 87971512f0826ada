"""Fields cut out of landed web pages with built-in string functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of the impact-factor listing and its notation for a missing value.
TABLE_START = "<th>Journal Name</th>"
TABLE_END = "CONTENT ENDS HERE"
MISSING_CELLS = ("&nbsp;", "-")
VALUE_CELLS = range(4, 8)


def table_section(html: Column, start: str = TABLE_START, end: str = TABLE_END) -> Column:
    """Text from the start marker up to the end marker."""
    first = F.instr(html, start)
    return F.when(
        (first > 0) & (F.instr(html, end) > first),
        F.substr(html, first, F.instr(html, end) - first),
    )


def table_rows(section: Column) -> Column:
    """Row pieces between header and trailer, without bold marks and line breaks."""
    pieces = F.split(section, "</tr>")
    inner = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 2, F.lit(0)))
    return F.transform(inner, lambda piece: F.regexp_replace(piece, "<b>|</b>|\n", ""))


def cell(cells: Column, position: int) -> Column:
    return F.replace(F.get(cells, F.lit(position - 1)), F.lit("<td>"), F.lit(""))


def first_valid_cell(cells: Column, positions=VALUE_CELLS) -> Column:
    """First value cell that is not a missing mark, as a number."""
    candidates = [cell(cells, p) for p in positions]
    return F.coalesce(*[F.when(~c.isin(*MISSING_CELLS), c) for c in candidates]).try_cast("double")


def listing_entries(pages: DataFrame, page_col: str, html_col: str = "html") -> DataFrame:
    """One row per journal row of each listing page."""
    rows = pages.select(page_col, F.posexplode(table_rows(table_section(F.col(html_col)))).alias("row_no", "piece"))
    cells = F.split(F.col("piece"), "</td>")
    return rows.select(
        page_col,
        F.col("row_no").cast("bigint").alias("row_no"),
        cell(cells, 2).alias("full_name"),
        cell(cells, 3).alias("issn"),
        first_valid_cell(cells).alias("impact_factor"),
    )


def drop_review_titles(entries: DataFrame, title_col: str = "full_name") -> DataFrame:
    """Journals that publish reviews are left out."""
    return entries.filter(~F.contains(F.lower(F.col(title_col)), F.lit("review")))


def list_items(html: Column) -> Column:
    """Texts of all list-item links."""
    return F.regexp_extract_all(html, F.lit("<li><a [^>]*>([^<]*)</a></li>"), F.lit(1))


def first_element_text(html: Column, tag: str, css_class: str | None = None) -> Column:
    """Text of the first element with the tag (and class); NULL when there is none."""
    attributes = "[^>]*" if css_class is None else f'[^>]*class="{css_class}"[^>]*'
    text = F.regexp_extract(html, f"(?s)<{tag}(?: {attributes})?>(.*?)</{tag}>" if css_class is None
                            else f"(?s)<{tag} {attributes}>(.*?)</{tag}>", 1)
    return F.when(text != "", text)


def first_element_number(html: Column, tag: str, css_class: str | None = None) -> Column:
    return first_element_text(html, tag, css_class).try_cast("double")


def union_pages(frames: list[DataFrame]) -> DataFrame:
    """Rows of several page batches stacked by column name."""
    return reduce(DataFrame.unionByName, frames)
