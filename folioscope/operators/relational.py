"""Filters, joins, groupings and set operations of journal and article tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.numeric import nan_to_null
from folioscope.functions.records import first_value, has_fields
from folioscope.functions.text import blank_to_null, contains_word, tokens, year_prefix
from folioscope.operators.quantiles import quantile_bounds  # noqa: F401
from folioscope.runtime import broadcast_if_small, stage

# Fields an article must carry, oldest accepted age, minimum articles per journal.
REQUIRED_FIELDS = ["AB", "TA", "PHST"]
PRESENT_YEAR = 2018
MAX_AGE_YEARS = 10
MIN_SUPPORT = 40


# -- filters -----------------------------------------------------------------------------------

def columns_at(df: DataFrame, start: int, stop: int | None = None) -> DataFrame:
    """Columns by position, as a half-open range or a single one."""
    return df.select(*df.columns[start:(start + 1 if stop is None else stop)])


def not_missing(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull() & ~F.isnan(col))


def member_of(df: DataFrame, keys: str | list[str], keep: DataFrame | list) -> DataFrame:
    """Rows whose key is in a literal list or in another table."""
    if isinstance(keep, DataFrame):
        return df.join(broadcast_if_small(stage(keep.select(keys), "keep")), keys, "left_semi")
    return df.filter(F.col(keys).isin(list(keep)))


def with_required_fields(records: DataFrame, fields_col: str = "fields") -> DataFrame:
    return records.filter(has_fields(F.col(fields_col), REQUIRED_FIELDS))


def article_columns(records: DataFrame, fields_col: str = "fields") -> DataFrame:
    """Typed article columns of field maps."""
    fields = F.col(fields_col)
    return records.select(
        first_value(fields, "PMID").try_cast("bigint").alias("pmid"),
        first_value(fields, "AB").alias("abstract"),
        F.lower(first_value(fields, "TA")).alias("journal_abbrev"),
        year_prefix(first_value(fields, "PHST")).alias("year"),
    )


def recent(year: Column, present_year: int = PRESENT_YEAR) -> Column:
    return year >= present_year - MAX_AGE_YEARS


# -- joins -------------------------------------------------------------------------------------

def either_key_join(left: DataFrame, keys: list[str], right: DataFrame, right_key: str) -> DataFrame:
    """Inner join on `left.k1 = right.key OR left.k2 = right.key ...` as a hash join.

    A literal OR plans as a nested loop. Every branch reads the same right column, so exploding
    the distinct non-NULL left keys gives the same pairs through an equi-join.
    """
    wanted = F.array_distinct(F.array_compact(F.array(*[F.col(k) for k in keys])))
    exploded = left.withColumn("__key", F.explode(wanted))
    return exploded.join(right, exploded["__key"] == right[right_key]).drop("__key")


def reconcile_impact(journals: DataFrame, impact: DataFrame) -> DataFrame:
    """Journals with the impact factors found under their print or online ISSN."""
    keyed = journals.withColumns(
        {"issn_print": blank_to_null(F.col("issn_print")), "issn_online": blank_to_null(F.col("issn_online"))}
    )
    factors = impact.select(blank_to_null(F.col("issn")).alias("issn"), "impact_factor")
    return either_key_join(keyed, ["issn_print", "issn_online"], factors, "issn").drop("issn")


def first_per_key(df: DataFrame, key: Column, key_name: str, order_cols: list[str], values: list[str]) -> DataFrame:
    """First row per key by `order_cols`; a plain aggregate, so hot keys combine before the shuffle."""
    packed = F.min(F.struct(*order_cols, *[c for c in values if c not in order_cols]))
    firsts = df.groupBy(key.alias(key_name)).agg(packed.alias("__first"))
    return firsts.select(key_name, *[F.col("__first")[c].alias(c) for c in values])


def first_match_lookup(left: DataFrame, key_col: str, lookup: DataFrame, lookup_key: str,
                       order_cols: list[str], values: list[str], how: str = "inner") -> DataFrame:
    """Case-insensitive lookup that takes the first of several matching rows."""
    firsts = stage(first_per_key(lookup, F.lower(F.col(lookup_key)), "__lookup", order_cols, values), "lookup")
    return left.join(
        broadcast_if_small(firsts), F.lower(left[key_col]) == firsts["__lookup"], how
    ).drop("__lookup")


def fill_missing(left: DataFrame, key_col: str, value_col: str, fallback: DataFrame) -> DataFrame:
    """Left join to a secondary source (unique `key_col`, `fallback_value`) that fills only missing values.

    `filled` tells which rows got their value from it.
    """
    known = nan_to_null(F.col(value_col))
    joined = left.join(fallback, key_col, "left")
    return joined.withColumns(
        {
            "filled": known.isNull() & F.col("fallback_value").isNotNull(),
            value_col: F.coalesce(known, F.col("fallback_value")),
        }
    ).drop("fallback_value")


def recode(value: Column, names: dict[str, str]) -> Column:
    """Display names of codes; a code without a name stays as it is."""
    pairs = [F.lit(x) for pair in names.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), value), value)


# -- aggregates --------------------------------------------------------------------------------

def count_per_key(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def share_of_total(df: DataFrame, key: str) -> DataFrame:
    """Group counts with their share of all rows; the data is read once, the total comes from the groups."""
    counts = stage(count_per_key(df, key), "counts")
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def supported_keys(df: DataFrame, *keys: str, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Keys with at least `min_support` rows."""
    return count_per_key(df, *keys).filter(F.col("n") >= min_support)


def top_n(df: DataFrame, key: str, n: int) -> DataFrame:
    """Most frequent keys, ties by key, with their chart position."""
    top = count_per_key(df, key).orderBy(F.desc("n"), F.asc(key)).limit(n)
    return top.withColumn("sort_order", F.row_number().over(Window.orderBy(F.desc("n"), F.asc(key))))


def equal_width_histogram(df: DataFrame, col: str, bins: int = 30) -> DataFrame:
    """Right-closed equal-width bins whose boundaries lie half a width off the multiples of it.

    Bins without rows are listed with zero. Two passes: bounds, then counts of at most `bins` groups.
    """
    values = not_missing(df.select(F.col(col).alias("x")), "x")
    lo, hi = values.agg(F.min("x"), F.max("x")).first()
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin BIGINT, lower DOUBLE, upper DOUBLE, n BIGINT")
    # Fixed value: a column with a single distinct value gets bins of this width.
    width = (hi - lo) / (bins - 1) if hi > lo else 0.1
    origin = width / 2 + math.floor((lo - width / 2) / width) * width

    def number(x: Column) -> Column:
        return F.greatest(F.ceil((x - F.lit(origin)) / F.lit(width)), F.lit(1)).cast("bigint")

    counted = values.groupBy(number(F.col("x")).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    last = max(math.ceil((hi - origin) / width), 1)
    frame = df.sparkSession.range(1, last + 1).withColumnRenamed("id", "bin")
    return frame.join(counted, "bin", "left").select(
        "bin",
        (F.lit(origin) + (F.col("bin") - 1) * width).alias("lower"),
        (F.lit(origin) + F.col("bin") * width).alias("upper"),
        F.coalesce("n", F.lit(0).cast("bigint")).alias("n"),
    )


# -- topics ------------------------------------------------------------------------------------

def search_terms(documents: DataFrame, terms: list[tuple[str, list[str], list[str]]],
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(topic, term_no, id) for every search term a text matches; one scan, no shuffle.

    Each term is (topic, required words, excluded words).
    """
    words = documents.select(id_col, F.array_distinct(tokens(F.col(text_col))).alias("__words"))
    hits = [
        F.when(
            contains_word(F.col("__words"), required, excluded),
            F.struct(F.lit(topic).alias("topic"), F.lit(number).alias("term_no")),
        )
        for number, (topic, required, excluded) in enumerate(terms)
    ]
    return words.select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(
        "hit.topic", "hit.term_no", id_col
    )


def parse_term(term: str) -> tuple[list[str], list[str]]:
    """(required, excluded) words of a search term: words before NOT are all required, those after it excluded."""
    required, _, excluded = term.partition(" NOT ")
    return required.lower().split(), excluded.lower().split()


def search_term_strings(documents: DataFrame, topics: dict[str, list[str]], phrases: bool = False,
                        id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(topic, term_no, id) for terms written as 'word word NOT word'; term_no counts over all topics.

    With `phrases` the required words must follow each other.
    """
    terms = [(topic, *parse_term(term)) for topic, listed in topics.items() for term in listed]
    if not phrases:
        return search_terms(documents, terms, id_col, text_col)
    words = documents.select(id_col, tokens(F.col(text_col)).alias("__words")).select(
        id_col, "__words", F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")).alias("__text"))
    hits = [
        F.when(
            F.contains(F.col("__text"), F.lit(f" {' '.join(required)} ")) & contains_word(F.col("__words"), [], excluded),
            F.struct(F.lit(topic).alias("topic"), F.lit(number).alias("term_no")))
        for number, (topic, required, excluded) in enumerate(terms)
    ]
    return words.select(id_col, F.explode(F.array_compact(F.array(*hits))).alias("hit")).select(
        "hit.topic", "hit.term_no", id_col)


def without_reviews(hits: DataFrame, reviews: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Search hits that are not review articles."""
    return hits.join(reviews.select(id_col), id_col, "left_anti")


def exclusive_topics(hits: DataFrame, topics: list[str], id_col: str = "doc_id") -> DataFrame:
    """(topic, id) of ids found under exactly one of the `topics`.

    Least and greatest topic number agree only then; one hash aggregate on numbers does union,
    dedupe and exclusion. A topic that is not in the list is an error.
    """
    names = F.array(*[F.lit(t) for t in topics])
    unknown = F.raise_error(F.concat(F.lit("unknown topic: "), F.coalesce("topic", F.lit("NULL")))).cast("bigint")
    number = F.coalesce(F.nullif(F.array_position(names, F.col("topic")), F.lit(0)), unknown)
    return (
        hits.groupBy(id_col)
        .agg(F.min(number).alias("__first"), F.max(number).alias("__last"))
        .filter(F.col("__first") == F.col("__last"))
        .select(F.get(names, (F.col("__first") - 1).cast("int")).alias("topic"), id_col)
    )
