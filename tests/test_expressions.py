"""Column expressions at their edges."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import text, vectors
from folioscope.functions.numeric import IMPACT_BAND_BOUNDS, impact_band
from folioscope.functions.records import first_value, has_fields
from folioscope.sources import html
from folioscope.sources.article_records import parse_record


def evaluate(spark, column, value, kind):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("factor, band", [
    (0.0, 0), (2.5, 0), (2.501, 1), (5.0, 1), (5.001, 2), (10.0, 2), (10.1, 3), (15.0, 3), (15.1, 4),
    (float("nan"), None), (None, None),
])
def test_impact_band_is_right_closed(spark, factor, band):
    assert len(IMPACT_BAND_BOUNDS) == 4
    assert evaluate(spark, impact_band, factor, "DOUBLE") == band


@pytest.mark.parametrize("value, words", [
    ("The cat, the hat.", ["the", "cat", "the", "hat"]), ("", []), ("!!! ---", []), ("don't STOP", ["don't", "stop"]),
    ("a\tb\nc  d", ["a", "b", "c", "d"]), ("x_y^z`w", ["x", "y", "z", "w"]), ("Éçole", ["éçole"]),
])
def test_tokens(spark, value, words):
    assert evaluate(spark, text.tokens, value, "STRING") == words


def test_raw_tokens_keep_case_and_empties(spark):
    assert evaluate(spark, text.raw_tokens, "A  b", "STRING") == ["A", "", "b"]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ids=st.lists(st.integers(1, 99), max_size=20), length=st.integers(1, 12))
def test_padded_length_is_fixed(spark, ids, length):
    got = evaluate(spark, lambda c: text.pad_sequence(c, length), ids, "ARRAY<INT>")
    assert got == (ids[-length:] + [0] * length)[:length]


@pytest.mark.parametrize("value, year", [("2010/01/02", 2010), ("20", 20), ("x", None), ("", None), (None, None)])
def test_year_prefix(spark, value, year):
    assert evaluate(spark, text.year_prefix, value, "STRING") == year


def test_query_string(spark):
    assert evaluate(spark, text.query_string, "j mol biol", "STRING") == "j+mol+biol"


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(scores=st.lists(st.sampled_from([0.0, 0.1, 0.5, 0.9]), min_size=1, max_size=8), data=st.data())
def test_ranks_agree_with_a_stable_sort(spark, scores, data):
    label = data.draw(st.integers(0, len(scores) - 1))
    order = sorted(range(len(scores)), key=lambda i: -scores[i])
    row = spark.createDataFrame([(scores, label)], "s ARRAY<DOUBLE>, y INT").select(
        vectors.ranked_classes(F.col("s")).alias("ranked"), vectors.argmax(F.col("s")).alias("best"),
        vectors.true_rank(F.col("s"), F.col("y")).alias("rank"), vectors.top_k(F.col("s"), 3).alias("top"),
    ).first()
    assert row.ranked == order
    assert row.best == order[0]
    assert row.rank == order.index(label) + 1
    assert row.top == order[:3]


def test_l2_normalise(spark):
    assert evaluate(spark, vectors.l2_normalise, [3.0, 4.0], "ARRAY<DOUBLE>") == [0.6, 0.8]
    assert evaluate(spark, vectors.l2_normalise, [0.0, 0.0], "ARRAY<DOUBLE>") == [0.0, 0.0]


def test_one_hot(spark):
    assert evaluate(spark, lambda c: vectors.one_hot(c, 4), 2, "INT") == [0, 0, 1, 0]
    assert evaluate(spark, lambda c: vectors.one_hot(c, 3), None, "INT") == [0, 0, 0]


def test_record_fields(spark):
    record = "PMID- 7\nAB  - first\n      second\nPHST- 2010/01/01\nPHST- 2011/01/01\nTA  - Nature"
    fields = evaluate(spark, parse_record, record, "STRING")
    assert fields == {"PMID": ["7"], "AB": ["first second"], "PHST": ["2010/01/01", "2011/01/01"], "TA": ["Nature"]}
    df = spark.createDataFrame([(fields,)], "f MAP<STRING, ARRAY<STRING>>")
    row = df.select(
        has_fields(F.col("f"), ["AB", "TA", "PHST"]).alias("all"), has_fields(F.col("f"), ["XX"]).alias("none"),
        first_value(F.col("f"), "PHST").alias("first"), first_value(F.col("f"), "XX").alias("missing"),
    ).first()
    assert tuple(row) == (True, False, "2010/01/01", None)


def test_listing_page(spark):
    row = "<tr><td>{}</td><td><b>{}</b></td>\n<td>{}</td><td>{}</td><td>{}</td><td>{}</td><td>{}</td></tr>"
    page = ("<p>before</p><th>Journal Name</th></tr>" + row.format(1, "Cell", "1-1", "&nbsp;", "-", "3.5", "9")
            + row.format(2, "Review of X", "2-2", "-", "-", "-", "&nbsp;") + "<b>CONTENT ENDS HERE</b>")
    entries = html.listing_entries(spark.createDataFrame([(1, page), (2, "no table")], "p INT, html STRING"), "p")
    assert [tuple(r)[2:] for r in entries.orderBy("row_no").collect()] == [("Cell", "1-1", 3.5), ("Review of X", "2-2", None)]
    assert [r.full_name for r in html.drop_review_titles(entries).collect()] == ["Cell"]


def test_first_element(spark):
    page = '<div>no</div><div class="v">4.25</div><div class="v">5</div>'
    assert evaluate(spark, lambda c: html.first_element_number(c, "div", "v"), page, "STRING") == 4.25
    assert evaluate(spark, lambda c: html.first_element_text(c, "h1"), page, "STRING") is None


def test_nan_never_counts_as_large(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x DOUBLE")
    assert [r.b for r in df.select(impact_band(F.col("x")).alias("b")).collect()] == [None, 0]
    assert math.isnan(df.first().x)
