"""Filter, join, aggregate and set queries (R, J, A, D, U, F1-F3)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.numeric import half_even, impact_band
from folioscope.functions.records import first_value, has_fields
from folioscope.functions.text import query_string, raw_tokens, tokens, year_prefix
from folioscope.operators import quantiles as quant
from folioscope.operators import relational as ops
from folioscope.operators import sketches
from folioscope.operators.inverted_index import TERMS as INDEX_TERMS
from folioscope.operators.inverted_index import build_index, search_index
from folioscope.operators.vocabulary import distinct_raw_tokens, encode_labels, staged_label_dictionary
from folioscope.plans import sql
from folioscope.plans.registry import query
from folioscope.plans.tables import TERMS, TOPICS, article_fields, articles, impact_list, journals, load, masters, texts
from folioscope.runtime import broadcast_if_small, new_path, stage
from folioscope.sources.journal_list import with_any_issn

LANGUAGES = {"en": "English", "fr": "French", "de": "German"}


@query("r1_positional_columns", sql.with_(sql.ARTICLES, body="SELECT category, journal_abbrev, impact_factor FROM articles"))
def positional_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.columns_at(articles(spark, sf_dir), 2, 5)


@query("r3_membership", sql.with_(sql.ARTICLES, body="""
SELECT pmid, journal_abbrev FROM articles WHERE journal_abbrev IN ('src1', 'src2', 'src3')"""))
def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles of three chosen journals."""
    chosen = ["src1", "src2", "src3"]
    return ops.member_of(articles(spark, sf_dir), "journal_abbrev", chosen).select("pmid", "journal_abbrev")


@query("r4_not_missing", sql.with_(sql.ARTICLES, body="SELECT pmid, impact_factor FROM articles WHERE impact_factor IS NOT NULL"))
def not_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = articles(spark, sf_dir).select(
        "pmid", F.coalesce("impact_factor", F.lit(float("nan"))).alias("impact_factor")
    )
    return ops.not_missing(rows, "impact_factor")


@query("r5_required_fields", sql.with_(sql.ARTICLES, body="""
SELECT pmid, CAST(year AS INTEGER) AS year FROM articles WHERE pmid % 7 <> 0"""))
def required_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that carry every required field (also F9), with the year of the first date."""
    kept = ops.with_required_fields(article_fields(spark, sf_dir))
    return kept.select("pmid", year_prefix(first_value(F.col("fields"), "PHST")).alias("year"))


@query("r6_quality_filter", sql.with_(sql.ARTICLES, body="""
SELECT a.pmid, a.journal_abbrev, a.year, a.impact_factor FROM articles a JOIN journals j ON a.journal_abbrev = lower(j.abbreviation)
WHERE a.pmid % 7 <> 0 AND length(a.abstract) > 0 AND a.year >= 2008 AND j.n % 7 <> 3"""))
def quality_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known journal, recent enough, non-empty abstract, with the journal's impact factor."""
    kept = ops.article_columns(ops.with_required_fields(article_fields(spark, sf_dir)))
    known = journals(spark, sf_dir).filter(~F.contains(F.lower("full_name"), F.lit("review"))).select(
        "abbreviation", "n", F.when(F.col("n") % 5 != 0, F.round(F.col("n").cast("double") * 0.9 + 0.5, 3)).alias("impact_factor")
    )
    good = kept.filter(ops.recent(F.col("year")) & (F.length("abstract") > 0))
    return ops.first_match_lookup(good, "journal_abbrev", known, "abbreviation", ["n"], ["impact_factor"]).select(
        "pmid", "journal_abbrev", "year", "impact_factor"
    )


@query("r8_any_key", sql.with_(sql.MASTERS, body="SELECT n, issn_print, issn_online FROM masters WHERE issn_print <> '' OR issn_online <> ''"))
def any_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_any_issn(masters(spark, sf_dir)).select("n", "issn_print", "issn_online")


@query("r10_row_slice", """
SELECT page_id, list_aggregate(list_slice(items, 2, len(items) - 1), 'string_agg', '|') AS inner_items FROM (
  SELECT page_id, regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1) AS items FROM pages)
WHERE len(items) > 2""")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pieces but the first and the last."""
    from folioscope.sources.html import list_items

    items = load(spark, sf_dir, "pages").select("page_id", list_items(F.col("html")).alias("items"))
    inner = F.slice("items", F.lit(2), F.size("items") - 2)
    return items.filter(F.size("items") > 2).select("page_id", F.array_join(inner, "|").alias("inner_items"))


@query("r11_null_pick", sql.with_(sql.ARTICLES, body="""
SELECT pmid, coalesce(impact_factor, CAST(year AS DOUBLE) / 1000) AS impact_factor FROM articles"""))
def null_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select(
        "pmid", F.coalesce("impact_factor", F.col("year").cast("double") / 1000).alias("impact_factor")
    )


# -- joins -------------------------------------------------------------------------------------

@query("j1_or_join", sql.with_(sql.JOURNALS, sql.IMPACT, body="""
SELECT j.full_name, j.abbreviation, NULLIF(j.issn_print, '') AS issn_print, NULLIF(j.issn_online, '') AS issn_online, i.impact_factor
FROM journals j JOIN impact_list i
  ON NULLIF(j.issn_print, '') = NULLIF(i.issn, '') OR NULLIF(j.issn_online, '') = NULLIF(i.issn, '')
WHERE j.issn_print <> '' OR j.issn_online <> ''"""))
def or_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = with_any_issn(journals(spark, sf_dir)).drop("n")
    return ops.reconcile_impact(named, impact_list(spark, sf_dir))


@query("j1_or_join_large", """
SELECT c_custkey, c_nationkey, s_suppkey FROM customer JOIN supplier ON c_custkey = s_suppkey OR c_nationkey = s_suppkey""")
def or_join_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = load(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"))
    pairs = ops.either_key_join(customers, ["c_custkey", "c_nationkey"], load(spark, sf_dir, "supplier"), "s_suppkey")
    return pairs.select("c_custkey", F.col("c_nationkey").cast("int").alias("c_nationkey"), "s_suppkey")


@query("j2_first_match", sql.with_(
    sql.ARTICLES,
    "dup AS (SELECT n, upper(abbreviation) AS abbreviation FROM journals UNION ALL SELECT n + 100, abbreviation FROM journals)",
    "firsts AS (SELECT lower(abbreviation) AS abbr, min(n) AS n FROM dup GROUP BY 1)",
    body="SELECT pmid, journal_abbrev, firsts.n AS journal_row FROM articles JOIN firsts ON lower(journal_abbrev) = abbr"))
def first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lookup holds every journal twice in different case; the first row wins."""
    base = journals(spark, sf_dir)
    twice = base.select("n", F.upper("abbreviation").alias("abbreviation")).unionByName(
        base.select((F.col("n") + 100).alias("n"), "abbreviation")
    )
    rows = articles(spark, sf_dir).select("pmid", "journal_abbrev")
    found = ops.first_match_lookup(rows, "journal_abbrev", twice, "abbreviation", ["n"], ["n"])
    return found.withColumnRenamed("n", "journal_row")


@query("j3_semi_join", """
SELECT doc_id, source, lang FROM documents SEMI JOIN (
  SELECT source, lang FROM documents GROUP BY source, lang HAVING count(*) >= 20) k USING (source, lang)""")
def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    keep = ops.supported_keys(docs, "source", "lang", min_support=20).drop("n")
    return ops.member_of(docs, ["source", "lang"], keep)


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "labels").filter(F.col("quality") == 0).select("doc_id")


def _term_sql() -> str:
    words = "words AS (SELECT doc_id, list(DISTINCT word) AS ws FROM tok GROUP BY doc_id)"
    parts = []
    for number, (topic, required, excluded) in enumerate(TERMS):
        tests = [f"list_contains(ws, '{w}')" for w in required] + [f"NOT list_contains(ws, '{w}')" for w in excluded]
        parts.append(f"SELECT '{topic}' AS topic, {number} AS term_no, doc_id FROM words WHERE {' AND '.join(tests)}")
    return f"{sql.TOKENS},\n{words},\nhits AS (" + "\nUNION ALL ".join(parts) + ")"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.search_terms(texts(spark, sf_dir), TERMS)


def _search(spark: SparkSession, sf_dir: str, terms: DataFrame) -> DataFrame:
    """Terms against an index of all texts, built and saved for the query."""
    index = build_index(texts(spark, sf_dir), new_path(spark, "index"))
    return search_index(index, terms)


@query("f11_term_search", sql.with_(_term_sql(), body="SELECT topic, term_no, doc_id FROM hits"))
def term_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(topic, number, required, excluded, False) for number, (topic, required, excluded) in enumerate(TERMS)]
    return _search(spark, sf_dir, spark.createDataFrame(rows, INDEX_TERMS))


@query("f11_vocabulary_terms", sql.with_(sql.TOKENS, body="""
SELECT DISTINCT word AS topic, CAST(length(word) AS INTEGER) AS term_no, doc_id FROM tok
JOIN (SELECT word FROM tok GROUP BY word HAVING count(DISTINCT doc_id) BETWEEN 3 AND 20) USING (word)
WHERE doc_id NOT IN (SELECT doc_id FROM tok WHERE word = 'the')"""))
def vocabulary_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of 3 to 20 texts as a term of its own: a table of thousands of terms."""
    docs = texts(spark, sf_dir)
    words = docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    terms = words.filter(F.col("n").between(3, 20)).select(
        F.col("word").alias("topic"), F.length("word").alias("term_no"), F.array("word").alias("required"),
        F.array(F.lit("the")).alias("excluded"), F.lit(False).alias("phrase"))
    return _search(spark, sf_dir, terms)


# Search terms as a user writes them, several per topic.
TERM_STRINGS = {"alpha": ["the NOT whou of", "whou"], "beta": ["de la", "der und NOT die das"], "delta": ["with the NOT that"]}


def _term_string_sql(phrases: bool) -> str:
    parts, number = [], 0
    for topic, listed in TERM_STRINGS.items():
        for term in listed:
            required, excluded = ops.parse_term(term)
            tests = [f"contains(t, ' {' '.join(required)} ')"] if phrases else [f"list_contains(ws, '{w}')" for w in required]
            tests += [f"NOT list_contains(ws, '{w}')" for w in excluded]
            parts.append(f"SELECT '{topic}' AS topic, {number} AS term_no, doc_id FROM words WHERE {' AND '.join(tests)}")
            number += 1
    words = "words AS (SELECT doc_id, list(word) AS ws, ' ' || string_agg(word, ' ' ORDER BY pos) || ' ' AS t FROM tok GROUP BY doc_id)"
    return sql.with_(sql.TOKENS, words, body="\nUNION ALL ".join(parts))


def _term_strings(spark: SparkSession, phrases: bool) -> DataFrame:
    listed = [(topic, *ops.parse_term(term), phrases) for topic, terms in TERM_STRINGS.items() for term in terms]
    rows = [(topic, number, *rest) for number, (topic, *rest) in enumerate(listed)]
    return spark.createDataFrame(rows, INDEX_TERMS)


@query("f11_term_strings", _term_string_sql(False))
def term_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _search(spark, sf_dir, _term_strings(spark, False))


@query("f11_term_phrases", _term_string_sql(True))
def term_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The required words of a term as a phrase."""
    return _search(spark, sf_dir, _term_strings(spark, True))


@query("j4_anti_join", sql.with_(_term_sql(), body="""
SELECT topic, term_no, doc_id FROM hits ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 0) r USING (doc_id)"""))
def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.without_reviews(_hits(spark, sf_dir), _reviews(spark, sf_dir)).select("topic", "term_no", "doc_id")


@query("a6_topic_exclusivity", sql.with_(_term_sql(), body="""
SELECT min(topic) AS topic, doc_id FROM hits ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 0) r USING (doc_id)
GROUP BY doc_id HAVING count(DISTINCT topic) = 1"""))
def topic_exclusivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.exclusive_topics(ops.without_reviews(_hits(spark, sf_dir), _reviews(spark, sf_dir)), TOPICS)


@query("d2_total_over_topics", sql.with_(
    _term_sql(),
    """x AS (SELECT min(topic) AS topic, doc_id FROM hits ANTI JOIN (SELECT doc_id FROM labels WHERE quality = 0) r USING (doc_id)
  GROUP BY doc_id HAVING count(DISTINCT topic) = 1)""",
    body="SELECT coalesce(topic, 'all topics') AS topic, count(*) AS n FROM x GROUP BY ROLLUP (topic)"))
def total_over_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    exclusive = ops.exclusive_topics(ops.without_reviews(_hits(spark, sf_dir), _reviews(spark, sf_dir)), TOPICS)
    return exclusive.rollup("topic").agg(F.count(F.lit(1)).alias("n")).select(
        F.coalesce("topic", F.lit("all topics")).alias("topic"), "n"
    )


@query("u1_union_distinct", sql.with_(_term_sql(), body="""
SELECT topic, doc_id FROM hits WHERE term_no = 0 UNION SELECT topic, doc_id FROM hits WHERE term_no > 0"""))
def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stage(_hits(spark, sf_dir), "hits")
    first = hits.filter(F.col("term_no") == 0).select("topic", "doc_id")
    others = hits.filter(F.col("term_no") > 0).select("topic", "doc_id")
    return first.union(others).distinct()


@query("u3_except", sql.with_(_term_sql(), body="""
SELECT doc_id FROM hits EXCEPT SELECT doc_id FROM labels WHERE quality = 0"""))
def except_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select("doc_id").subtract(_reviews(spark, sf_dir))


@query("u4_intersect", sql.with_(_term_sql(), body="""
SELECT doc_id FROM hits WHERE topic = 'gamma' INTERSECT SELECT doc_id FROM hits WHERE topic <> 'gamma'"""))
def intersect_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = stage(_hits(spark, sf_dir), "hits")
    return hits.filter(F.col("topic") == "gamma").select("doc_id").intersect(
        hits.filter(F.col("topic") != "gamma").select("doc_id")
    )


@query("u5_dedupe", "SELECT DISTINCT source, lang FROM documents")
def dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("source", "lang").dropDuplicates()


@query("j5_dictionary_lookup", """
SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INTEGER) AS label_idx FROM documents""")
def dictionary_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "lang")
    return encode_labels(docs, staged_label_dictionary(docs, "lang"), "lang")


_FILL = sql.with_(sql.MASTERS, """filled AS (
  SELECT m.abbreviation, CASE WHEN m.n % 5 <> 0 THEN CAST(m.n AS DOUBLE) / 4 WHEN m.n % 2 = 0 THEN CAST(m.n AS DOUBLE) / 8 END AS impact_factor,
         m.n % 5 = 0 AND m.n % 2 = 0 AS filled
  FROM masters m)""", body="{}")


def _filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    base = masters(spark, sf_dir).select(
        "abbreviation", F.when(n % 5 != 0, n.cast("double") / 4).otherwise(F.lit(float("nan"))).alias("impact_factor")
    )
    fallback = masters(spark, sf_dir).select(
        "abbreviation", F.when(n % 2 == 0, n.cast("double") / 8).alias("fallback_value")
    )
    return ops.fill_missing(base, "abbreviation", "impact_factor", fallback)


@query("j6_fallback_fill", _FILL.format("SELECT abbreviation, impact_factor, filled FROM filled WHERE impact_factor IS NOT NULL"))
def fallback_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.not_missing(_filled(spark, sf_dir), "impact_factor").select("abbreviation", "impact_factor", "filled")


@query("d6_fill_counter", _FILL.format("""
SELECT count(*) AS journals, count(CASE WHEN filled THEN 1 END) AS filled, count(impact_factor) AS remaining FROM filled"""))
def fill_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filled(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("journals"), F.count_if("filled").alias("filled"),
        F.count("impact_factor").alias("remaining"),
    )


@query("j11_display_labels", """
SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE lang END AS topic, count(*) AS n
FROM documents GROUP BY 1""")
def display_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = ops.count_per_key(load(spark, sf_dir, "documents"), "lang")
    return counts.select(ops.recode(F.col("lang"), LANGUAGES).alias("topic"), "n")


# -- aggregates --------------------------------------------------------------------------------

@query("a1_count_per_key", "SELECT source, count(*) AS n FROM documents GROUP BY source")
def count_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.count_per_key(load(spark, sf_dir, "documents"), "source")


@query("a2_share_of_total", """
SELECT lang, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share FROM documents GROUP BY lang""")
def share_of_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = ops.share_of_total(load(spark, sf_dir, "documents"), "lang")
    return shares.withColumn("share", F.round("share", 6))


@query("a3_min_support", """
SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 40""")
def min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.supported_keys(load(spark, sf_dir, "documents"), "source")


@query("a4_distinct_count", """
SELECT (SELECT count(DISTINCT source) FROM documents) AS journals,
       (SELECT count(DISTINCT w) FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents)) AS raw_tokens""")
def distinct_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    journals_ = docs.agg(F.countDistinct("source")).scalar()
    return distinct_raw_tokens(texts(spark, sf_dir)).agg(journals_.alias("journals"), F.count(F.lit(1)).alias("raw_tokens"))


@query("a4_distinct_sketch", sql.with_(sql.TOKENS, body="""
SELECT lang, count(DISTINCT word) AS words, true AS within FROM tok JOIN documents USING (doc_id) GROUP BY lang"""))
def distinct_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct words per language, exact and from states kept per source and merged: within 3 % of each other."""
    docs = load(spark, sf_dir, "documents").select("lang", "source", F.explode(tokens(F.col("text"))).alias("word"))
    states = stage(sketches.distinct_states(docs, "word", "lang", "source"), "distinct-states")
    estimates = sketches.distinct_estimates(sketches.merge_distinct(states, "lang"), "lang")
    exact = docs.distinct().select("lang", "word").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("words"))
    close = F.abs(F.col("n") - F.col("words")) <= F.greatest(F.lit(0.03) * F.col("words"), F.lit(1))
    return exact.join(estimates, exact["lang"].eqNullSafe(estimates["lang"])).select(exact["lang"], "words", close.alias("within"))


_HIST = """
, lim AS (SELECT min({col}) AS lo, max({col}) AS hi, (max({col}) - min({col})) / 29 AS w FROM {table}),
o AS (SELECT *, w / 2 + floor((lo - w / 2) / w) * w AS origin FROM lim),
c AS (SELECT CAST(greatest(ceil(({col} - origin) / w), 1) AS BIGINT) AS bin, count(*) AS n
      FROM {table} CROSS JOIN o WHERE {col} IS NOT NULL GROUP BY 1),
g AS (SELECT unnest(range(1, CAST(ceil((hi - origin) / w) AS BIGINT) + 1)) AS bin, origin, w FROM o)
SELECT bin, round(origin + (bin - 1) * w, 6) AS lower, round(origin + bin * w, 6) AS upper, coalesce(n, 0) AS n
FROM g LEFT JOIN c USING (bin)"""


def _rounded_bins(bins: DataFrame) -> DataFrame:
    return bins.withColumns({"lower": F.round("lower", 6), "upper": F.round("upper", 6)})


@query("a5_histogram", "WITH " + sql.ARTICLES + _HIST.format(col="impact_factor", table="articles"))
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_bins(ops.equal_width_histogram(articles(spark, sf_dir), "impact_factor"))


@query("a5_histogram_prices", "WITH src AS (SELECT o_totalprice FROM orders)" + _HIST.format(col="o_totalprice", table="src"))
def histogram_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_bins(ops.equal_width_histogram(load(spark, sf_dir, "orders"), "o_totalprice"))


@query("d1_funnel", sql.with_(sql.ARTICLES, body="""
SELECT count(CASE WHEN pmid % 7 <> 0 AND n % 7 <> 3 AND year >= 2008 AND length(abstract) > 0 THEN 1 END) AS accepted,
       count(CASE WHEN pmid % 7 = 0 THEN 1 END) AS missing_fields,
       count(CASE WHEN pmid % 7 <> 0 AND n % 7 = 3 THEN 1 END) AS unknown_journal
FROM articles JOIN journals ON journal_abbrev = abbreviation"""))
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records by fate, counted in one pass."""
    records = article_fields(spark, sf_dir)
    complete = has_fields(F.col("fields"), ops.REQUIRED_FIELDS)
    cols = records.select(
        complete.alias("complete"),
        F.lower(first_value(F.col("fields"), "TA")).alias("journal"),
        year_prefix(first_value(F.col("fields"), "PHST")).alias("year"),
        F.length(first_value(F.col("fields"), "AB")).alias("chars"),
    )
    known = journals(spark, sf_dir).filter(~F.contains(F.lower("full_name"), F.lit("review"))).select(
        F.lower("abbreviation").alias("journal"), F.lit(True).alias("known")
    ).distinct()
    marked = cols.join(broadcast_if_small(stage(known, "known-journals")), "journal", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    return marked.agg(
        F.count_if(F.col("complete") & F.col("known") & ops.recent(F.col("year")) & (F.col("chars") > 0)).alias("accepted"),
        F.count_if(~F.col("complete")).alias("missing_fields"),
        F.count_if(F.col("complete") & ~F.col("known")).alias("unknown_journal"),
    )


@query("d4_quantiles", """
SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.05), 4) AS q_low, round(quantile_cont(o_totalprice, 0.95), 4) AS q_high
FROM orders GROUP BY o_orderpriority""")
def quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounds = quant.quantile_bounds(load(spark, sf_dir, "orders"), "o_totalprice", "o_orderpriority")
    return bounds.withColumns({"q_low": F.round("q_low", 4), "q_high": F.round("q_high", 4)})


@query("d4_quantile_sketch", """
SELECT o_orderpriority, count(*) AS n, true AS low_within, true AS high_within FROM orders GROUP BY o_orderpriority""")
def quantile_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles from sketches kept per status and merged: each is within 1 % of its rank in the rows."""
    orders = load(spark, sf_dir, "orders")
    parts = stage(quant.quantile_sketches(orders, "o_totalprice", "o_orderpriority", "o_orderstatus"), "sketches")
    merged = quant.sketched_quantiles(quant.merge_quantile_sketches(parts, "o_orderpriority"), "o_orderpriority")
    merged = broadcast_if_small(stage(merged, "sketched"))
    price = F.col("o_totalprice")
    below = orders.join(merged, "o_orderpriority").groupBy("o_orderpriority", "n").agg(*[
        F.avg((price < F.col(q)).cast("double")).alias(f"{q}_under") for q in ("q_low", "q_high")], *[
        F.avg((price <= F.col(q)).cast("double")).alias(f"{q}_upto") for q in ("q_low", "q_high")])

    def within(q: str, share: float) -> Column:
        return (F.col(f"{q}_under") <= share + 0.01) & (F.col(f"{q}_upto") >= share - 0.01)

    return below.select("o_orderpriority", "n", within("q_low", 0.05).alias("low_within"), within("q_high", 0.95).alias("high_within"))


# -- scalar functions --------------------------------------------------------------------------

@query("f1_strings", """
SELECT page_id, lower(url) AS lowered, length(html) AS n_chars, contains(lower(html), 'review') AS is_review,
       replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), ' ', '+') AS query, substr(url, 1, 12) AS head,
       CAST(len(string_split(html, ' ')) AS BIGINT) AS pieces
FROM pages""")
def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select(
        "page_id",
        F.lower("url").alias("lowered"),
        F.length("html").cast("bigint").alias("n_chars"),
        F.contains(F.lower("html"), F.lit("review")).alias("is_review"),
        query_string(F.regexp_extract("html", "<h1>(.*?)</h1>", 1)).alias("query"),
        F.substring("url", 1, 12).alias("head"),
        F.size(raw_tokens(F.col("html"))).cast("bigint").alias("pieces"),
    )


@query("f2_numbers", """
SELECT o_orderkey, round(o_totalprice / 7, 3) AS third_digit, CAST(round_even(o_orderkey / 2.0::DOUBLE, 0) AS DOUBLE) AS half_even,
       CAST(ceil(o_totalprice / 512) AS BIGINT) AS batches, CAST((o_orderkey + 1) / 8.0::DOUBLE AS DOUBLE) AS coverage
FROM orders""")
def numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    return load(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.round(price / 7, 3).alias("third_digit"),
        half_even(key / 2).alias("half_even"),
        F.ceil(price / 512).alias("batches"),
        ((key + 1) / 8).alias("coverage"),
    )


@query("f3_banding", sql.with_(sql.ARTICLES, body=f"SELECT pmid, CAST({sql.BAND} AS INTEGER) AS band FROM articles"))
def banding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles(spark, sf_dir).select("pmid", impact_band(F.col("impact_factor")).alias("band"))
