"""Source, sink and parsing queries (S, K, P)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.records import first_value
from folioscope.operators.relational import fill_missing, not_missing
from folioscope.operators.vocabulary import label_dictionary, token_counts
from folioscope.plans import sql
from folioscope.plans.registry import query
from folioscope.plans.tables import (
    articles, impact_list, journals, listing_pages, load, master_lines, master_records, masters, record_text, texts,
)
from folioscope.runtime import new_path
from folioscope.sources import commit_log, html, tabular
from folioscope.sources.article_records import RECORD_SEPARATOR, read_article_records
from folioscope.sources.journal_list import assemble_records, parse_record_rows, tagged_lines

# Text that one task writes to a file: several ranges of a scan.
FILE_BYTES = 512 * 1024 * 1024
ARTICLE_COLUMNS = ["abstract", "pmid", "category", "journal_abbrev", "impact_factor"]


@query("s1_tsv_scan", sql.with_(sql.ARTICLES, body="""
SELECT pmid, md5(abstract) AS abstract_md5, category, journal_abbrev, impact_factor FROM articles"""))
def tsv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles written as tab-separated text and read back: texts with tabs, quotes and line breaks survive."""
    path = new_path(spark, "articles-tsv")
    tabular.write_delimited(articles(spark, sf_dir).select(*ARTICLE_COLUMNS), path)
    back = tabular.read_delimited(spark, path, tabular.ARTICLE_SCHEMA)
    return back.select("pmid", F.md5("abstract").alias("abstract_md5"), "category", "journal_abbrev", "impact_factor")


@query("s1_single_file", sql.with_(sql.ARTICLES, body="""
SELECT category, count(*) AS n, count(DISTINCT pmid) AS ids, CAST(sum(length(abstract)) AS BIGINT) AS chars FROM articles GROUP BY category"""))
def single_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All articles in one file with line breaks inside values, read in ranges by several tasks.

    A table above FILE_BYTES goes to several such files, as one task writes a file.
    """
    path = new_path(spark, "articles-one-file")
    tabular.write_few_files(articles(spark, sf_dir).select(*ARTICLE_COLUMNS), path, FILE_BYTES)
    back = tabular.read_delimited(spark, path, tabular.ARTICLE_SCHEMA)
    return back.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pmid").alias("ids"), F.sum(F.length("abstract").cast("bigint")).alias("chars"))


@query("s3_csv_scan", sql.with_(sql.MASTERS, body="""
SELECT full_name, NULLIF(issn_print, '') AS issn, CAST(n AS DOUBLE) / 8 AS impact_factor FROM masters"""))
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "impact-csv")
    rows = masters(spark, sf_dir).select(
        "full_name", F.col("issn_print").alias("issn"), (F.col("n") / 8).alias("impact_factor")
    )
    tabular.write_delimited(rows, path, sep=",")
    back = tabular.read_delimited(spark, path, tabular.IMPACT_SCHEMA, sep=",", multiline=False)
    return back.select("full_name", F.nullif("issn", F.lit("")).alias("issn"), "impact_factor")


@query("s4_line_scan", sql.with_(sql.MASTERS, body="""
SELECT line, count(*) AS n FROM (
  SELECT 'JrId: ' || n AS line FROM masters UNION ALL SELECT 'JournalTitle: ' || full_name FROM masters
  UNION ALL SELECT 'MedAbbr: ' || abbreviation FROM masters UNION ALL SELECT 'ISSN (Print): ' || issn_print FROM masters
  UNION ALL SELECT 'ISSN (Online): ' || issn_online FROM masters) GROUP BY line"""))
def line_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "master-lines")
    tabular.write_lines(master_records(spark, sf_dir).select("value"), path)
    return tabular.read_lines(spark, path).groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).alias("n"))


@query("s6_dictionary_scan", """
SELECT source AS label, CAST(row_number() OVER (ORDER BY source) - 1 AS INTEGER) AS label_idx
FROM (SELECT DISTINCT source FROM documents)""")
def dictionary_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label dictionary saved as a table and loaded again (also K4)."""
    path = new_path(spark, "labels")
    dictionary = label_dictionary(load(spark, sf_dir, "documents"), "source")
    tabular.save_dictionary(dictionary, path)
    return tabular.load_dictionary(spark, path, dictionary.schema)


@query("k2_append_batches", sql.with_(sql.ARTICLES, body="""
SELECT category, count(*) AS n, CAST(sum(length(abstract)) AS BIGINT) AS chars FROM articles GROUP BY category"""))
def append_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to one table: articles with and without an impact factor."""
    path = new_path(spark, "articles-append")
    rows = articles(spark, sf_dir)
    tabular.append_table(rows.filter(F.col("impact_factor").isNotNull()), path)
    tabular.append_table(rows.filter(F.col("impact_factor").isNull()), path)
    back = spark.read.schema(rows.schema).parquet(path)
    return back.groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("abstract").cast("bigint")).alias("chars")
    )


@query("k2_logged_append", sql.with_(sql.ARTICLES, body="""
SELECT category, count(*) AS n, CAST(sum(length(abstract)) AS BIGINT) AS chars FROM articles GROUP BY category"""))
def logged_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same two batches as appends that may be run again: the first one is, and counts once."""
    table = new_path(spark, "articles-batches")
    rows = articles(spark, sf_dir)
    known, other = rows.filter(F.col("impact_factor").isNotNull()), rows.filter(F.col("impact_factor").isNull())
    for batch, part in (("known", known), ("other", other), ("known", known)):
        commit_log.append_batch(part, table, batch)
    return commit_log.read_batches(spark, table, rows.schema).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("abstract").cast("bigint")).alias("chars"))


@query("k3_write_if_absent", sql.with_(sql.TOKENS, body="SELECT word, count(*) AS n FROM tok GROUP BY word"))
def write_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second write is skipped, so the table keeps the first result."""
    path = new_path(spark, "counts-once")
    counts = token_counts(texts(spark, sf_dir))
    tabular.write_if_absent(counts, path)
    tabular.write_if_absent(counts.withColumn("n", -F.col("n")), path)
    return spark.read.schema(counts.schema).parquet(path)


@query("k5_staged_rewrite", sql.with_(sql.JOURNALS, body="""
SELECT abbreviation, CAST(CASE WHEN n % 5 = 0 THEN 1.5 ELSE n END AS DOUBLE) AS impact_factor
FROM journals WHERE n % 5 <> 0 OR n % 2 = 0"""))
def staged_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fill missing factors, save under a new path, go on from there."""
    n = F.col("n")
    base = journals(spark, sf_dir).select(
        "n", "abbreviation", F.when(n % 5 != 0, n.cast("double")).otherwise(F.lit(float("nan"))).alias("impact_factor")
    )
    fallback = base.filter(n % 2 == 0).select("abbreviation", F.lit(1.5).alias("fallback_value"))
    saved, _ = tabular.rewrite_table(fill_missing(base, "abbreviation", "impact_factor", fallback), "journals")
    return not_missing(saved, "impact_factor").select("abbreviation", "impact_factor")


@query("p1_tagged_lines", sql.with_(sql.MASTERS, body="""
SELECT n * 5 + 1 AS line_no, 'JournalTitle: ' || full_name AS value FROM masters
UNION ALL SELECT n * 5 + 2, 'MedAbbr: ' || abbreviation FROM masters
UNION ALL SELECT n * 5 + 3, 'ISSN (Print): ' || issn_print FROM masters
UNION ALL SELECT n * 5 + 4, 'ISSN (Online): ' || issn_online FROM masters"""))
def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged_lines(master_lines(spark, sf_dir))


_RECORDS = sql.with_(sql.MASTERS, body="SELECT full_name, abbreviation, issn_print, issn_online FROM masters")


@query("p2_record_assembly", _RECORDS)
def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble_records(master_lines(spark, sf_dir), "line_no").drop("record_no")


@query("p2_record_file", _RECORDS)
def record_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a file whose scan already splits it into records."""
    path = new_path(spark, "master-records")
    separator = "\n-----\n"
    tabular.write_lines(master_records(spark, sf_dir).select("value"), path, separator)
    return parse_record_rows(tabular.read_lines(spark, path, separator))


@query("p2_role_columns", """
SELECT conv_id, turn, max(CASE WHEN role = 'user' THEN md5(text) END) AS user_md5,
       max(CASE WHEN role = 'assistant' THEN md5(text) END) AS assistant_md5,
       max(CASE WHEN role = 'system' THEN md5(text) END) AS system_md5
FROM conversations GROUP BY conv_id, turn""")
def role_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag-to-column step of record assembly on tagged messages."""
    roles = ["user", "assistant", "system"]
    return load(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(
        *[F.max(F.when(F.col("role") == r, F.md5("text"))).alias(f"{r}_md5") for r in roles]
    )


@query("p3_record_map", sql.with_(sql.ARTICLES, body="""
SELECT pmid, md5(replace(abstract, chr(10), ' ')) AS abstract_md5, journal_abbrev AS ta,
       CAST(2 AS INTEGER) AS n_dates, year || '/01/01' AS first_date, year + 1 || '/06/30' AS last_date
FROM articles"""))
def record_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "article-records")
    tabular.write_lines(record_text(spark, sf_dir), path, RECORD_SEPARATOR)
    fields = F.col("fields")
    return read_article_records(spark, path).select(
        first_value(fields, "PMID").cast("bigint").alias("pmid"),
        F.md5(first_value(fields, "AB")).alias("abstract_md5"),
        first_value(fields, "TA").alias("ta"),
        F.size(fields["PHST"]).alias("n_dates"),
        first_value(fields, "PHST").alias("first_date"),
        F.get(fields["PHST"], F.lit(1)).alias("last_date"),
    )


_LISTED = """
  SELECT n // 100 AS page_no, n % 100 AS row_no, full_name,
         CASE WHEN n % 2 = 0 THEN issn_print ELSE issn_online END AS issn,
         CASE WHEN n % 5 = 4 THEN 1 ELSE 0 END AS v4_only, n FROM masters"""


@query("p4_listing_rows", sql.with_(sql.MASTERS, body=f"SELECT page_no, row_no, full_name, issn FROM ({_LISTED})"))
def listing_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = listing_pages(spark, sf_dir)
    return html.listing_entries(pages, "page_no").drop("impact_factor")


@query("p4_list_items", """
SELECT page_id, unnest(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1)) AS item,
       CAST(generate_subscripts(regexp_extract_all(html, '<li><a [^>]*>([^<]*)</a></li>', 1), 1) - 1 AS INTEGER) AS pos
FROM pages""")
def list_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "pages").select("page_id", F.posexplode(html.list_items(F.col("html"))).alias("pos", "item"))


@query("p5_first_valid_cell", sql.with_(sql.MASTERS, body="""
SELECT n // 100 AS page_no, n % 100 AS row_no,
       CASE WHEN n % 5 >= 4 THEN NULL ELSE CAST(n % 40 + n % 5 + 1 AS DOUBLE) + 0.25 END AS impact_factor
FROM masters"""))
def first_valid_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.listing_entries(listing_pages(spark, sf_dir), "page_no").select("page_no", "row_no", "impact_factor")


@query("p6_first_element", """
SELECT page_id, NULLIF(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') AS heading,
       TRY_CAST(NULLIF(regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1), '') AS DOUBLE) AS heading_number,
       NULLIF(regexp_extract(html, '(?s)<div [^>]*class="ad"[^>]*>(.*?)</div>', 1), '') AS ad_text
FROM pages""")
def first_element(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("html")
    return load(spark, sf_dir, "pages").select(
        "page_id",
        html.first_element_text(page, "h1").alias("heading"),
        html.first_element_number(page, "h1").alias("heading_number"),
        html.first_element_text(page, "div", "ad").alias("ad_text"),
    )


@query("r7_reject_pattern", sql.with_(sql.MASTERS, body="""
SELECT n // 100 AS page_no, n % 100 AS row_no, full_name FROM masters WHERE NOT contains(lower(full_name), 'review')"""))
def reject_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = html.listing_entries(listing_pages(spark, sf_dir), "page_no")
    return html.drop_review_titles(entries).select("page_no", "row_no", "full_name")


@query("d3_row_counts", sql.with_(sql.MASTERS, body="""
SELECT count(*) AS seen, count(CASE WHEN NOT contains(lower(full_name), 'review') THEN 1 END) AS extracted,
       count(CASE WHEN (CASE WHEN n % 2 = 0 THEN issn_print ELSE issn_online END) = '' THEN 1 END) AS missing_issn,
       count(CASE WHEN n % 5 < 4 THEN 1 END) AS with_factor
FROM masters"""))
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows seen, kept and incomplete, in one pass over the listing."""
    title = F.lower("full_name")
    return html.listing_entries(listing_pages(spark, sf_dir), "page_no").agg(
        F.count(F.lit(1)).alias("seen"),
        F.count_if(~F.contains(title, F.lit("review"))).alias("extracted"),
        F.count_if(F.col("issn") == "").alias("missing_issn"),
        F.count_if(F.col("impact_factor").isNotNull()).alias("with_factor"),
    )


@query("u2_union_all", sql.with_(sql.ARTICLES, sql.IMPACT, body="""
SELECT issn, impact_factor FROM impact_list
UNION ALL SELECT issn_print, CAST(n AS DOUBLE) FROM journals"""))
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = journals(spark, sf_dir).select(F.col("n").cast("double").alias("impact_factor"), F.col("issn_print").alias("issn"))
    return html.union_pages([impact_list(spark, sf_dir), extra])
