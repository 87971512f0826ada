"""Input tables and the journal / article views derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.runtime import spread

# Search terms by topic: (topic, required words, excluded words).
TERMS = [
    ("alpha", ["the"], ["whou", "of"]),
    ("alpha", ["whou"], []),
    ("beta", ["de"], []),
    ("gamma", ["der"], []),
    ("delta", ["with"], ["that"]),
]
TOPICS = sorted({topic for topic, _, _ in TERMS})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text) of all documents, spread over all cores for work on whole texts."""
    return spread(load(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def _source_number() -> Column:
    return F.substring("source", 4, 10).cast("int")


def numbered_factor(n: Column) -> Column:
    return F.when(n % 5 != 0, F.round(n.cast("double") * F.lit(0.9) + F.lit(0.5), 3))


def journals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One journal per document source, some without an ISSN or with a review title."""
    n = F.col("n")
    code = F.lpad(n.cast("string"), 4, "0")
    sources = load(spark, sf_dir, "documents").select("source").distinct().withColumn("n", _source_number())
    return sources.select(
        "n",
        F.concat(F.when(n % 7 == 3, "Review of ").otherwise("Journal of "), F.col("source")).alias("full_name"),
        F.col("source").alias("abbreviation"),
        F.when(n % 6 == 0, "").otherwise(F.concat(code, F.lit("-0001"))).alias("issn_print"),
        F.when(n % 4 == 0, "").otherwise(F.concat(code, F.lit("-0002"))).alias("issn_online"),
    )


def impact_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact factors by ISSN; some journals appear under both of theirs."""
    base = journals(spark, sf_dir)
    n = F.col("n")
    first = base.select(
        F.when(n % 2 == 0, F.col("issn_print")).otherwise(F.col("issn_online")).alias("issn"),
        numbered_factor(n).alias("impact_factor"),
    )
    second = base.filter(n % 3 == 0).select(F.col("issn_online").alias("issn"), F.lit(1.0).alias("impact_factor"))
    return first.unionByName(second)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return articles_of(load(spark, sf_dir, "documents"))


def articles_of(documents: DataFrame) -> DataFrame:
    """Documents as articles: language is the topic, source the journal. Works on a stream as well."""
    return documents.select(
        F.col("doc_id").alias("pmid"),
        F.col("text").alias("abstract"),
        F.col("lang").alias("category"),
        F.col("source").alias("journal_abbrev"),
        numbered_factor(_source_number()).alias("impact_factor"),
        (F.lit(2004) + F.col("doc_id") % 15).cast("int").alias("year"),
    )


def article_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return article_fields_of(load(spark, sf_dir, "documents"))


def article_fields_of(documents: DataFrame) -> DataFrame:
    """Documents as field maps; some lack an abstract, history dates are repeated. Works on a stream as well."""
    a = articles_of(documents)
    date = F.concat(F.col("year").cast("string"), F.lit("/01/01"))
    later = F.concat((F.col("year") + 1).cast("string"), F.lit("/06/30"))
    entries = F.array(
        F.struct(F.lit("PMID").alias("tag"), F.array(F.col("pmid").cast("string")).alias("vals")),
        F.when(
            F.col("pmid") % 7 != 0,
            F.struct(F.lit("AB").alias("tag"), F.array("abstract").alias("vals")),
        ),
        F.struct(F.lit("TA").alias("tag"), F.array(F.upper("journal_abbrev")).alias("vals")),
        F.struct(F.lit("PHST").alias("tag"), F.array(date, later).alias("vals")),
    )
    return a.select("pmid", "category", F.map_from_entries(F.array_compact(entries)).alias("fields"))


def record_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tagged record texts with folded abstracts."""
    folded = F.replace(F.col("abstract"), F.lit("\n"), F.lit("\n      "))
    year = F.col("year").cast("string")
    return articles(spark, sf_dir).select(
        F.concat(
            F.lit("PMID- "), F.col("pmid").cast("string"),
            F.lit("\nAB  - "), folded,
            F.lit("\nTA  - "), F.col("journal_abbrev"),
            F.lit("\nPHST- "), year, F.lit("/01/01"),
            F.lit("\nPHST- "), (F.col("year") + 1).cast("string"), F.lit("/06/30"),
        ).alias("value")
    )


def masters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A journal master list that grows with the data: one journal per part."""
    k = F.col("p_partkey")
    key = k.cast("string")
    return load(spark, sf_dir, "part").select(
        k.alias("n"),
        F.concat(F.when(k % 7 == 3, "Review of ").otherwise("Journal of "), F.col("p_name"), F.lit(" "), key)
        .alias("full_name"),
        F.concat(F.lit("J "), F.col("p_name"), F.lit(" "), key).alias("abbreviation"),
        F.when(k % 6 == 0, "").otherwise(F.concat(key, F.lit("-0001"))).alias("issn_print"),
        F.when(k % 4 == 0, "").otherwise(F.concat(key, F.lit("-0002"))).alias("issn_online"),
    )


def master_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master list as record texts of tagged lines with one untagged line each."""
    return masters(spark, sf_dir).select(
        "n",
        F.concat(
            F.lit("JrId: "), F.col("n").cast("string"),
            F.lit("\nJournalTitle: "), F.col("full_name"),
            F.lit("\nMedAbbr: "), F.col("abbreviation"),
            F.lit("\nISSN (Print): "), F.col("issn_print"),
            F.lit("\nISSN (Online): "), F.col("issn_online"),
        ).alias("value"),
    )


def master_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Master list as numbered lines."""
    pieces = master_records(spark, sf_dir).select("n", F.posexplode(F.split("value", "\n")).alias("pos", "value"))
    return pieces.select((F.col("n") * 5 + F.col("pos")).alias("line_no"), "value")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact-factor listing pages of up to 100 journals with missing value cells."""
    n = F.col("n")

    def td(value: Column) -> Column:
        return F.concat(F.lit("<td>"), value, F.lit("</td>"))

    values = [
        td(F.when(n % 5 >= i, F.when(n % 2 == 0, "&nbsp;").otherwise("-"))
           .otherwise(F.concat((n % 40 + i).cast("string"), F.lit(".25"))))
        for i in range(1, 5)
    ]
    row = F.concat(
        F.lit("<tr>"), td(n.cast("string")),
        F.lit("<td><b>"), F.col("full_name"), F.lit("</b></td>\n"),
        td(F.when(n % 2 == 0, F.col("issn_print")).otherwise(F.col("issn_online"))),
        *values, F.lit("</tr>"),
    )
    rows = masters(spark, sf_dir).select(F.floor(n / 100).alias("page_no"), "n", row.alias("row"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "row"))), lambda r: r["row"]), "")
    return rows.groupBy("page_no").agg(
        F.concat(
            F.lit("<html><table><tr><th>No</th><th>Journal Name</th><th>ISSN</th></tr>"), body,
            F.lit("</table><!-- CONTENT ENDS HERE --></html>"),
        ).alias("html")
    )
