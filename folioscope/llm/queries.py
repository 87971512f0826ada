"""The thin queries: one per operator over its whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm import (
    exact_dedup, language_id, lexical_search, line_dedup, mixing, order_minhash, packing, pii, simhash, suffix_dedup,
    token_alignment, token_files, vector_dedup,
)
from folioscope.llm.common import documents
from folioscope.llm.registry import query


@query("op1_language_id")
def identify_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    apart = language_id.held_out(F.col("doc_id"))
    scored = language_id.identify(docs, docs.filter(~apart))
    return scored.select("doc_id", apart.alias("held_out"), "lang_pred", "score")


@query("op2_line_dedup", """
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, i AS pos, ls[i + 1] AS a, ls[i + 2] AS b, ls[i + 3] AS c
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l) WHERE ls[i + 1] <> '' OR ls[i + 2] <> '' OR ls[i + 3] <> ''),
f AS (SELECT a, b, c, min((doc_id, pos)) AS first FROM w GROUP BY a, b, c HAVING count(*) > 1),
covered AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS i FROM w JOIN f USING (a, b, c) WHERE (doc_id, pos) <> first),
rows_ AS (SELECT l.doc_id, n.i, ls[n.i + 1] AS line, c.i IS NOT NULL AS gone
  FROM (SELECT doc_id, ls, unnest(range(0, len(ls))) AS i FROM l) n JOIN l USING (doc_id, ls) LEFT JOIN covered c ON c.doc_id = n.doc_id AND c.i = n.i),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM rows_)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
  coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '') AS text FROM s GROUP BY doc_id""")
def dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rest = line_dedup.without_repeated_lines(docs)
    return rest.select(
        "doc_id", F.col("__llm_lines").alias("n_lines"), F.col("__llm_removed").alias("n_removed"),
        F.col("__llm_spans").alias("n_spans"), F.coalesce("text", F.lit("")).alias("text"))


def _spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


@query("op3_pii")
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, pii.KINDS), F.sha2(_spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _spans_text(F.col("spans")).alias("spans"))


@query("op4_order_minhash")
def fingerprint_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_minhash.fingerprints_with_neighbours(documents(spark, sf_dir))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", order_minhash.as_text(F.col("fp")).alias("fingerprint"),
        order_minhash.as_text(F.col("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


@query("op5_simhash_near_dedup")
def simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = simhash.near_duplicate_components(documents(spark, sf_dir), shingle=4, radius=4)
    return parts.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op6_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)""")
def exact_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir))


@query("op7_suffix_array_dedup")
def dedup_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = suffix_dedup.without_repeats(documents(spark, sf_dir))
    return rest.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))


@query("op8_best_fit_packing")
def pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir)).drop("h")


@query("op9_token_files")
def token_file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir))


# Domains of the mixture and target weights along the tree; paths that are not named weigh 1.
DOMAIN = "concat('d', cast(try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int) % 4 AS string))"
WEIGHTS = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d0", "en"): 3, ("d1", "en"): 3, ("d2", "en"): 3, ("d3", "en"): 3, ("d0", "en", "src0"): 2}


def _mix_sql(share: float, epochs: int) -> str:
    """The budgets level by level, then the prefix of each leaf's epoch."""
    def level(name: str, parent: str, above: str, keys: list[str], weight: str) -> str:
        part = f"PARTITION BY {', '.join(keys[:-1])}" if keys[:-1] else ""
        return f"""{name}_c AS (SELECT {', '.join(keys)}, sum(tokens)::BIGINT * {epochs} AS cap, {weight} AS w FROM leaf GROUP BY ALL),
{name}_r AS (SELECT c.*, least({above}, sum(cap) OVER ({part})) - coalesce(sum(cap) OVER ({part} ORDER BY cap / w, {keys[-1]}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS remain,
    sum(w) OVER ({part} ORDER BY cap / w, {keys[-1]} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open FROM {name}_c c {parent}),
{name}_m AS (SELECT *, max(CASE WHEN cap * open > remain * w THEN (remain / open, remain, open) END) OVER ({part}) AS rate FROM {name}_r),
{name} AS (SELECT {', '.join(keys)}, (CASE WHEN cap * open <= remain * w THEN cap ELSE w * rate[2] // rate[3] END)::BIGINT AS budget FROM {name}_m)"""

    words = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"
    return f"""WITH d AS (SELECT doc_id, 'd' || (CAST(regexp_extract(source, '([0-9]+)$', 1) AS INTEGER) % 4) AS domain, lang, source,
  {words}::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
total AS (SELECT floor(sum(tokens)::DOUBLE * {share})::BIGINT AS above FROM leaf),
{level("l1", "CROSS JOIN total", "above", ["domain"], "CASE domain WHEN 'd0' THEN 4 WHEN 'd1' THEN 3 WHEN 'd2' THEN 2 ELSE 1 END")},
{level("l2", "JOIN l1 USING (domain)", "budget", ["domain", "lang"], "CASE lang WHEN 'en' THEN 3 ELSE 1 END")},
{level("l3", "JOIN l2 USING (domain, lang)", "budget", ["domain", "lang", "source"], "CASE WHEN domain = 'd0' AND lang = 'en' AND source = 'src0' THEN 2 ELSE 1 END")},
b AS (SELECT d.*, budget AS leaf_budget, budget // tokens AS epochs, budget % tokens AS rest FROM d JOIN leaf USING (domain, lang, source) JOIN l3 USING (domain, lang, source)),
p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(doc_id || ':0:' || epochs), doc_id) - n_tokens AS start FROM b)
SELECT doc_id, domain, lang, source, n_tokens, leaf_budget, (epochs + CASE WHEN start < rest THEN 1 ELSE 0 END)::BIGINT AS times FROM p"""


@query("op10_mixing", _mix_sql(0.8, 2))
def mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    mixed = mixing.mix(docs, F.expr(DOMAIN), share=0.8, max_epochs=2, weights=WEIGHTS)
    return mixed.select(
        "doc_id", F.col("__mix_domain").alias("domain"), "lang", "source", F.col("__mix_tokens").alias("n_tokens"),
        F.col("__mix_budget").alias("leaf_budget"), F.col("__mix_times").alias("times"))


_ITEM_TERMS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query("op11_lexical_search", f"""
WITH dt AS (SELECT doc_id, unnest({_ITEM_TERMS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM dt GROUP BY ALL),
dn AS (SELECT doc_id, count(*) AS n FROM dt GROUP BY ALL),
s AS (SELECT count(*) AS docs, sum(n)::BIGINT AS words FROM dn),
m AS (SELECT doc_id, 100 - 75 + ((75 * n * docs) // words) AS m FROM dn, s),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2) / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY ALL), s),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_ITEM_TERMS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scored WHERE score > 0)
SELECT item_id, r::INTEGER AS rank, doc_id, score FROM ranked WHERE r <= 10""")
def search_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query("op12_token_alignment")
def align_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = token_alignment.default_paths()
    rows = token_alignment.staged_alignment(documents(spark, sf_dir), a, b)
    return token_alignment.with_link_counts(rows, token_alignment.b_size(b)).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query("op13_vector_dedup")
def dedup_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), threshold=0.98)
