"""Shared pieces of the check queries (DuckDB SQL)."""

from __future__ import annotations

from folioscope.functions.text import TOKEN_SEPARATORS

JOURNALS = """journals AS (
  SELECT n, CASE WHEN n % 7 = 3 THEN 'Review of ' ELSE 'Journal of ' END || source AS full_name,
         source AS abbreviation,
         CASE WHEN n % 6 = 0 THEN '' ELSE lpad(CAST(n AS VARCHAR), 4, '0') || '-0001' END AS issn_print,
         CASE WHEN n % 4 = 0 THEN '' ELSE lpad(CAST(n AS VARCHAR), 4, '0') || '-0002' END AS issn_online
  FROM (SELECT DISTINCT source, CAST(substr(source, 4) AS INTEGER) AS n FROM documents))"""

IMPACT = """impact_list AS (
  SELECT CASE WHEN n % 2 = 0 THEN issn_print ELSE issn_online END AS issn,
         CASE WHEN n % 5 = 0 THEN NULL ELSE round(CAST(n AS DOUBLE) * CAST(0.9 AS DOUBLE) + CAST(0.5 AS DOUBLE), 3) END AS impact_factor
  FROM journals
  UNION ALL
  SELECT issn_online, CAST(1.0 AS DOUBLE) FROM journals WHERE n % 3 = 0)"""

ARTICLES = JOURNALS + """, articles AS (
  SELECT d.doc_id AS pmid, d.text AS abstract, d.lang AS category, d.source AS journal_abbrev,
         CASE WHEN j.n % 5 = 0 THEN NULL ELSE round(CAST(j.n AS DOUBLE) * CAST(0.9 AS DOUBLE) + CAST(0.5 AS DOUBLE), 3) END AS impact_factor,
         CAST(2004 + d.doc_id % 15 AS INTEGER) AS year
  FROM documents d JOIN journals j ON d.source = j.abbreviation)"""

BAND = """CASE WHEN impact_factor IS NULL THEN NULL WHEN impact_factor <= 2.5 THEN 0 WHEN impact_factor <= 5 THEN 1
  WHEN impact_factor <= 10 THEN 2 WHEN impact_factor <= 15 THEN 3 ELSE 4 END"""

MASTERS = """masters AS (
  SELECT p_partkey AS n,
         CASE WHEN p_partkey % 7 = 3 THEN 'Review of ' ELSE 'Journal of ' END || p_name || ' ' || p_partkey AS full_name,
         'J ' || p_name || ' ' || p_partkey AS abbreviation,
         CASE WHEN p_partkey % 6 = 0 THEN '' ELSE p_partkey || '-0001' END AS issn_print,
         CASE WHEN p_partkey % 4 = 0 THEN '' ELSE p_partkey || '-0002' END AS issn_online
  FROM part)"""

TOKENS = f"""tok AS (
  SELECT doc_id, pos, word FROM (
    SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
    FROM (SELECT doc_id, string_split_regex(lower(text), '{TOKEN_SEPARATORS}') AS ws FROM documents))
  WHERE word <> '')"""


def split(table: str, key: str, chunk_rows: int = 50_000, name: str = "splits") -> str:
    """CTE (key, chunk, split) of the positional split."""
    return f"""{name} AS (
  SELECT {key}, chunk,
         CASE WHEN pos < round_even(0.1 * sz, 0) THEN 'dev'
              WHEN pos < round_even(0.1 * sz, 0) + round_even(0.1 * sz, 0) THEN 'test' ELSE 'train' END AS split
  FROM (SELECT {key}, chunk, pos, CAST(count(*) OVER (PARTITION BY chunk) AS DOUBLE) AS sz
        FROM (SELECT {key}, i // {chunk_rows} AS chunk, i % {chunk_rows} AS pos
              FROM (SELECT {key}, row_number() OVER (ORDER BY {key}) - 1 AS i FROM {table}))))"""


def vocabulary(source: str = "tok", name: str = "vocab") -> str:
    """CTE (word, n, idx): frequency rank, ties by first appearance."""
    return f"""{name} AS (
  SELECT word, n, CAST(row_number() OVER (ORDER BY n DESC, first_seen) AS INTEGER) AS idx
  FROM (SELECT word, count(*) AS n, min((doc_id, pos)) AS first_seen FROM {source} GROUP BY word))"""


# Per (model, vec_id): label, prediction and rank of the true label for three vector classifiers.
VECTOR_MODELS = split("embeddings", "vec_id") + """,
base AS (SELECT vec_id, label, split, unnest(CAST(embedding AS DOUBLE[])) AS v, generate_subscripts(embedding, 1) AS dim
         FROM embeddings JOIN splits USING (vec_id)),
unit AS (SELECT vec_id, label, split, dim, v / sqrt(sum(v * v) OVER (PARTITION BY vec_id)) AS v FROM base),
cb AS (SELECT label AS c, dim, avg(v) AS w FROM base WHERE split = 'train' GROUP BY 1, 2),
sb AS (SELECT vec_id, label, split, c, sum(v * w) AS s FROM base JOIN cb USING (dim) GROUP BY 1, 2, 3, 4),
cu AS (SELECT label AS c, dim, avg(v) AS w FROM unit WHERE split = 'train' GROUP BY 1, 2),
su AS (SELECT vec_id, label, split, c, sum(v * w) AS s FROM unit JOIN cu USING (dim) GROUP BY 1, 2, 3, 4),
stack AS (SELECT vec_id, label, split, dim, v FROM base UNION ALL SELECT vec_id, label, split, 1000 + c, s FROM sb),
cs AS (SELECT label AS c, dim, avg(v) AS w FROM stack WHERE split = 'train' GROUP BY 1, 2),
ss AS (SELECT vec_id, label, split, c, sum(v * w) AS s FROM stack JOIN cs USING (dim) GROUP BY 1, 2, 3, 4),
scores AS (SELECT 'baseline' AS model, * FROM sb UNION ALL SELECT 'multitask', * FROM su
           UNION ALL SELECT 'embedding', * FROM ss),
ordered AS (SELECT *, row_number() OVER (PARTITION BY model, vec_id ORDER BY s DESC, c) AS r FROM scores),
ranks AS (SELECT model, vec_id, any_value(split) AS split, any_value(label) AS label_idx,
                 min(CASE WHEN r = 1 THEN c END) AS predicted,
                 min(CASE WHEN c = label THEN r END) AS true_rank
          FROM ordered GROUP BY model, vec_id),
ncls AS (SELECT count(DISTINCT label) AS nc FROM embeddings)"""


def curve(groups: str, source: str, step: int, name: str = "curve") -> str:
    """CTE (groups..., k, coverage, accuracy) of the coverage curve over rank rows."""
    return f"""{name} AS (
  SELECT {groups}, k, (k + 1) / CAST(any_value(nc) AS DOUBLE) AS coverage,
         avg(CASE WHEN true_rank <= k THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy
  FROM {source} CROSS JOIN (SELECT nc, CAST(unnest(range(0, nc, {step})) AS INTEGER) AS k FROM ncls) g
  GROUP BY {groups}, k)"""


def counted_curve(groups: str, source: str, step: int, name: str = "curve") -> str:
    """`curve` over (groups..., true_rank, n) histograms."""
    return f"""{name} AS (
  SELECT {groups}, k, (k + 1) / CAST(any_value(nc) AS DOUBLE) AS coverage,
         CAST(coalesce(sum(n) FILTER (true_rank <= k), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS accuracy
  FROM {source} CROSS JOIN (SELECT nc, CAST(unnest(range(0, nc, {step})) AS INTEGER) AS k FROM ncls) g
  GROUP BY {groups}, k)"""


def metrics(groups: str, source: str, digits: int, name: str = "perf", curve_name: str = "curve") -> str:
    """CTE (groups..., accuracy, auc, k90) of (groups..., true_rank, n) histograms, the first two rounded."""
    return f"""{name} AS (
  SELECT {groups}, accuracy, auc, k90 FROM
    (SELECT {groups}, round(CAST(coalesce(sum(n) FILTER (true_rank = 1), 0) AS DOUBLE) / CAST(sum(n) AS DOUBLE), {digits}) AS accuracy FROM {source} GROUP BY {groups}) a
    JOIN (SELECT {groups}, round(sum((coverage - x0) * (accuracy + y0) / 2), {digits}) AS auc,
                 min(CASE WHEN accuracy > 0.9 THEN k END) AS k90
          FROM (SELECT *, lag(coverage) OVER (PARTITION BY {groups} ORDER BY k) AS x0,
                       lag(accuracy) OVER (PARTITION BY {groups} ORDER BY k) AS y0 FROM {curve_name})
          GROUP BY {groups}) b USING ({groups}))"""


def with_(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body
