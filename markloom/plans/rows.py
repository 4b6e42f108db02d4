"""Queries of languages, data templates, figures of a run and the bucketed store, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators import expansion, languages
from ..sources.buckets import Store
from ..sources.shared import new_path
from ..streaming import figures


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


_HEADER = "CASE WHEN page_id % 5 = 0 THEN 'de-AT, en' WHEN page_id % 5 = 1 THEN '' END"
_HTML = "CASE WHEN page_id % 3 > 0 THEN replace(html, ' lang=', ' x=') ELSE html END"


def q_guessed_languages(s, d):
    docs = _t(s, d, "documents", "doc_id AS id", "text", "lang")
    return languages.guessed(docs.select("id", "text"), languages.profiles(docs)).withColumnRenamed("id", "doc_id")


def q_page_languages(s, d):
    return languages.page_languages(_t(s, d, "pages", "page_id AS id", f"{_HEADER} AS header", f"{_HTML} AS html"), languages.profiles(_t(s, d, "documents", "text", "lang"))).withColumnRenamed("id", "page_id")


_DATA = "CASE p_size % 4 WHEN 0 THEN 'n {{Popolazione|' || p_brand || '}} {{none|x}}' WHEN 1 THEN '{{box|' || p_name || '|k=' || p_size || '}} {{ Box }}' WHEN 2 THEN '{{loop|' || p_size || '}} {{box|{{popolazione|a}}}}' ELSE p_name END"


def q_expanded_data(s, d):
    number = _t(s, d, "region", "'popolazione' AS name", "concat('<', r_name, ':{{{1}}}>') AS body").where("body LIKE '<ASIA%'")
    others = _t(s, d, "region", "explode(map('Box', '[{{popolazione|{{{1|d}}}}}/{{{k|0}}}/{{{x}}}]', 'loop', 'l{{loop2}}', 'loop2', '{{loop}}')) AS (name, body)").distinct()
    return expansion.expanded(_t(s, d, "part", "p_partkey AS id", f"{_DATA} AS text"), number.unionByName(others)).withColumnRenamed("id", "p_partkey")


def q_run_figures(s, d):
    usage = _t(s, d, "events", "event_id", "user_id AS tokens", "value AS cost").where("event_id % 3 > 0")
    seen = figures.written_with_figures(usage, new_path(s, "usage"), *figures.usage_metrics())
    return s.createDataFrame([(seen["calls"], seen["tokens"], seen["cost"])], "calls long, tokens long, cost double")


def _store(s, d) -> Store:
    store = Store(s, f"store_{uuid.uuid4().hex[:8]}", 8)
    store.create(_t(s, d, "orders", "o_custkey AS k", "o_orderpriority AS v", "o_orderkey AS seq").where("k % 3 > 0"))
    return store


def q_bucket_gets(s, d):
    return _store(s, d).get(_t(s, d, "customer", "c_custkey AS k"))


def q_bucket_upserts(s, d):
    store = _store(s, d)
    store.count_hits(_t(s, d, "events", "user_id AS k"))
    store.upsert(_t(s, d, "customer", "c_custkey AS k", "c_mktsegment AS v", "c_custkey + 7 AS seq").where("k % 2 = 0"))
    return store.rows()


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}


def _grams(texts: str, by: str) -> str:
    """SQL of the ranked trigrams of a table expression (by, text)."""
    return f"""SELECT * FROM (SELECT {by}, gram, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, gram) AS rank FROM (SELECT {by}, gram, count(*) AS n
      FROM (SELECT {by}, unnest(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])) AS gram FROM (SELECT {by}, string_split(lower(trim(regexp_replace(text, '[ \\t\\r\\n\\f]+', ' ', 'g'))), '') AS c FROM {texts})) GROUP BY ALL)) WHERE rank <= 300"""


def _guess(texts: str) -> str:
    """SQL of the nearest language of each text of a table expression (id, text)."""
    return f"""SELECT id, arg_min(lang, (far, lang)) AS lang FROM (SELECT o.id, p.lang, sum(abs(o.rank - p.rank) - 300) AS far FROM ({_grams(f"(SELECT * FROM {texts} WHERE length(trim(text)) >= 50)", "id")}) o
      JOIN ({_grams("(SELECT lang, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)", "lang")}) p ON o.gram = p.gram GROUP BY o.id, p.lang) GROUP BY id"""


ORACLE_SQL = {
    "guessed_languages": f"SELECT d.doc_id, g.lang FROM documents d LEFT JOIN ({_guess('(SELECT doc_id AS id, text FROM documents)')}) g ON d.doc_id = g.id",
    "page_languages": f"""WITH p AS (SELECT page_id AS id, nullif(split_part(split_part({_HEADER}, ',', 1), '-', 1), '') AS said, nullif(lower(regexp_extract(left(h, 5000), '(?i)<html[^>]*\\slang=["'']?([A-Za-z]+)', 1)), '') AS own,
        left(trim(regexp_replace(regexp_replace(left(h, 20000), '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f]+', ' ', 'g')), 2000) AS text FROM (SELECT page_id, {_HTML} AS h FROM pages)),
      g AS ({_guess("(SELECT id, text FROM p WHERE said IS NULL AND own IS NULL)")})
      SELECT p.id AS page_id, coalesce(said, own, g.lang) AS lang, CASE WHEN said IS NOT NULL THEN 'header' WHEN own IS NOT NULL THEN 'page' WHEN g.lang IS NOT NULL THEN 'text' END AS source FROM p LEFT JOIN g ON p.id = g.id""",
    "expanded_data": """WITH RECURSIVE x AS (SELECT p_partkey, 0 AS i, CASE p_size % 4 WHEN 0 THEN 'n {{Popolazione|' || p_brand || '}} {{none|x}}' WHEN 1 THEN '{{box|' || p_name || '|k=' || p_size || '}} {{ Box }}' WHEN 2 THEN '{{loop|' || p_size || '}} {{box|{{popolazione|a}}}}' ELSE p_name END AS text, p_size FROM part
        UNION ALL SELECT p_partkey, i + 1, regexp_replace(regexp_replace(regexp_replace(text, '\\{\\{[Pp]opolazione\\|([^{}|]*)\\}\\}', '<ASIA:\\1>', 'g'), '\\{\\{ ?[Bb]ox\\|([^{}|]*)\\|k=([^{}|]*)\\}\\}', '[{{popolazione|\\1}}/\\2/{{{x}}}]'), '\\{\\{ ?[Bb]ox(?:\\|([^{}|]*)| )\\}\\}', '[{{popolazione|' || CASE WHEN p_size % 4 = 1 THEN 'd' ELSE '\\1' END || '}}/0/{{{x}}}]'), p_size FROM x WHERE i < 6)
      SELECT p_partkey, text, CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 3 ELSE 0 END::BIGINT AS n, CASE WHEN p_size % 4 = 2 THEN 1 ELSE 0 END::BIGINT AS "left" FROM x WHERE i = 6""",
    "run_figures": "SELECT count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 4) AS cost FROM events WHERE event_id % 3 > 0",
    "bucket_gets": "SELECT c_custkey AS k, v FROM customer LEFT JOIN (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) AS v FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1) s ON s.k = c_custkey",
    "bucket_upserts": """WITH s AS (SELECT o_custkey AS k, max_by(o_orderpriority, o_orderkey) AS v, min(o_orderkey) AS created FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1), n AS (SELECT * FROM customer WHERE c_custkey % 2 = 0), h AS (SELECT user_id, count(*) AS hits FROM events GROUP BY 1)
      SELECT coalesce(k, c_custkey) AS k, coalesce(c_mktsegment, v) AS v, coalesce(created, c_custkey + 7) AS created, CASE WHEN k IS NULL THEN 0 ELSE coalesce(hits, 0) END AS hits FROM s FULL JOIN n ON k = c_custkey LEFT JOIN h ON user_id = k""",
}
