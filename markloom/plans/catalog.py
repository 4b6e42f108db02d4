"""All queries of the library over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import relational as R
from . import markup, pairing, rows, stores, streams, wiki

FLAGSHIP = "locate_findings"


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(s, d):
    docs = _t(s, d, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))


def _spans(s, d):
    return _t(s, d, "events").selectExpr("user_id AS id", "event_id % 500 AS s", "event_id % 500 + 1 + cast(value AS bigint) % 5 AS e")


def _chunks(s, d):
    return _t(s, d, "conversations").selectExpr("conv_id AS article", "turn AS ord", "coalesce(text, '') AS text")


def q_merge_spans(s, d):
    return R.merge_spans(_spans(s, d))


def q_complement_spans(s, d):
    return R.complement_spans(_spans(s, d), _spans(s, d).selectExpr("id", "600L AS n").distinct())


def q_line_runs(s, d):
    return R.line_runs(_lines(s, d).selectExpr("doc_id AS id", "cast(n AS bigint) AS n", "length(line) > 80 AS hit"))


def q_assemble(s, d):
    return R.assemble(_chunks(s, d))


def q_locate_findings(s, d):
    f = _chunks(s, d).selectExpr("article", "ord AS finding", "ord * 2 AS line")
    return R.locate_findings(f, R.assemble(_chunks(s, d)))


def q_usage(s, d):
    return R.usage_by_model(_t(s, d, "events").selectExpr("event_type AS model", "user_id AS tokens", "value AS cost"))


def q_costs(s, d):
    e = _t(s, d, "events").selectExpr("event_id AS id", "event_type AS model", "user_id AS n_in", "event_id % 7 AS n_out", "CASE WHEN event_id % 5 = 0 THEN 1.5D END AS reported")
    return R.costs(e, s.createDataFrame([("click", 0.5, 2.0), ("view", 0.25, 1.0)], "model string, p_in double, p_out double"))


def q_resolve_cached(s, d):
    e = _t(s, d, "events")
    return R.resolve_cached(_t(s, d, "customer").selectExpr("c_custkey AS k"), e.where("event_id % 3 = 0").groupBy(F.col("user_id").alias("k")).agg(F.min("event_type").alias("v")), e.where("event_id % 50 = 0").groupBy(F.col("user_id").alias("k")).agg(F.max("event_type").alias("v")))


def q_upsert(s, d):
    e = _t(s, d, "events").selectExpr("user_id AS k", "event_type AS v", "ts AS created", "event_id AS seq")
    return R.upsert(e.where("seq % 2 = 0"), e.where("seq % 2 = 1"))


def q_cache_keys(s, d):
    return R.cache_keys(_t(s, d, "documents").selectExpr("doc_id AS id", "source AS model", "lang AS source_lang", "'sq' AS target_lang", "'s' AS skill_hash", "'' AS facts_hash", "coalesce(text, '') AS text"))


def q_recurring_terms(s, d):
    m = _chunks(s, d).select("article", F.col("ord").alias("chunk"), F.posexplode(F.split("text", " ")).alias("p", "term")).selectExpr("article", "chunk", "term", "chunk * 100000 + p AS pos")
    return R.recurring_terms(m)


def q_open_terms(s, d):
    """Recurring terms without those that the article's first turn has."""
    m = _chunks(s, d).select("article", F.col("ord").alias("chunk"), F.posexplode(F.split("text", " ")).alias("at", "term")).select("article", "chunk", "term", (F.col("chunk") * 100000 + F.col("at")).alias("pos"))
    return R.recurring_terms(m, m.where("chunk = 0").select("article", "term"))


def q_canonical_forms(s, d):
    e = _t(s, d, "events").groupBy(F.col("user_id").alias("finding"), F.col("event_type").alias("form")).agg(F.count("*").alias("n"), F.min("event_id").alias("ord"))
    return R.canonical_forms(e)


def q_restore_names(s, d):
    e = _t(s, d, "events")
    return R.restore_names(e.selectExpr("user_id AS article", "event_id AS pos", "event_id % 11 AS print"), e.where("event_id % 3 = 0").selectExpr("user_id AS article", "event_id % 11 AS print", "event_type AS name"))


def q_lost_templates(s, d):
    e = _t(s, d, "events").selectExpr("event_id", "user_id AS article", "event_type AS name")
    return R.lost_templates(e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))


def q_stale_claims(s, d):
    return R.stale_claims(_t(s, d, "events").selectExpr("event_id AS id", "user_id AS worker", "ts"))


def q_attempts(s, d):
    return R.attempts(_t(s, d, "events").where("event_type = 'click'").selectExpr("user_id AS article"))


def q_pending(s, d):
    e = _t(s, d, "events")
    return R.pending(_t(s, d, "customer").selectExpr("c_custkey AS article"), e.where("event_type = 'click'").selectExpr("user_id AS article"), e.where("event_id % 40 = 0").selectExpr("user_id AS article"))


def q_line_number(s, d):
    return _t(s, d, "documents").select("doc_id", T.line_number(F.col("text"), F.floor(F.length("text") / 2)).cast("long").alias("line"), T.snippet(F.col("text")).alias("snippet"))


def q_strip_html(s, d):
    return _t(s, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("text"), T.page_language(F.col("html")).alias("lang"))


def q_titles(s, d):
    return _t(s, d, "part").select("p_partkey", T.normal_title(F.col("p_name")).alias("title"), T.file_name(F.concat(F.lit(" a:b/"), "p_name")).alias("file"))


def q_link_targets(s, d):
    made = F.concat(F.lit("[["), F.element_at(F.split("p_name", " "), 1), F.lit("|x]] [[File:a]] [["), F.col("p_brand"), F.lit("#s]] [[ "), F.col("p_brand"), F.lit("]]"))
    return _t(s, d, "part").select("p_partkey", F.array_join(T.link_targets(made), "|").alias("targets"))


def q_same_article(s, d):
    p = _t(s, d, "pages")
    return p.select("page_id", T.same_article(F.col("html"), T.strip_html(F.col("html"))).alias("same"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")} | markup.QUERIES | pairing.QUERIES | wiki.QUERIES | stores.QUERIES | streams.QUERIES | rows.QUERIES

_SPANS = "(SELECT user_id AS id, event_id % 500 AS s, event_id % 500 + 1 + CAST(trunc(value) AS BIGINT) % 5 AS e FROM events)"
_MERGED = f"""(SELECT id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island
  FROM (SELECT *, max(e) OVER (PARTITION BY id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {_SPANS} x) y) z GROUP BY id, island)"""
_CHUNKS = "(SELECT conv_id AS article, turn AS ord, coalesce(text, '') AS text FROM conversations)"
_ASSEMBLED = f"""(WITH a AS (SELECT article, ord, text, last_value(nullif(text, '') IGNORE NULLS) OVER (PARTITION BY article ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {_CHUNKS}),
  b AS (SELECT *, CASE WHEN text <> '' AND before IS NOT NULL AND right(before, 1) <> chr(10) AND left(text, 1) <> chr(10) THEN 1 ELSE 0 END AS joint, length(text) - length(replace(text, chr(10), '')) AS breaks FROM a),
  c AS (SELECT *, sum(joint + breaks) OVER (PARTITION BY article ORDER BY ord ROWS UNBOUNDED PRECEDING) AS total FROM b)
  SELECT article, ord, CAST(1 + total - breaks AS BIGINT) AS first_line, CAST(CASE WHEN text = '' THEN total - breaks WHEN right(text, 1) = chr(10) THEN total ELSE 1 + total END AS BIGINT) AS last_line FROM c)"""

ORACLE_SQL = {
    "merge_spans": f"SELECT id, s, e FROM {_MERGED}",
    "complement_spans": f"""SELECT id, s, e FROM (SELECT id, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s, e), 0) AS s, s AS e
      FROM (SELECT id, s, e FROM {_MERGED} UNION ALL SELECT DISTINCT user_id, 600, 600 FROM events) u) g WHERE s < e""",
    "line_runs": """WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
      a AS (SELECT id, n, n - row_number() OVER (PARTITION BY id ORDER BY n) AS island FROM l WHERE length(line) > 80)
      SELECT id, CAST(min(n) AS BIGINT) AS first_line, CAST(max(n) AS BIGINT) AS last_line FROM a GROUP BY id, island""",
    "assemble": f"SELECT * FROM {_ASSEMBLED}",
    "locate_findings": f"SELECT f.article, f.ord AS finding, min(s.ord) AS ord FROM {_CHUNKS} f LEFT JOIN {_ASSEMBLED} s ON f.article = s.article AND f.ord * 2 BETWEEN s.first_line AND s.last_line GROUP BY f.article, f.ord",
    "usage": "SELECT event_type AS model, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY ROLLUP (event_type)",
    "costs": "SELECT event_id AS id, CASE WHEN event_id % 5 = 0 THEN 1.5::DOUBLE ELSE CASE event_type WHEN 'click' THEN user_id * 0.5::DOUBLE + (event_id % 7) * 2.0::DOUBLE WHEN 'view' THEN user_id * 0.25::DOUBLE + (event_id % 7) * 1.0::DOUBLE ELSE 0::DOUBLE END END AS cost FROM events",
    "resolve_cached": """SELECT c.c_custkey AS k, coalesce(l.v, x.v) AS v, (l.k IS NOT NULL OR x.k IS NOT NULL) AS checked FROM customer c
      LEFT JOIN (SELECT user_id AS k, min(event_type) AS v FROM events WHERE event_id % 3 = 0 GROUP BY user_id) x ON c.c_custkey = x.k
      LEFT JOIN (SELECT user_id AS k, max(event_type) AS v FROM events WHERE event_id % 50 = 0 GROUP BY user_id) l ON c.c_custkey = l.k""",
    "upsert": "SELECT user_id AS k, max_by(event_type, event_id) AS v, min(ts) AS created FROM events GROUP BY user_id",
    "cache_keys": "SELECT doc_id AS id, sha256(concat_ws(chr(0), source, lang, 'sq', 's', '', coalesce(text, ''))) AS cache_key FROM documents",
    "recurring_terms": f"""WITH m AS (SELECT article, ord AS chunk, unnest(string_split(text, ' ')) AS term, ord * 100000 + generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM {_CHUNKS}),
      a AS (SELECT article, term, count(DISTINCT chunk) AS n, min(pos) AS pos FROM m WHERE NOT regexp_full_match(term, '[0-9]+') AND NOT starts_with(term, '#') GROUP BY article, term HAVING count(DISTINCT chunk) >= 2)
      SELECT article, term, n, CAST(place AS INTEGER) AS place FROM (SELECT article, term, n, row_number() OVER (PARTITION BY article ORDER BY n DESC, pos) AS place FROM a) WHERE place <= 40""",
    "open_terms": f"""WITH m AS (SELECT article, ord AS chunk, unnest(string_split(text, ' ')) AS term, ord * 100000 + generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM {_CHUNKS}),
      a AS (SELECT article, term, count(DISTINCT chunk) AS n, min(pos) AS pos FROM m WHERE NOT regexp_full_match(term, '[0-9]+') AND NOT starts_with(term, '#') AND (article, term) NOT IN (SELECT (article, term) FROM m WHERE chunk = 0) GROUP BY article, term HAVING count(DISTINCT chunk) >= 2)
      SELECT article, term, n, CAST(place AS INTEGER) AS place FROM (SELECT article, term, n, row_number() OVER (PARTITION BY article ORDER BY n DESC, pos) AS place FROM a) WHERE place <= 40""",
    "canonical_forms": """SELECT finding, canonical FROM (SELECT finding, form AS canonical, count(*) OVER (PARTITION BY finding) AS k, row_number() OVER (PARTITION BY finding ORDER BY n DESC, ord) AS r
      FROM (SELECT user_id AS finding, event_type AS form, count(*) AS n, min(event_id) AS ord FROM events GROUP BY user_id, event_type)) WHERE k >= 2 AND r = 1""",
    "restore_names": """SELECT m.user_id AS article, m.event_id AS pos, o.name FROM events m JOIN (SELECT user_id AS article, event_id % 11 AS print, min(event_type) AS name FROM events WHERE event_id % 3 = 0 GROUP BY 1, 2 HAVING count(DISTINCT event_type) = 1) o
      ON m.user_id = o.article AND m.event_id % 11 = o.print""",
    "lost_templates": """SELECT article, name, had, has FROM (SELECT user_id AS article, event_type AS name, count(*) FILTER (WHERE event_id % 2 = 0) AS had, count(*) FILTER (WHERE event_id % 2 = 1) AS has FROM events GROUP BY 1, 2) WHERE has < had""",
    "stale_claims": "SELECT event_id AS id, user_id AS worker FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 HOURS",
    "attempts": "SELECT user_id AS article, count(*) AS n, count(*) >= 3 AS exhausted FROM events WHERE event_type = 'click' GROUP BY user_id",
    "pending": "SELECT DISTINCT c_custkey AS article FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'click' OR event_id % 40 = 0)",
    "line_number": """SELECT doc_id, CAST(1 + length(h) - length(replace(h, chr(10), '')) AS BIGINT) AS line, CASE WHEN length(t) > 120 THEN left(t, 120) || '…' ELSE t END AS snippet
      FROM (SELECT doc_id, left(text, length(text) // 2) AS h, replace(trim(text), chr(10), ' ') AS t FROM documents)""",
    "strip_html": "SELECT page_id, trim(regexp_replace(html, '<[^>]+>', '', 'g')) AS text, nullif(lower(regexp_extract(left(html, 5000), '(?i)<html[^>]*\\slang=[\"'']?([A-Za-z-]+)', 1)), '') AS lang FROM pages",
    "titles": "SELECT p_partkey, upper(left(p_name, 1)) || substr(p_name, 2) AS title, regexp_replace(replace(trim(' a:b/' || p_name), ' ', '_'), '[\\\\/:*?\"<>|]', '_', 'g') AS file FROM part",
    "link_targets": "SELECT p_partkey, CASE WHEN w = b THEN b ELSE w || '|' || b END AS targets FROM (SELECT p_partkey, split_part(p_name, ' ', 1) AS w, split_part(p_brand, '#', 1) AS b FROM part)",
    "same_article": "SELECT page_id, strlen(trim(regexp_replace(html, '<[^>]+>', '', 'g'))) / strlen(html) BETWEEN 0.65 AND 1.5 AS same FROM pages",
} | markup.ORACLE_SQL | pairing.ORACLE_SQL | wiki.ORACLE_SQL | stores.ORACLE_SQL | streams.ORACLE_SQL | rows.ORACLE_SQL
