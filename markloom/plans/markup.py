"""Queries of the markup functions and record operators, and their DuckDB SQL.

The test tables hold no markup, so each query builds it from their columns
with an expression that both engines read the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import markup as M
from ..operators import layout as L, records as R


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


_TEXT = "coalesce(text, '')"
_SECTIONS = f"{_TEXT} || chr(10) || '== ' || source || ' ==' || chr(10) || left({_TEXT}, 300) || chr(10) || '=== ' || lang || ' ===' || chr(10)"
_COMPLEX = f"{_TEXT} || repeat('{{{{x}}}}<ref>', CAST(doc_id % 9 AS INT)) || CASE WHEN doc_id % 10 = 0 THEN '{{{{ Infobox a' ELSE '' END"
_PARAMS = "'{{{' || replace(p_name, ' ', '1|}}} {{{ ') || '2|}}} {{{3|}}} {{{' || replace(p_name, ' ', '|}}} {{{') || '}}}'"
_NEEDLE = f"substr({_TEXT}, CAST(floor(length({_TEXT}) / 3) AS INT) + 1, 12)"
_LISTS = "'{{ ' || CASE p_size % 4 WHEN 0 THEN 'Notes List' WHEN 1 THEN 'nls' WHEN 2 THEN 'notesx' ELSE 'EfnList' END || ' |' || p_name || '}}'"
_QUOTES = "p_name || '{{ `}}' || p_brand || '{{''\"}}{{x}}'"
_LEAKS = f"{_TEXT} || CASE doc_id % 3 WHEN 0 THEN ' As an AI language model I cannot translate' WHEN 1 THEN ' {{{{përkthyer NGA|en' ELSE '' END"
_ERRORS = "CASE event_id % 4 WHEN 0 THEN 'HTTP 429' WHEN 1 THEN 'line 14290' WHEN 2 THEN 'Rate_Limit ' || event_type ELSE event_type END"
_ARCHIVE = "'a https://web.archive.org/web/2020/01/2020-01-29133126/https://web.archive.org/web/2020-01-29/133126/http://' || p_brand || ' b https://web.archive.org/web/20200129133126/http://c'"
_NOTES = "p_name || chr(10) || ' {{Redirect-x|' || p_brand || '|{{y}}}} ' || chr(10) || 'z {{redirect|a}}'"
_REFS = """CASE p_size % 5 WHEN 0 THEN 'https://SQ.m.wikipedia.org/wiki/A_%C3%ABb+' || p_brand WHEN 1 THEN 'sq: ' || p_name WHEN 2 THEN 'Category:' || p_name WHEN 3 THEN ' zh-hans:' || p_name || ' ' ELSE 'http://en.wikipedia.org/wiki/X?a=1' END"""
_ATTRIBUTED = "p_name || chr(10) || CASE WHEN p_size % 3 > 0 THEN chr(10) || '<!--' || chr(10) || 'NUK ËSHTË PJESË' || chr(10) || '{{Përkthyer nga|en|' || p_name || '|1 maj|' || p_partkey || '}}' ELSE '' END"
_ANSWER = """CASE event_id % 4 WHEN 0 THEN 'So: ```json' || chr(10) || '{"a": 7.9, "b": "x"}' || chr(10) || '``` {no}' WHEN 1 THEN 'x {"a": ' || event_id || '} y' WHEN 2 THEN 'none' ELSE '{"b": 1}' END"""
_LINE = "CASE event_id % 3 WHEN 0 THEN 'u' || chr(9) || 'DONE' || chr(9) || 'review=' || event_type || chr(9) || 'm@p' WHEN 1 THEN 'u' || chr(9) || 'DONE' ELSE 'u' || chr(9) || 'FAILED' END"


def q_sections(s, d):
    cut = _t(s, d, "documents", "doc_id", f"{_SECTIONS} AS x").select("doc_id", F.posexplode(M.sections(F.col("x"))).alias("ord", "text"))
    return cut.select("doc_id", F.col("ord").cast("long"), M.section_level(F.col("text")).cast("long").alias("level"), M.section_title(F.col("text")).alias("title"), "text")


def q_complexity(s, d):
    return _t(s, d, "documents", "doc_id", f"{_COMPLEX} AS x").select("doc_id", M.tokens(F.col("x")).cast("long").alias("tokens"), M.is_complex(F.col("x")).alias("complex"))


def q_declared_params(s, d):
    return _t(s, d, "part", "p_partkey", f"{_PARAMS} AS x").select("p_partkey", F.array_join(F.array_sort(M.declared_params(F.col("x"))), "|").alias("params"))


def q_ref_fingerprint(s, d):
    from ..functions.text import fingerprint

    f = fingerprint(F.col("html"))
    return _t(s, d, "pages", "page_id", "html").select("page_id", F.array_join(f["urls"], "|").alias("urls"), F.array_join(f["digits"], "|").alias("digits"))


def q_locate_needle(s, d):
    found = _t(s, d, "documents", "doc_id", f"{_TEXT} AS x", f"{_NEEDLE} AS needle").select("doc_id", M.locate(F.col("x"), F.col("needle")).alias("f"))
    return found.select("doc_id", F.col("f.line").cast("long").alias("line"), "f.snippet")


def q_plain_notelists(s, d):
    return _t(s, d, "part", "p_partkey", f"{_LISTS} AS x").select("p_partkey", M.plain_notelists(F.col("x")).alias("text"))


def q_plain_quotes(s, d):
    return _t(s, d, "part", "p_partkey", f"{_QUOTES} AS x").select("p_partkey", M.plain_quotes(F.col("x")).alias("text"))


def q_leaks(s, d):
    return _t(s, d, "documents", "doc_id", f"{_LEAKS} AS x").select("doc_id", F.explode(M.leaks(F.col("x"))).alias("marker"))


def q_usage_limit(s, d):
    return _t(s, d, "events", "event_id", f"{_ERRORS} AS x").select("event_id", M.is_usage_limit(F.col("x")).alias("limited"))


def q_truncated(s, d):
    e = _t(s, d, "events", "event_id", "CASE WHEN event_id % 9 = 0 THEN 'max_tokens' WHEN event_id % 9 > 1 THEN 'end' END AS stop", "event_id % 4000 AS visible", "user_id * 40 AS chars")
    return e.select("event_id", M.is_truncated(F.col("stop"), F.col("visible"), F.col("chars")).alias("truncated"))


def q_archive_urls(s, d):
    return _t(s, d, "part", "p_partkey", f"{_ARCHIVE} AS x").select("p_partkey", M.archive_urls(F.col("x")).alias("text"))


def q_redirect_notes(s, d):
    return L.without_redirect_notes(_t(s, d, "part", "p_partkey AS id", f"{_NOTES} AS text")).select(F.col("id").alias("p_partkey"), "text")


def q_source_refs(s, d):
    return _t(s, d, "part", "p_partkey", f"{_REFS} AS x").select("p_partkey", M.source_ref(F.col("x")).alias("r")).select("p_partkey", "r.lang", "r.title")


def q_bundle_hash(s, d):
    return _t(s, d, "documents", "doc_id", f"{_TEXT} AS x", "lang", "source").select("doc_id", M.bundle_hash(F.col("x"), F.col("lang"), F.col("source")).alias("hash"))


def q_attribution(s, d):
    return _t(s, d, "part", "p_partkey", f"{_ATTRIBUTED} AS x").select("p_partkey", M.attribution(F.col("x")).alias("a")).select("p_partkey", "a.body", "a.revid")


def q_attribution_date(s, d):
    return _t(s, d, "orders", "o_orderkey", "o_orderdate").select("o_orderkey", M.attribution_date(F.col("o_orderdate")).alias("day"))


def q_partial_chunks(s, d):
    c = _t(s, d, "conversations", "conv_id", "turn", "role", f"{_TEXT} AS x", "CASE turn % 3 WHEN 0 THEN 'repaired' WHEN 1 THEN 'pending' ELSE 'failed' END AS status")
    return c.select("conv_id", "turn", M.shown_or_pending(F.col("status"), F.col("role"), F.col("x")).alias("text"))


def q_judge_scores(s, d):
    return _t(s, d, "events", "event_id", f"{_ANSWER} AS x").select("event_id", M.score(F.col("x"), "a").alias("a"), M.score(F.col("x"), "b").alias("b"))


def q_progress(s, d):
    e = _t(s, d, "events", "event_id", "event_id % 101 AS done", "100L AS total", "value")
    return e.select("event_id", M.eta(F.col("done"), F.col("total"), F.col("value")).alias("eta"), M.is_milestone(F.col("done"), F.col("total")).alias("milestone"))


def q_retries(s, d):
    e = _t(s, d, "events", "event_id", "event_id % 10 + 1 AS n", "CASE event_id % 4 WHEN 0 THEN 402 WHEN 1 THEN 429 WHEN 2 THEN 503 ELSE 200 END AS code", "CASE WHEN event_id % 3 = 0 THEN 'Quota' ELSE 'x' END AS said")
    return e.select("event_id", M.backoff(F.col("n")).alias("wait"), M.is_retryable(F.col("code"), F.col("said")).alias("again"))


def q_reviewed_lines(s, d):
    return _t(s, d, "events", "event_id", "event_type", f"{_LINE} AS x").select("event_id", M.marked_reviewed(F.col("x"), F.col("event_type")).alias("line"))


def q_language_breakdown(s, d):
    return R.language_breakdown(_t(s, d, "documents", "lang || ', ,' || source || ',' || lang AS langs"))


def q_footnotes(s, d):
    return R.reconcile_footnotes(_t(s, d, "events", "user_id AS article", "event_id % 7 AS key", "event_id AS pos", "CASE WHEN event_id % 3 > 0 THEN event_type END AS ps"))


def q_established(s, d):
    return R.established(_t(s, d, "events", "user_id AS article", "event_type AS title", "'d' || event_id AS display", "event_id AS seq"))


def q_compare_engines(s, d):
    return R.compare_engines(_t(s, d, "events", "event_type AS model", "value AS runtime", "user_id AS tokens", "event_id % 4 = 0 AS hit", "event_id % 90 = 0 AND event_type = 'click' AS failed"))


def q_sitelinks(s, d):
    answers = _t(s, d, "part", "upper(left(p_name, 1)) || substr(p_name, 2) AS title", "CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS target", "p_partkey").where("p_partkey % 3 = 0")
    return R.sitelinks(_t(s, d, "part", "p_name AS title"), answers.groupBy("title").agg(F.min("target").alias("target")))


_SITES = "CASE event_id % 5 WHEN 0 THEN 'enwiki' WHEN 1 THEN 'commonswiki' WHEN 2 THEN 'dewiki' WHEN 3 THEN 'frwikiquote' ELSE event_type || 'wiki' END"


def q_edition_counts(s, d):
    return R.edition_counts(_t(s, d, "customer", "c_custkey AS entity"), _t(s, d, "events", "user_id AS entity", f"{_SITES} AS site"), "enwiki")


def q_over_limits(s, d):
    return R.over_limits(_t(s, d, "events", "user_id AS article", "event_id AS seq", "event_id % 11 AS n_in", "event_id % 67 AS n_out"), total=3000)


def q_store_hits(s, d):
    return R.with_hits(_t(s, d, "customer", "c_custkey AS k", "c_name AS v", "c_custkey % 3 AS hits"), _t(s, d, "events", "user_id AS k"))


def q_store_present(s, d):
    return R.present(_t(s, d, "customer", "c_custkey AS k", "c_name AS v"), _t(s, d, "events", "user_id AS k"))


_INPUT = "CASE event_id % 4 WHEN 0 THEN ' # no' WHEN 1 THEN '  ' ELSE ' ' || event_type END"


def q_input_titles(s, d):
    return R.input_titles(_t(s, d, "events", "event_id AS n", f"{_INPUT} AS value"))


def q_existing(s, d):
    c = lambda *x: _t(s, d, "customer", "c_custkey AS k", *x)
    return R.existing(c("'t' || c_custkey AS title"), c("'t' || c_custkey AS src", "'T' || c_custkey AS dst").where("k % 2 = 0"), c("'T' || c_custkey AS src", "'p' || c_nationkey || '#x' AS dst").where("k % 4 = 0"), _t(s, d, "nation", "'p' || n_nationkey AS title").where("title <> 'p3'"))


def q_review_index(s, d):
    return R.review_index(_t(s, d, "events", "'a|' || user_id AS title", "event_id AS seq", "event_type || '|' || event_id AS note"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_MARKERS = ", ".join("('" + m.replace("'", "''") + "')" for m in M.LEAK_MARKERS)
_OUT = ", ".join(f"'{s}'" for s in (*R.NON_EDITIONS, "enwiki"))
_DAYS = "[" + ", ".join(f"'{m}'" for m in M.MONTHS) + "]"

ORACLE_SQL = {
    "sections": f"""WITH c AS (SELECT doc_id, list_filter(string_split(regexp_replace({_SECTIONS}, '(?m)^(={{1,6}}[^=\\n][^\\n]*=[ \\t]*)$', chr(1) || '\\1', 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS a FROM documents),
      u AS (SELECT doc_id, unnest(a) AS text, generate_subscripts(a, 1) - 1 AS ord FROM c)
      SELECT doc_id, CAST(ord AS BIGINT) AS ord, text, CASE WHEN ord = 0 AND left(text, 1) <> '=' THEN 0 WHEN left(text, 3) = '===' THEN 3 ELSE 2 END AS level, CASE WHEN left(text, 1) = '=' THEN trim(split_part(text, chr(10), 1), '= ') ELSE 'Lead' END AS title FROM u""",
    "complexity": f"""WITH c AS (SELECT doc_id, {_COMPLEX} AS x FROM documents), n AS (SELECT *, len(regexp_extract_all(x, '[A-Za-z0-9_]+|[^A-Za-z0-9_\\s]')) AS t, len(string_split(x, '{{{{')) - 1 AS b, len(string_split(x, '<ref')) - 1 AS r, len(string_split(x, '|-')) - 1 AS w FROM c)
      SELECT doc_id, CAST(t AS BIGINT) AS tokens, contains(x, '{{{{ Infobox') OR (t > 0 AND (w >= 5 OR r * 1000 > t * 15 OR b * 1000 > t * 30)) AS complex FROM n""",
    "declared_params": f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all({_PARAMS}, '\\{{\\{{\\{{\\s*([A-Za-z_][A-Za-z0-9_]*)\\s*[|}}]', 1), lambda n: regexp_replace(n, '[0-9]+$', '')))), '|') AS params FROM part",
    "ref_fingerprint": "SELECT page_id, array_to_string(regexp_extract_all(html, 'https?://[^\\s|\\]}<]+'), '|') AS urls, array_to_string(regexp_extract_all(regexp_replace(html, 'https?://[^\\s|\\]}<]+', ' ', 'g'), '[0-9]+'), '|') AS digits FROM pages",
    "locate_needle": f"""WITH a AS (SELECT doc_id, {_TEXT} AS x, nullif(instr({_TEXT}, {_NEEDLE}), 0) AS p, {_NEEDLE} AS n FROM documents), b AS (SELECT *, trim(split_part(substr(x, p), chr(10), 1)) AS r FROM a WHERE n <> '')
      SELECT d.doc_id, CAST(len(string_split(left(x, p - 1), chr(10))) AS BIGINT) AS line, CASE WHEN length(r) > 120 THEN left(r, 119) || '…' ELSE r END AS snippet FROM documents d LEFT JOIN b USING (doc_id)""",
    "plain_notelists": "SELECT p_partkey, CASE p_size % 4 WHEN 2 THEN '{{ notesx |' ELSE '{{ notelist |' END || p_name || '}}' AS text FROM part",
    "plain_quotes": "SELECT p_partkey, p_name || '`' || p_brand || '''\"{{x}}' AS text FROM part",
    "leaks": f"SELECT doc_id, m AS marker FROM (SELECT doc_id, lower({_LEAKS}) AS x FROM documents) d, (VALUES {_MARKERS}) v(m) WHERE contains(x, lower(m))",
    "usage_limit": "SELECT event_id, event_id % 4 IN (0, 2) AS limited FROM events",
    "truncated": "SELECT event_id, event_id % 9 = 0 OR (event_id % 4000 >= 2000 AND user_id * 40 < event_id % 4000) AS truncated FROM events",
    "archive_urls": "SELECT p_partkey, 'a https://web.archive.org/web/20200129133126/http://' || p_brand || ' b https://web.archive.org/web/20200129133126/http://c' AS text FROM part",
    "redirect_notes": "SELECT p_partkey, p_name || chr(10) || 'z {{redirect|a}}' AS text FROM part",
    "source_refs": """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'sq' WHEN 1 THEN 'sq' WHEN 3 THEN 'zh-hans' WHEN 4 THEN 'en' END AS lang,
      CASE p_size % 5 WHEN 0 THEN 'A ëb+' || split_part(p_brand, '#', 1) WHEN 2 THEN 'Category:' || p_name WHEN 4 THEN 'X' ELSE p_name END AS title FROM part""",
    "bundle_hash": f"SELECT doc_id, left(sha256(concat_ws(chr(0), {_TEXT}, lang, source)), 16) AS hash FROM documents",
    "attribution": "SELECT p_partkey, p_name || CASE WHEN p_size % 3 > 0 THEN '' ELSE chr(10) END AS body, CASE WHEN p_size % 3 > 0 THEN p_partkey END AS revid FROM part",
    "attribution_date": f"SELECT o_orderkey, day(o_orderdate) || ' ' || ({_DAYS})[month(o_orderdate)] || ' ' || year(o_orderdate) AS day FROM orders",
    "partial_chunks": f"SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN {_TEXT} WHEN 1 THEN '<!-- pending: ' || role || ' (pending) -->' ELSE '<!-- pending: ' || role || ' (failed) -->' END AS text FROM conversations",
    "judge_scores": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 7 WHEN 1 THEN CAST(event_id AS INTEGER) ELSE 0 END AS a, CASE event_id % 4 WHEN 3 THEN 1 ELSE 0 END AS b FROM events",
    "progress": "SELECT event_id, CASE WHEN d > 0 AND value > 0 THEN (100 - d) * value / d END AS eta, d = 100 OR d % 10 = 0 AS milestone FROM (SELECT *, event_id % 101 AS d FROM events)",
    "retries": "SELECT event_id, least(pow(2, event_id % 10), 60)::DOUBLE AS wait, event_id % 4 = 2 OR (event_id % 4 = 1 AND event_id % 3 > 0) AS again FROM events",
    "reviewed_lines": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'u' || chr(9) || 'DONE' || chr(9) || 'm@p' || chr(9) || 'review=' || event_type WHEN 1 THEN 'u' || chr(9) || 'DONE' || chr(9) || 'review=' || event_type ELSE 'u' || chr(9) || 'FAILED' END AS line FROM events",
    "language_breakdown": "SELECT lang, count(*) AS n FROM (SELECT trim(unnest(string_split(lang || ', ,' || source || ',' || lang, ','))) AS lang FROM documents) WHERE lang <> '' GROUP BY lang",
    "footnotes": """SELECT article, pos, first, ps IS DISTINCT FROM first AS changed FROM (SELECT user_id AS article, event_id AS pos, ps, first_value(ps) OVER (PARTITION BY user_id, event_id % 7 ORDER BY event_id) AS first
      FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN event_type END AS ps FROM events))""",
    "established": "SELECT user_id AS article, event_type AS title, 'd' || min(event_id) AS display FROM events GROUP BY user_id, event_type",
    "compare_engines": """WITH m AS (SELECT event_type AS model, count(*) AS calls, round(sum(value), 4) AS runtime, CAST(sum(user_id) AS BIGINT) AS tokens, count(*) FILTER (WHERE event_id % 4 = 0) AS hits, count(*) FILTER (WHERE event_id % 90 = 0 AND event_type = 'click') AS failures FROM events GROUP BY 1)
      SELECT *, failures = 0 AND (SELECT count(*) FROM m WHERE failures = 0) >= 2 AS judged FROM m""",
    "sitelinks": """WITH a AS (SELECT upper(left(p_name, 1)) || substr(p_name, 2) AS title, min(CASE WHEN p_partkey % 2 = 0 THEN p_brand END) AS target FROM part WHERE p_partkey % 3 = 0 GROUP BY 1)
      SELECT DISTINCT p_name AS title, a.target, a.title IS NOT NULL AS checked FROM part LEFT JOIN a ON upper(left(p_name, 1)) || substr(p_name, 2) = a.title""",
    "edition_counts": f"SELECT c_custkey AS entity, count(DISTINCT site) AS n FROM customer LEFT JOIN (SELECT user_id, {_SITES} AS site FROM events) e ON c_custkey = user_id AND site LIKE '%wiki' AND site NOT IN ({_OUT}) GROUP BY c_custkey",
    "over_limits": """SELECT article, min(seq) AS seq FROM (SELECT user_id AS article, event_id AS seq, sum(event_id % 11) OVER w AS i, sum(event_id % 67) OVER w AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
      WHERE (i > 0 AND o > 5 * i) OR i + o > 3000 GROUP BY article""",
    "store_hits": "SELECT c_custkey AS k, c_name AS v, c_custkey % 3 + coalesce(n, 0) AS hits FROM customer LEFT JOIN (SELECT user_id, count(*) AS n FROM events GROUP BY user_id) r ON c_custkey = user_id",
    "store_present": "SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey IN (SELECT user_id FROM events)",
    "input_titles": "SELECT event_id AS n, event_type AS title FROM events WHERE event_id % 4 >= 2",
    "existing": """SELECT 't' || c_custkey AS title, CASE WHEN c_custkey % 4 = 0 AND c_nationkey <> 3 THEN 'p' || c_nationkey END AS page, c_custkey % 4 = 0 AND c_nationkey <> 3 AS found FROM customer""",
    "review_index": """SELECT title, max(seq) AS seq, '| ' || replace(title, '|', '\\|') || ' | ' || replace(max_by(note, seq), '|', '\\|') || ' |' AS row FROM (SELECT 'a|' || user_id AS title, event_id AS seq, event_type || '|' || event_id AS note FROM events) GROUP BY title""",
}
