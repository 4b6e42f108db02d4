"""Queries of the pairing operators and structure functions, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import structure as S, wiki as M
from ..operators import pairing as P, wikitext as T


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


def _e(s, d, where: str, *columns: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").where(where).selectExpr(*columns)


_BODY = "'b ' || CASE WHEN event_id % 4 = 0 THEN ' ' ELSE '' END || event_type"
_BLOCK = """CASE p_size % 4 WHEN 0 THEN chr(10) || '== R ==' || chr(10) || '<ref name="' || p_name || '">' || p_brand || '</ref>' || chr(10) || '<!-- x --></references>' WHEN 1 THEN '== R ==' || chr(10) || 'text <ref>a</ref>' WHEN 2 THEN '<ref>' || p_name || '</ref> ' ELSE '<ref name="a" />' END"""
_MADE = "CASE WHEN p_size % 3 = 0 THEN '== T ==' || chr(10) || 'y' ELSE 'z' END"
_TRAILING = """'<references><ref>a</ref></references>' || chr(10) || '<ref name="' || p_name || '">b</ref> <!-- c -->' || chr(10) || '<REF>d</ref> end'"""
_RESETS = "'Limit · resets ' || (event_id % 14) || CASE WHEN event_id % 2 = 0 THEN ':1' || (event_id % 10) ELSE '' END || CASE WHEN event_id % 3 = 0 THEN 'am' ELSE ' PM' END"
_BRACES = "coalesce(text, '') || chr(10) || CASE doc_id % 5 WHEN 0 THEN 'a {{b}} {{c' WHEN 1 THEN '}} {{d}}' WHEN 2 THEN '}}{{' WHEN 3 THEN '{{e|{{f}}' ELSE '{{g}}' END"
_HEADED = "coalesce(text, '') || chr(10) || '== A ==' || chr(10) || '=== B ===' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'c -->' ELSE '<pre>' END || chr(10) || '== D ==' || chr(10) || '</pre>' || chr(10) || '== E =='"
_REPLY = """'Here: {"click": " k' || event_id || ' ", "view": 3, "purchase": "", "other": "x"' || CASE WHEN event_id % 5 = 0 THEN '' ELSE '}' END"""
_QUEUE = ("event_id AS line", "CASE WHEN event_id % 3 > 0 THEN 'en' END AS lang", "'T ' || event_id AS title", "CASE event_id % 4 WHEN 0 THEN 'DONE' WHEN 1 THEN 'CLAIMED' WHEN 2 THEN 'FAILED' ELSE '' END AS status")


def q_excerpts(s, d):
    made = _e(s, d, "event_id % 2 = 0", "user_id AS article", "event_id AS pos", "'p' || event_id % 7 AS title")
    source = _e(s, d, "event_id % 2 = 1", "user_id AS article", "event_id AS pos", "'p' || event_id % 9 AS title")
    return P.excerpts(made, source, _t(s, d, "nation", "'p' || n_nationkey AS title").where("title IN ('p0', 'p2', 'p4', 'p5', 'p8')"))


def q_group_names(s, d):
    return P.group_names(_e(s, d, "event_id % 2 = 0", "user_id AS article", "'g' || event_id % 3 AS grp"), _e(s, d, "event_id % 7 = 0", "user_id AS article", "'g' || event_id % 4 AS grp"))


def q_orphan_definitions(s, d):
    keys = ("user_id AS article", "event_type AS name")
    return P.orphan_definitions(_e(s, d, "event_id % 2 = 0", *keys, "event_id AS pos"), _e(s, d, "event_id % 40 = 1", *keys), _e(s, d, "event_id % 5 = 0", *keys, "event_id AS pos", "'b' || event_id AS body"))


def q_unsupported_reuses(s, d):
    keys = ("user_id AS article", "event_type AS name")
    return P.unsupported_reuses(_e(s, d, "event_id % 2 = 0", *keys, "event_id AS pos"), _e(s, d, "event_id % 40 = 1", *keys), _t(s, d, "customer", "c_custkey AS article", "CASE WHEN c_custkey % 2 = 0 THEN 'the clicks' ELSE 'a view' END AS text"))


def q_list_duplicates(s, d):
    keys = ("user_id AS article", "event_type AS name")
    made = _e(s, d, "event_id % 2 = 0", *keys, "event_id AS pos", "event_id % 3 = 0 AS in_list", "CASE WHEN event_id % 5 = 0 THEN 'g' END AS grp")
    return P.list_duplicates(made, _e(s, d, "event_id % 9 = 1", *keys, "event_id % 4 > 0 AS in_list"))


def q_route_findings(s, d):
    f = _t(s, d, "conversations", "conv_id AS article", "turn AS finding", "CASE WHEN turn % 2 = 0 THEN substr(text, 20, 7) ELSE 'no such name' END AS name")
    return P.route_findings(f, _t(s, d, "conversations", "conv_id AS article", "turn AS ord", "coalesce(text, '') AS text"))


def q_queue_results(s, d):
    return P.queue_results(_t(s, d, "events", *_QUEUE), _e(s, d, "event_id % 2 = 0", "'en' AS lang", "' T_' || event_id AS title", "event_id % 6 = 0 AS ok", "event_id AS seq"), "en")


def q_answered_inputs(s, d):
    return P.answered_inputs(_t(s, d, "customer", "'en' AS lang", "c_custkey AS title", "c_custkey % 5 = 0 AS is_file"), _e(s, d, "event_id % 3 = 0", "user_id AS title"))


def q_plans_to_run(s, d):
    return P.plans_to_run(_t(s, d, "events", "event_id AS article", "event_id % 10 = 0 AS failed", "user_id AS source_bytes", "CASE WHEN event_id % 3 > 0 THEN event_id % 200 END AS target_bytes"))


def q_unreviewed(s, d):
    extra = "CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN event_type || chr(9) || 'review=x' ELSE event_type || chr(9) || 'note' END AS extra"
    return P.unreviewed(_t(s, d, "events", "event_id AS n", "'u' || event_id AS url", "CASE WHEN event_id % 4 > 0 THEN 'DONE' ELSE 'FAILED' END AS status", extra), "click")


def q_conflicting_definitions(s, d):
    keys = ("user_id AS article", "event_id % 3 AS name")
    return P.conflicting_definitions(_e(s, d, "true", *keys, "event_id AS pos", f"{_BODY} AS body"), _e(s, d, "event_id % 11 = 0", *keys, f"{_BODY} AS body"))


def q_stray_lists(s, d):
    return P.stray_lists(_t(s, d, "events", "user_id AS article", "event_type AS kind", "CASE WHEN event_id % 3 > 0 THEN 'g' END AS grp", "event_id AS pos", "event_id % 4 = 0 AS under_notes"), _e(s, d, "event_id % 8 = 0", "user_id AS article", "event_type AS kind", "CASE WHEN event_id % 3 > 0 THEN 'g' END AS grp"))


def q_template_params(s, d):
    store = _t(s, d, "customer", "c_custkey AS k", "CASE c_custkey % 3 WHEN 0 THEN '[]' WHEN 1 THEN '[\"a\",\"' || c_name || '\"]' END AS v").where("k % 2 = 0")
    return P.template_params(_t(s, d, "customer", "c_custkey AS k"), store).select("k", F.array_join("params", "|").alias("params"))


def q_glossary(s, d):
    return P.glossary(_t(s, d, "events", "event_id AS article", f"{_REPLY} AS reply"), _t(s, d, "events", "event_id AS article", "event_type AS term"))


def q_verified_facts(s, d):
    mentions = _t(s, d, "events", "user_id AS article", "event_id AS chunk", "event_type AS title")
    facts = _e(s, d, "event_id % 20 = 0", "user_id AS article", "event_type AS title", "'t' || event_type AS target").distinct()
    texts = _t(s, d, "events", "user_id AS article", "event_id AS chunk", "event_type || 'ed x' AS text")
    return P.verified_facts(mentions, facts, texts, _t(s, d, "customer", "c_custkey AS article", "'ked' AS term", "c_name AS rendering"))


def q_unbalanced(s, d):
    return P.unbalanced(_t(s, d, "documents", "doc_id AS id", f"{_BRACES} AS text"))


def q_spaced_headings(s, d):
    return P.spaced_headings(_t(s, d, "documents", "doc_id AS id", f"{_HEADED} AS text"))


def q_reference_blocks(s, d):
    p = _t(s, d, "part", "p_partkey", f"{_BLOCK} AS x", f"{_MADE} AS y")
    return T.mapped(p, lambda x, y: (M.is_reference_only(x), M.source_reference_block(x, y)), "only boolean, text string", "x", "y").drop("x", "y")


def q_extended_references(s, d):
    return T.mapped(_t(s, d, "part", "p_partkey", f"{_TRAILING} AS x"), lambda x: (M.extended_references(x),), "text string", "x").drop("x")


def q_ages(s, d):
    o = _t(s, d, "orders", "o_orderkey", "CAST(o_orderdate AS DATE) AS a", "CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3000 AS INT) AS b")
    return o.select("o_orderkey", S.age(F.col("a"), F.col("b")).alias("age"))


def q_reset_waits(s, d):
    return _t(s, d, "events", "event_id", "ts", f"{_RESETS} AS x").select("event_id", S.reset_wait(F.col("x"), F.date_trunc("second", "ts")).cast("long").alias("wait"))


def q_tiers(s, d):
    e = _t(s, d, "events", "event_id", "event_id % 3 = 0 AS hard", "event_type AS model", "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'big' WHEN 3 THEN 'huge' END AS large")
    return e.select("event_id", S.tier(F.col("hard"), F.col("model"), F.col("large")).alias("model"))


_NAMED = "'<ref name=\"' || role || turn % 4 || '\"> x'"
_SAID = "CASE WHEN turn % 3 = 0 THEN 'Gabim: “' || upper(role) || turn % 5 || '” again' WHEN turn % 3 = 1 THEN 'Moduli:X' ELSE 'harvc in ' || role END"
_FINDING = "CASE WHEN turn % 7 = 6 THEN 'harvc_used' WHEN turn % 3 = 0 THEN 'cite_error' WHEN turn % 2 = 0 THEN 'unexpanded_template' ELSE 'lua_script_error' END"


def q_route_messages(s, d):
    findings = _t(s, d, "conversations", "conv_id AS article", "turn AS finding", f"{_FINDING} AS kind", "CASE WHEN turn % 7 = 6 AND conv_id % 2 = 0 THEN turn END AS line", f"{_SAID} AS message")
    return P.route_messages(findings, _t(s, d, "conversations", "conv_id AS article", "turn AS ord", f"{_NAMED} AS text", "CASE WHEN turn % 2 = 0 THEN 'none' END AS made"))


_KIND = "CASE WHEN event_id % 4 = 0 THEN 'template' ELSE 'link' END"


def q_fact_lines(s, d):
    mentions = _t(s, d, "events", "user_id AS article", "event_id % 7 AS chunk", f"{_KIND} AS kind", "concat(event_type, event_id % 3) AS title")
    facts = _e(s, d, "event_id % 5 > 0", "user_id AS article", f"{_KIND} AS kind", "concat(event_type, event_id % 3) AS title", "CASE WHEN event_id % 13 = 0 THEN concat('Stampa:', event_id) END AS target")
    renderings = _e(s, d, "event_id % 9 = 0", "user_id AS article", "concat(event_type, event_id % 3) AS title", "concat('r', event_id) AS rendering")
    editions = _t(s, d, "nation", "concat('click', n_nationkey % 3) AS title", "CAST(n_regionkey AS BIGINT) * (n_nationkey % 3) AS n")
    params = _t(s, d, "nation", "concat('view', n_nationkey % 3) AS title", "array('a', n_name) AS params")
    return P.fact_lines(mentions, facts, renderings, editions, params)


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SQUASHED = f"trim(regexp_replace({_BODY}, '\\s+', ' ', 'g'))"
_YEARS = "(year(b) - year(a) - CASE WHEN month(b) * 100 + day(b) < month(a) * 100 + day(a) THEN 1 ELSE 0 END)"

ORACLE_SQL = {
    "excerpts": """WITH m AS (SELECT user_id AS article, event_id AS pos, 'p' || event_id % 7 AS title, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events WHERE event_id % 2 = 0 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      s AS (SELECT user_id AS article, 'p' || event_id % 9 AS title, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id) AS k FROM events WHERE event_id % 2 = 1 WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
      j AS (SELECT m.article, m.pos, m.title, coalesce(s.title, m.title) AS original FROM m LEFT JOIN s USING (article, n, k))
      SELECT article, pos, original, CASE WHEN title IN ('p0', 'p2', 'p4', 'p5', 'p8') THEN 'kept' WHEN original IN ('p0', 'p2', 'p4', 'p5', 'p8') THEN 'renamed' ELSE 'noted' END AS outcome FROM j""",
    "group_names": """WITH a AS (SELECT user_id AS article, list_distinct(list('g' || event_id % 3) FILTER (WHERE event_id % 2 = 0)) AS m, list_distinct(list('g' || event_id % 4) FILTER (WHERE event_id % 7 = 0)) AS s FROM events GROUP BY 1),
      b AS (SELECT *, list_filter(m, lambda x: NOT list_contains(s, x)) AS new, list_filter(s, lambda x: NOT list_contains(m, x)) AS lost FROM a WHERE s IS NOT NULL AND m IS NOT NULL)
      SELECT article, unnest(new) AS grp, CASE WHEN len(s) = 1 THEN s[1] ELSE lost[1] END AS becomes FROM b WHERE len(s) = 1 OR (len(new) = 1 AND len(lost) = 1)""",
    "orphan_definitions": """SELECT user_id AS article, event_type AS name, min(event_id) FILTER (WHERE event_id % 2 = 0) AS pos, 'b' || min(event_id) FILTER (WHERE event_id % 5 = 0) AS body FROM events GROUP BY 1, 2
      HAVING pos IS NOT NULL AND body IS NOT NULL AND count(*) FILTER (WHERE event_id % 40 = 1) = 0""",
    "unsupported_reuses": """SELECT user_id AS article, event_type AS name, event_id AS pos FROM events e WHERE event_id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id % 40 = 1 AND o.user_id = e.user_id AND o.event_type = e.event_type)
      AND user_id IN (SELECT c_custkey FROM customer) AND event_type <> CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END""",
    "list_duplicates": """SELECT user_id AS article, event_type AS name, event_id AS pos FROM events WHERE event_id % 2 = 0 AND event_id % 3 <> 0 AND event_id % 5 <> 0
      AND (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE event_id % 9 = 1 GROUP BY user_id, event_type HAVING bool_and(event_id % 4 > 0)) AND (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE event_id % 6 = 0)""",
    "route_findings": """WITH f AS (SELECT conv_id, turn, (SELECT min(c.turn) FROM conversations c WHERE c.conv_id = f.conv_id AND contains(coalesce(c.text, ''), CASE WHEN f.turn % 2 = 0 THEN substr(f.text, 20, 7) ELSE 'no such name' END)) AS ord FROM conversations f)
      SELECT f.conv_id AS article, f.turn AS finding, c.turn AS ord FROM f JOIN conversations c ON c.conv_id = f.conv_id AND (f.ord IS NULL OR c.turn = f.ord)""",
    "queue_results": """SELECT event_id AS line, CASE WHEN event_id % 6 = 0 THEN 'DONE' WHEN event_id % 2 = 0 AND event_id % 4 = 2 THEN 'FAILED' ELSE CASE event_id % 4 WHEN 0 THEN 'DONE' WHEN 1 THEN 'CLAIMED' WHEN 2 THEN 'FAILED' ELSE '' END END AS status FROM events""",
    "answered_inputs": "SELECT 'en' AS lang, c_custkey AS title FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey IN (SELECT user_id FROM events WHERE event_id % 3 = 0)",
    "plans_to_run": "SELECT event_id AS article FROM events WHERE event_id % 10 <> 0 AND NOT (event_id % 3 > 0 AND user_id <> 0 AND event_id % 200 >= 0.65 * user_id AND event_id % 200 <= 1.5 * user_id)",
    "unreviewed": "SELECT event_id AS n, 'u' || event_id AS url FROM events WHERE event_id % 4 > 0 AND event_id % 3 <> 1 AND event_type = 'click'",
    "conflicting_definitions": f"""WITH m AS (SELECT user_id AS article, event_id % 3 AS name, event_id AS pos, {_SQUASHED} AS b, first_value({_SQUASHED}) OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id) AS first FROM events)
      SELECT article, name, pos FROM m WHERE b <> first AND (article, name) IN (SELECT (user_id, event_id % 3) FROM events WHERE event_id % 11 = 0 GROUP BY user_id, event_id % 3 HAVING count(DISTINCT {_SQUASHED}) = 1)""",
    "stray_lists": """SELECT article, kind, grp, pos FROM (SELECT user_id AS article, event_type AS kind, CASE WHEN event_id % 3 > 0 THEN 'g' END AS grp, event_id AS pos, row_number() OVER (PARTITION BY user_id, event_type, event_id % 3 > 0 ORDER BY event_id % 4 = 0 DESC, event_id DESC) AS place,
      count(*) FILTER (WHERE event_id % 8 = 0) OVER (PARTITION BY user_id, event_type, event_id % 3 > 0) AS n FROM events) WHERE place > n""",
    "template_params": "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'a|' || c_name END END AS params FROM customer",
    "glossary": "SELECT event_id AS article, 'click' AS term, 'k' || event_id AS rendering FROM events WHERE event_type = 'click' AND event_id % 5 <> 0",
    "verified_facts": """SELECT user_id AS article, event_id AS chunk, 'link' AS kind, event_type AS name, 't' || event_type AS value FROM events WHERE (user_id, event_type) IN (SELECT (user_id, event_type) FROM events WHERE event_id % 20 = 0)
      UNION ALL SELECT user_id, event_id, 'term', 'ked', c_name FROM events JOIN customer ON c_custkey = user_id WHERE contains(event_type || 'ed x', 'ked')""",
    "route_messages": f"""WITH f AS (SELECT conv_id AS article, turn AS finding, {_FINDING} AS kind, CASE WHEN turn % 7 = 6 AND conv_id % 2 = 0 THEN turn END AS line, {_SAID} AS message FROM conversations),
      g AS (SELECT * FROM f WHERE line IS NULL AND NOT (kind IN ('lua_script_error', 'unexpanded_template') AND contains(lower(message), 'harvc') AND article IN (SELECT article FROM f WHERE kind = 'harvc_used' AND line IS NOT NULL))
        AND NOT (kind = 'unexpanded_template' AND contains(lower(message), 'moduli:'))),
      r AS (SELECT conv_id AS article, turn AS ord, regexp_extract({_NAMED}, 'name="([^"]*)"', 1) AS name FROM conversations),
      t AS (SELECT g.article, g.finding, min(r.ord) AS ord FROM g JOIN r ON g.article = r.article AND g.kind = 'cite_error' AND r.name = lower(regexp_extract(g.message, '“([^”]*)”', 1)) GROUP BY ALL)
      SELECT article, ord, min(finding) AS finding, targeted FROM (SELECT g.article, c.turn AS ord, g.finding, g.kind, g.message, t.ord IS NOT NULL AS targeted FROM g LEFT JOIN t USING (article, finding) JOIN conversations c ON c.conv_id = g.article AND c.turn = coalesce(t.ord, c.turn)) GROUP BY article, ord, kind, message, targeted""",
    "fact_lines": f"""WITH e AS (SELECT *, {_KIND} AS kind, event_type || event_id % 3 AS title FROM events),
      f AS (SELECT user_id, kind, title, max(CASE WHEN event_id % 13 = 0 THEN 'Stampa:' || event_id END) AS target FROM e WHERE event_id % 5 > 0 GROUP BY ALL),
      r AS (SELECT user_id, title, max('r' || event_id) AS rendering FROM e WHERE event_id % 9 = 0 GROUP BY ALL),
      n AS (SELECT 'click' || n_nationkey % 3 AS title, max(n_regionkey * (n_nationkey % 3)) AS n FROM nation GROUP BY 1), p AS (SELECT 'view' || n_nationkey % 3 AS title, 'a, ' || max(n_name) AS params FROM nation GROUP BY 1)
      SELECT DISTINCT e.user_id AS article, event_id % 7 AS chunk, e.kind, e.title,
        CASE WHEN target IS NOT NULL THEN 'confirmed' WHEN e.kind = 'template' THEN 'missing' WHEN rendering IS NOT NULL THEN 'established' WHEN n > 0 THEN 'elsewhere' WHEN n = 0 THEN 'nowhere' ELSE 'missing' END AS state,
        CASE WHEN e.kind = 'link' THEN coalesce(target, rendering, CAST(n AS VARCHAR)) WHEN target IS NOT NULL THEN substr(target, 8) || coalesce(': ' || params, '') END AS value
      FROM e JOIN f ON f.user_id = e.user_id AND f.kind = e.kind AND f.title = e.title LEFT JOIN r ON r.user_id = e.user_id AND r.title = e.title LEFT JOIN n ON n.title = e.title LEFT JOIN p ON p.title = e.title""",
    "unbalanced": """WITH x AS (SELECT doc_id, coalesce(text, '') AS t, doc_id % 5 AS m FROM documents WHERE doc_id % 5 IN (0, 1, 3))
      SELECT doc_id AS id, CASE m WHEN 1 THEN 1 ELSE 2 END AS opened, CASE m WHEN 1 THEN 2 ELSE 1 END AS closed, CAST(length(t) + 1 + CASE m WHEN 0 THEN 8 ELSE 0 END AS BIGINT) AS at, CAST(length(t) - length(replace(t, chr(10), '')) + 2 AS BIGINT) AS line FROM x""",
    "spaced_headings": """WITH x AS (SELECT doc_id, coalesce(text, '') AS t, regexp_matches(string_split(coalesce(text, ''), chr(10))[-1], '\\S') AS gap FROM documents)
      SELECT doc_id AS id, t || chr(10) || CASE WHEN gap THEN chr(10) ELSE '' END || '== A ==' || chr(10) || '=== B ===' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'c -->' ELSE '<pre>' END || chr(10) || '== D ==' || chr(10) || '</pre>' || chr(10) || chr(10) || '== E ==' AS text,
      CASE WHEN gap THEN 2 ELSE 1 END AS added FROM x""",
    "reference_blocks": """SELECT p_partkey, p_size % 4 = 2 AS only, CASE WHEN p_size % 4 = 0 THEN CASE WHEN p_size % 3 = 0 THEN '== T ==' ELSE '== R ==' END || chr(10) || '<ref name="' || p_name || '">' || p_brand || '</ref>' || chr(10) || '<!-- x --></references>'
      WHEN p_size % 3 = 0 THEN '== T ==' || chr(10) || 'y' ELSE 'z' END AS text FROM part""",
    "extended_references": """SELECT p_partkey, '<references><ref>a</ref><ref name="' || p_name || '">b</ref> <!-- c -->' || chr(10) || '<REF>d</ref>' || chr(10) || '</references> end' AS text FROM part""",
    "ages": f"""WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS a, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3000 AS INT) AS b FROM orders), y AS (SELECT *, {_YEARS} AS y, date_diff('day', CAST(a + to_years(CAST({_YEARS} AS INT)) AS DATE), b) AS n FROM o)
      SELECT o_orderkey, concat_ws(', ', CASE WHEN y <> 0 THEN y || ' vjet' END, CASE WHEN n <> 0 OR y = 0 THEN n || ' ditë' END) AS age FROM y""",
    "reset_waits": """WITH e AS (SELECT event_id, date_trunc('second', ts) AS now, event_id % 14 AS h, CASE WHEN event_id % 2 = 0 THEN 10 + event_id % 10 ELSE 0 END AS m, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 12 END AS half FROM events),
      l AS (SELECT event_id, h, CAST((h % 12 + half) * 3600 + m * 60 - date_diff('second', date_trunc('day', now), now) AS BIGINT) AS n FROM e), w AS (SELECT event_id, h, CASE WHEN n <= 0 THEN n + 86400 ELSE n END + 90 AS wait FROM l)
      SELECT event_id, CASE WHEN h BETWEEN 1 AND 12 AND wait <= 21600 THEN wait END AS wait FROM w""",
    "tiers": "SELECT event_id, CASE WHEN event_id % 3 = 0 AND event_id % 4 = 1 THEN 'big' WHEN event_id % 3 = 0 AND event_id % 4 = 3 THEN 'huge' ELSE event_type END AS model FROM events",
}
