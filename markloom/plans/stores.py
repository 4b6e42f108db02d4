"""Queries of stores, reports and the engine surface, and their DuckDB SQL; the engine is a local, deterministic one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import articles as A, engine as E, relational as R, stores as S
from ..sources import files, snapshots
from ..sources.shared import new_path


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


def _local(fn):
    return lambda: E.LocalEngine(fn)


def _sq(text: str) -> str:
    return "sq:" + text


def _closed(text: str) -> str:
    return text + "]]" if text.count("[[") > text.count("]]") else text


def _faults(text: str) -> str:
    return '[{"message": "wrong word", "severity": "Warning", "snippet": "bad"}]' if "bad" in text else "no faults"


def _mend(text: str) -> str:
    return text.replace("bad", "good")


_CHUNK = "CASE WHEN p_size % 5 = 0 THEN '<ref>' || p_name || '</ref>' ELSE p_name || ' [[' || p_brand || ']]' END"
_STORED = "CASE WHEN p_partkey % 9 = 0 THEN 'old {{' ELSE 'old ' || p_name END"
_HTML = """'<p><strong class="x scribunto-error">Script error: <b>' || p_brand || '</b></strong><span class="error mw-ext-cite-error">Gabim <i>ref</i> ' || p_size || '</span><span class="cite_error">Gabim ref ' || p_size || '</span> Country data ' || p_brand || ' x</p>'"""
_REPORT = "'# ' || p_name || chr(10) || CASE p_size % 3 WHEN 0 THEN '## Review' || chr(10) || 'old' || chr(10) || '## Next' || chr(10) || 'n' WHEN 1 THEN '<!--' || chr(10) || 'NUK ËSHTË PJESË x' ELSE 'end' || chr(10) END"
_STATE = "CASE WHEN turn % 3 = 0 THEN 'a [[' || role ELSE 'fine ' || role END"


def q_row_count(s, d):
    return S.row_count(_t(s, d, "customer", "c_custkey AS k"))


def q_recached(s, d):
    store = _t(s, d, "customer", "c_custkey AS k", "c_name AS v", "c_acctbal AS created", "0L AS seq").where("k % 3 > 0")
    return S.recached(store, _t(s, d, "customer", "c_custkey AS k", "c_mktsegment AS v", "1L AS seq").where("k % 2 = 0"))


def q_merged_usage(s, d):
    each = lambda odd: _t(s, d, "events", "event_type AS model", "user_id AS tokens", "value AS cost").where(f"tokens % 2 = {odd}").groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("cost").alias("cost"))
    return R.merge_usage(each(0), each(1)).select("model", "calls", "tokens", F.round("cost", 4).alias("cost"))


def q_partial_articles(s, d):
    return S.partial_articles(_t(s, d, "conversations", "conv_id AS article", "turn AS ord", "role AS section", "CASE turn % 3 WHEN 0 THEN 'cached' WHEN 1 THEN 'pending' ELSE 'translated' END AS status", "text"))


def q_stats_line(s, d):
    return S.stats_line(_t(s, d, "orders", "o_orderstatus AS model", "o_custkey AS tokens", "o_totalprice AS cost").withColumn("cost", F.lit(0.5)))


def q_fact_export(s, d):
    return S.fact_export(_t(s, d, "nation", "CASE WHEN n_nationkey % 2 = 0 THEN 'link' ELSE 'template' END AS kind", "n_name AS title", "CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) END AS target"))


def q_article_reports(s, d):
    articles = _t(s, d, "region", "r_regionkey AS article", "'en' AS lang", "r_regionkey * 7 AS revid", "r_regionkey AS repaired")
    return S.article_reports(articles, _t(s, d, "nation", "n_regionkey AS article", "CASE WHEN n_nationkey % 2 = 0 THEN 'link' ELSE 'template' END AS kind", "n_name AS title", "CASE WHEN n_nationkey % 3 > 0 THEN lower(n_name) END AS target").where("article > 0"))


def q_report_sections(s, d):
    return _t(s, d, "part", "p_partkey", "p_brand", f"{_REPORT} AS x").select("p_partkey", S.with_section(F.col("x"), "## Review", F.col("p_brand")).alias("text"))


def q_attribution_blocks(s, d):
    o = _t(s, d, "orders", "o_orderkey", "o_orderpriority AS title", "CASE WHEN o_orderkey % 3 > 0 THEN 'en' ELSE 'de' END AS lang", "CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS revid", "o_orderdate AS ts")
    return o.select("o_orderkey", S.attribution_block(F.col("title"), F.col("lang"), F.col("revid"), F.col("ts")).alias("block"))


def q_live_findings(s, d):
    templates = _t(s, d, "part", "p_partkey AS article", "CASE p_size % 3 WHEN 0 THEN 'Moduli:TNT/config' ELSE 'Stampa:' || p_brand END AS title", "p_size % 2 = 0 AS exists")
    return S.live_findings(_t(s, d, "part", "p_partkey AS article", f"{_HTML} AS html"), templates)


def q_gathered_facts(s, d):
    mentions = _t(s, d, "events", "user_id AS article", "CASE WHEN event_id % 2 = 0 THEN 'link' ELSE 'template' END AS kind", "'t' || event_id % 40 AS title")
    answers = lambda mod: _t(s, d, "nation", "CASE WHEN n_nationkey % 2 = 0 THEN 'link' ELSE 'template' END AS kind", "'t' || n_nationkey AS title", f"CASE WHEN n_nationkey % 3 > 0 THEN n_name || '{mod}' END AS target").where(f"CAST(substr(title, 2) AS INT) % {mod} = 0")
    return S.gathered_facts(mentions, answers(1), answers(5), _t(s, d, "nation", "'t' || (n_nationkey + 15) AS title"), _t(s, d, "nation", "'t' || n_nationkey AS title", "n_regionkey AS n").where("n > 0"))


def q_category_members(s, d):
    return S.category_members(_t(s, d, "events", "event_type AS category", "event_id % 3 AS ns", "'T' || event_id AS title"), 50)


def q_sibling_links(s, d):
    return S.sibling_links(_t(s, d, "documents", "doc_id AS article", "split(coalesce(text, ''), ' ') AS links")).select("article", F.array_join("links", "|").alias("links"))


def q_score_tables(s, d):
    return S.score_tables(_t(s, d, "lineitem", "l_orderkey AS article", "CAST(l_linenumber AS STRING) AS label", "l_returnflag AS model", "CAST(l_quantity AS INT) AS score"))


def q_saved_articles(s, d):
    path = new_path(s, "articles")
    files.save_articles(_t(s, d, "part", "p_name || p_partkey AS title", "p_brand AS text", "CASE WHEN p_size % 2 = 0 THEN 'sq' ELSE 'de' END AS target_lang"), path)
    return files.unsaved(_t(s, d, "part", "p_name || p_partkey AS title"), path, "sq")


def q_saved_snapshot(s, d):
    """Drafts are saved after each chunk; what is read back is the last version."""
    path = new_path(s, "drafts")
    for before in (1, 3):
        chunks = _t(s, d, "conversations", "conv_id AS article", "turn AS ord", "role AS section", f"CASE WHEN turn % 4 < {before} THEN 'translated' ELSE 'pending' END AS status", "text")
        version = snapshots.save(S.partial_articles(chunks), path)
    return snapshots.load(s, path).withColumn("version", F.lit(version))


def q_saved_stats(s, d):
    path = new_path(s, "stats")
    for status in ("O", "F"):
        snapshots.save(S.stats_line(_t(s, d, "orders", "o_orderpriority AS model", "o_custkey AS tokens", "0.5D AS cost", "o_orderstatus").where(F.col("o_orderstatus") == status)), path, form="json")
    return snapshots.load(s, path)


def q_completed(s, d):
    return E.completed(_t(s, d, "part", "p_brand AS prompt"), "sq", _local(_sq))


def q_translated(s, d):
    chunks = _t(s, d, "part", "p_partkey AS article", "0L AS ord", "p_brand AS section", f"{_CHUNK} AS text", "p_partkey AS k")
    store = _t(s, d, "part", "p_partkey AS k", f"{_STORED} AS v").where("k % 3 = 0")
    return E.translated(chunks, store, "sq", _local(_sq)).select("article", "made", "status")


def q_repaired(s, d):
    faulty = _t(s, d, "part", "p_partkey AS article", "0L AS ord", "p_name AS text", "CASE WHEN p_size % 2 = 0 THEN '{{efn|' || p_name || '}}' ELSE p_brand END AS made", "array('e') AS errors")
    return E.repaired(faulty, "lower", _local(lambda x: x.replace("efn", "sfn").lower())).select("article", "made")


def q_reviewed(s, d):
    articles = _t(s, d, "part", "p_partkey AS article", "p_name AS source", "CASE WHEN p_size % 3 = 0 THEN 'bad ' ELSE '' END || p_brand AS made")
    return E.reviewed(articles, "faults", _local(_faults)).drop("ord")


def q_judged(s, d):
    return E.judged(_t(s, d, "part", "p_partkey AS article", "p_name AS source", "array_repeat(p_brand, CAST(p_size % 6 AS INT)) AS answers"), "echo", _local(lambda x: x)).select("article", F.col("n").cast("long").alias("n"))


def q_repair_rounds(s, d):
    state = _t(s, d, "conversations", "conv_id AS article", "turn AS ord", "role AS text", f"{_STATE} AS made")
    return E.repair_rounds(state, "closed", _local(_closed))[0].select("article", "ord", "made")


def q_review_rounds(s, d):
    state = _t(s, d, "conversations", "conv_id AS article", "turn AS ord", "role AS text", "CASE WHEN turn % 4 = 0 THEN 'bad ' ELSE 'bag ' END || role AS made")
    return E.review_rounds(state, ("faults", _local(_faults)), ("mend", _local(_mend)))[0].select("article", "ord", "made")


_ARTICLE = "'Lead ' || p_brand || '.' || chr(10) || '== ' || p_name || ' ==' || chr(10) || '{{nls|' || p_size || '}} {{r|name=' || p_brand || '|ref=x}}' || chr(10)"
_SAVED = "'Lead ' || CASE WHEN p_size % 3 = 0 THEN 'bad ' ELSE '' END || p_brand || chr(10) || '== ' || p_name || ' ==' || chr(10) || 'x' || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '<!--' || chr(10) || 'NUK ËSHTË PJESË bad' ELSE '' END"


def q_expanded_templates(s, d):
    wiki = lambda lang: A.LocalWiki({"box": "<{{{1}}}/{{{x|none}}}>", "outer": "{{box|{{{1}}}|x=o}}"})
    return A.expanded(_t(s, d, "part", "p_partkey AS article", "'{{Box|' || p_brand || CASE WHEN p_size % 2 = 0 THEN '|x=' || p_size ELSE '' END || '}} {{outer|' || p_name || '}} {{other}}' AS text"), wiki, "sq")


def q_planned(s, d):
    return A.planned(_t(s, d, "part", "p_partkey AS article", f"{_ARTICLE} AS text"), 1, 40).select("article", "ord", "section", "text", "is_complex")


def q_processed(s, d):
    store = s.createDataFrame([], "k string, v string")
    articles = _t(s, d, "part", "p_partkey AS article", "'Lead ' || p_brand || '.' || chr(10) || '== ' || p_name || ' ==' || chr(10) || CASE WHEN p_size % 3 = 0 THEN 'a [[b' ELSE 'c' END AS text")
    return A.processed(articles, store, "closed", _local(_closed), 1, 60)


def q_rereviewed(s, d):
    return A.rereviewed(_t(s, d, "part", "p_partkey AS article", f"{_SAVED} AS text"), ("faults", _local(_faults)), ("mend", _local(_mend)))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}

_SHOWN = "CASE WHEN turn % 3 = 1 THEN '<!-- pending: ' || role || ' (pending) -->' ELSE coalesce(text, '') END"

ORACLE_SQL = {
    "expanded_templates": """SELECT p_partkey AS article, '<' || p_brand || '/' || CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) ELSE 'none' END || '> <' || p_name || '/o> {{other}}' AS text FROM part""",
    "planned": """SELECT p_partkey AS article, unnest([0, 1])::BIGINT AS ord, unnest(['Lead', p_name]) AS section, unnest(['Lead ' || p_brand || '.' || chr(10), '== ' || p_name || ' ==' || chr(10) || '{{notelist|' || p_size || '}} <ref name="' || p_brand || '">x</ref>' || chr(10)]) AS text, unnest([false, true]) AS is_complex FROM part""",
    "processed": """SELECT p_partkey AS article, 'Lead ' || p_brand || '.' || chr(10) || '== ' || p_name || ' ==' || chr(10) || CASE WHEN p_size % 3 = 0 THEN 'a [[b]]' ELSE 'c' END AS text, CAST(0 AS BIGINT) AS findings FROM part""",
    "rereviewed": """SELECT p_partkey AS article, CASE WHEN p_size % 3 = 0 THEN regexp_replace(x, 'bad', 'good') ELSE x END AS text, p_size % 3 = 0 AS changed FROM (SELECT *, 'Lead ' || CASE WHEN p_size % 3 = 0 THEN 'bad ' ELSE '' END || p_brand || chr(10) || '== ' || p_name || ' ==' || chr(10) || 'x' || CASE WHEN p_size % 2 = 0 THEN chr(10) || chr(10) || '<!--' || chr(10) || 'NUK ËSHTË PJESË bad' ELSE '' END AS x FROM part)""",
    "row_count": "SELECT count(*) AS n FROM customer",
    "recached": "SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS v, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS created FROM customer WHERE c_custkey % 3 > 0 OR c_custkey % 2 = 0",
    "merged_usage": "SELECT event_type AS model, count(*) AS calls, CAST(sum(user_id) AS BIGINT) AS tokens, round(sum(value), 4) AS cost FROM events GROUP BY event_type",
    "partial_articles": f"""WITH c AS (SELECT conv_id, turn, {_SHOWN} AS t FROM conversations), l AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)
      SELECT conv_id AS article, string_agg(CASE WHEN t <> '' AND b IS NOT NULL AND right(b, 1) <> chr(10) AND left(t, 1) <> chr(10) THEN chr(10) ELSE '' END || t, '' ORDER BY turn) AS text FROM l GROUP BY conv_id""",
    "saved_snapshot": f"""WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN '<!-- pending: ' || role || ' (pending) -->' ELSE coalesce(text, '') END AS t FROM conversations), l AS (SELECT *, last_value(nullif(t, '') IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c)
      SELECT conv_id AS article, string_agg(CASE WHEN t <> '' AND b IS NOT NULL AND right(b, 1) <> chr(10) AND left(t, 1) <> chr(10) THEN chr(10) ELSE '' END || t, '' ORDER BY turn) AS text, 2 AS version FROM l GROUP BY conv_id""",
    "saved_stats": """SELECT '{"calls":' || sum(n) || ',"tokens":' || sum(t) || ',"models":[' || string_agg('{"model":"' || m || '","calls":' || n || ',"tokens":' || t || ',"cost":' || c || '}', ',' ORDER BY m) || ']}' AS line
      FROM (SELECT o_orderpriority AS m, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS t, CAST(count(*) * 0.5 AS DOUBLE) AS c FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)""",
    "stats_line": """SELECT '{"calls":' || sum(n) || ',"tokens":' || sum(t) || ',"models":[' || string_agg('{"model":"' || m || '","calls":' || n || ',"tokens":' || t || ',"cost":' || c || '}', ',' ORDER BY m) || ']}' AS line
      FROM (SELECT o_orderstatus AS m, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS t, CAST(count(*) * 0.5 AS DOUBLE) AS c FROM orders GROUP BY 1)""",
    "fact_export": "SELECT CASE WHEN n_nationkey % 2 = 0 THEN 'link' ELSE 'template' END AS kind, CASE WHEN n_nationkey % 2 = 0 THEN '## Links' ELSE '## Templates' END || chr(10) || string_agg('| ' || n_name || ' | ' || lower(n_name) || ' |', chr(10) ORDER BY n_name) AS text FROM nation WHERE n_nationkey % 3 > 0 GROUP BY n_nationkey % 2",
    "article_reports": """WITH f AS (SELECT n_regionkey AS a, CASE WHEN n_nationkey % 2 = 0 THEN 'link' ELSE 'template' END AS k, '## ' || CASE WHEN n_nationkey % 2 = 0 THEN 'link' ELSE 'template' END || chr(10) || '- confirmed: ' || coalesce(string_agg(n_name, ', ' ORDER BY n_name) FILTER (WHERE n_nationkey % 3 > 0), '') || chr(10) || '- missing: ' || coalesce(string_agg(n_name, ', ' ORDER BY n_name) FILTER (WHERE n_nationkey % 3 = 0), '') AS t FROM nation WHERE n_regionkey > 0 GROUP BY n_regionkey, n_nationkey % 2),
      g AS (SELECT a, string_agg(t, chr(10) ORDER BY k) AS t FROM f GROUP BY a)
      SELECT r_regionkey AS article, '# ' || r_regionkey || chr(10) || '- language: en' || chr(10) || '- revision: ' || r_regionkey * 7 || chr(10) || '- repaired: ' || r_regionkey || coalesce(chr(10) || t, '') AS text FROM region LEFT JOIN g ON a = r_regionkey""",
    "report_sections": f"""SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN replace(x, chr(10) || 'old' || chr(10), chr(10) || p_brand || chr(10)) WHEN 1 THEN replace(x, '<!--', '## Review' || chr(10) || p_brand || chr(10) || chr(10) || '<!--') ELSE x || chr(10) || '## Review' || chr(10) || p_brand || chr(10) END AS text FROM (SELECT *, {_REPORT} AS x FROM part)""",
    "attribution_blocks": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 5 > 0 THEN '<!--' || chr(10) || 'NUK ËSHTË PJESË E ARTIKULLIT' || chr(10) || chr(10) || '== Për faqen e diskutimit (Talk) ==' || chr(10) || '{{Përkthyer nga|en|' || o_orderpriority || '|' || day(o_orderdate) || ' ' ||
      ['janar', 'shkurt', 'mars', 'prill', 'maj', 'qershor', 'korrik', 'gusht', 'shtator', 'tetor', 'nëntor', 'dhjetor'][month(o_orderdate)] || ' ' || year(o_orderdate) || '|' || o_custkey || '}}' || chr(10) || '-->' END AS block FROM orders""",
    "live_findings": """SELECT p_partkey AS article, 'lua_script_error' AS kind, 'Script error: ' || p_brand AS message FROM part UNION ALL SELECT p_partkey, 'orphaned_named_ref', 'Gabim ref ' || p_size FROM part
      UNION ALL SELECT p_partkey, 'country_data_leak', regexp_extract('Country data ' || p_brand || ' x', 'Country data \\S+') FROM part UNION ALL SELECT p_partkey, 'unexpanded_template', 'Stampa:' || p_brand FROM part WHERE p_size % 3 > 0 AND p_size % 2 = 1""",
    "gathered_facts": """WITH m AS (SELECT DISTINCT user_id AS article, CASE WHEN event_id % 2 = 0 THEN 'link' ELSE 'template' END AS kind, event_id % 40 AS i FROM events),
      a AS (SELECT *, i < 25 AND (i % 2 = 0) = (kind = 'link') AS checked FROM m), b AS (SELECT *, CASE WHEN checked AND i % 3 > 0 THEN (SELECT n_name FROM nation WHERE n_nationkey = i) || CASE WHEN i % 5 = 0 THEN '5' ELSE '1' END END AS t, kind = 'template' AND i BETWEEN 15 AND 39 AS there FROM a)
      SELECT article, kind, 't' || i AS title, coalesce(t, CASE WHEN there THEN 't' || i END) AS target, checked OR (t IS NULL AND there) AS checked, CASE WHEN kind = 'link' AND t IS NULL AND checked THEN coalesce((SELECT n_regionkey FROM nation WHERE n_nationkey = i), 0) END AS editions FROM b""",
    "category_members": "SELECT category, title FROM (SELECT event_type AS category, 'T' || event_id AS title, row_number() OVER (PARTITION BY event_type ORDER BY 'T' || event_id) AS n FROM events WHERE event_id % 3 = 0) WHERE n <= 50",
    "sibling_links": "SELECT doc_id AS article, array_to_string(string_split(coalesce(text, ''), ' ')[1:80], '|') AS links FROM documents",
    "score_tables": "SELECT l_orderkey AS article, string_agg('| ' || l_linenumber || ' | ' || l_returnflag || ' | ' || CAST(l_quantity AS INT) || ' |', chr(10) ORDER BY CAST(l_quantity AS INT) DESC, CAST(l_linenumber AS VARCHAR), l_returnflag) AS \"table\" FROM lineitem GROUP BY l_orderkey",
    "saved_articles": "SELECT p_name || p_partkey AS title FROM part WHERE p_size % 2 = 1",
    "completed": "SELECT DISTINCT p_brand AS prompt, 'sq:' || p_brand AS reply, CAST(len(string_split(p_brand, ' ')) AS BIGINT) AS n_in, CAST(len(string_split(p_brand, ' ')) AS BIGINT) AS n_out FROM part",
    "translated": f"""SELECT p_partkey AS article, CASE WHEN p_size % 5 = 0 THEN x WHEN p_partkey % 3 = 0 AND p_partkey % 9 > 0 THEN 'old ' || p_name ELSE 'sq:' || x END AS made, CASE WHEN p_size % 5 > 0 AND p_partkey % 3 = 0 AND p_partkey % 9 > 0 THEN 'cached' ELSE 'translated' END AS status FROM (SELECT *, {_CHUNK} AS x FROM part)""",
    "repaired": "SELECT p_partkey AS article, CASE WHEN p_size % 2 = 0 THEN '{{efn|' || p_name || '}}' ELSE lower(p_brand) END AS made FROM part",
    "reviewed": "SELECT p_partkey AS article, 'semantic_fidelity' AS kind, 'wrong word' AS message, 'warning' AS severity, 'bad' AS snippet FROM part WHERE p_size % 3 = 0",
    "judged": "SELECT p_partkey AS article, CAST(least(p_size % 6, 4) AS BIGINT) AS n FROM part",
    "repair_rounds": "SELECT conv_id AS article, turn AS ord, CASE WHEN turn % 3 = 0 THEN 'a [[' || role || ']]' ELSE 'fine ' || role END AS made FROM conversations",
    "review_rounds": "SELECT conv_id AS article, turn AS ord, CASE WHEN turn % 4 = 0 THEN 'good ' ELSE 'bag ' END || role AS made FROM conversations",
}
