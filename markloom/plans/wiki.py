"""Queries of the scanner's functions over markup made of the tables' columns, and DuckDB SQL that reads the same markup with regular expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import checks as C, chunks as K, rewrites as W
from ..operators import cutting as X, elements as E, folds as O, layout as L, pairing as P, quality as Q, rewriting as R, wikitext as T


def _t(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*columns)


_N = "chr(10)"
_BRACKETS = f"p_name || {_N} || CASE p_size % 4 WHEN 0 THEN '[[' || p_brand || ']]' WHEN 1 THEN 'x [[' || p_name WHEN 2 THEN p_brand || ']] [[a]]' ELSE '<nowiki>[[</nowiki>' || {_N} || '[[b]]' END"
_TABLES = f"CASE p_size % 4 WHEN 0 THEN '{{|' || {_N} || '| ' || p_name || {_N} || '|}}' WHEN 1 THEN '{{{{val|' || p_brand || '|}}}}' || {_N} || '{{|' || {_N} || '| a' WHEN 2 THEN p_name || {_N} || '|}}' || {_N} || '|}}' ELSE p_name END"
_REFS = f"p_name || CASE p_size % 5 WHEN 0 THEN '<ref>' || p_brand || '</ref>' WHEN 1 THEN '<ref name=\"' || p_brand || '\" />' || {_N} || '<REF>' WHEN 2 THEN {_N} || 'x</ref >' WHEN 3 THEN '<ref>a</ref><ref>' ELSE '' END"
_HEADS = f"CASE p_size % 4 WHEN 0 THEN '== ' || p_name || ' ==' WHEN 1 THEN p_brand || ' == ' || p_name || ' ==' || {_N} || 'x' WHEN 2 THEN 'a === ' || p_brand || ' ===  ' ELSE p_name || ' = b =' END"
_LOOPS = "repeat(p_name || ' ', CAST(p_size AS INT))"
_CALLS = "CASE p_size % 6 WHEN 0 THEN '{{convert|' || p_size || '|km}}' WHEN 1 THEN 'a {{Convert|' || p_name || '|km}}' WHEN 2 THEN '{{harvc|last=' || p_brand || '}}{{sfn|A|1}}' WHEN 3 THEN '{{sfnp|A|1990|text=' || p_name || '}}' WHEN 4 THEN '{{Sfn|' || p_name || '|2000}}' ELSE p_name END"
_GRID = f"'{{|' || {_N} || '! a !! b !! c' || {_N} || '|-' || {_N} || '| 1 || 2 || 3' || {_N} || '|-' || {_N} || CASE p_size % 4 WHEN 0 THEN '| ' || p_name WHEN 1 THEN '| colspan=\"' || p_size || '\" | ' || p_name ELSE '| ' || p_name || ' || ' || p_brand || ' || x' END || {_N} || '|-' || {_N} || '| 4 || 5 || 6' || {_N} || '|}}'"
_CITES = "CASE p_size % 7 WHEN 0 THEN '{{cite web|title=' || p_name || '|url=http://' || p_brand || '}}' WHEN 1 THEN '{{Cite web|title=' || p_name || '|url=}}' WHEN 2 THEN '{{cite book|title=' || p_name || '|access-date=2020-01-02}}' WHEN 3 THEN '{{cite tweet|user=' || p_brand || '}}' WHEN 4 THEN '{{tlit|grc|' || p_name || '}} {{Transliteration |x}}' WHEN 5 THEN 'a<ref>' || p_name || '</ref>' ELSE '{{cite web|url=http://a|date=2019-0' || p_size % 9 || '}}' END"
_NAMED = "'{{Infobox ' || p_brand || '|a={{' || p_name || '}}}}{{#if:x}}{{' || p_brand || '}} {{subst:' || p_name || '}}'"
_ILLS = "'{{ill|' || p_name || '|' || CASE WHEN p_size % 3 = 0 THEN 'de' ELSE 'en' END || CASE WHEN p_size % 2 = 0 THEN '|' || p_brand ELSE '' END || '}} {{ill|' || p_brand || ' x|en|' || p_brand || '}}'"
_NOTED = "CASE p_size % 4 WHEN 0 THEN '{{efn|' || p_name || '}}' WHEN 1 THEN '{{Efn|' || p_name || '|group=g}}{{notelist|group=g}}' WHEN 2 THEN '{{Notelist}}' || p_name ELSE p_name END"
_PARAM = "'{{Cite web|titulli=' || p_name || '|autori2=' || p_brand || CASE WHEN p_size % 3 = 0 THEN '|title=T' ELSE '' END || '}} {{x|titulli=1}}'"
_PAGES = "'{{sfn|' || p_brand || '|1990|' || CASE p_size % 4 WHEN 0 THEN 'f=' WHEN 1 THEN 'fq. ' WHEN 2 THEN 'faqet=' ELSE 'p=' END || p_size || '}}{{x|f=1}}'"
_WRAPPED = "'a<ref>' || CASE WHEN p_size % 3 = 0 THEN p_name ELSE '' END || '{{sfn|' || p_brand || '|1990}}</ref> b<ref name=\"x\">{{Sfn|A|1}}</ref>{{sfn|B|2}}'"
_NESTED = "p_name || '<ref group=\"n\">' || p_brand || ' | x.' || CASE WHEN p_size % 2 = 0 THEN '<ref>' || p_name || '</ref>' ELSE '' END || '</ref> end'"
_DEFINED = "'{{r|name=' || p_name || CASE WHEN p_size % 3 > 0 THEN '|ref=text ' || p_brand ELSE '' END || CASE WHEN p_size % 2 = 0 THEN '|page=' || p_size ELSE '' END || '}} z'"
_LINKED = "'[[{{ill|' || p_name || '|en|B}}' || CASE WHEN p_size % 2 = 0 THEN '| ' || p_brand || ' ' ELSE '' END || ']] [[X|{{ill|' || p_brand || '|en}}]]'"
_DATED = "'{{cite web|date=' || CASE p_size % 4 WHEN 0 THEN '2' || p_size % 8 || ' March 2019' WHEN 1 THEN 'May ' || p_size % 9 || ', 2020' WHEN 2 THEN '2021-0' || (1 + p_size % 9) ELSE p_name END || '|title=27 May 2001}} {{x|date=2001-02}}'"
_AS_OF = "p_name || CASE WHEN p_size % 2 = 0 THEN '. ' ELSE ' ' END || '{{As of|20' || (10 + p_size) || CASE WHEN p_size % 3 > 0 THEN '|4' ELSE '' END || '|lang=sq}}'"
_AGES = "'x {{Age in years and days|1946|2|2|' || (1950 + p_size) || '|3|' || (1 + p_size % 28) || '}} {{age in years and days|1946|2|2}}'"
_AGENCY = "'{{cite news|title=' || p_name || CASE p_size % 3 WHEN 0 THEN '' WHEN 1 THEN '|publisher=' || p_brand ELSE '|publisher=The AP of ' || p_brand END || '|agency=AP}}{{x|agency=1}}'"
_SPLIT = f"'== R ==' || {_N} || '<references>' || {_N} || '<ref>' || p_name || '</ref>' || {_N} || '</references>' || {_N} || CASE WHEN p_size % 2 = 0 THEN '<ref>b</ref>' || {_N} || '</references>' ELSE '== S ==' || {_N} || '</references>' END"
_HATS = "'{{Kryesor|' || p_name || '}} t {{Kryesor|' || p_brand || '|Y}}'"
_HAT_SOURCES = "'{{Main|One}}' || CASE WHEN p_size % 3 = 0 THEN '' ELSE '{{main|Two|Three}}' END"
_COMMENTED = f"'a <!-- mbaj ' || p_brand || ' --> b' || {_N} || CASE WHEN p_size % 2 = 0 THEN '<!-- shtuar ' || p_name || ' -->' || {_N} ELSE '' END || 'c'"
_COMMENTS = "'a <!-- keep ' || p_brand || ' --> b c d e f g h i j k l m n o p q r s t'"
_CREFS = f"'A{{{{Cref2|' || p_size % 3 || '}}}} B{{{{cref2|' || p_size % 2 || '}}}}' || {_N} || '{{{{Cnote2 Begin}}}}{{{{Cnote2|0|' || p_name || '}}}}{{{{Cnote2|1|' || p_brand || '}}}}{{{{Cnote2 End}}}}'"
_UNITS = f"p_name || '. ' || p_brand || '! x' || {_N} || {_N} || CASE WHEN p_size % 2 = 0 THEN 'short ' || p_brand || {_N} || ' ' || {_N} ELSE '' END || p_name || '? y'"
_PROTECTED = f"'lead ' || p_brand || ' {{{{t|' || p_name || '}}}} x <!-- ' || p_name || ' -->' || {_N} || CASE WHEN p_size % 2 = 0 THEN '* ' || p_name || {_N} || '* b' || {_N} ELSE 'plain' || {_N} END || 'end<ref>' || p_brand || '</ref>'"


def _part(s, d, expr: str, *more: str) -> DataFrame:
    return _t(s, d, "part", "p_partkey", f"{expr} AS x", *more)


def _texts(s, d, expr: str) -> DataFrame:
    return _t(s, d, "part", "p_partkey AS id", f"{expr} AS text")


def _found(s, d, expr: str, check) -> DataFrame:
    return T.findings(_part(s, d, expr), check, "x", ["p_partkey"]).select("p_partkey", "kind", "line")


def _text(s, d, expr: str, fn) -> DataFrame:
    return T.mapped(_part(s, d, expr), lambda x: (fn(x)[0], fn(x)[1]), "text string, n long", "x").drop("x")


def q_bracket_findings(s, d):
    texts = _texts(s, d, _BRACKETS)
    found = P.unbalanced(texts.select("id", E.masked(F.col("text")).alias("text")), "[[", "]]")
    return found.select(F.col("id").alias("p_partkey"), F.lit("link").alias("kind"), F.col("line").cast("int").alias("line"))


def q_masked(s, d):
    return _texts(s, d, _BRACKETS).select(F.col("id").alias("p_partkey"), E.masked(F.col("text")).alias("text"))


def q_table_balance(s, d):
    found = R.table_balance(_texts(s, d, _TABLES))
    said = F.concat(F.lit("unbalanced table: "), F.col("opened").cast("string"), F.lit(" of {| and "), F.col("closed").cast("string"), F.lit(" of |}"))
    return found.select(F.col("id").alias("p_partkey"), F.lit("table").alias("kind"), said.alias("message"))


def q_ref_balance(s, d):
    return R.ref_balance(_texts(s, d, _REFS)).select(F.col("id").alias("p_partkey"), F.lit("reference").alias("kind"), F.col("line").cast("int").alias("line"))


def q_misplaced_headings(s, d):
    return Q.misplaced_headings(_texts(s, d, _HEADS)).select(F.col("id").alias("p_partkey"), F.lit("heading").alias("kind"), "ord")


def q_repetitive(s, d):
    return T.findings(_part(s, d, _LOOPS), C.repetitive, "x", ["p_partkey"]).select("p_partkey", "kind")


def q_template_findings(s, d):
    texts = _texts(s, d, _CALLS)
    found = Q.placed(Q.template_findings(texts), texts).join(texts, "id")
    severity = F.when(F.col("kind") == "sfn_unsupported_param", "warning").otherwise("error")
    return found.select(F.col("id").alias("p_partkey"), "kind", severity.alias("severity"), F.col("line").cast("int").alias("line"), E.cut(F.col("text"), F.col("at"), F.col("e")).alias("snippet"))


def q_table_spans(s, d):
    return O.off_rows(_texts(s, d, _GRID)).select(F.col("id").alias("p_partkey"), F.lit("table_span_mismatch").alias("kind"), F.col("line").cast("int").alias("line"))


def q_valid_texts(s, d):
    return T.validity(_part(s, d, _REFS), "x", "p_partkey").select("p_partkey", "valid", F.array_join("kinds", "|").alias("kinds"))


def q_qa_findings(s, d):
    texts = _texts(s, d, _CITES)
    return Q.placed(Q.qa_findings(texts), texts).select(F.col("id").alias("p_partkey"), "kind", F.col("line").cast("int").alias("line"))


def q_assembled_findings(s, d):
    texts = _texts(s, d, _REFS)
    rest = _found(s, d, _REFS, C.validated).select("p_partkey")
    return rest.unionByName(Q.qa_findings(texts).select(F.col("id").alias("p_partkey"))).groupBy("p_partkey").agg(F.count("*").alias("n"))


def q_template_names(s, d):
    return E.template_names(_texts(s, d, _NAMED)).withColumnRenamed("id", "p_partkey")


def q_ill_renderings(s, d):
    return R.ill_renderings(_texts(s, d, _ILLS)).withColumnRenamed("id", "p_partkey")


def q_lost_boxes(s, d):
    source, made = _texts(s, d, "'{{Infobox a|' || p_name || '}}{{Kuti b}}'"), _texts(s, d, "repeat('{{Kuti c}}', p_size % 3) || p_brand")
    return R.with_lost_boxes(source, made).select(F.col("id").alias("p_partkey"), "text", F.col("n").alias("lost"))


def q_note_groups(s, d):
    return R.implicit_note_groups(_texts(s, d, _NOTED)).withColumnRenamed("id", "p_partkey")


def q_note_counts(s, d):
    return R.note_counts(_texts(s, d, _NOTED)).withColumnRenamed("id", "p_partkey")


def q_protected_spans(s, d):
    return E.protected_spans(_texts(s, d, _PROTECTED)).withColumnRenamed("id", "p_partkey")


def q_free_units(s, d):
    return X.free_units(_texts(s, d, _UNITS), 6).select(F.col("id").alias("p_partkey"), F.col("ord").cast("long").alias("ord"), "unit")


def q_section_pieces(s, d):
    out = X.section_pieces(_t(s, d, "documents", "doc_id AS id", "coalesce(text, '') AS text"), 50, 200)
    return out.groupBy(F.col("id").alias("doc_id")).agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda r: r["text"]), ""), 256).alias("joined"))


def q_packed_lines(s, d):
    """Lines of documents as units, their blanks as sizes."""
    lines = _t(s, d, "documents", "doc_id AS id", "posexplode(split(coalesce(text, ''), '\n')) AS (i, line)").selectExpr("id", "i", "length(line) - length(replace(line, ' ', '')) AS n")
    return X.packed(lines, 40, 90).groupBy("id", "piece").agg(F.min("i").alias("first"), F.count("*").alias("lines"))


def q_article_chunks(s, d):
    body = f"'lead ' || source || {_N} || '== A ==' || {_N} || coalesce(text, '') || {_N} || '== B ==' || {_N} || lang"
    sections = X.sectioned(_t(s, d, "documents", "doc_id AS article", f"{body} AS text"))
    out = X.article_chunks(sections, 5, 40)
    return out.groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda r: r["text"]), "").alias("text"), F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "titles"))), lambda r: r["titles"]))), "|").alias("titles"))


def q_saved_pieces(s, d):
    return T.exploded(_part(s, d, f"'lead' || {_N} || '== ' || p_name || ' ==' || {_N} || p_brand || {_N} || '=== C ===' || {_N} || 'x'"), K.saved_pieces, "title string, text string", ["x"], ["p_partkey"])


def q_english_params(s, d):
    return R.english_params(_texts(s, d, _PARAM)).withColumnRenamed("id", "p_partkey")


def q_page_params(s, d):
    return R.page_params(_texts(s, d, _PAGES)).withColumnRenamed("id", "p_partkey")


def q_citation_languages(s, d):
    texts = _texts(s, d, "'{{cite web|title=' || p_name || '|url=u' || p_size % 3 || CASE WHEN p_size % 4 = 0 THEN '|lang=x' ELSE '' END || '}}'")
    by_url = _t(s, d, "part", "p_partkey AS id", "'u' || p_size % 3 AS url", "CASE WHEN p_size % 3 > 0 THEN 'l' || p_size % 3 END AS lang")
    by_title = _t(s, d, "part", "p_partkey AS id", "p_name AS title", "CASE WHEN p_size % 5 = 0 THEN 'fr' END AS lang")
    return R.with_languages(texts, by_url, by_title).withColumnRenamed("id", "p_partkey")


def q_unwrapped_notes(s, d):
    return R.unwrapped_notes(_texts(s, d, _WRAPPED)).withColumnRenamed("id", "p_partkey")


def q_plain_notes(s, d):
    return R.plain_notes(_texts(s, d, _WRAPPED)).withColumnRenamed("id", "p_partkey")


def q_nested_notes(s, d):
    return L.nested_notes(_texts(s, d, _NESTED)).withColumnRenamed("id", "p_partkey")


def q_expanded_r(s, d):
    return _text(s, d, _DEFINED, W.expanded_r)


def q_unnested_ills(s, d):
    return L.unnested_ills(_texts(s, d, _LINKED)).withColumnRenamed("id", "p_partkey")


def q_right_dates(s, d):
    return L.right_dates(_texts(s, d, _DATED)).withColumnRenamed("id", "p_partkey")


def q_right_as_of(s, d):
    return L.right_as_of(_texts(s, d, _AS_OF)).withColumnRenamed("id", "p_partkey")


def q_age_calls(s, d):
    return L.age_words(_texts(s, d, _AGES)).withColumnRenamed("id", "p_partkey")


def q_agencies(s, d):
    return R.without_agencies(_texts(s, d, _AGENCY)).withColumnRenamed("id", "p_partkey")


def q_merged_references(s, d):
    return L.merged_references(_texts(s, d, _SPLIT)).withColumnRenamed("id", "p_partkey")


def q_ordered_rewrites(s, d):
    return L.ordered(_texts(s, d, _PARAM)).select(F.col("id").alias("p_partkey"), "text", F.size("steps").cast("long").alias("n"))


def q_hatnotes(s, d):
    missing = _t(s, d, "part", "p_partkey AS id", "p_brand AS title")
    return L.linked_hatnotes(_texts(s, d, _HATS), _texts(s, d, _HAT_SOURCES), missing).select(F.col("id").alias("p_partkey"), "text")


def q_settled_comments(s, d):
    return O.settled_comments(_texts(s, d, _COMMENTS), _texts(s, d, _COMMENTED)).select(F.col("id").alias("p_partkey"), "text", F.col("n").alias("gone"))


def q_expanded_notes(s, d):
    return L.expanded_notes(_texts(s, d, _CREFS)).select(F.col("id").alias("p_partkey"), "text", "n", F.array_join("lost", "|").alias("lost"), F.array_join("idle", "|").alias("idle"))


QUERIES = {n[2:]: f for n, f in list(globals().items()) if n.startswith("q_")}


def _over(expr: str, body: str) -> str:
    return f"WITH p AS (SELECT p_partkey, p_size, p_name, p_brand, {expr} AS x FROM part) {body}"


def _lines(upto: str) -> str:
    return f"CAST(1 + len({upto}) - len(replace({upto}, chr(10), '')) AS INT)"


_COUNT = "(len({0}) - len(replace({0}, '{1}', ''))) // {2}"
_DAY = "CAST((p_size % 28) + 1 AS INT)"

ORACLE_SQL = {
    "masked": _over(_BRACKETS, "SELECT p_partkey, replace(x, '<nowiki>[[</nowiki>', repeat(' ', 19)) AS text FROM p"),
    "bracket_findings": _over(
        _BRACKETS,
        f"""SELECT p_partkey, 'link' AS kind, {_lines("left(m, CASE WHEN strpos(m, ']]') > 0 AND (strpos(m, '[[') = 0 OR strpos(m, ']]') < strpos(m, '[[')) THEN strpos(m, ']]') ELSE strpos(m, '[[') END)")} AS line
        FROM (SELECT *, replace(x, '<nowiki>[[</nowiki>', repeat(' ', 19)) AS m FROM p) WHERE {_COUNT.format('m', '[[', 2)} <> {_COUNT.format('m', ']]', 2)}""",
    ),
    "table_balance": _over(
        _TABLES,
        f"""SELECT p_partkey, 'table' AS kind, 'unbalanced table: ' || o || ' of {{| and ' || c || ' of |}}' AS message FROM (SELECT p_partkey, CAST({_COUNT.format('y', '{|', 2)} AS INT) AS o, CAST({_COUNT.format('y', '|}', 2)} AS INT) AS c
        FROM (SELECT p_partkey, regexp_replace(x, '\\{{\\{{[^{{}}]*\\}}\\}}', '', 'g') AS y FROM p)) WHERE o <> c""",
    ),
    "ref_balance": _over(
        _REFS,
        f"""SELECT p_partkey, 'reference' AS kind, {_lines("left(x, strpos(lower(x), CASE WHEN p_size % 5 = 1 THEN '<ref>' WHEN p_size % 5 = 2 THEN '</ref' ELSE '</ref><ref>' END) + 5)")} AS line FROM p
        WHERE len(regexp_extract_all(x, '(?i)<ref\\b[^>/]*>')) <> len(regexp_extract_all(x, '(?i)</ref\\s*>'))""",
    ),
    "misplaced_headings": _over(_HEADS, "SELECT p_partkey, 'heading' AS kind, CAST(0 AS BIGINT) AS ord FROM p WHERE regexp_matches(x, '[^\\n=]={2,6}[^\\n=]+={2,6}[ \\t]*(\\n|$)')"),
    "repetitive": _over(_LOOPS, "SELECT p_partkey, 'degenerate_repetition' AS kind FROM p WHERE strlen(x) >= 500 AND p_size >= 15"),
    "template_findings": _over(
        _CALLS,
        """SELECT p_partkey, 'convert_malformed' AS kind, 'error' AS severity, 1 AS line, regexp_extract(x, '\\{\\{.*\\}\\}') AS snippet FROM p WHERE regexp_matches(x, '(?i)\\{\\{convert\\|[^0-9]')
        UNION ALL SELECT p_partkey, 'harvc_used', 'error', 1, regexp_extract(x, '\\{\\{harvc[^}]*\\}\\}') FROM p WHERE contains(x, '{{harvc')
        UNION ALL SELECT p_partkey, 'sfn_unsupported_param', 'warning', 1, x FROM p WHERE regexp_matches(x, '(?i)\\{\\{sfn[pm]?\\|[^}]*text=')""",
    ),
    "table_spans": _over(_GRID, "SELECT p_partkey, 'table_span_mismatch' AS kind, 6 AS line FROM p WHERE len(string_split(string_split(x, chr(10))[6], '||')) - 1 + CASE WHEN contains(x, 'colspan') THEN CAST(regexp_extract(x, 'colspan=\"(\\d+)', 1) AS INT) ELSE 1 END <> 3"),
    "valid_texts": _over(_REFS, "SELECT p_partkey, o = c AS valid, CASE WHEN o = c THEN '' ELSE 'reference' END AS kinds FROM (SELECT p_partkey, len(regexp_extract_all(x, '(?i)<ref\\b[^>/]*>')) AS o, len(regexp_extract_all(x, '(?i)</ref\\s*>')) AS c FROM p)"),
    "assembled_findings": _over(_REFS, "SELECT p_partkey, n FROM (SELECT p_partkey, CAST(CASE WHEN len(regexp_extract_all(x, '(?i)<ref\\b[^>/]*>')) <> len(regexp_extract_all(x, '(?i)</ref\\s*>')) THEN 1 ELSE 0 END + CASE WHEN regexp_matches(x, '(?i)<ref\\b') THEN 1 ELSE 0 END AS BIGINT) AS n FROM p) WHERE n > 0"),
    "qa_findings": _over(
        _CITES,
        """SELECT p_partkey, 'qa_cite_web_no_url' AS kind, 1 AS line FROM p WHERE regexp_matches(x, '(?i)\\{\\{cite web\\|') AND NOT regexp_matches(x, '\\|url=[^|}]')
        UNION ALL SELECT p_partkey, 'qa_cite_orphan_url_qualifier', 1 FROM p WHERE contains(x, 'access-date=') AND NOT contains(x, 'url=')
        UNION ALL SELECT p_partkey, 'qa_cite_tweet', 1 FROM p WHERE contains(x, '{{cite tweet')
        UNION ALL SELECT p_partkey, 'qa_broken_transliteration', 1 FROM (SELECT p_partkey, unnest(regexp_extract_all(x, '(?i)\\{\\{(tlit|transliteration )\\|')) FROM p)
        UNION ALL SELECT p_partkey, 'qa_missing_reflist', 1 FROM p WHERE contains(x, '<ref')
        UNION ALL SELECT p_partkey, 'qa_bare_month_date', 1 FROM p WHERE regexp_matches(x, 'date=\\d{4}-\\d{2}[|}]')""",
    ),
    "template_names": _over(_NAMED, "SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i) - 1 AS BIGINT) AS ord, name FROM (SELECT p_partkey, min(i) AS i, name FROM (SELECT p_partkey, unnest(names) AS name, unnest(range(len(names))) AS i FROM (SELECT p_partkey, list_transform(list_filter(regexp_extract_all(x, '\\{\\{([^{}|]+)', 1), lambda n: NOT regexp_matches(n, '^(#|subst:)')), lambda n: trim(n)) AS names FROM p)) GROUP BY p_partkey, name)"),
    "ill_renderings": _over(_ILLS, "SELECT p_partkey, title, min_by(display, i) AS display FROM (SELECT p_partkey, i, c[2] AS display, coalesce(c[4], c[2]) AS title FROM (SELECT p_partkey, unnest(range(len(a))) AS i, string_split(unnest(a), '|') AS c FROM (SELECT p_partkey, regexp_extract_all(x, '\\{\\{(ill[^}]*)\\}\\}', 1) AS a FROM p)) WHERE c[3] = 'en') GROUP BY p_partkey, title"),
    "lost_boxes": "SELECT p_partkey, CAST(2 - p_size % 3 AS BIGINT) AS lost, repeat('{{Kuti c}}', CAST(p_size % 3 AS INT)) || CASE p_size % 3 WHEN 0 THEN chr(10) || '{{Infobox a|' || p_name || '}}' || chr(10) || '{{Kuti b}}' WHEN 1 THEN chr(10) || '{{Kuti b}}' ELSE '' END || p_brand AS text FROM part",
    "note_groups": _over(_NOTED, "SELECT p_partkey, regexp_matches(x, '(?i)\\{\\{(efn|notelist)[^{}]*\\}\\}') AND NOT contains(x, 'group=') AS implicit FROM p"),
    "note_counts": _over(_NOTED, "SELECT p_partkey, name, count(*) AS n FROM (SELECT p_partkey, replace(lower(unnest(regexp_extract_all(x, '(?i)\\{\\{(efn|notelist)', 1))), 'notelist', 'listë shënimesh') AS name FROM p) GROUP BY p_partkey, name"),
    "protected_spans": _over(
        _PROTECTED,
        """SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY s) - 1 AS BIGINT) AS ord, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM (
        SELECT p_partkey, strpos(x, m) - 1 AS s, len(m) AS n FROM (SELECT p_partkey, x, unnest(regexp_extract_all(x, '\\{\\{[^{}]*\\}\\}|<!--.*?-->|(?:\\n\\* [^\\n]*)+\\n|<ref>[^<]*</ref>')) AS m FROM p) WHERE NOT starts_with(m, chr(10))
        UNION ALL SELECT p_partkey, strpos(x, chr(10) || '* '), len(regexp_extract(x, '(?:\\n\\* [^\\n]*)+\\n')) - 1 FROM p WHERE contains(x, chr(10) || '* '))""",
    ),
    "free_units": _over(
        _UNITS,
        """, q AS (SELECT p_partkey, i, para, len(regexp_extract_all(regexp_replace(para, '\\n[ \\t]*\\n$', ''), '\\w+|[^\\w\\s]')) > 6 AS long FROM (SELECT p_partkey, unnest(range(len(a))) AS i, unnest(a) AS para FROM (SELECT p_partkey, list_filter(string_split(regexp_replace(x, '(\\n[ \\t]*\\n)', '\\1' || chr(1), 'g'), chr(1)), lambda u: u <> '') AS a FROM p))),
        r AS (SELECT p_partkey, i, unnest(range(len(b))) AS j, unnest(b) AS unit FROM (SELECT p_partkey, i, CASE WHEN long THEN string_split(regexp_replace(para, '([.!?] )', '\\1' || chr(1), 'g'), chr(1)) ELSE [para] END AS b FROM q))
        SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY i, j) - 1 AS BIGINT) AS ord, unit FROM r""",
    ),
    "section_pieces": "SELECT doc_id, sha256(coalesce(text, '')) AS joined FROM documents",
    "packed_lines": """WITH RECURSIVE l AS (SELECT doc_id AS id, unnest(range(len(a))) AS i, unnest(a) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
      u AS (SELECT id, i, length(line) - length(replace(line, ' ', '')) AS n FROM l),
      p AS (SELECT id, i, n, 0 AS piece, n AS size FROM u WHERE i = 0
        UNION ALL SELECT id, i, n, CASE WHEN new THEN piece + 1 ELSE piece END, CASE WHEN new THEN n ELSE size + n END FROM (SELECT u.id, u.i, u.n, p.piece, p.size, p.n > 90 OR p.size >= 40 OR (u.n <= 90 AND p.size + u.n > 90) AS new FROM p JOIN u ON u.id = p.id AND u.i = p.i + 1))
      SELECT id, CAST(piece AS BIGINT) AS piece, CAST(min(i) AS INT) AS first, count(*) AS lines FROM p GROUP BY id, piece""",
    "article_chunks": "SELECT doc_id AS article, 'lead ' || source || chr(10) || '== A ==' || chr(10) || coalesce(text, '') || chr(10) || '== B ==' || chr(10) || lang AS text, 'Lead|A|B' AS titles FROM documents",
    "saved_pieces": "SELECT p_partkey, unnest([0, 1, 2])::BIGINT AS ord, unnest(['(lead)', p_name, 'C']) AS title, unnest(['lead' || chr(10), '== ' || p_name || ' ==' || chr(10) || p_brand || chr(10), '=== C ===' || chr(10) || 'x']) AS text FROM part",
    "english_params": _over(_PARAM, "SELECT p_partkey, CASE WHEN contains(x, '|title=') THEN y ELSE replace(y, 'web|titulli=', 'web|title=') END AS text, CAST(1 + CAST(NOT contains(x, '|title=') AS INT) AS BIGINT) AS n FROM (SELECT p_partkey, x, replace(x, '|autori2=', '|author2=') AS y FROM p)"),
    "ordered_rewrites": _over(_PARAM, "SELECT p_partkey, CASE WHEN contains(x, '|title=') THEN y ELSE replace(y, 'web|titulli=', 'web|title=') END AS text, CAST(1 AS BIGINT) AS n FROM (SELECT p_partkey, x, replace(x, '|autori2=', '|author2=') AS y FROM p)"),
    "page_params": _over(_PAGES, "SELECT p_partkey, regexp_replace(regexp_replace(x, '(sfn[^}]*)\\|(?:f=|fq\\. )', '\\1|p='), '\\|faqet=', '|pp=') AS text, CAST(CASE WHEN regexp_matches(x, '\\|p=') THEN 0 ELSE 1 END AS BIGINT) AS n FROM p"),
    "citation_languages": """SELECT p_partkey, CASE WHEN l IS NULL THEN x ELSE left(x, len(x) - 2) || '|language=' || l || '}}' END AS text, CAST(l IS NOT NULL AS BIGINT) AS n FROM (SELECT p_partkey, '{{cite web|title=' || p_name || '|url=u' || p_size % 3 || CASE WHEN p_size % 4 = 0 THEN '|lang=x' ELSE '' END || '}}' AS x,
      CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 5 = 0 THEN 'fr' WHEN p_size % 3 > 0 THEN 'l' || p_size % 3 END AS l FROM part)""",
    "unwrapped_notes": _over(_WRAPPED, "SELECT p_partkey, regexp_replace(x, '<ref>(\\{\\{sfn[^{}]*\\}\\})</ref>', '\\1') AS text, CAST(regexp_matches(x, '<ref>\\{\\{sfn') AS BIGINT) AS n FROM p"),
    "plain_notes": _over(_WRAPPED, "SELECT p_partkey, regexp_replace(x, '(?i)(<ref[^>]*>[^<{]*\\{\\{)sfn', '\\1harvnb', 'g') AS text, CAST(len(regexp_extract_all(x, '(?i)<ref[^>]*>[^<{]*\\{\\{sfn')) AS BIGINT) AS n FROM p"),
    "nested_notes": _over(_NESTED, "SELECT p_partkey, CASE WHEN n = 1 THEN replace(replace(replace(x, '<ref group=\"n\">', '{{refn|group=n|1='), '</ref></ref>', '</ref>}}'), ' | x', ' {{!}} x') ELSE x END AS text, n FROM (SELECT *, CAST(contains(x, '</ref></ref>') AS BIGINT) AS n FROM p)"),
    "expanded_r": _over(_DEFINED, "SELECT p_partkey, regexp_replace(regexp_replace(x, '\\{\\{r\\|name=([^|]*)\\|ref=([^|}]*)\\}\\}', '<ref name=\"\\1\">\\2</ref>'), '\\{\\{r\\|name=([^|]*)\\|ref=([^|}]*)\\|page=([^|}]*)\\}\\}', '<ref name=\"\\1\">\\2</ref>{{Rp|\\3}}') AS text, CAST(contains(x, '|ref=') AS BIGINT) AS n FROM p"),
    "unnested_ills": _over(_LINKED, "SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(x, '\\[\\[(\\{\\{ill[^}]*)\\}\\}\\]\\]', '\\1}}'), '\\[\\[(\\{\\{ill[^}]*)\\}\\}\\| *([^\\]]*?) *\\]\\]', '\\1|lt=\\2}}'), '\\[\\[X\\|(\\{\\{ill[^}]*\\}\\})\\]\\]', '\\1') AS text, CAST(2 AS BIGINT) AS n FROM p"),
    "right_dates": _over(_DATED, "SELECT p_partkey, CASE m WHEN 0 THEN regexp_replace(x, 'date=(\\d+) March (\\d+)', 'date=\\2-03-\\1') WHEN 1 THEN regexp_replace(x, 'date=May (\\d), (\\d+)', 'date=\\2-05-0\\1') WHEN 2 THEN regexp_replace(x, 'web\\|date=(\\d+)-\\d\\d', 'web|date=' || monthname(make_date(2000, CAST(regexp_extract(x, 'web\\|date=\\d+-(\\d\\d)', 1) AS INT), 1)) || ' \\1') ELSE x END AS text, CAST(m < 3 AS BIGINT) AS n FROM (SELECT *, p_size % 4 AS m FROM p)"),
    "right_as_of": _over(_AS_OF, "SELECT p_partkey, CASE WHEN contains(x, '|4|') THEN regexp_replace(x, '\\{\\{As of\\|(\\d+)\\|4\\|lang=sq\\}\\}', '{{As of|\\1|alt=' || CASE WHEN contains(x, '. {{') THEN 'Që' ELSE 'që' END || ' nga prilli \\1}}') ELSE replace(x, '|lang=sq', '') END AS text, CAST(1 AS BIGINT) AS n FROM p"),
    "age_calls": f"""WITH q AS (SELECT p_partkey, p_size, date_diff('day', make_date(CAST(1950 + p_size AS INT), 2, 2), make_date(CAST(1950 + p_size AS INT), 3, {_DAY})) AS days FROM part)
      SELECT p_partkey, 'x ' || (4 + p_size) || ' vjet' || CASE WHEN days > 0 THEN ', ' || days || ' ditë' ELSE '' END || ' ' AS text, CAST(2 AS BIGINT) AS n FROM q""",
    "agencies": _over(_AGENCY, "SELECT p_partkey, CASE WHEN NOT contains(x, 'publisher=') THEN replace(x, '|agency=AP', '|publisher=AP') WHEN contains(x, 'The AP') THEN replace(x, '|agency=AP', '') ELSE replace(replace(x, '|agency=AP', ''), '|publisher=', '|publisher=AP; ') END AS text, CAST(1 AS BIGINT) AS n FROM p"),
    "merged_references": _over(_SPLIT, "SELECT p_partkey, CASE WHEN contains(x, '== S') THEN x ELSE regexp_replace(x, '</references>\\n', '') END AS text, CAST(NOT contains(x, '== S') AS BIGINT) AS n FROM p"),
    "hatnotes": _over(_HATS, "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN x ELSE regexp_replace(x, '\\{\\{Kryesor\\|([^|}]*)\\|Y\\}\\}', '{{Hatnote|Artikulli kryesor: {{ill|\\1|en|Two}} dhe [[Y]]}}') END AS text FROM p"),
    "settled_comments": _over(_COMMENTED, "SELECT p_partkey, regexp_replace(regexp_replace(x, '<!-- shtuar [^>]*-->\\n', ''), '<!-- mbaj', '<!-- Nga en.wiki: mbaj') AS text, CAST(contains(x, 'shtuar') AS BIGINT) AS gone FROM p"),
    "expanded_notes": """SELECT p_partkey, CAST(CASE WHEN a = 2 THEN 1 ELSE 2 END AS BIGINT) AS n, CASE WHEN a = 2 THEN '2' ELSE '' END AS lost, CASE WHEN a = b OR a = 2 THEN CAST(1 - b AS VARCHAR) ELSE '' END AS idle,
      'A' || CASE WHEN a = 2 THEN '{{Cref2|2}}' ELSE '<ref name="cnote-' || a || '" group="upper-alpha">' || CASE a WHEN 0 THEN p_name ELSE p_brand END || '</ref>' END || ' B<ref name="cnote-' || b || '" group="upper-alpha"' || CASE WHEN a = b THEN ' />' ELSE '>' || CASE b WHEN 0 THEN p_name ELSE p_brand END || '</ref>' END || chr(10) || '{{Reflist|group=upper-alpha}}' AS text
      FROM (SELECT *, p_size % 3 AS a, p_size % 2 AS b FROM part)""",
}
