"""Stores, sinks and reports: rows in, text or rows out, in DataFrame expressions.

Edge cases: null titles and notes are left out where the docstring says so;
ties are ordered by what the docstring names; an empty table gives an empty
report or none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import markup as M
from .relational import _sql, upsert

# Fixed values.
HARMLESS_MISSING = ("Moduli:WikidataIB/i18n", "Moduli:SST/registry", "Moduli:TNT/config", "Stampa:Sec link image")


def row_count(store: DataFrame) -> DataFrame:
    """U06. Number of rows."""
    return store.agg(F.count("*").alias("n"))


def recached(store: DataFrame, repaired: DataFrame) -> DataFrame:
    """U08. store (k, v, created, seq) with repaired (k, v, seq) written under their own keys; created stays, unknown keys take their seq."""
    new = repaired.select("k", "v", F.lit(None).cast(store.schema["created"].dataType).alias("created"), "seq")
    return upsert(store, new)


def partial_articles(chunks: DataFrame) -> DataFrame:
    """K02. chunks (article, ord, section, status, text): the text so far of each article, a comment for each unfinished chunk; parts are joined as K01 joins them."""
    shown = chunks.select("article", "ord", F.coalesce(M.shown_or_pending(F.col("status"), F.coalesce("section", F.lit("")), F.coalesce("text", F.lit(""))), F.lit("")).alias("text"))
    return _sql(
        """WITH a AS (SELECT article, ord, text, last_value(nullif(text, ''), true) OVER (PARTITION BY article ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {shown}),
        b AS (SELECT article, ord, CASE WHEN text <> '' AND before IS NOT NULL AND right(before, 1) <> '\\n' AND left(text, 1) <> '\\n' THEN concat('\\n', text) ELSE text END AS part FROM a)
        SELECT article, array_join(transform(array_sort(collect_list(struct(ord, part))), r -> r.part), '') AS text FROM b GROUP BY article""",
        shown=shown,
    )


def stats_line(usage: DataFrame) -> DataFrame:
    """K06. usage (model, tokens, cost) as one JSON object: totals, and a map of the models in order."""
    each = usage.groupBy("model").agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"))
    row = F.struct("model", "calls", "tokens", "cost")
    return each.agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"), F.array_sort(F.collect_list(row)).alias("models")).select(F.to_json(F.struct("calls", "tokens", "models")).alias("line"))


def fact_export(links: DataFrame) -> DataFrame:
    """K10. links (kind, title, target): a line a confirmed fact, by kind and title; missing ones are left out."""
    kinds = F.create_map(F.lit("link"), F.lit("Links"), F.lit("template"), F.lit("Templates"))
    lines = links.where("target IS NOT NULL").select("kind", "title", F.concat(F.lit("| "), "title", F.lit(" | "), "target", F.lit(" |")).alias("line"))
    body = lines.groupBy("kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("title", "line"))), lambda r: r["line"]), "\n").alias("body"))
    return body.select("kind", F.concat(F.lit("## "), F.coalesce(kinds[F.col("kind")], F.col("kind")), F.lit("\n"), "body").alias("text"))


def article_reports(articles: DataFrame, facts: DataFrame) -> DataFrame:
    """K08. articles (article, lang, revid, repaired), facts (article, kind, title, target): a report of source, confirmed and missing facts by kind, and repairs."""
    names = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("title")))), ", ")
    by_kind = facts.groupBy("article", "kind").agg(names(F.col("target").isNotNull()).alias("confirmed"), names(F.col("target").isNull()).alias("missing"))
    line = F.concat_ws("\n", F.concat(F.lit("## "), "kind"), F.concat(F.lit("- confirmed: "), "confirmed"), F.concat(F.lit("- missing: "), "missing"))
    parts = by_kind.groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", line.alias("line")))), lambda r: r["line"]), "\n").alias("facts"))
    head = F.concat_ws("\n", F.concat(F.lit("# "), F.col("article").cast("string")), F.concat(F.lit("- language: "), "lang"), F.concat(F.lit("- revision: "), F.col("revid").cast("string")), F.concat(F.lit("- repaired: "), F.col("repaired").cast("string")))
    return articles.join(parts, "article", "left").select("article", F.concat_ws("\n", head, "facts").alias("text"))


def with_section(report: Column, heading: str, body: Column) -> Column:
    """K12. A report with one section of that heading replaced, or put in front of the attribution block or at the end where it has none."""
    section = F.concat(F.lit(f"{heading}\n"), body, F.lit("\n"))
    at = F.instr(F.concat(F.lit("\n"), report), f"\n{heading}\n")
    behind = F.substring(report, at + len(heading), F.length(report))
    following = F.instr(behind, "\n## ")
    rest = F.when(following > 0, F.substring(behind, following + 1, F.length(behind))).otherwise(F.lit(""))
    block = F.instr(report, "<!--\nNUK ËSHTË PJESË")
    return (
        F.when(at > 0, F.concat(F.substring(report, F.lit(1), at - 1), section, rest))
        .when(block > 0, F.concat(F.substring(report, F.lit(1), block - 1), section, F.lit("\n"), F.substring(report, block, F.length(report))))
        .otherwise(F.concat(F.rtrim(report, F.lit(" \n")), F.lit("\n\n"), section))
    )


def attribution_block(title: Column, lang: Column, revid: Column, ts: Column) -> Column:
    """K09. The block that names an English source's revision; null for other languages or without revision or time."""
    day = M.attribution_date(ts)
    call = F.concat(F.lit("{{Përkthyer nga|en|"), title, F.lit("|"), day, F.lit("|"), revid.cast("string"), F.lit("}}"))
    return F.when((lang == "en") & revid.isNotNull() & ts.isNotNull(), F.concat(F.lit("<!--\nNUK ËSHTË PJESË E ARTIKULLIT\n\n== Për faqen e diskutimit (Talk) ==\n"), call, F.lit("\n-->")))


def live_findings(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """V12. pages (article, html), templates (article, title, exists): errors that a rendered page shows, each text once, and templates that are missing.

    Errors are the strong and span elements whose class names a script or citation error.
    """
    marked = r'(?is)<(?:strong|span)\b[^>]*\bclass="([^"]*(?:scribunto-error|cite[-_]error)[^"]*)"[^>]*>(.*?)</(?:strong|span)>'
    both = pages.select("article", F.explode(F.arrays_zip(F.regexp_extract_all("html", F.lit(marked), F.lit(1)).alias("c"), F.regexp_extract_all("html", F.lit(marked), F.lit(2)).alias("m"))).alias("x"))
    said = F.trim(F.regexp_replace(F.regexp_replace(F.col("x.m"), "<[^>]+>", ""), r"\s+", " "))
    script = F.lower(F.col("x.c")).contains("scribunto-error") | said.rlike("(?i)script error|lua error")
    kind = F.when(script, "lua_script_error").when(F.lower(said).contains("ref"), "orphaned_named_ref").otherwise("cite_error")
    errors = both.select("article", kind.alias("kind"), said.alias("message")).where("message <> ''")
    scripts, cites = errors.where("kind = 'lua_script_error'"), errors.where("kind <> 'lua_script_error'").distinct()
    plain = F.regexp_replace("html", "<[^>]+>", "")
    leaks = pages.select("article", F.lit("country_data_leak").alias("kind"), F.explode(F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?i)Country[\s_-]data[\s_]\S+"), F.lit(0)))).alias("message"))
    missing = templates.where(~F.col("exists") & ~F.col("title").isin(*HARMLESS_MISSING)).select("article", F.lit("unexpanded_template").alias("kind"), F.col("title").alias("message"))
    return scripts.unionByName(cites).unionByName(leaks).unionByName(missing)


def gathered_facts(mentions: DataFrame, cache: DataFrame, live: DataFrame, target: DataFrame, counts: DataFrame) -> DataFrame:
    """J21. mentions (article, kind, title) of links and templates: the cached or else live answer (kind, title, target); a template without one counts as there if the target wiki (title) has it; links without one take the number of other editions (title, n)."""
    return _sql(
        """WITH m AS (SELECT DISTINCT article, kind, title FROM {mentions}),
        l AS (SELECT kind, title, max(target) AS target FROM {live} GROUP BY kind, title), c AS (SELECT kind, title, max(target) AS target FROM {cache} GROUP BY kind, title),
        a AS (SELECT m.*, CASE WHEN l.title IS NOT NULL THEN l.target ELSE c.target END AS target, l.title IS NOT NULL OR c.title IS NOT NULL AS checked FROM m LEFT JOIN l USING (kind, title) LEFT JOIN c USING (kind, title))
        SELECT a.article, a.kind, a.title, coalesce(a.target, CASE WHEN a.kind = 'template' THEN t.title END) AS target, a.checked OR t.title IS NOT NULL AS checked,
          CASE WHEN a.kind = 'link' AND a.target IS NULL AND a.checked THEN coalesce(n.n, 0) END AS editions
        FROM a LEFT JOIN (SELECT DISTINCT title FROM {target}) t ON a.kind = 'template' AND a.target IS NULL AND a.title = t.title LEFT JOIN (SELECT title, max(n) AS n FROM {counts} GROUP BY title) n ON a.title = n.title""",
        mentions=mentions,
        cache=cache,
        live=live,
        target=target,
        counts=counts,
    )


def category_members(pages: DataFrame, limit: int = 500) -> DataFrame:
    """S04. pages (category, ns, title): the first ``limit`` articles (namespace 0) of each category, by title."""
    return _sql(f"SELECT category, title FROM (SELECT category, title, row_number() OVER (PARTITION BY category ORDER BY title) AS n FROM {{pages}} WHERE ns = 0) x WHERE n <= {limit}", pages=pages)


def sibling_links(articles: DataFrame, most: int = M.SIBLING_LINKS) -> DataFrame:
    """A12. articles (article, links array): the first links of each."""
    return articles.select("article", F.slice("links", 1, most).alias("links"))


def score_tables(judged: DataFrame) -> DataFrame:
    """K11. judged (article, label, model, score): a row a model, best first, labels for names."""
    ranked = F.struct(-F.col("score"), "label", F.concat(F.lit("| "), "label", F.lit(" | "), "model", F.lit(" | "), F.col("score").cast("string"), F.lit(" |")).alias("line"))
    return judged.groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(ranked)), lambda r: r["line"]), "\n").alias("table"))
