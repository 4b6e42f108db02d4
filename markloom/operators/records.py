"""Relational operators over findings, look-ups, stores and usage records."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .relational import _sql

# Sites whose ids end like those of language editions.
NON_EDITIONS = ("commonswiki", "specieswiki", "metawiki", "wikidatawiki", "mediawikiwiki", "sourceswiki", "incubatorwiki", "outreachwiki", "wikimaniawiki", "foundationwiki", "wikifunctionswiki")


def language_breakdown(pages: DataFrame) -> DataFrame:
    """A05. pages (langs): how often each name of the comma-separated lists occurs; empty names are dropped."""
    return _sql("SELECT lang, count(*) AS n FROM (SELECT trim(l) AS lang FROM {pages} LATERAL VIEW explode(split(langs, ',')) t AS l) x WHERE lang <> '' GROUP BY lang", pages=pages)


def reconcile_footnotes(notes: DataFrame) -> DataFrame:
    """A08. notes (article, key, pos, ps): all notes of a key take the first one's ps, null included."""
    return _sql(
        """SELECT article, pos, first, NOT (ps <=> first) AS changed FROM
        (SELECT article, pos, ps, first_value(ps) OVER (PARTITION BY article, key ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first FROM {notes}) x""",
        notes=notes,
    )


def established(renderings: DataFrame) -> DataFrame:
    """A11. renderings (article, title, display, seq): the first display of each title."""
    return _sql("SELECT article, title, min_by(display, seq) AS display FROM {renderings} GROUP BY article, title", renderings=renderings)


def compare_engines(runs: DataFrame) -> DataFrame:
    """A15. runs (model, runtime, tokens, hit, failed): totals by model; judged if two models or more failed nothing."""
    return _sql(
        """WITH m AS (SELECT model, count(*) AS calls, round(sum(runtime), 4) AS runtime, sum(tokens) AS tokens, count_if(hit) AS hits, count_if(failed) AS failures FROM {runs} GROUP BY model)
        SELECT m.*, whole.n >= 2 AND m.failures = 0 AS judged FROM m CROSS JOIN (SELECT count_if(failures = 0) AS n FROM m) whole""",
        runs=runs,
    )


def sitelinks(wanted: DataFrame, answers: DataFrame) -> DataFrame:
    """J03. wanted (title), answers (title, target): every distinct title gets the answer of its normal form; checked tells a null answer from none."""
    return _sql(
        """SELECT w.title, a.target, a.title IS NOT NULL AS checked FROM (SELECT DISTINCT title FROM {wanted}) w
        LEFT JOIN {answers} a ON concat(upper(left(w.title, 1)), substr(w.title, 2)) = a.title""",
        wanted=wanted,
        answers=answers,
    )


def edition_counts(entities: DataFrame, links: DataFrame, source: str) -> DataFrame:
    """J04. entities (entity), links (entity, site): language editions of an entity besides the source's, 0 for none."""
    out = ", ".join(f"'{s}'" for s in (*NON_EDITIONS, source))
    return _sql(
        f"""SELECT e.entity, coalesce(l.n, 0) AS n FROM {{entities}} e LEFT JOIN
        (SELECT entity, count(DISTINCT site) AS n FROM {{links}} WHERE endswith(site, 'wiki') AND site NOT IN ({out}) GROUP BY entity) l ON e.entity = l.entity""",
        entities=entities,
        links=links,
    )


def over_limits(chunks: DataFrame, ratio: float = 5.0, total: int = 0) -> DataFrame:
    """V17. chunks (article, seq, n_in, n_out): the first seq at which the running tokens break a limit; 0 turns a limit off."""
    return _sql(
        f"""SELECT article, min(seq) AS seq FROM (SELECT article, seq, sum(n_in) OVER w AS i, sum(n_out) OVER w AS o FROM {{chunks}} WINDOW w AS (PARTITION BY article ORDER BY seq ROWS UNBOUNDED PRECEDING)) x
        WHERE ({ratio}D > 0 AND i > 0 AND o > {ratio}D * i) OR ({total} > 0 AND i + o > {total}) GROUP BY article""",
        chunks=chunks,
    )


def with_hits(store: DataFrame, requests: DataFrame) -> DataFrame:
    """U02. store (k, v, hits), requests (k): the store with the requests it answered counted; requests are counted before they are joined."""
    return _sql("SELECT s.k, s.v, s.hits + coalesce(r.n, 0) AS hits FROM {store} s LEFT JOIN (SELECT k, count(*) AS n FROM {requests} GROUP BY k) r ON s.k = r.k", store=store, requests=requests)


def present(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """U04. Rows of store (k, v) whose key is wanted (k)."""
    return _sql("SELECT s.k, s.v FROM {store} s LEFT SEMI JOIN {wanted} w ON s.k = w.k", store=store, wanted=wanted)


def input_titles(lines: DataFrame) -> DataFrame:
    """S02. lines (n, value): titles of a line file; blank lines and those with a # in front are dropped, repeats stay."""
    return _sql("SELECT n, trim(value) AS title FROM {lines} WHERE trim(value) <> '' AND NOT startswith(trim(value), '#')", lines=lines)


def existing(wanted: DataFrame, normalized: DataFrame, redirects: DataFrame, pages: DataFrame) -> DataFrame:
    """S05. wanted (title) through normalized and redirects (src, dst), each at most once, to pages (title); sections of a target are left out."""
    return _sql(
        """WITH a AS (SELECT w.title, coalesce(n.dst, w.title) AS t FROM {wanted} w LEFT JOIN {normalized} n ON w.title = n.src),
        b AS (SELECT a.title, substring_index(coalesce(r.dst, a.t), '#', 1) AS t FROM a LEFT JOIN {redirects} r ON a.t = r.src)
        SELECT b.title, p.title AS page, p.title IS NOT NULL AS found FROM b LEFT JOIN {pages} p ON b.t = p.title""",
        wanted=wanted,
        normalized=normalized,
        redirects=redirects,
        pages=pages,
    )


def review_index(entries: DataFrame) -> DataFrame:
    """K07. entries (title, seq, note): the last note of each title as a table row, pipes escaped."""
    return _sql(r"""SELECT title, max(seq) AS seq, concat('| ', replace(title, '|', '\\|'), ' | ', replace(max_by(note, seq), '|', '\\|'), ' |') AS row FROM {entries} GROUP BY title""", entries=entries)
