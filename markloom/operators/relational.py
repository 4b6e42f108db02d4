"""Relational operators over markup corpora, in SQL that Catalyst plans whole.

Every function takes DataFrames with the columns its docstring names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def _sql(text: str, **frames: DataFrame) -> DataFrame:
    return next(iter(frames.values())).sparkSession.sql(text, **frames)


def merge_spans(spans: DataFrame) -> DataFrame:
    """P05. spans (id, s, e): overlapping or touching half-open spans of an id become one; null borders come last.

    Both windows have one order, so that equal spans keep theirs from the first to the second.
    """
    return _sql(
        """WITH a AS (SELECT id, s, e, max(e) OVER (PARTITION BY id ORDER BY s NULLS LAST, e NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM {spans}),
        b AS (SELECT id, s, e, sum(CASE WHEN top IS NULL OR s > top THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY s NULLS LAST, e NULLS LAST ROWS UNBOUNDED PRECEDING) AS island FROM a)
        SELECT id, min(s) AS s, max(e) AS e FROM b GROUP BY id, island""",
        spans=spans,
    )


def complement_spans(spans: DataFrame, lengths: DataFrame) -> DataFrame:
    """P06. What merged spans leave uncovered of [0, n) for every (id, n) of lengths."""
    return _sql(
        """WITH edges AS (SELECT id, s, e FROM {spans} UNION ALL SELECT id, n, n FROM {lengths}),
        gaps AS (SELECT id, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s NULLS LAST, e NULLS LAST), 0) AS s, s AS e FROM edges)
        SELECT id, s, e FROM gaps WHERE s < e""",
        spans=merge_spans(spans),
        lengths=lengths,
    )


def line_runs(lines: DataFrame) -> DataFrame:
    """P04. lines (id, n, hit): runs of neighbouring lines with hit, as first and last line."""
    return _sql(
        """WITH a AS (SELECT id, n, n - row_number() OVER (PARTITION BY id ORDER BY n) AS island FROM {lines} WHERE hit)
        SELECT id, min(n) AS first_line, max(n) AS last_line FROM a GROUP BY id, island""",
        lines=lines,
    )


def assemble(chunks: DataFrame) -> DataFrame:
    """K01. chunks (article, ord, text): 1-based inclusive line spans in the ordered concatenation.

    A newline joins two chunks only if both have text and neither has one at
    the joint; an empty or null chunk ends before it starts.
    """
    return _sql(
        """WITH a AS (SELECT article, ord, coalesce(text, '') AS text, last_value(nullif(text, ''), true) OVER (PARTITION BY article ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {chunks}),
        b AS (SELECT article, ord, text, CASE WHEN text <> '' AND before IS NOT NULL AND right(before, 1) <> '\\n' AND left(text, 1) <> '\\n' THEN 1 ELSE 0 END AS joint, length(text) - length(replace(text, '\\n', '')) AS breaks FROM a),
        c AS (SELECT *, sum(joint + breaks) OVER (PARTITION BY article ORDER BY ord ROWS UNBOUNDED PRECEDING) AS total FROM b)
        SELECT article, ord, CAST(1 + total - breaks AS BIGINT) AS first_line,
          CAST(CASE WHEN text = '' THEN total - breaks WHEN right(text, 1) = '\\n' THEN total ELSE 1 + total END AS BIGINT) AS last_line FROM c""",
        chunks=chunks,
    )


def locate_findings(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """J05. findings (article, finding, line): the first chunk (by ord) whose span holds the line; null where none does.

    A span (article, ord, first_line, last_line) lies in one or two bins of the
    least power of two that is no shorter than it, and a line meets the spans of
    its bin at each length that occurs, at most 63; so the join is on equal
    (article, length, bin), and an article of any number of lines is dealt over
    all tasks.  Null lines, articles and borders meet nothing; spans that end
    before they start hold nothing; repeated findings are one.
    """
    return _sql(
        """WITH s AS (SELECT article, ord, first_line, last_line, CAST(length(conv(last_line - first_line, 10, 2)) * if(last_line = first_line, 0, 1) AS INT) AS k FROM {spans} WHERE last_line >= first_line AND article IS NOT NULL),
        b AS (SELECT *, explode(array_distinct(array(shiftright(CAST(first_line AS BIGINT), k), shiftright(CAST(last_line AS BIGINT), k)))) AS bin FROM s),
        f AS (SELECT DISTINCT article, finding, line FROM {findings}),
        l AS (SELECT article, finding, line, explode(ks) AS k FROM (SELECT *, (SELECT collect_set(k) FROM s) AS ks FROM f WHERE line IS NOT NULL) x),
        m AS (SELECT l.article, l.finding, min(b.ord) AS ord FROM l JOIN b ON l.article = b.article AND l.k = b.k AND shiftright(CAST(l.line AS BIGINT), l.k) = b.bin AND l.line BETWEEN b.first_line AND b.last_line GROUP BY l.article, l.finding)
        SELECT f.article, f.finding, m.ord FROM (SELECT DISTINCT article, finding FROM f) f LEFT JOIN m ON f.article <=> m.article AND f.finding <=> m.finding""",
        spans=spans,
        findings=findings,
    )


def usage_by_model(usage: DataFrame) -> DataFrame:
    """A01-A03. usage (model, tokens, cost): calls, tokens and cost of each model and of all (model null)."""
    return _sql("SELECT model, count(*) AS calls, sum(tokens) AS tokens, round(sum(cost), 4) AS cost FROM {usage} GROUP BY ROLLUP (model)", usage=usage)


def merge_usage(left: DataFrame, right: DataFrame) -> DataFrame:
    """A02. Two partial reports (model, calls, tokens, cost) as one."""
    return _sql("SELECT model, sum(calls) AS calls, sum(tokens) AS tokens, sum(cost) AS cost FROM (SELECT * FROM {left} UNION ALL SELECT * FROM {right}) u GROUP BY model", left=left, right=right)


def costs(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """A04. usage (id, model, n_in, n_out, reported) priced by prices (model, p_in, p_out); a reported cost wins, no price is 0."""
    return _sql(
        """SELECT u.id, coalesce(u.reported, u.n_in * coalesce(p.p_in, 0) + u.n_out * coalesce(p.p_out, 0)) AS cost
        FROM {usage} u LEFT JOIN {prices} p ON u.model = p.model""",
        usage=usage,
        prices=prices,
    )


def resolve_cached(wanted: DataFrame, cache: DataFrame, live: DataFrame) -> DataFrame:
    """J02. wanted (k): value from live where it has one, else from cache; checked tells a known null from an unchecked key.

    Of several rows of a key the largest value counts, null only if there is no other.
    """
    return _sql(
        """SELECT w.k, CASE WHEN l.k IS NOT NULL THEN l.v ELSE c.v END AS v, (l.k IS NOT NULL OR c.k IS NOT NULL) AS checked
        FROM (SELECT DISTINCT k FROM {wanted}) w LEFT JOIN (SELECT k, max(v) AS v FROM {cache} GROUP BY k) c ON w.k = c.k LEFT JOIN (SELECT k, max(v) AS v FROM {live} GROUP BY k) l ON w.k = l.k""",
        wanted=wanted,
        cache=cache,
        live=live,
    )


def upsert(stored: DataFrame, new: DataFrame) -> DataFrame:
    """U03. (k, v, created, seq) tables: the latest v of each key with the key's first created."""
    return _sql(
        """SELECT k, max_by(v, seq) AS v, min(created) AS created FROM (SELECT k, v, created, seq FROM {stored} UNION ALL SELECT k, v, created, seq FROM {new}) u GROUP BY k""",
        stored=stored,
        new=new,
    )


def cache_keys(rows: DataFrame) -> DataFrame:
    """U01. rows (id, model, source_lang, target_lang, skill_hash, facts_hash, text): SHA-256 over the NUL-joined parts."""
    return _sql("SELECT id, sha2(concat_ws(chr(0), model, source_lang, target_lang, skill_hash, facts_hash, text), 256) AS cache_key FROM {rows}", rows=rows)


def recurring_terms(mentions: DataFrame, confirmed: DataFrame | None = None, top: int = 40) -> DataFrame:
    """A06. mentions (article, chunk, term, pos): terms of two chunks or more, most frequent first, then first seen; top per article.

    Numbers, places inside a page and, by an anti join, what confirmed (article,
    term) already has a target for are left out; null terms and articles too.
    """
    own = mentions if confirmed is None else mentions.join(confirmed.select("article", "term"), ["article", "term"], "left_anti")
    return _sql(
        f"""WITH a AS (SELECT article, term, count(DISTINCT chunk) AS n, min(pos) AS pos FROM {{mentions}}
          WHERE article IS NOT NULL AND NOT term RLIKE '^[0-9]+$' AND NOT startswith(term, '#') GROUP BY article, term HAVING count(DISTINCT chunk) >= 2),
        b AS (SELECT article, term, n, row_number() OVER (PARTITION BY article ORDER BY n DESC, pos) AS place FROM a)
        SELECT article, term, n, place FROM b WHERE place <= {top}""",
        mentions=own,
    )


def canonical_forms(forms: DataFrame) -> DataFrame:
    """A07. forms (finding, ord, form, n): the most frequent form of a finding with two forms present, the earlier on a tie."""
    return _sql("SELECT finding, max_by(form, struct(n, -ord)) AS canonical FROM {forms} WHERE n > 0 GROUP BY finding HAVING count(*) >= 2", forms=forms)


def restore_names(made: DataFrame, source: DataFrame) -> DataFrame:
    """J09. Definitions (article, pos, print) take the one name that source definitions (article, print, name) of the same print have."""
    return _sql(
        """WITH one AS (SELECT article, print, min(name) AS name FROM {source} GROUP BY article, print HAVING count(DISTINCT name) = 1)
        SELECT m.article, m.pos, o.name FROM {made} m JOIN one o ON m.article = o.article AND m.print = o.print""",
        made=made,
        source=source,
    )


def lost_templates(before: DataFrame, after: DataFrame) -> DataFrame:
    """V14. (article, name) rows: names whose count fell, with both counts."""
    return _sql(
        """WITH b AS (SELECT article, name, count(*) AS n FROM {before} GROUP BY article, name), a AS (SELECT article, name, count(*) AS n FROM {after} GROUP BY article, name)
        SELECT b.article, b.name, b.n AS had, coalesce(a.n, 0) AS has FROM b LEFT JOIN a ON b.article = a.article AND b.name = a.name WHERE coalesce(a.n, 0) < b.n""",
        before=before,
        after=after,
    )


def stale_claims(claims: DataFrame, hours: float = 3) -> DataFrame:
    """Q02. claims (worker, ts): claims older than hours at the latest claim of all."""
    return _sql(f"SELECT c.id, c.worker FROM {{claims}} c, (SELECT max(ts) AS now FROM {{claims}}) n WHERE c.ts < n.now - INTERVAL {int(hours * 3600)} SECONDS", claims=claims)


def attempts(tries: DataFrame, limit: int = 3) -> DataFrame:
    """Q04. tries (article): number of attempts, and whether the limit is reached."""
    return _sql(f"SELECT article, count(*) AS n, count(*) >= {limit} AS exhausted FROM {{tries}} GROUP BY article", tries=tries)


def pending(wanted: DataFrame, done: DataFrame, locked: DataFrame) -> DataFrame:
    """J15, S12. wanted (article) without those done or locked."""
    return _sql("SELECT DISTINCT w.article FROM {wanted} w LEFT ANTI JOIN {done} d ON w.article = d.article LEFT ANTI JOIN {locked} l ON w.article = l.article", wanted=wanted, done=done, locked=locked)
