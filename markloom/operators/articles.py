"""Whole articles: planning, processing and re-review as chains of tables, and the services of a wiki as local stand-ins.

Edge cases: null texts are empty; an article without text has one empty chunk
less than it has sections, that is none; ties of ord do not occur.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame, functions as F

from ..functions import chunks as K, rewrites as W, wiki as M
from ..functions.checks import validated
from . import engine as E, layout as L, quality as Q, relational as R, stores as S, wikitext as T

DEPTH = 40


class Wiki(Protocol):
    """S07, S08. What a live wiki answers."""

    def expand(self, text: str, title: str) -> str: ...

    def render(self, text: str, title: str) -> tuple[str, list[tuple[str, bool]]]: ...


class LocalWiki:
    """S07, S08. A wiki of given template bodies: expansion puts them in, rendering escapes the text and names its templates."""

    def __init__(self, bodies: dict[str, str]):
        self.bodies = {k.strip().lower(): v for k, v in bodies.items()}

    def expand(self, text: str, title: str = "") -> str:
        """Known templates replaced by their bodies with their parameters, outermost first, DEPTH deep at most."""
        for _ in range(DEPTH):
            m = M.Markup(text)
            edits = []
            for e in m.of("template"):
                body = self.bodies.get(m.key_of(e))
                if body is None:
                    continue
                given = {p.name: p.value for p in m.params(e)} | {"PAGENAME": title}
                b = M.Markup(body)
                slots = [(a.start, a.end, given.get((b.text[a.inner[0] : a.pipes[0] if a.pipes else a.inner[1]]).strip(), b.text[a.pipes[0] + 1 : a.inner[1]] if a.pipes else "")) for a in b.of("argument")]
                edits.append((e.start, e.end, M.edited(body, slots)))
            if not edits:
                break
            text = M.edited(text, edits)
        return text

    def render(self, text: str, title: str = "") -> tuple[str, list[tuple[str, bool]]]:
        out = self.expand(text, title)
        names = M.template_names(text)
        return out.replace("&", "&amp;").replace("<", "&lt;"), [(n, n.lower() in self.bodies) for n in names]


def wiki_of(lang: str, factory: Callable[[str], Wiki]) -> Wiki:
    """S06. The worker's own client of a language, made when it is first asked for."""
    return E.pooled(f"wiki:{lang}", lambda: factory(lang))


def expanded(articles: DataFrame, factory: Callable[[str], Wiki], lang: str) -> DataFrame:
    """S07. articles (article, text) with their templates expanded."""
    return T.mapped(articles, lambda title, text: (wiki_of(lang, factory).expand(text, str(title)),), "text string", "article", "text")


def planned(articles: DataFrame, least: int = K.CHUNK_MIN, most: int = K.CHUNK_MAX) -> DataFrame:
    """R21. articles (article, text): the chunks of their texts, after the rewrites of a source (note list names, notes, defining R calls), with what the engine needs: (article, ord, section, text, tokens, is_complex)."""
    from ..functions.markup import is_complex, plain_notelists

    source = articles.select(F.col("article").alias("id"), plain_notelists(F.coalesce("text", F.lit(""))).alias("text"))
    noted = L.expanded_notes(source).select(F.col("id").alias("article"), "text")
    ready = T.mapped(noted, lambda x: (W.expanded_r(x)[0],), "text string", "text")
    cut = T.article_chunks(ready, least, most)
    return cut.select("article", "ord", F.array_join("titles", "; ").alias("section"), "text", "tokens", is_complex(F.col("text")).alias("is_complex"))


def processed(articles: DataFrame, store: DataFrame, name: str, factory: Callable[[], E.Engine], least: int = K.CHUNK_MIN, most: int = K.CHUNK_MAX) -> DataFrame:
    """F15. articles (article, text): (article, text, findings) after planning, translation from store (k, v) or the engine, repair rounds, the ordered rewrites and the last checks."""
    chunks = planned(articles, least, most).withColumn("k", F.sha2(F.concat_ws("\0", F.lit(name), "text"), 256))
    made = E.translated(chunks, store, name, factory).select("article", "ord", "text", "made")
    state, _ = E.repair_rounds(E.checkpointed(made), name, factory)
    whole = S.partial_articles(state.select("article", "ord", F.lit("").alias("section"), F.lit("translated").alias("status"), F.col("made").alias("text")))
    final = L.ordered(whole.select(F.col("article").alias("id"), "text"))
    gate = Q.qa_findings(final).groupBy("id").agg(F.count("*").alias("n"))
    checked = T.mapped(final.join(gate, "id", "left"), lambda x, n: (len(validated(x)) + (n or 0),), "findings long", "text", "n")
    return checked.select(F.col("id").alias("article"), "text", "findings")


def rereviewed(saved: DataFrame, reviewer: tuple[str, Callable[[], E.Engine]], mender: tuple[str, Callable[[], E.Engine]]) -> DataFrame:
    """F16. saved (article, text) articles with their attribution block: (article, text, changed) after review rounds over their pieces; the block stays, unreviewed."""
    from ..functions.markup import attribution

    parts = saved.select("article", "text", attribution(F.col("text")).alias("a")).select("article", F.col("a.body").alias("body"), F.substring("text", F.length("a.body") + 1, F.length("text")).alias("block"), "text")
    pieces = T.exploded(parts, lambda body: [(p,) for _, p in K.saved_pieces(body)], "made string", ["body"], ["article"])
    state, _ = E.review_rounds(E.checkpointed(pieces.select("article", "ord", F.col("made").alias("text"), "made")), reviewer, mender)
    body = state.groupBy("article").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "made"))), lambda r: r["made"]), "").alias("new"))
    out = parts.join(body, "article", "left").select("article", F.concat(F.coalesce("new", F.lit("")), "block").alias("text"), F.col("text").alias("old"))
    return out.select("article", "text", (F.col("text") != F.col("old")).alias("changed"))


def resolved(titles: DataFrame, cache: DataFrame, live: DataFrame) -> DataFrame:
    """J02, J03. titles (k) through cache and live answers (k, v), under their normal forms."""
    from ..functions.text import normal_title

    return R.resolve_cached(titles.select(normal_title(F.col("k")).alias("k")), cache, live)
