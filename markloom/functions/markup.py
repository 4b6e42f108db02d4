"""Extraction, checks and repairs of markup text as column expressions; none of them shuffles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Fixed values.
NOTELIST_ALIASES = ("nlist", "noteslist", "notes list", "note list", "nls", "notes", "efnlist")
LEAK_MARKERS = (
    "NUK ËSHTË PJESË E ARTIKULLIT",
    "Për faqen e diskutimit (Talk)",
    "{{Përkthyer nga|",
    "Nuk ka tekst burimor",
    "Ju lutem siguroni tekstin",
    "as an ai language model",
    "i cannot translate",
    "i don't have access to",
    "there is no source text",
    "please provide the text",
    "the provided wikitext appears to be",
    "i'll provide a clean version",
    "doesn't form meaningful content",
)
MONTHS = ("janar", "shkurt", "mars", "prill", "maj", "qershor", "korrik", "gusht", "shtator", "tetor", "nëntor", "dhjetor")
USAGE_LIMIT = r"(?i)rate[ _]limit|usage limit|spend limit|quota|\b429\b"
RETRYABLE = (429, 500, 502, 503)
COMPLEX_ROWS, COMPLEX_REFS, COMPLEX_TEMPLATES = 5, 15, 30
TOO_MANY_PARAMS, SIBLING_LINKS, SNIPPET = 60, 80, 120


def sections(text: Column) -> Column:
    """P01. Array of sections with their headings, blank ones dropped; the text is cut before each heading line."""
    return F.filter(F.split(text, r"(?m)(?=^(={1,6})[^=\n](?:[^\n]*[^=\n])?\1[ \t]*$)"), lambda s: s.rlike(r"\S"))


def section_level(section: Column) -> Column:
    """P01. Number of equals signs of the heading, 0 for the lead."""
    return F.length(F.regexp_extract(section, r"^(={1,6})[^=\n][^\n]*=[ \t]*(?:\n|$)", 1))


def section_title(section: Column) -> Column:
    """P01. Title of the heading, ``Lead`` where there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(section, r"^={1,6}[ \t]*([^=\n][^\n]*?)[ \t]*={1,6}[ \t]*(?:\n|$)", 1), F.lit("")), F.lit("Lead"))


def tokens(text: Column) -> Column:
    """P02. Runs of word characters plus single marks: a stand-in, not equal to any model's count."""
    return F.regexp_count(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"))


def is_complex(text: Column) -> Column:
    """P10. Boxes, tables of many rows, dense references or templates; without tokens only boxes count."""
    n = tokens(text)
    return text.rlike(r"\{\{\s*([Ii]nfobox|[Nn]avbox)") | (
        (n > 0)
        & (
            (F.regexp_count(text, F.lit(r"\|-")) >= COMPLEX_ROWS)
            | (F.regexp_count(text, F.lit("(?i)<ref")) * 1000 > n * COMPLEX_REFS)
            | (F.regexp_count(text, F.lit(r"\{\{")) * 1000 > n * COMPLEX_TEMPLATES)
        )
    )


def declared_params(text: Column) -> Column:
    """P14. Named placeholders of a template without their trailing digits, first seen first."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"\{\{\{([^{}|]*)[|}]"), F.lit(1)), lambda n: F.trim(n))
    names = F.array_distinct(F.filter(found, lambda n: n.rlike(r"^[A-Za-z_]\w*$")))
    return F.slice(F.array_distinct(F.transform(names, lambda n: F.rtrim(n, F.lit("0123456789")))), 1, TOO_MANY_PARAMS)


def locate(text: Column, needle: Column) -> Column:
    """P19. Line of the first occurrence and the rest of that line, cut to 120 characters; nulls where there is none."""
    at = F.when(F.length(needle) > 0, F.nullif(F.instr(text, needle), F.lit(0)))
    before = F.substring(text, F.lit(1), at - 1)
    rest = F.trim(F.substring_index(F.substring(text, at, F.length(text)), "\n", 1))
    cut = F.when(F.length(rest) > SNIPPET, F.concat(F.substring(rest, 1, SNIPPET - 1), F.lit("…"))).otherwise(rest)
    return F.when(at.isNotNull(), F.struct((F.regexp_count(before, F.lit("\n")) + 1).alias("line"), cut.alias("snippet")))


def plain_notelists(text: Column) -> Column:
    """P21. Aliases of the note list become ``notelist`` where the name ends."""
    names = "|".join(a.replace(" ", r"\s+") for a in NOTELIST_ALIASES)
    return F.regexp_replace(text, rf"(?i)(\{{\{{\s*)(?:{names})(?=\s*[|}}])", "$1notelist")


def plain_quotes(text: Column) -> Column:
    """P23. Templates that only draw quotation marks become those marks; runs of any length take no stack."""
    return F.regexp_replace(text, r"""\{\{\s*+(["'`](?:[\s"'`]*["'`])?)\s*+\}\}""", "$1")


def leaks(text: Column) -> Column:
    """V06. Markers of leaked commentary that the text holds, letter case aside."""
    held = F.lower(text)
    return F.filter(F.array(*[F.lit(m) for m in LEAK_MARKERS]), lambda m: F.contains(held, F.lower(m)))


def is_usage_limit(text: Column) -> Column:
    """V18. Whether an error speaks of a limit; 429 counts as a whole number only."""
    return text.rlike(USAGE_LIMIT)


def is_truncated(stop: Column, visible: Column, chars: Column) -> Column:
    """V19. Stopped at the limit, or 2,000 visible tokens and more with fewer characters than tokens."""
    return F.coalesce(stop == "max_tokens", F.lit(False)) | F.coalesce((visible >= 2000) & (chars < visible), F.lit(False))


def archive_urls(text: Column) -> Column:
    """R15. Archive addresses with cut timestamps in their right form; of several cut ones in a row the last stays."""
    host = r"https?://web\.archive\.org/web/"
    year, month, day, clock = r"([0-9]{4})", r"([0-9]{2})", r"([0-9]{2})", r"([0-9]{6})"
    marked = F.regexp_replace(text, rf"{host}{year}[/-]{month}[/-](?:\1-\2-)?{day}/?{clock}/(?=https?://)", "\ue000$1$2$3$4/")
    last = F.regexp_replace(F.regexp_replace(marked, "\ue000[0-9]{14}/(?=\ue000)", ""), "\ue000([0-9]{14})/", "https://web.archive.org/web/$1/")
    return F.when(F.contains(text, F.lit("\ue000")), text).otherwise(last)


def source_ref(raw: Column) -> Column:
    """S01. (lang, title) of an address or ``lang:Title``; lang is null where neither is given; plus and broken percent signs stay."""
    t = F.trim(raw)
    url = F.when(t.rlike("(?i)^https?://"), t).otherwise(F.concat(F.lit("https://"), t))
    host = F.split(F.lower(F.regexp_extract(url, "^[^/]*//([^/]*)", 1)), r"\.")
    page = F.regexp_extract(url, "^[^/]*//[^/]*/wiki/([^?#]+)", 1)
    wiki = (page != "") & F.array_join(F.filter(F.slice(host, 2, 4), lambda x: x != "m"), ".").eqNullSafe("wikipedia.org") & F.element_at(host, 1).rlike("^[a-z0-9-]+$")
    title = F.replace(F.coalesce(F.try_url_decode(F.replace(page, F.lit("+"), F.lit("%2B"))), page), F.lit("_"), F.lit(" "))
    lang, rest = F.substring_index(t, ":", 1), F.trim(F.substring(t, F.instr(t, ":") + 1, F.length(t)))
    named = F.contains(t, F.lit(":")) & lang.rlike("^[a-z]{2,3}(-[a-z]+)?$") & (rest != "")
    none = F.lit(None).cast("string")
    return F.struct(F.when(wiki, F.element_at(host, 1)).when(named, lang).otherwise(none).alias("lang"), F.when(wiki, title).when(named, rest).otherwise(t).alias("title"))


def bundle_hash(*parts: Column) -> Column:
    """S11. First 16 hex digits of SHA-256 over the parts with NUL between them."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def attribution(text: Column) -> Column:
    """S14. (body, revid): text before the last attribution block, and the revision it names."""
    start, call = "<!--\nNUK ËSHTË PJESË", "{{Përkthyer nga|"
    at = F.length(text) - F.instr(F.reverse(text), F.lit(start[::-1])) - len(start) + 2
    has = F.contains(text, F.lit(start))
    body = F.when(has, F.rtrim(F.substring(text, F.lit(1), at - 1), F.lit("\n"))).otherwise(text)
    tail = F.when(has, F.substring(text, at, F.length(text)))
    given = F.split(F.substring_index(F.substring(tail, F.instr(tail, call) + len(call), F.length(tail)), "}}", 1), r"\|")
    revid = F.when(F.contains(tail, F.lit(call)) & (F.size(given) == 4) & F.get(given, F.lit(3)).rlike("^[0-9]+$"), F.get(given, F.lit(3)).try_cast("long"))
    return F.struct(body.alias("body"), revid.alias("revid"))


def attribution_date(ts: Column) -> Column:
    """K09. Day, month name and year, without zeros in front."""
    return F.concat_ws(" ", F.dayofmonth(ts), F.element_at(F.array(*[F.lit(m) for m in MONTHS]), F.month(ts)), F.year(ts))


def shown_or_pending(status: Column, section: Column, text: Column) -> Column:
    """K02. The text of a chunk that is translated, cached or repaired, a comment naming section and status for any other."""
    return F.when(status.isin("translated", "cached", "repaired"), text).otherwise(F.concat(F.lit("<!-- pending: "), section, F.lit(" ("), status, F.lit(") -->")))


def score(answer: Column, name: str) -> Column:
    """A14. Whole number of a judge's JSON, fenced or between the outermost braces; 0 if missing or no number."""
    body = F.coalesce(F.nullif(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit("")), F.regexp_extract(answer, r"(?s)(\{.*\})", 1))
    return F.coalesce(F.get_json_object(body, f"$.{name}").try_cast("double").try_cast("int"), F.lit(0))


def eta(done: Column, total: Column, elapsed: Column) -> Column:
    """A16. Seconds left at the rate so far, null before the first is done."""
    return F.when((done > 0) & (elapsed > 0), (total - done) * elapsed / done)


def is_milestone(done: Column, total: Column) -> Column:
    """A16. Each tenth of the total, and the last."""
    return (done == total) | (done % F.greatest(F.lit(1), F.floor(total / 10)) == 0)


def backoff(attempt: Column) -> Column:
    """Q06. Seconds before the n-th retry, without the random second that is added."""
    return F.least(F.pow(F.lit(2.0), attempt - 1), F.lit(60.0))


def is_retryable(code: Column, message: Column) -> Column:
    """Q06. Codes worth another try; a 429 about a quota is not."""
    return code.isin(*RETRYABLE) & ~((code == 429) & F.contains(F.lower(message), F.lit("quota")))


def marked_reviewed(line: Column, marker: Column) -> Column:
    """Q05. Tab-separated line with its review field replaced; lines that are not DONE stay."""
    kept = F.filter(F.split(line, "\t"), lambda f: ~F.startswith(f, F.lit("review=")))
    return F.when(F.array_contains(kept, "DONE"), F.array_join(F.array_append(kept, F.concat(F.lit("review="), marker)), "\t")).otherwise(line)
