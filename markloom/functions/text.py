"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Size band of an article that counts as the same one.
SAME_ARTICLE = (0.65, 1.50)


def line_number(text: Column, offset: Column) -> Column:
    """P11. 1-based line of a 0-based code point offset."""
    before = F.substring(text, F.lit(1), offset.cast("int"))
    return F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1


def snippet(text: Column, cap: int = 120) -> Column:
    """P11. Trimmed, on one line, cut to cap characters with an ellipsis."""
    t = F.replace(F.trim(text), F.lit("\n"), F.lit(" "))
    return F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("…"))).otherwise(t)


def strip_html(html: Column) -> Column:
    """P18. Text without tags, trimmed."""
    return F.trim(F.regexp_replace(html, "<[^>]+>", ""))


def normal_title(title: Column) -> Column:
    """P16. First character in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(title, 1, 1)), F.substring(title, 2, 1 << 30))


def file_name(title: Column) -> Column:
    """K03. Blanks become underscores, characters that file systems forbid too."""
    return F.regexp_replace(F.replace(F.trim(title), F.lit(" "), F.lit("_")), r'[\\/:*?"<>|]', "_")


def link_targets(text: Column) -> Column:
    """P12. Targets of [[…]] in order of first mention, without URLs, files and categories."""
    found = F.regexp_extract_all(text, F.lit(r"\[\[([^\[\]|#]+)"), F.lit(1))
    kept = F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: (t != "") & ~t.rlike("(?iu)^(https?:|file:|image:|category:)"))
    return F.array_distinct(kept)


def fingerprint(body: Column) -> Column:
    """P17. URLs and the digit runs outside them: what a translation leaves alone."""
    url = r"https?://[^\s|\]}<]+"
    return F.struct(F.regexp_extract_all(body, F.lit(url), F.lit(0)).alias("urls"), F.regexp_extract_all(F.regexp_replace(body, url, " "), F.lit("[0-9]+"), F.lit(0)).alias("digits"))


def same_article(source: Column, target: Column) -> Column:
    """V16. Whether the target's bytes are in the band of the source's."""
    return (F.octet_length(target) / F.octet_length(source)).between(*SAME_ARTICLE)


def page_language(html: Column, header: Column | None = None) -> Column:
    """R04. The Content-Language header's first value, else the html tag's lang in the first 5,000 characters; lower case, null where there is none."""
    tag = F.regexp_extract(F.lower(F.substring(html, 1, 5000)), "<html([^>]*)>?", 1)
    own = F.nullif(F.regexp_extract(F.concat(F.lit(" "), tag), "\\slang=[\"']?([a-z-]+)", 1), F.lit(""))
    said = F.lower(F.trim(F.substring_index(header, ",", 1))) if header is not None else F.lit(None).cast("string")
    return F.coalesce(F.nullif(said, F.lit("")), own)
