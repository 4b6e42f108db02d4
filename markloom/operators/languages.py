"""Languages of texts and pages by ranks of character trigrams.

A language's profile is its ``RANKS`` most frequent trigrams in labelled texts,
and a text's are its own; the distance of the two is the sum of the differences
of ranks over the text's trigrams, ``RANKS`` where the profile lacks one.  The
differences are joined on the trigram and summed, so no pair of a text and a
language without a common trigram is made.  Texts are lower-cased, and white
space is one blank.

Edge cases: texts of fewer than ``LEAST`` visible characters, null ones and
those without a common trigram have no language; of equal distances the
smaller name counts, of equal frequencies the smaller trigram; labelled rows of
null text or language are not learned from; no profile gives no language;
repeated rows are texts of their own, ids must be unique and not null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

# Fixed values.
HEAD, SHOWN, JUDGED, LEAST = 5000, 20000, 2000, 50
RANKS = 300


def visible(html: Column) -> Column:
    """What a page's beginning shows: tags left out, white space as one blank."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.substring(html, 1, SHOWN), "<[^>]+>", " "), r"[ \t\r\n\f]+", " "))


def _ranked(texts: DataFrame, *by: str) -> DataFrame:
    """(by..., gram, rank) of texts (by..., text): the most frequent trigrams, from 1 on."""
    text = F.lower(F.trim(F.regexp_replace("text", r"[ \t\r\n\f]+", " ")))
    grams = texts.select(*by, F.explode(F.regexp_extract_all(text, F.lit("(?s)(?=(.{3}))"), F.lit(1))).alias("gram"))
    counted = grams.groupBy(*by, "gram").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "gram"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= RANKS).drop("n")


def profiles(labelled: DataFrame) -> DataFrame:
    """(lang, gram, rank) of labelled texts (text, lang)."""
    return _ranked(labelled.where("text IS NOT NULL AND lang IS NOT NULL"), "lang")


def guessed(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, lang) of texts (id, text): the language of the nearest profile, null where none is near or the text is short."""
    own = _ranked(texts.where(F.length(F.trim("text")) >= LEAST), "id")
    far = own.join(known.select("lang", "gram", F.col("rank").alias("other")), "gram").groupBy("id", "lang").agg(F.sum(F.abs(F.col("rank") - F.col("other")) - RANKS).alias("far"))
    best = far.groupBy("id").agg(F.min_by("lang", F.struct("far", "lang")).alias("lang"))
    return texts.select("id").join(best, "id", "left")


def page_languages(pages: DataFrame, known: DataFrame) -> DataFrame:
    """R04. (id, lang, source) of pages (id, header, html): what the header says first, else the page's own attribute, else what its text is; source is header, page or text."""
    said = F.nullif(F.lower(F.trim(F.split(F.split("header", ",")[0], "-")[0])), F.lit(""))
    own = F.nullif(F.lower(F.regexp_extract(F.substring("html", 1, HEAD), r"(?i)<html[^>]*\slang=[\"']?([A-Za-z]+)", 1)), F.lit(""))
    both = pages.select("id", said.alias("said"), own.alias("own"), F.substring(visible(F.col("html")), 1, JUDGED).alias("text"))
    left = both.where("said IS NULL AND own IS NULL")
    found = both.select("id", "said", "own").join(guessed(left.select("id", "text"), known), "id", "left")
    source = F.when(F.col("said").isNotNull(), "header").when(F.col("own").isNotNull(), "page").when(F.col("lang").isNotNull(), "text")
    return found.select("id", F.coalesce("said", "own", "lang").alias("lang"), source.alias("source"))
