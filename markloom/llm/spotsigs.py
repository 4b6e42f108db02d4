"""SpotSigs document fingerprints, in SQL functions only.

Anchors are common words of the languages at hand.  Every anchor starts a
signature: the next CHAIN words that are no anchors, up to GAP anchors skipped
before each (near the end of a text the chain may be shorter).  A text without
anchors takes every word position as spot.  The fingerprint is the sorted set
of 32-bit signature hashes, eight hex digits each, so that the likeness of two
fingerprints can be taken from them alone: the sets' Jaccard, 1 for two empty
ones and 0 against one.

near_pairs compares whole tables: equal sets are one row, sets are partitioned
by length so that only ranges that can reach the similarity meet, and within
them sets meet over the rarest signatures of which a near pair must share one;
the Jaccard is taken only if the lengths allow it.

The next document is found in ranges of about equal numbers of rows, whose
borders are quantiles of doc_id; an id that fills whole ranges is cut further
by a hash of the text.  The text is shuffled once, and only one row of each
range, a bounded number, is ordered globally.

Edge cases: null text is empty; two texts without words are alike (1.0), one
against words is 0.0; rows of equal doc_id stand in the order of a hash of
their texts, the largest first, then of their texts; null doc_ids come last, as
if they were the smallest number; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from has he in is it of on or that the this to was were with "
    "aber als auf aus bei das dem den der des die ein eine er für im ist mit nicht sich sie und von zu "
    "au avec ce dans de du elle en est et il la le les ne pas pour que qui se sur un une "
    "al como con del el ella esta las lo los más para por pero su sus y"
).split()
CHAIN, GAP = 3, 8
_MARK = "\u0001"
_PUNCTUATION = r"[\x00-\x20!-/:-@\[-`{-~]+"
_ANCHOR = "(?<= )(?:" + "|".join(dict.fromkeys(ANCHORS)) + ")(?= )"
_WORD = f"(?: {_MARK}){{0,{GAP}}}+ [^ {_MARK}]++"
_SPOT = f"{_MARK}(?=({_WORD}(?:{_WORD}){{0,{CHAIN - 1}}}+))"
_EVERY = f"(?<= )(?=([^ ]++(?: [^ ]++){{0,{CHAIN - 1}}}+))"
RANGES, _LAST = 256, -(2**63)


def signatures(text: Column) -> Column:
    """Sorted set of a text's signature hashes; empty only without words."""
    plain = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), _PUNCTUATION, " ")), F.lit(" "))
    marked = F.regexp_replace(plain, _ANCHOR, _MARK)
    spots = F.regexp_extract_all(marked, F.lit(_SPOT), F.lit(1))
    every = F.regexp_extract_all(plain, F.lit(_EVERY), F.lit(1))
    found = F.when(F.contains(marked, F.lit(_MARK)), F.when(F.size(spots) > 0, spots).otherwise(every)).otherwise(every)
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.shiftrightunsigned(F.xxhash64(F.translate(x, f"{_MARK} ", "")), 32))))


def fingerprint(sigs: Column) -> Column:
    """The set as a string of eight hex digits a signature, in order."""
    return F.array_join(F.transform(sigs, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard of two signature sets; two empty sets are alike."""
    both = F.size(F.array_intersect(a, b))
    some = (F.size(a) > 0) & (F.size(b) > 0)
    return F.when(some, both / (F.size(a) + F.size(b) - both)).otherwise(F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(F.lit(0.0)))


def _within():
    return Window.partitionBy("bucket").orderBy("guest", F.desc("o"), F.desc("h"), "text")


def in_order(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Rows dealt by ranges of doc_id, with a copy (guest = 1) of the row that follows each range.

    So the text is shuffled once, every row finds the next one in its own
    partition, and no task sees all rows.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("o", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    at = [(i + 1) / ranges for i in range(ranges - 1)]
    (borders,) = own.agg(F.percentile_approx("o", at, 100 * ranges)).first()
    borders = borders or []
    full = sorted({x for x, y in zip(borders, borders[1:], strict=False) if x == y})
    edges = F.array(*map(F.lit, sorted(set(borders)))).cast("array<long>")
    part = F.when(F.array_contains(F.array(*map(F.lit, full)).cast("array<long>"), F.col("o")), F.shiftright("h", 54)).otherwise(F.lit(-1000))
    own = own.withColumn("h", F.xxhash64("text")).withColumn("bucket", F.struct(F.size(F.filter(edges, lambda x: x < F.col("o"))).alias("r"), part.alias("p")))
    tops = own.groupBy("bucket").agg(F.max(F.struct("o", "h")).alias("top"))
    order = Window.orderBy(F.desc("top"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = tops.select(F.col("bucket").alias("into"), F.coalesce(F.lead("top").over(order), F.first("top").over(whole)).alias("top"))
    found = own.join(F.broadcast(after), (own["o"] == F.col("top.o")) & (own["h"] == F.col("top.h")))  # one row a range
    guests = found.groupBy(F.col("into").alias("bucket"), "o", "h").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast(docs.schema["doc_id"].dataType).alias("doc_id"), "text", "o", "h", "bucket", F.lit(1).alias("guest"))
    return own.select("doc_id", "text", "o", "h", "bucket", F.lit(0).alias("guest")).unionByName(guests)


def edited_likeness(docs: DataFrame, ranges: int = RANGES) -> DataFrame:
    """Each text's fingerprint, that of its edited text, and likenesses to the edited and the next text."""
    rows = in_order(docs, ranges)
    rows = rows.withColumn("next", F.coalesce(F.lead("text").over(_within()), F.lit("")))
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next"), F.lit(1), half)))
    rows = rows.select("doc_id", "o", "h", "bucket", "guest", "text", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), signatures(F.col("text")).alias("sigs"), F.when(F.col("guest") == 0, signatures(F.col("edited"))).alias("edited_sigs"))
    rows = rows.withColumn("next_sigs", F.lead("sigs").over(_within())).where("guest = 0")
    return rows.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"), likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"))


def near_pairs(docs: DataFrame, similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(membership, pairs): doc_id to class, equal sets being one class named by its fingerprint, and pairs of classes.

    pairs has (a, b, likeness), a < b, likeness at least ``similarity``.
    """
    sets = docs.select("doc_id", signatures(F.coalesce("text", F.lit(""))).alias("sigs")).withColumn("class", F.sha2(fingerprint(F.col("sigs")), 256))
    one = sets.groupBy("class").agg(F.first("sigs").alias("sigs")).withColumn("n", F.size("sigs")).where("n > 0")
    each = one.select("class", "n", F.explode("sigs").alias("sig"))
    counted = each.join(each.groupBy("sig").agg(F.count("*").alias("df")), "sig")
    rank = F.row_number().over(Window.partitionBy("class").orderBy("df", "sig"))
    rare = counted.withColumn("r", rank).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * similarity) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity)))
    left = rare.select(F.col("class").alias("a"), F.col("n").alias("na"), "sig", part.alias("p"))
    right = rare.select(F.col("class").alias("b"), F.col("n").alias("nb"), "sig", F.explode(F.array(part - 1, part, part + 1)).alias("p"))
    met = left.join(right, ["sig", "p"]).where((F.col("a") < F.col("b")) & (F.least("na", "nb") >= F.greatest("na", "nb") * similarity)).select("a", "b").distinct()
    s, t = one.select(F.col("class").alias("a"), F.col("sigs").alias("sa")), one.select(F.col("class").alias("b"), F.col("sigs").alias("sb"))
    pairs = met.join(s, "a").join(t, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("likeness")).where(F.col("likeness") >= similarity)
    return sets.select("doc_id", "class"), pairs
