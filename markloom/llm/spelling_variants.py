"""Groups of spelling variants, by a rare-first filter over positional bigrams.

Bigrams are ordered by the number of words that hold them, the rarest first,
and a word is represented by its three first ones with their places.  One edit
spoils at most two bigrams of a word, and those left keep their order, so two
words one edit apart share one of the three.  It stands before the edit or
behind it: then either all up to its end, or all from its start on, is the same
in both words.  So words meet on a rare bigram with what is before it (its
place from the front) or with what is behind it (its place from the end), and
only if their lengths allow one edit; a 64-bit map of their characters, of
which one edit changes two bits at most, discards most, and the edit distance
is taken of the rest.  The join is on equal keys in DataFrame operations, so a
common key is split by adaptive execution.

The order of bigrams is an array over pairs of the alphabet of ``RUN``, 90 by 90
numbers at any size of the input.

Edge cases: null texts have no words; a null doc_id stands for an empty number
in the checksum; rows count each, repeated ones too; words that no other is
near to have no form and are their own root; an empty table gives none; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ._store import dropped, written

RUN = r"[A-Za-zÀ-ÿ]"
EVERY, LEAST_CHARS, LEAST, TIMES = 31, 7, 2, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALPHABET = 26 + 64


def words(docs: DataFrame, every: int = EVERY, least_chars: int = LEAST_CHARS, least: int = LEAST) -> DataFrame:
    """(word, n): runs of letters, one character left out of every ``every``-th by its checksum with the document."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))).alias("run"))
    low = runs.select("id", F.translate("run", UPPER, LOWER).alias("run")).withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    kept = low.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_chars)
    return kept.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _letter(char: Column) -> Column:
    code = F.ascii(char)
    return F.when(code < 128, code - 97).otherwise(code - 0xC0 + 26)


def _bigram(word: Column, place: Column) -> Column:
    """A number for the bigram at a place from 1 on."""
    return _letter(F.substring(word, place, F.lit(1))) * ALPHABET + _letter(F.substring(word, place + 1, F.lit(1)))


def bigram_order(found: DataFrame) -> list[int]:
    """The place of every bigram of the alphabet in the order of frequency; those that do not occur come last."""
    places = found.select("word", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("p"))
    counted = places.groupBy(_bigram(F.col("word"), F.col("p")).alias("gram")).agg(F.count("*").alias("n"))
    order = [ALPHABET**2] * ALPHABET**2
    for i, row in enumerate(sorted(counted.collect(), key=lambda r: (r.n, r.gram))):  # at most ALPHABET ** 2 rows
        order[row.gram] = i
    return order


def keyed(found: DataFrame, rarest: int = 3) -> DataFrame:
    """(key, word, n, size, chars): six keys a word, one before and one behind each of its rarest bigrams."""
    order = F.split(F.lit(",".join(map(str, bigram_order(found)))), ",").cast("array<int>")
    word = F.col("word")
    grams = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda p: F.struct(F.element_at(order, _bigram(word, p) + 1).alias("o"), p.alias("p")))
    head = lambda g: F.xxhash64(F.lit(0), F.substring(word, F.lit(1), g["p"] + 1))
    tail = lambda g: F.xxhash64(F.lit(1), F.substring(word, g["p"], F.length(word)))
    rare = found.select("word", "n", F.slice(F.array_sort(grams), 1, rarest).alias("rare"))
    keys = F.array_distinct(F.concat(F.transform("rare", head), F.transform("rare", tail)))
    return rare.select(F.explode(keys).alias("key"), "word", "n", F.length("word").alias("size"), _chars(word).alias("chars"))


def _chars(word: Column) -> Column:
    """Bit c mod 64 for each character of code c."""
    codes = F.transform(F.split(word, ""), lambda c: F.ascii(c) % 64)
    return F.aggregate(codes, F.lit(0).cast("long"), lambda m, c: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c)))


def near_pairs(found: DataFrame) -> DataFrame:
    """(a, na, b, nb): each two words that differ by one inserted, deleted or replaced character, once."""
    own = written(keyed(found), "keyed")
    a = own.select("key", "size", F.col("word").alias("a"), F.col("n").alias("na"), F.col("chars").alias("ca"))
    b = own.select("key", F.explode(F.array(F.col("size"), F.col("size") - 1)).alias("size"), F.col("size").alias("own"), F.col("word").alias("b"), F.col("n").alias("nb"), F.col("chars").alias("cb"))
    met = a.join(b, ["key", "size"]).where((F.bit_count(F.col("ca").bitwiseXOR(F.col("cb"))) <= 2) & ((F.col("own") > F.col("size")) | (F.col("a") < F.col("b"))))
    return met.where(F.levenshtein("a", "b", 1) == 1).groupBy("a", "b").agg(F.first("na").alias("na"), F.first("nb").alias("nb"))


def variants(docs: DataFrame, times: int = TIMES, **how) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word."""
    found = written(words(docs, **how), "words")
    pairs = written(near_pairs(found), "near")
    both = pairs.select(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")).unionByName(pairs.select(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"), F.first("n").alias("n"))
    best = written(best.select("word", "n_near", "n", F.col("best.near").alias("near"), (-F.col("best.m")).alias("near_n")), "best")
    strong = F.col("near_n") >= times * F.col("n")
    to = roots(best.where(strong).select("word", F.col("near").alias("to")))
    out = found.join(best.select("word", "n_near", F.when(strong, F.col("near")).alias("form"), F.when(strong, F.col("near_n")).alias("form_n")), "word", "left").join(to, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("to", "word").alias("root"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, to) with to followed to its end, twice as far each round; a form is ``TIMES`` as frequent as its word, so ends come soon and no chain is a circle."""
    now = written(forms, "roots")
    while True:
        after = now.select(F.col("word").alias("to"), F.col("to").alias("after"))
        new = written(now.join(after, "to", "left").select("word", F.coalesce("after", "to").alias("to"), F.col("after").isNotNull().alias("moved")), "roots")
        for path in {p.rsplit("/", 1)[0] for p in now.inputFiles()}:
            dropped(now.sparkSession, path)
        now = new.drop("moved")
        if not new.where("moved").limit(1).count():
            return now
