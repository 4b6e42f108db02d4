"""Which texts of a scope contain which names, by an inverted index of tokens.

A name is a substring to be found, marks, blanks and part words included.  Its
tokens are its runs of letters and digits: one bounded by other characters
inside the name is a whole word of every text that holds the name; its first
one may be the end of a word there, its last one the start, and a single one
any part.  A name meets texts on one token, the one that the fewest texts of
the scope hold: whole ones by equality, parts by the words of the scope's
vocabulary that hold them, which are found over their rarest gram of at most
three characters or the end or start that they must be.  Names without a letter or digit meet texts on their rarest
character.  What meets is verified on the text.

So texts are exploded once, into their distinct words and marks, no pair of a
name and a text without a common token is made, and keys are (scope, token),
so that one hot scope is dealt over all tasks.

Edge cases: names are distinct in their scope, case and accents count; null or
empty names and null texts are in nothing; null scopes meet nothing; repeated
texts are found each, as (scope, part) with part repeated; an empty side gives
no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

_RUN = r"[\p{L}\p{N}\p{M}_]+"
_GRAM = 3
WHOLE, START, END, PART, MARK = range(5)


def name_tokens(names: DataFrame) -> DataFrame:
    """(scope, name, token, kind) of distinct names: how each token must stand in a text."""
    own = names.select("scope", "name").where("name <> ''").distinct()
    runs = own.withColumn("runs", F.regexp_extract_all("name", F.lit(f"({_RUN})"), F.lit(1))).withColumn("n", F.size("runs"))
    first, last = F.col("name").rlike(f"^{_RUN}"), F.col("name").rlike(f"{_RUN}$")
    each = runs.select("scope", "name", "n", first.alias("open"), last.alias("shut"), F.posexplode("runs").alias("i", "token"))
    head, tail = (F.col("i") == 0) & F.col("open"), (F.col("i") == F.col("n") - 1) & F.col("shut")
    kind = F.when(head & tail, PART).when(head, START).when(tail, END).otherwise(WHOLE)
    marks = runs.where("n = 0").select("scope", "name", F.explode(F.array_distinct(F.split("name", ""))).alias("token")).where("token <> ''")
    return each.select("scope", "name", "token", kind.alias("kind")).distinct().unionByName(marks.withColumn("kind", F.lit(MARK)))


def text_words(texts: DataFrame) -> DataFrame:
    """(scope, text_id, word): distinct words and other characters of the texts."""
    words = F.regexp_extract_all("text", F.lit(f"({_RUN})"), F.lit(1))
    marks = F.split(F.regexp_replace("text", _RUN, ""), "")
    return texts.select("scope", "text_id", F.explode(F.array_distinct(F.concat(words, marks))).alias("word")).where("word <> ''")


def _holds(kind: Column, word: Column, token: Column) -> Column:
    """Whether a word can hold a token of that kind: the name's first token ends a word, its last one starts one."""
    return F.when(kind == START, F.endswith(word, token)).when(kind == END, F.startswith(word, token)).otherwise(F.contains(word, token))


def _grams(word: Column, size: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(word) - size + 1), lambda p: F.substring(word, p, size))


def _anchored(kind: Column, token: Column, size: Column) -> Column:
    """A key for the end of a word that the name's first token is, or the start that its last one is: characters that no token holds tell them from grams."""
    return F.when(kind == START, F.concat(F.lit("$"), F.right(token, size))).when(kind == END, F.concat(F.lit("^"), F.left(token, size)))


def _asked(kind: Column, token: Column) -> Column:
    """The keys over which a token may be found: its grams and its end or start; of a short one, that is the whole of it."""
    size = F.least(F.length(token), F.lit(_GRAM))
    key = _anchored(kind, token, size)
    return F.when(key.isNull(), _grams(token, size)).when(F.length(token) <= _GRAM, F.array(key)).otherwise(F.concat(_grams(token, size), F.array(key)))


def _keys(word: Column) -> Column:
    """All keys of a word."""
    sizes = [F.lit(k) for k in range(1, _GRAM + 1)]
    each = [F.concat(_grams(word, k), F.array(_anchored(F.lit(START), word, k), _anchored(F.lit(END), word, k))) for k in sizes]
    return F.concat(*(F.when(F.length(word) >= k, x).otherwise(F.array().cast("array<string>")) for k, x in zip(sizes, each)))


#: Hashes of the keys that a scope asks for: so many at most are sent to its words.
_HASHES = 4096


def _spellings(tokens: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """(scope, token, kind, word, n): the words of the vocabulary that hold a part of a word, found over its rarest key.

    A word's keys are made only where its scope asks for one of their hashes;
    what the hashes let through is joined by the keys themselves.
    """
    parts = tokens.where(F.col("kind").isin(START, END, PART)).select("scope", "token", "kind").distinct()
    asked = parts.select("scope", "token", "kind", F.explode(F.array_distinct(_asked(F.col("kind"), F.col("token")))).alias("gram"))
    hashed = lambda key: F.pmod(F.xxhash64(key), F.lit(_HASHES)).cast("int")
    wanted = asked.groupBy("scope").agg(F.collect_set(hashed(F.col("gram"))).alias("wanted"))
    own = vocabulary.select("scope", "word", "n").join(wanted, "scope")
    some = F.array_distinct(F.filter(_keys(F.col("word")), lambda key: F.array_contains("wanted", hashed(key))))
    indexed = own.select("scope", "word", "n", F.explode(some).alias("gram"))
    held = indexed.join(asked.select("scope", "gram").distinct(), ["scope", "gram"], "left_semi")
    counted = asked.join(held.groupBy("scope", "gram").agg(F.count("*").alias("words")), ["scope", "gram"], "left").withColumn("words", F.coalesce("words", F.lit(0)))
    rarest = counted.groupBy("scope", "token", "kind").agg(F.min(F.struct("words", "gram")).alias("g")).select("scope", "token", "kind", F.col("g.gram").alias("gram"))
    met = rarest.join(held, ["scope", "gram"])
    return met.where(_holds(F.col("kind"), F.col("word"), F.col("token"))).select("scope", "token", "kind", "word", "n")


def anchors(names: DataFrame, words: DataFrame) -> DataFrame:
    """(scope, name, word): the words over which each name meets texts, those of its token that the fewest texts hold."""
    tokens = name_tokens(names)
    vocabulary = words.groupBy("scope", "word").agg(F.count("*").alias("n"))
    exact = tokens.where(F.col("kind").isin(WHOLE, MARK)).select("scope", "token", "kind").distinct()
    spelled = _spellings(tokens, vocabulary).unionByName(exact.join(vocabulary.withColumnRenamed("word", "token"), ["scope", "token"]).select("scope", "token", "kind", F.col("token").alias("word"), "n"))
    weighed = tokens.join(spelled.groupBy("scope", "token", "kind").agg(F.sum("n").alias("n")), ["scope", "token", "kind"], "left")
    order = Window.partitionBy("scope", "name").orderBy(F.coalesce("n", F.lit(0)), "token", "kind")
    best = weighed.withColumn("r", F.row_number().over(order)).where("r = 1").select("scope", "name", "token", "kind")
    return best.join(spelled, ["scope", "token", "kind"]).select("scope", "name", "word").distinct()


def held(names: DataFrame, texts: DataFrame) -> DataFrame:
    """(scope, name, part) of names (scope, name) in texts (scope, part, text), one row for each text that holds the name."""
    own = texts.select("scope", "part", "text").where("text IS NOT NULL").withColumn("text_id", F.xxhash64("part", "text"))
    words = text_words(own)
    met = anchors(names, words).join(words, ["scope", "word"]).select("scope", "name", "text_id").distinct()
    return met.join(own, ["scope", "text_id"]).where(F.contains("text", F.col("name"))).select("scope", "name", "part")
