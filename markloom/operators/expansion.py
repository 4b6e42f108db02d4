"""Expansion of data templates into the texts of their bodies.

Bodies (name, body) call each other.  Names that reach themselves are found by
a recursive query over who calls whom, and are never expanded.  The others
form no circle, so replacing the innermost calls round by round ends: a body's
arguments ``{{{name|default}}}`` take the call's values, and what comes out may
hold calls of its own for the next round.  Calls of other names stay as they
are, as do those of circles and those that hold an argument without a value.

Names are compared in lower case, blanks and underscores as one blank.  ids
must be unique and not null; null texts stay null; of several bodies of a name
the largest counts; an empty side changes nothing.  Rounds are written to the
shared folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.shared import new_path
from . import elements as E

_CALL = r"\{\{([^{}|\[\]<>#]+)((?:\|[^{}]*)?)\}\}"


def key_of(name: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(name, r"[\s_]+", " ")))


def circles(bodies: DataFrame) -> DataFrame:
    """(name) of bodies (name, body) that reach themselves by their calls."""
    calls = bodies.select(key_of(F.col("name")).alias("a"), F.explode(F.regexp_extract_all("body", F.lit(r"\{\{([^{}|\[\]<>#]+)"), F.lit(1))).alias("b")).select("a", key_of(F.col("b")).alias("b")).distinct()
    known = bodies.select(key_of(F.col("name")).alias("b")).distinct()
    edges = calls.join(known, "b", "left_semi").select("a", "b")
    path = new_path(bodies.sparkSession, "calls")
    edges.write.parquet(path)
    # UNION would end by itself; levels do, as a chain is no longer than there are names
    names = max(1, known.count())
    return bodies.sparkSession.sql(
        f"""WITH RECURSIVE e AS (SELECT a, b FROM parquet.`{path}`), r(a, b, n) AS (
          SELECT a, b, 1 FROM e UNION ALL SELECT DISTINCT r.a, e.b, r.n + 1 FROM r JOIN e ON r.b = e.a WHERE r.a <> r.b AND r.n < {names})
        SELECT DISTINCT a AS name FROM r WHERE a = b"""
    )


def _filled(body: Column, values: Column) -> Column:
    """A body with its arguments filled from a map of values; those without a value take their default, or stay."""
    gaps, found = E.split_at(body, r"\{\{\{[^{}]*\}\}\}")

    def value(mark: Column) -> Column:
        inner = F.substring(mark, F.lit(4), F.length(mark) - 6)
        name, default = F.trim(F.split(inner, r"\|", 2)[0]), F.get(F.split(inner, r"\|", 2), F.lit(1))
        return F.coalesce(F.try_element_at(values, name), default, mark)

    return F.array_join(F.zip_with(gaps, F.transform(found, value), lambda g, v: F.concat(g, F.coalesce(v, F.lit("")))), "")


def _values(args: Column) -> Column:
    """A map of a call's values from its text behind the name, by name or place; the last of a name counts."""
    parts = F.filter(F.transform(F.split(args, r"\|"), lambda p, i: F.struct(i.alias("i"), p.alias("p"))), lambda x: x["i"] > 0)
    places = F.filter(parts, lambda x: ~F.contains(x["p"], F.lit("=")))
    named = F.filter(parts, lambda x: F.contains(x["p"], F.lit("=")))
    by_place = F.transform(places, lambda x, i: F.struct((i + 1).cast("string").alias("k"), x["p"].alias("v")))
    by_name = F.transform(named, lambda x: F.struct(F.trim(F.split(x["p"], "=", 2)[0]).alias("k"), F.trim(F.split(x["p"], "=", 2)[1]).alias("v")))
    every = F.concat(by_place, by_name)
    keys = F.array_distinct(F.transform(every, lambda x: x["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(every, lambda x: x["k"] == k), -1)["v"]))


def expanded(texts: DataFrame, bodies: DataFrame) -> DataFrame:
    """R09. (id, text, n, left) of texts (id, text): n calls expanded, in all rounds, and left calls of known names that circles keep."""
    spark = texts.sparkSession
    known = bodies.where("name IS NOT NULL AND body IS NOT NULL").groupBy(key_of(F.col("name")).alias("name")).agg(F.max("body").alias("body"))
    loops = circles(known)
    usable = known.join(loops, "name", "left_anti")
    state = texts.select("id", "text", F.lit(0).cast("long").alias("n"))
    while True:
        gaps, found = E.split_at(F.col("text"), _CALL)
        rows = state.where("text IS NOT NULL").select("id", F.posexplode(F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("gap"), found.alias("mark"))).alias("i", "x")).select("id", "i", "x.gap", "x.mark")
        e = F.sum(F.col("gap") + F.length("mark")).over(Window.partitionBy("id").orderBy("i"))
        calls = rows.withColumn("e", e).withColumn("s", F.col("e") - F.length("mark")).withColumn("name", key_of(F.regexp_extract("mark", _CALL, 1))).withColumn("args", F.regexp_extract("mark", _CALL, 2))
        edits = calls.join(usable, "name").select("id", "s", "e", _filled(F.col("body"), _values(F.col("args"))).alias("new"))
        path = new_path(spark, "expanded")
        new = E.edited(state, edits).select("id", "text", F.col("n").alias("more"))
        new.join(state.select("id", "n"), "id").select("id", "text", (F.col("n") + F.col("more")).alias("n"), "more").write.parquet(path)
        state = spark.read.parquet(path)
        if not state.where("more > 0").limit(1).count():
            break
        state = state.drop("more")
    kept = calls.join(loops, "name", "left_semi").groupBy("id").agg(F.count("*").alias("left"))
    return state.join(kept, "id", "left").select("id", "text", "n", F.coalesce("left", F.lit(0)).cast("long").alias("left"))
