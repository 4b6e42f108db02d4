"""Checks that read rows in order with a state: folds over arrays in SQL functions.

ids must be unique and not null; null texts have no rows; an empty table gives
none; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from . import elements as E

# Fixed values.
COMMENT_MARK, FAR, LEAST_ALIKE = "Nga en.wiki:", 0.2, 0.5

_TABLE = r"(?ms)^\{\|.*?^\|\}"
_ATTRIBUTES = r"^\s*((?:[A-Za-z-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s|]+)\s*)+)\|(?!\|)"


def _cell(cell: Column) -> Column:
    """(r, c): rows and columns that a cell takes by the attributes in front of its first lone bar."""
    head = F.regexp_extract(cell, _ATTRIBUTES, 1)
    of = lambda name: F.coalesce(F.nullif(F.regexp_extract(head, rf"(?i)\b{name}\s*=\s*[\"']?(\d{{1,6}})", 1), F.lit("")).cast("int"), F.lit(1))
    return F.struct(of("rowspan").alias("r"), of("colspan").alias("c"))


def table_rows(texts: DataFrame) -> DataFrame:
    """(id, tab, row, at, line, cells) of the tables without tables inside: the place and line of a row's first cell or else its mark, and the (r, c) of its cells."""
    gaps, found = E.split_at(F.col("text"), _TABLE)
    both = texts.select("id", F.posexplode(F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("gap"), found.alias("block"))).alias("tab", "x")).select("id", "tab", "x.gap", "x.block")
    order = Window.partitionBy("id").orderBy("tab")
    ends = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    placed = both.withColumn("start", F.sum(F.length("gap") + F.length("block")).over(order) - F.length("block")).withColumn("first", F.sum(ends(F.col("gap")) + ends(F.col("block"))).over(order) - ends(F.col("block")) + 1)
    single = placed.where(F.size(F.split("block", r"\{\|")) == 2)
    lines = single.select("id", "tab", "start", "first", F.posexplode(F.split("block", "\n")).alias("n", "line"))
    by = Window.partitionBy("id", "tab").orderBy("n")
    lines = lines.withColumn("at", F.col("start") + F.sum(F.length("line") + 1).over(by) - F.length("line") - 1).withColumn("bare", F.rtrim("line"))
    mark = F.col("bare").startswith("|-")
    holds = ~mark & F.col("bare").rlike(r"^[!|]") & ~F.col("bare").rlike(r"^\|[}+]")
    parts = F.split(F.substring("bare", 2, 1 << 30), F.when(F.col("bare").startswith("!"), F.lit(r"!!|\|\|")).otherwise(F.lit(r"\|\|")), F.lit(-1))
    rows = lines.withColumn("row", F.sum(F.when(mark, 1).otherwise(0)).over(by)).withColumn("cells", F.when(holds, F.transform(parts, _cell)))
    place = F.struct("n", "at", (F.col("first") + F.col("n")).alias("no"))
    out = rows.groupBy("id", "tab", "row").agg(
        F.coalesce(F.min(F.when(holds, place)), F.min(place)).alias("x"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(holds, F.struct("n", "cells")))), lambda p: p["cells"])).alias("cells"),
    )
    marked = out.withColumn("rows", F.max("row").over(Window.partitionBy("id", "tab")))
    kept = marked.where((F.col("row") > 0) | (F.size("cells") > 0) | (F.col("rows") == 0))
    return kept.select("id", "tab", "row", F.col("x.at").alias("at"), F.col("x.no").alias("line"), "cells")


def row_widths(rows: DataFrame) -> DataFrame:
    """V09. (id, tab, row, width): columns of each row with those that reach into it from above, by a fold that carries the open row spans as a map from rows left to columns."""
    own = rows.groupBy("id", "tab").agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))
    fold = """aggregate(rows, struct(map_from_arrays(array(0), array(0)) AS open, CAST(array() AS array<struct<row: bigint, width: bigint>>) AS out), (st, r) -> struct(
        map_from_entries(filter(transform(array_distinct(concat(transform(map_keys(st.open), k -> k - 1), transform(r.cells, c -> c.r - 1), array(0))),
          k -> struct(k AS k, coalesce(element_at(st.open, k + 1), 0) + aggregate(filter(r.cells, c -> c.r - 1 = k), 0, (a, c) -> a + c.c) AS v)), e -> e.k >= 0)) AS open,
        concat(st.out, array(struct(CAST(r.row AS BIGINT) AS row, CAST(aggregate(map_entries(st.open), 0, (a, e) -> a + if(e.key > 0, e.value, 0)) + aggregate(r.cells, 0, (a, c) -> a + c.c) AS BIGINT) AS width))) AS out)).out"""
    return own.select("id", "tab", F.explode(F.expr(fold)).alias("x")).select("id", "tab", "x.row", "x.width")


def off_rows(texts: DataFrame) -> DataFrame:
    """V09. (id, tab, at, line, width, usual) of lone rows whose width is not the table's most frequent one, the first seen of several."""
    rows = table_rows(texts)
    widths = row_widths(rows)
    usual = widths.groupBy("id", "tab", "width").agg(F.count("*").alias("k"), F.min("row").alias("seen")).groupBy("id", "tab").agg(F.max_by("width", F.struct("k", -F.col("seen"))).alias("usual"), F.sum("k").alias("rows"))
    order = Window.partitionBy("id", "tab").orderBy("row")
    off = F.col("width") != F.col("usual")
    both = widths.join(usual, ["id", "tab"]).where("rows > 1").withColumn("off", off)
    lone = both.withColumn("lone", F.col("off") & ~F.coalesce(F.lag("off").over(order), F.lit(False)) & ~F.coalesce(F.lead("off").over(order), F.lit(False))).where("lone")
    return lone.join(rows.select("id", "tab", "row", "at", "line"), ["id", "tab", "row"]).select("id", "tab", "at", "line", "width", "usual")


_WORDS = r"https?://\S+|\d[\d.,]*|\[\[[^\]]+\]\]|\{\{[^}]+\}\}|\b[A-Z][\w-]+"


def comments(texts: DataFrame) -> DataFrame:
    """(id, n, s, e, place, body, words) of comments: place from 0 to 1, words those that translation leaves alone."""
    gaps, found = E.split_at(F.col("text"), r"(?s)<!--.*?-->")
    rows = texts.select("id", F.length("text").alias("size"), F.posexplode(F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("gap"), found.alias("mark"))).alias("n", "x")).select("id", "size", "n", "x.gap", "x.mark")
    e = F.sum(F.col("gap") + F.length("mark")).over(Window.partitionBy("id").orderBy("n"))
    placed = rows.withColumn("e", e).withColumn("s", F.col("e") - F.length("mark"))
    body = F.regexp_replace(F.substring("mark", 5, 1 << 30), r"-->$", "")
    return placed.select("id", "n", "s", "e", (F.col("s") / F.greatest(F.col("size"), F.lit(1))).alias("place"), E.trimmed(body).alias("body")).withColumn("words", F.regexp_extract_all("body", F.lit(f"({_WORDS})"), F.lit(1)))


def _alike(s: str, t: str) -> str:
    """P20. SQL: how well two comments match: 3 if equal, 2 if marked before, else 1 with the share of common words and nearness, or 0."""
    both = f"size({s}.words) + size({t}.words)"
    common = f"aggregate(array_distinct({s}.words), 0, (a, w) -> a + least(size(filter({s}.words, x -> x = w)), size(filter({t}.words, x -> x = w))))"
    share = f"if(size({s}.words) = 0, 0D, 2D * {common} / ({both}))"
    near = f"greatest(0D, 1D - abs({s}.place - {t}.place) / {FAR}D)"
    return f"CASE WHEN {s}.body = {t}.body THEN 3D WHEN startswith({t}.body, '{COMMENT_MARK}') THEN 2D WHEN {share} < {LEAST_ALIKE}D AND {near} <= 0 THEN 0D ELSE 1D + {share} + {near} END"


def aligned(source: DataFrame, made: DataFrame) -> DataFrame:
    """J11. (id, i, n) of comments of the source and of the translation that pair, in an order-keeping matching of the largest sum.

    The fold over the source's comments keeps the row of the best sums so far,
    and one move for each cell (0 skips the translation's comment, 1 the
    source's, 2 pairs); a second fold walks the moves back.  Of equal sums the
    pair is kept, then the source's comment is skipped.
    """
    kind = "struct<n: int, place: double, body: string, words: array<string>>"
    listed = lambda df, name: comments(df).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("n", "place", "body", "words"))).cast(f"array<{kind}>").alias(name))
    both = listed(source, "ss").join(listed(made, "ts"), "id")
    # the new row is a fold over the translation's comments: row[j] from row[j-1] and the row before
    row = f"""aggregate(sequence(1, size(ts)), struct(array(0D) AS sums, CAST(array() AS array<int>) AS moves), (r, j) ->
        aggregate(array(struct({_alike("s", "ts[j - 1]")} AS score)), r, (q, x) -> aggregate(array(struct(if(x.score > 0, st.sums[j - 1] + x.score, -1D) AS pair, st.sums[j] AS up, element_at(r.sums, -1) AS left)), q, (p, o) ->
          struct(concat(p.sums, array(greatest(o.pair, o.up, o.left))) AS sums, concat(p.moves, array(CASE WHEN o.pair >= greatest(o.up, o.left) THEN 2 WHEN o.up >= o.left THEN 1 ELSE 0 END)) AS moves))))"""
    table = f"""aggregate(ss, struct(array_repeat(0D, size(ts) + 1) AS sums, CAST(array() AS array<array<int>>) AS moves), (st, s) ->
        aggregate(array({row}), st, (st0, r) -> struct(r.sums AS sums, concat(st0.moves, array(r.moves)) AS moves)))"""
    back = """aggregate(sequence(1, size(ss) + size(ts)), struct(size(ss) AS i, size(ts) AS j, CAST(array() AS array<struct<i: int, n: int>>) AS out), (st, k) -> CASE
        WHEN st.i = 0 OR st.j = 0 THEN st
        WHEN m[st.i - 1][st.j - 1] = 2 THEN struct(st.i - 1 AS i, st.j - 1 AS j, concat(st.out, array(struct(st.i - 1 AS i, st.j - 1 AS n))) AS out)
        WHEN m[st.i - 1][st.j - 1] = 1 THEN struct(st.i - 1 AS i, st.j AS j, st.out AS out)
        ELSE struct(st.i AS i, st.j - 1 AS j, st.out AS out) END).out"""
    moved = both.withColumn("m", F.expr(f"{table}.moves"))
    return moved.select("id", F.explode(F.expr(back)).alias("x")).select("id", "x.i", "x.n")


def settled_comments(source: DataFrame, made: DataFrame) -> DataFrame:
    """J11. (id, text, n) of made (id, text): the source's comments are marked as such, n others go, with their line where they stand alone."""
    found = comments(made).join(aligned(source, made).select("id", "n", F.lit(True).alias("paired")), ["id", "n"], "left").join(made.select("id", "text"), "id")
    text = F.col("text")
    mark = found.where(F.col("paired") & ~F.col("body").startswith(COMMENT_MARK)).select("id", "s", "e", F.concat(F.lit(f"<!-- {COMMENT_MARK} "), "body", F.lit(" -->")).alias("new"))
    lead = F.length(F.regexp_extract(E.cut(text, F.lit(0), F.col("s").cast("int")), r"(?:^|\n)([ \t]*)\z", 1))
    alone = E.cut(text, F.lit(0), F.col("s").cast("int")).rlike(r"(?:^|\n)[ \t]*\z") & F.substring(text, F.col("e").cast("int") + 1, F.length(text)).rlike(r"^[ \t]*(?:\n|\z)")
    tail = F.length(F.regexp_extract(F.substring(text, F.col("e").cast("int") + 1, F.length(text)), r"^([ \t]*\n?)", 1))
    gone = found.where("paired IS NULL").select("id", F.when(alone, F.col("s") - lead).otherwise(F.col("s")).alias("s"), F.when(alone, F.col("e") + tail).otherwise(F.col("e")).alias("e"), F.lit("").alias("new"))
    out = E.edited(made, mark.unionByName(gone)).drop("n")
    return out.join(gone.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
