"""Nested marks as rows: one table of elements, in DataFrame and SQL expressions.

A text is split once at its marks.  Comments and verbatim tags are one mark
each, so what they hide is never seen; arguments without braces inside are one
mark too.  Marks become rows with their places by running sums.  Inside a kind,
the running depth, raised wherever a closer has no opener, numbers the levels,
and on a level openers and closers alternate: an opener and the mark behind it
are an element.  Opened marks of all kinds together give the depth of each
element; elements whose depths at both ends differ cross others and are plain
text, which is looked for twice.  The element around another one, and the owner
of a separator, is the last one that started a level above.

Places are characters from 0, ends exclusive.  Rows are keyed by id; a text's
marks are sorted in one task, its characters are not: a text of any number of
marks is streamed through the windows.  Texts are dealt over as many tasks as
their number asks for, since marks compress so well that Spark, which counts
the bytes written, would sort those of a whole table in one task.  ids must be
unique and not null; null texts have no marks; an empty table gives no rows;
further columns are not read.
"""

from __future__ import annotations

from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..sources.shared import new_path, plain_unions

# Fixed values.
VERBATIM = ("math", "chem", "nowiki", "code", "pre", "syntaxhighlight", "source", "tt")
WHOLE_TAGS = ("table", "ref", "math", "chem", "poem", "gallery", "pre", "nowiki", "syntaxhighlight", "source", "timeline", "blockquote", "score", "graph", "mapframe")
MAGIC_PREFIXES = ("safesubst", "subst", "int", "msg", "msgnw", "raw")

_HIDDEN = rf"<({'|'.join(VERBATIM)})\b[^<>]*(?<!/)>.*?</\1\s*>"
MARKS = rf"(?is)<!--.*?-->|{_HIDDEN}|\{{\{{\{{[^{{}}]*\}}\}}\}}|\{{\{{|\}}\}}|\[\[|\]\]|(?m:^)\{{\||(?m:^)\|\}}(?!\}})|\||=|</?[a-z][a-z0-9]*\b[^<>]*>"


def split_at(text: Column, pattern: str) -> tuple[Column, Column]:
    """The parts between matches, one more than there are, and the matches."""
    return F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def masked(text: Column) -> Column:
    """V02. A text with its verbatim tags and what they hold blanked, line ends kept."""
    gaps, found = split_at(text, f"(?is){_HIDDEN}")
    blank = F.transform(found, lambda m: F.regexp_replace(m, r"[^\n]", " "))
    return F.array_join(F.zip_with(gaps, blank, lambda g, b: F.concat(g, F.coalesce(b, F.lit("")))), "")


#: Texts in a task, on average.
TEXTS = 4096
_DEALT: WeakKeyDictionary[DataFrame, DataFrame] = WeakKeyDictionary()
_TASKS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def tasks(texts: DataFrame) -> int:
    """How many tasks texts (id, text) are dealt over: one for each TEXTS of them; they are counted once."""
    if texts not in _TASKS:
        plain_unions(texts.sparkSession)
        _TASKS[texts] = texts.select("id").count() // TEXTS + 1
    return _TASKS[texts]


def dealt(texts: DataFrame) -> DataFrame:
    """texts (id, text) dealt by id over their tasks; all parts of a plan share the exchange."""
    if texts not in _DEALT:
        _DEALT[texts] = texts.select("id", "text").repartition(tasks(texts), "id")
    return _DEALT[texts]


def kept(rows: DataFrame, name: str, texts: DataFrame) -> DataFrame:
    """rows (id, ...) of texts, written once to the shared folder, where several parts of a plan read them, and dealt as the texts are: what is joined by id and place later stays in as many tasks."""
    path = new_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path).repartition(tasks(texts), "id")


def marks(texts: DataFrame) -> DataFrame:
    """(id, at, mark) of texts (id, text), in order."""
    gaps, found = split_at(F.col("text"), MARKS)
    both = dealt(texts).select("id", found.alias("found"), F.transform(gaps, F.length).alias("gaps")).where(F.size("found") > 0)
    rows = both.select("id", F.posexplode(F.arrays_zip(F.slice("gaps", 1, F.size("found")).alias("gap"), F.col("found").alias("mark"))).alias("i", "x")).select("id", "i", "x.gap", "x.mark")
    order = Window.partitionBy("id").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.select("id", (F.sum(F.col("gap") + F.length("mark")).over(order) - F.length("mark")).alias("at"), "mark")


def _kinds(found: DataFrame) -> DataFrame:
    """(id, at, mark, kind, name, step): step 1 opens, -1 closes, 0 is whole, null separates."""
    mark = F.col("mark")
    tag = mark.startswith("<") & ~mark.startswith("<!--")
    name = F.when(tag, F.lower(F.regexp_extract(mark, "^</?([A-Za-z0-9]+)", 1))).otherwise(F.lit(""))
    kind = (
        F.when(mark.isin("{{", "}}"), "template").when(mark.isin("[[", "]]"), "link").when(mark.isin("{|", "|}"), "table")
        .when(mark.startswith("<!--"), "comment").when(mark.startswith("{{{"), "argument").when(tag, "tag").otherwise("separator")
    )
    whole = mark.rlike(r"(?s)/\s*>$") & ~mark.startswith("</") | mark.rlike(rf"(?is)^{_HIDDEN}$")
    step = F.when(mark.isin("{{", "[[", "{|"), 1).when(mark.isin("}}", "]]", "|}"), -1).when(kind.isin("comment", "argument"), 0).when(tag & whole, 0).when(mark.startswith("</"), -1).when(tag, 1)
    return found.select("id", "at", "mark", kind.alias("kind"), name.alias("name"), step.alias("step"))


def _paired(rows: DataFrame) -> DataFrame:
    """(id, kind, name, s, e, opener, closer) of openers and closers of one kind and name, crossing ones too, and of marks that are whole by themselves."""
    own = Window.partitionBy("id", "kind", "name").orderBy("at")
    upto, before = own.rowsBetween(Window.unboundedPreceding, Window.currentRow), own.rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("sum", F.sum("step").over(upto))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(before), F.lit(0)))
    # whole marks add nothing to a sum and stand on level 0, below all others
    level = F.when(F.col("step") == 0, 0).when(F.col("step") > 0, F.col("sum") - F.col("low")).when(F.col("sum") >= F.col("low"), F.col("sum") + 1 - F.col("low"))
    levels = summed.withColumn("low", low).withColumn("level", level).where("level IS NOT NULL")
    order = Window.partitionBy("id", "kind", "name", "level").orderBy("at")
    after = levels.withColumn("next", F.lead(F.struct("step", "at", "mark")).over(order)).where("step = 0 OR step = 1 AND next.step = -1")
    last = F.when(F.col("step") == 1, F.col("next"))
    e = F.coalesce(last["at"] + F.length(last["mark"]), F.col("at") + F.length("mark"))
    return after.select("id", "kind", "name", F.col("at").alias("s"), e.alias("e"), F.col("mark").alias("opener"), F.coalesce(last["mark"], F.lit("")).alias("closer"))


def _depths(found: DataFrame) -> DataFrame:
    """Elements with their depths: the number of open ones before the start (depth) and behind the end (over)."""
    ends = F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("step")), F.struct(F.col("e").alias("at"), F.lit(-1).alias("step")))
    rows = found.select("*", F.explode(ends).alias("x")).select(*found.columns, "x.at", "x.step")
    order = Window.partitionBy("id").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    open_ = rows.withColumn("open", F.sum("step").over(order) - F.when(F.col("step") > 0, 1).otherwise(0))
    back = Window.partitionBy("id", "kind", "name", "s").orderBy("at")
    return open_.withColumn("over", F.lead("open").over(back)).where("step = 1").drop("at", "step").withColumnRenamed("open", "depth")


def _nested(texts: DataFrame, separated: bool = False) -> DataFrame:
    """The rows of elements; if separated, bars and equals signs too, as whole elements of kind separator that are around nothing.

    All comes from one table, row by row, without a union: what a union of parts
    of one table claims of its partitions may not hold when adaptive execution
    has changed a part.
    """
    rows = _kinds(marks(texts))
    found = _paired(rows.fillna(0, "step") if separated else rows.where("step IS NOT NULL"))
    for _ in range(2):
        found = _depths(found).where("depth = over").drop("depth", "over")
    found = _depths(found).drop("over")
    # each row twice: as one that looks for the element a level above, and as one that may be it
    element = F.struct("kind", "name", "s", "e")
    asks = F.struct((F.col("depth") - 1).alias("level"), F.lit(None).cast(found.select(element.alias("x")).schema["x"].dataType).alias("element"))
    both = F.when(F.col("kind") == "separator", F.array(asks)).otherwise(F.array(asks, F.struct(F.col("depth").alias("level"), element.alias("element"))))
    each = found.select("*", F.explode(both).alias("x")).select(*found.columns, "x.level", "x.element")
    order = Window.partitionBy("id", "level").orderBy("s", F.col("element").isNull().desc()).rowsBetween(Window.unboundedPreceding, -1)
    owned = each.withColumn("owner", F.last("element", ignorenulls=True).over(order)).where("element IS NULL")
    return owned.select("id", "kind", "name", "s", "e", "opener", "closer", "depth", F.when(F.col("owner.e") >= F.col("e"), F.col("owner")).alias("parent"))


def elements(texts: DataFrame) -> DataFrame:
    """(id, kind, name, s, e, opener, closer, depth, parent) of all elements: parent is the struct (kind, name, s, e) of the element around, null at the top."""
    return _nested(texts)


def separators(texts: DataFrame) -> DataFrame:
    """(id, at, mark, kind, s, e) of bars and equals signs that stand in a template or link itself; kind, s and e are their owner's."""
    own = _nested(texts, separated=True).where("kind = 'separator' AND parent.kind IN ('template', 'link')")
    return own.select("id", F.col("s").alias("at"), F.col("opener").alias("mark"), "parent.kind", "parent.s", "parent.e")


def cut(text: Column, a: Column, b: Column) -> Column:
    """The characters from a up to b."""
    return F.substring(text, a + 1, b - a)


def template_calls(texts: DataFrame) -> DataFrame:
    """(id, s, e, name, depth, bar) of all templates, the name as written, blanks around it dropped; bar is the place of the first bar, null without parameters."""
    call, bar = F.col("kind") == "template", (F.col("kind") == "separator") & (F.col("opener") == "|") & (F.col("parent.kind") == "template")
    rows = _nested(texts, separated=True).where(call | bar).select("id", F.when(call, F.col("s")).otherwise(F.col("parent.s")).alias("s"), F.when(call, F.col("e")).alias("e"), F.when(call, F.col("depth")).alias("depth"), F.when(~call, F.col("s")).alias("bar"))
    both = rows.groupBy("id", "s").agg(F.max("e").alias("e"), F.max("depth").alias("depth"), F.min("bar").alias("bar")).join(dealt(texts), "id")
    name = cut(F.col("text"), F.col("s") + 2, F.coalesce("bar", F.col("e") - 2))
    return both.select("id", "s", "e", F.regexp_replace(name, r"^\s+|\s+$", "").alias("name"), "depth", "bar")


def template_names(texts: DataFrame) -> DataFrame:
    """P13. (id, ord, name): names of all templates, first seen first, without parser functions and magic prefixes."""
    calls = template_calls(texts).where(F.col("name") != "").where(~F.col("name").startswith("#"))
    named = calls.where(~F.lower(F.trim(F.split("name", ":", 2)[0])).isin(*MAGIC_PREFIXES))
    first = named.groupBy("id", "name").agg(F.min("s").alias("s"))
    return first.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("s")) - 1).cast("long").alias("ord"), "name")


def template_params(texts: DataFrame) -> DataFrame:
    """(id, s, e, call, n, name, value, keyed, a, v, b, name_span, value_span): parameters of all templates; call is the template's name for look-ups, a the place behind the bar, v that of the value, b the parameter's end, the spans those without blanks around.

    Parameters without a name are named by their number among such.
    """
    order = Window.partitionBy("id", "s").orderBy("at")
    own = separators(texts).where("kind = 'template'").withColumn("n", F.count(F.when(F.col("mark") == "|", 1)).over(order)).where("n > 0")
    spans = own.groupBy("id", "s", "e", "n").agg((F.min(F.when(F.col("mark") == "|", F.col("at"))) + 1).alias("a"), F.min(F.when(F.col("mark") == "=", F.col("at"))).alias("cut"))
    spans = spans.withColumn("b", F.coalesce(F.lead("a").over(Window.partitionBy("id", "s").orderBy("n")) - 1, F.col("e") - 2))
    spans = spans.withColumn("place", F.count(F.when(F.col("cut").isNull(), 1)).over(Window.partitionBy("id", "s").orderBy("n")))
    v = F.coalesce(F.col("cut") + 1, F.col("a"))
    spans = spans.withColumn("bar", F.min("a").over(Window.partitionBy("id", "s")) - 1)
    both = spans.join(dealt(texts), "id").withColumn("call", F.regexp_replace(F.lower(trimmed(cut(F.col("text"), F.col("s") + 2, F.col("bar")))), r"\s+", " "))
    name = F.when(F.col("cut").isNotNull(), trimmed(cut(F.col("text"), F.col("a"), F.col("cut")))).otherwise(F.col("place").cast("string"))
    own = cut(F.col("text"), v, F.col("b"))
    out = both.select("id", "s", "e", "call", "n", name.alias("name"), trimmed(own).alias("value"), F.col("cut").isNotNull().alias("keyed"), "a", v.alias("v"), "b", F.coalesce("cut", "a").alias("c"), own.alias("own"), cut(F.col("text"), F.col("a"), F.coalesce("cut", "a")).alias("head"))
    return out.select("id", "s", "e", "call", "n", "name", "value", "keyed", "a", "v", "b", inner_span(F.col("head"), F.col("a")).alias("name_span"), inner_span(F.col("own"), F.col("v")).alias("value_span"))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def inner_span(text: Column, at: Column) -> Column:
    """(s, e) of what stands between the blanks of a text at a place; the whole span of a blank one."""
    lead = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
    blank = trimmed(text) == ""
    return F.struct((at + F.when(blank, 0).otherwise(lead)).alias("s"), (at + F.when(blank, F.length(text)).otherwise(lead + F.length(trimmed(text)))).alias("e"))


def edited(texts: DataFrame, edits: DataFrame) -> DataFrame:
    """texts (id, text) after edits (id, s, e, new), with n, their number: each span replaced; of nested spans the outer one holds; spans do not overlap otherwise."""
    order = Window.partitionBy("id").orderBy("s", F.desc("e"))
    before = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = edits.withColumn("before", before).where(F.col("s") >= F.col("before"))
    each = kept.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("s", "e", "new", "before"))).alias("x"))
    text = F.col("text")
    parts = F.transform("x", lambda p: F.concat(cut(text, p["before"].cast("int"), p["s"].cast("int")), p["new"]))
    tail = F.substring(text, F.element_at("x", -1)["e"].cast("int") + 1, F.length(text))
    new = F.when(F.col("x").isNotNull(), F.concat(F.array_join(parts, ""), tail)).otherwise(text)
    return dealt(texts).join(each, "id", "left").select("id", new.alias("text"), F.coalesce(F.size("x"), F.lit(0)).cast("long").alias("n"))


def without_templates(texts: DataFrame) -> DataFrame:
    """(id, text): each template replaced by nothing but its line ends."""
    outer = elements(texts).where("kind = 'template'").select("id", "s", "e")
    blank = outer.join(dealt(texts), "id").select("id", "s", "e", F.regexp_replace(cut(F.col("text"), F.col("s"), F.col("e")), r"[^\n]", " ").alias("new"))
    return edited(texts, blank).select("id", "text")


def list_runs(texts: DataFrame) -> DataFrame:
    """P04. (id, s, e): neighbouring lines that begin with a list mark."""
    lines = dealt(texts).select("id", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    order = Window.partitionBy("id").orderBy("n")
    placed = lines.withColumn("e", F.sum(F.length("line") + 1).over(order)).withColumn("s", F.col("e") - F.length("line") - 1)
    last = F.col("e") - F.when(F.lead("n").over(order).isNull(), 1).otherwise(0)
    placed = placed.withColumn("e", last).where(F.col("line").rlike(r"^[ \t]*[*#:;]"))
    island = F.col("n") - F.row_number().over(order)
    return placed.withColumn("island", island).groupBy("id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).select("id", "s", "e")


def protected_spans(texts: DataFrame) -> DataFrame:
    """P03. (id, ord, s, e): spans that are never cut: templates, comments, tables and whole tags at the top, what a reference list defines, list runs; touching ones are one."""
    found = elements(texts)
    plain = F.col("kind").isin("template", "comment", "table")
    top = (F.col("depth") == 0) & (plain | ((F.col("kind") == "tag") & F.col("name").isin(*WHOLE_TAGS)))
    defined = (F.col("depth") == 1) & (F.col("parent.kind") == "tag") & (F.col("parent.name") == "references") & ((F.col("kind") == "template") | ((F.col("kind") == "tag") & (F.col("name") == "ref")))
    spans = found.where(top | defined).select("id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e")).unionByName(list_runs(texts).select("id", F.col("s").cast("long").alias("s"), F.col("e").cast("long").alias("e"))).repartition(tasks(texts), "id")
    order = Window.partitionBy("id").orderBy("s", "e")
    before = F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(before.isNull() | (F.col("s") > before), 1).otherwise(0))
    grouped = marked.withColumn("g", F.sum("new").over(order)).groupBy("id", "g").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return grouped.select("id", (F.col("g") - 1).cast("long").alias("ord"), "s", "e")
