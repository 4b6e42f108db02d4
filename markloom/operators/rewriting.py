"""Rewrites and checks as edits and counts on the tables of elements and parameters.

Every rewrite takes texts (id, text) and gives (id, text, n), n the number of
its edits; a text without the markup in question comes back as it is, and a
second run changes nothing.  Nested calls are each rewritten.  ids must be
unique and not null; null texts stay null; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.rewrites import CITATION_PARAMS, CITATIONS, PAGE_PARAMS, PLAIN_TWIN, SELF_WRAPPING, SHORT_NOTES
from ..functions.wiki import BOX_PREFIXES, IMPLICIT_NOTE_TEMPLATES, NOTE_COUNTED
from . import elements as E


def _map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _edit(span: Column, new: Column) -> list[Column]:
    return [F.col("id"), span["s"].alias("s"), span["e"].alias("e"), new.alias("new")]


def _citation() -> Column:
    return F.col("call").startswith("cite") | (F.col("call") == "citation")


def english_params(texts: DataFrame) -> DataFrame:
    """R01. Localised parameter names of known citations in English, a number at the end kept; a name that the call has already is not given twice."""
    own = E.template_params(texts).where(F.col("call").isin(*CITATIONS))
    low = F.lower("name")
    base = F.regexp_replace(low, r"[0-9]+$", "")
    new = F.concat(_map(CITATION_PARAMS)[base], F.substring(F.col("name"), F.length(base) + 1, F.length("name")))
    named = own.withColumn("names", F.collect_set(low).over(Window.partitionBy("id", "s"))).where("keyed").withColumn("new", new).where(F.col("new").isNotNull() & ~F.array_contains("names", F.col("new")))
    first = named.withColumn("r", F.row_number().over(Window.partitionBy("id", "s", "new").orderBy("n"))).where("r = 1")
    return E.edited(texts, first.select(*_edit(F.col("name_span"), F.col("new"))))


def page_params(texts: DataFrame) -> DataFrame:
    """R02. Page parameters of short footnotes by their right names; a page given in third place or later, such as ``f. 161``, is named: pp if it holds a dash or comma."""
    own = E.template_params(texts).where(F.col("call").isin(*SHORT_NOTES))
    new = _map(PAGE_PARAMS)[F.lower("name")]
    renamed = own.where(F.col("keyed") & new.isNotNull()).select(*_edit(F.col("name_span"), new))
    page = F.regexp_extract("value", r"(?is)^fq?\.?\s*(\d.*)$", 1)
    placed = own.where(~F.col("keyed") & (F.expr("try_cast(name AS INT)") > 2) & (page != "")).withColumn("page", page)
    shown = F.concat(F.when(F.col("page").rlike("[-,]"), "pp").otherwise("p"), F.lit("="), "page")
    return E.edited(texts, renamed.unionByName(placed.select(*_edit(F.struct(F.col("v").alias("s"), F.col("b").alias("e")), shown))))


def _values(params: DataFrame, *names: str) -> DataFrame:
    """(id, s, e, call, one column a name): the last value of each name in a call."""
    last = lambda x: F.max_by(F.when(F.lower("name") == x, F.col("value")), F.when(F.lower("name") == x, F.col("n"))).alias(x)
    return params.groupBy("id", "s", "e", "call").agg(*map(last, names))


def with_languages(texts: DataFrame, by_url: DataFrame, by_title: DataFrame) -> DataFrame:
    """R03. Citations without language or lang take the language of by_title (id, title, lang), or else of by_url (id, url, lang)."""
    calls = _values(E.template_params(texts).where(F.col("call").isin(*CITATIONS)), "title", "url", "language", "lang")
    bare = calls.where("coalesce(language, '') = '' AND coalesce(lang, '') = ''").drop("lang")
    found = bare.join(by_title.groupBy("id", "title").agg(F.max("lang").alias("t")), ["id", "title"], "left").join(by_url.groupBy("id", "url").agg(F.max("lang").alias("u")), ["id", "url"], "left")
    lang = F.coalesce("t", "u")
    end = F.struct((F.col("e") - 2).alias("s"), (F.col("e") - 2).alias("e"))
    return E.edited(texts, found.where(lang.isNotNull()).select(*_edit(end, F.concat(F.lit("|language="), lang))))


def _inside(rows: DataFrame, around: DataFrame, texts: DataFrame) -> DataFrame:
    """rows (id, s, ...) of texts that start inside some span of around (id, s, e): by the number of open spans at their place."""
    steps = around.select("id", F.explode(F.array(F.struct(F.col("s").alias("at"), F.lit(1).alias("step")), F.struct((F.col("e") - 1).alias("at"), F.lit(-1).alias("step")))).alias("x")).select("id", "x.at", "x.step")
    both = rows.withColumn("at", F.col("s")).withColumn("step", F.lit(0)).withColumn("own", F.lit(True)).unionByName(steps, allowMissingColumns=True).repartition(E.tasks(texts), "id")
    order = Window.partitionBy("id").orderBy("at", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("open", F.sum("step").over(order)).where("own AND open > 0").drop("at", "step", "own", "open")


def _calls(texts: DataFrame) -> DataFrame:
    """(id, s, e, call, name, depth, bar) of templates, call for look-ups."""
    return E.template_calls(texts).withColumn("call", F.regexp_replace(F.lower("name"), r"\s+", " "))


def plain_notes(texts: DataFrame) -> DataFrame:
    """R06. Self-wrapping footnotes inside a reference become their twins that do not wrap."""
    refs = E.elements(texts).where("kind = 'tag' AND name = 'ref'").select("id", "s", "e")
    own = _inside(_calls(texts).where(F.col("call").isin(*PLAIN_TWIN)), refs, texts).join(E.dealt(texts), "id")
    at = F.col("s") + 2 + F.length(F.regexp_extract(E.cut(F.col("text"), F.col("s") + 2, F.col("e")), r"^\s*", 0))
    span = F.struct(at.alias("s"), (at + F.length("name")).alias("e"))
    return E.edited(texts, own.select(*_edit(span, _map(PLAIN_TWIN)[F.col("call")])))


def unwrapped_notes(texts: DataFrame) -> DataFrame:
    """R05. An unnamed reference around one self-wrapping footnote and nothing else goes, the footnote stays."""
    found = E.elements(texts)
    refs = found.where(F.col("name").eqNullSafe("ref") & (F.col("closer") != "") & ~F.col("opener").rlike(r"(?i)\bname\s*=")).select("id", "s", "e", (F.col("s") + F.length("opener")).alias("a"), (F.col("e") - F.length("closer")).alias("b"))
    inner = found.where("parent.kind = 'tag' AND parent.name = 'ref'").groupBy("id", F.col("parent.s").alias("s")).agg(F.count("*").alias("k"), F.min("s").alias("x"), F.min("e").alias("y"), F.min("kind").alias("kind"))
    own = refs.join(inner.where("k = 1 AND kind = 'template'"), ["id", "s"]).join(_calls(texts).where(F.col("call").isin(*SELF_WRAPPING)).select("id", F.col("s").alias("x")), ["id", "x"]).join(E.dealt(texts), "id")
    text = F.col("text")
    bare = (E.trimmed(E.cut(text, F.col("a"), F.col("x"))) == "") & (E.trimmed(E.cut(text, F.col("y"), F.col("b"))) == "")
    return E.edited(texts, own.where(bare).select("id", "s", "e", E.cut(text, F.col("x"), F.col("y")).alias("new")))


def without_agencies(texts: DataFrame) -> DataFrame:
    """R16. A citation's agency becomes its publisher, stands in front of one that does not name it, or goes; n counts calls."""
    own = E.template_params(texts).where(_citation() & F.col("keyed") & F.lower("name").isin("agency", "publisher")).withColumn("low", F.lower("name"))
    last = own.withColumn("r", F.row_number().over(Window.partitionBy("id", "s", "low").orderBy(F.desc("n")))).where("r = 1")
    row = F.struct("a", "b", "value", "name_span", "value_span")
    calls = last.groupBy("id", "s").agg(F.max(F.when(F.col("low") == "agency", row)).alias("x"), F.max(F.when(F.col("low") == "publisher", row)).alias("y")).where("x IS NOT NULL")
    edit = lambda s, e, new: F.struct(s.alias("s"), e.alias("e"), new.alias("new"))
    named = edit(F.col("x.name_span.s"), F.col("x.name_span.e"), F.lit("publisher"))
    gone = edit(F.col("x.a") - 1, F.col("x.b"), F.lit(""))
    front = edit(F.col("y.value_span.s"), F.col("y.value_span.e"), F.concat("x.value", F.lit("; "), "y.value"))
    unsaid = (F.col("x.value") != "") & (F.col("y.value") != "") & ~F.contains(F.lower("y.value"), F.lower("x.value"))
    edits = F.when(F.col("y").isNull(), F.array(named)).when(unsaid, F.array(gone, front)).otherwise(F.array(gone))
    out = E.edited(texts, calls.select("id", F.explode(edits).alias("q")).select("id", "q.*")).drop("n")
    return out.join(calls.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def ill_renderings(texts: DataFrame) -> DataFrame:
    """P15. (id, title, display) of interlanguage links from English, the first display of each title."""
    own = E.template_params(texts).where("call = 'ill'").groupBy("id", "s").agg(*(F.max_by(F.when(F.col("name") == k, F.col("value")), F.when(F.col("name") == k, F.col("n"))).alias(f"p{k}") for k in "123"))
    found = own.where("p1 <> '' AND lower(p2) = 'en'").select("id", "s", F.coalesce(F.expr("nullif(p3, '')"), "p1").alias("title"), F.col("p1").alias("display"))
    return found.groupBy("id", "title").agg(F.min_by("display", "s").alias("display"))


def implicit_note_groups(texts: DataFrame) -> DataFrame:
    """V15. (id, implicit): whether some note template names no group."""
    calls = _calls(texts).where(F.col("call").isin(*IMPLICIT_NOTE_TEMPLATES)).select("id", "s")
    grouped = _values(E.template_params(texts), "group").where("`group` <> ''").select("id", "s")
    bare = calls.join(grouped, ["id", "s"], "left_anti").select("id").distinct().withColumn("implicit", F.lit(True))
    return texts.select("id").join(bare, "id", "left").select("id", F.coalesce("implicit", F.lit(False)).alias("implicit"))


def note_counts(texts: DataFrame) -> DataFrame:
    """A13. (id, name, n): how often each note template is called, aliases as one."""
    return _calls(texts).select("id", _map(NOTE_COUNTED)[F.col("call")].alias("name")).where("name IS NOT NULL").groupBy("id", "name").agg(F.count("*").alias("n"))


def boxes(texts: DataFrame) -> DataFrame:
    """P24. (id, ord, box): infoboxes at the top level, in order."""
    name = F.lower("name")
    own = E.template_calls(texts).where("depth = 0").where(name.startswith(BOX_PREFIXES[0]) | name.startswith(BOX_PREFIXES[1])).join(E.dealt(texts), "id")
    return own.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("s")) - 1).cast("long").alias("ord"), E.cut(F.col("text"), F.col("s"), F.col("e")).alias("box"))


def with_lost_boxes(source: DataFrame, made: DataFrame) -> DataFrame:
    """P24, P25. made (id, text) with the source's infoboxes beyond as many as it has, put behind the templates and comments that it begins with; n is their number."""
    # each kept by itself, as a task that finds the boxes of both holds some sixty sorts
    have = E.kept(boxes(made).groupBy("id").agg(F.count("*").alias("k")), "have", made)
    lost = E.kept(boxes(source), "boxes", made).join(have, "id", "left").where("ord >= coalesce(k, 0)")
    joined = lost.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "box"))), lambda r: r["box"]), "\n").alias("boxes"), F.count("*").alias("lost"))
    top = E.elements(made).where("depth = 0").join(E.dealt(made), "id")
    order = Window.partitionBy("id").orderBy("s")
    gap = E.cut(F.col("text"), F.coalesce(F.lag("e").over(order), F.lit(0)), F.col("s"))
    stop = F.when(F.col("kind").isin("template", "comment") & (E.trimmed(gap) == ""), 0).otherwise(1)
    lead = top.withColumn("stop", stop).withColumn("stops", F.sum("stop").over(order)).where("stops = 0").groupBy("id").agg(F.max("e").alias("at"))
    at = F.coalesce("at", F.lit(0))
    put = joined.join(lead, "id", "left").select("id", at.alias("s"), at.alias("e"), F.concat(F.lit("\n"), "boxes").alias("new"))
    return E.edited(made, put).drop("n").join(joined.select("id", "lost"), "id", "left").select("id", "text", F.coalesce("lost", F.lit(0)).cast("long").alias("n"))


def table_balance(texts: DataFrame) -> DataFrame:
    """V03. (id, opened, closed) of texts with unequal numbers of table marks outside templates."""
    from .pairing import unbalanced

    return unbalanced(E.without_templates(texts), "{|", "|}").select("id", "opened", "closed")


def ref_balance(texts: DataFrame) -> DataFrame:
    """V04. (id, opened, closed, at, line) of texts with unequal numbers of opening and closing reference tags; at is the first without a partner, tags that close themselves are left out."""
    gaps, found = E.split_at(F.col("text"), r"(?i)<ref\b[^>]*>|</ref\s*>")
    rows = texts.select("id", F.posexplode(F.arrays_zip(F.slice(F.transform(gaps, F.length), 1, F.size(found)).alias("gap"), found.alias("mark"))).alias("i", "x")).select("id", "i", "x.gap", "x.mark")
    order = Window.partitionBy("id").orderBy("i")
    placed = rows.withColumn("at", F.sum(F.col("gap") + F.length("mark")).over(order) - F.length("mark")).where(~F.col("mark").rlike(r"/\s*>$") | F.col("mark").startswith("</"))
    step = F.when(F.col("mark").startswith("</"), -1).otherwise(1)
    summed = placed.withColumn("step", step).withColumn("sum", F.sum(step).over(order))
    low = F.least(F.lit(0), F.coalesce(F.min("sum").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    level = summed.withColumn("low", low).withColumn("lone", (F.col("step") < 0) & (F.col("sum") < F.col("low")))
    back = Window.partitionBy("id").orderBy(F.desc("i"))
    # an opener stays open if the sum never falls under its own again
    after = F.min("sum").over(back.rowsBetween(Window.unboundedPreceding, -1))
    level = level.withColumn("after", after).withColumn("lone", F.col("lone") | ((F.col("step") > 0) & (F.col("after").isNull() | (F.col("after") >= F.col("sum")))))
    out = level.groupBy("id").agg(F.count(F.when(F.col("step") > 0, 1)).alias("opened"), F.count(F.when(F.col("step") < 0, 1)).alias("closed"), F.min(F.when(F.col("lone"), F.col("at"))).alias("at")).where("opened <> closed")
    line = F.length(F.regexp_replace(E.cut(F.col("text"), F.lit(0), F.col("at").cast("int")), r"[^\n]", "")) + 1
    return out.join(E.dealt(texts), "id").select("id", "opened", "closed", "at", line.alias("line"))
