"""Rewrites of dates, notes, hatnotes and reference lists as edits on the tables of elements and parameters.

As in ``rewriting``: texts (id, text) in, (id, text, n) out, n the number of
edits; ids unique and not null; null texts stay null; an empty table gives
none; a second run changes nothing.  Impossible dates and odd digits are left
as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..functions.rewrites import DATE_PARAMS, ENGLISH_MONTHS, HATNOTES, LETTER_GROUPS, LOCAL_MONTHS, LOCAL_MONTHS_DEFINITE, NOTE_GROUP
from ..sources.shared import new_path
from . import elements as E, rewriting as R



def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder, where several parts of a plan read it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_YES = ("y", "yes", "on", "1", "true")


def _month(name: Column) -> Column:
    """The number of an English month by its first three letters, null for other words."""
    return R._map({m.lower()[:3]: f"{i:02d}" for i, m in enumerate(ENGLISH_MONTHS, 1)})[F.lower(F.substring(name, 1, 3))]


def _names(names: tuple[str, ...]) -> Column:
    return F.array(*map(F.lit, names))


def right_date(value: Column) -> Column:
    """A date as citations take it: days in digits, months alone in English; null for what is right or unknown."""
    plain = F.trim(F.regexp_replace(value, r"[\s,]+", " "))
    part = lambda pattern, k: F.nullif(F.regexp_extract(plain, pattern, k), F.lit(""))
    day_first, month_first = r"^(\d{1,2}) ([A-Za-z]+)\.? (\d{4})$", r"^([A-Za-z]+)\.? (\d{1,2}) (\d{4})$"
    days = [F.concat_ws("-", part(p, 3), _month(part(p, m)), F.lpad(part(p, d), 2, "0")) for p, d, m in ((day_first, 1, 2), (month_first, 2, 1))]
    local = R._map(dict(zip(LOCAL_MONTHS, ENGLISH_MONTHS, strict=True)))[F.lower(part(r"^(\p{L}+) \d{4}$", 1))]
    number = F.nullif(F.regexp_extract(F.trim(value), r"^\d{4}-(0[1-9]|1[0-2])$", 1), F.lit(""))
    return F.coalesce(
        *(F.when(F.length(x) == 10, x) for x in days),
        F.concat(local, F.lit(" "), part(r"^\p{L}+ (\d{4})$", 1)),
        F.concat(F.get(_names(ENGLISH_MONTHS), number.cast("int") - 1), F.lit(" "), F.substring(F.trim(value), 1, 4)),
    )


def right_dates(texts: DataFrame) -> DataFrame:
    """R12. Dates of citations in the form that is understood; an archive's own date stands in its address. Days are not checked against months."""
    own = E.template_params(texts).where(R._citation() & F.col("keyed")).withColumn("low", F.lower("name"))
    stamp = r"web\.archive\.org/web/(\d{4})(\d\d)(\d\d)"
    url = F.max_by(F.when(F.col("low") == "archive-url", F.col("value")), F.when(F.col("low") == "archive-url", F.col("n"))).over(Window.partitionBy("id", "s"))
    dated = own.withColumn("url", url).where(F.col("low").isin(*DATE_PARAMS))
    archived = F.when(F.col("low").startswith("archive") & F.col("url").rlike(stamp), F.regexp_replace(F.regexp_extract("url", stamp, 0), stamp, "$1-$2-$3"))
    new = F.coalesce(archived, right_date(F.col("value")))
    return E.edited(texts, dated.withColumn("new", new).where("new <> value").select(*R._edit(F.col("value_span"), F.col("new"))))


def _listed(params: DataFrame) -> DataFrame:
    """(id, s, e, call, places, named): values without a name in order, and (k, v) of the others."""
    pair = F.struct("n", F.col("name").alias("k"), F.col("value").alias("v"))
    return params.groupBy("id", "s", "e", "call").agg(
        F.transform(F.array_sort(F.collect_list(F.when(~F.col("keyed"), pair))), lambda x: x["v"]).alias("places"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("keyed"), pair))), lambda x: F.struct(x["k"].alias("k"), x["v"].alias("v"))).alias("named"),
    )


def _childless(found: DataFrame, calls: DataFrame) -> DataFrame:
    """Those calls (id, s, ...) that hold no other one of the elements found."""
    return calls.join(found.where("parent IS NOT NULL").select("id", F.col("parent.s").alias("s")).distinct(), ["id", "s"], "left_anti")


def right_as_of(texts: DataFrame) -> DataFrame:
    """R13. As of with a month says it in words, with a capital where a sentence begins, in the place of lc; lang goes.

    Year, month and day are given each, or as one date.  Calls with a text of
    their own, without a known month, keep year and names.
    """
    marked, params = E.kept(E.elements(texts), "elements", texts), E.kept(E.template_params(texts), "params", texts)
    calls = _childless(marked, _listed(params.where("call = 'as of'"))).where(F.size("places") > 0)
    place = lambda i: F.get("places", F.lit(i))
    date = F.regexp_replace(place(0), r"[\s,]+", " ")
    part = lambda c, p: F.nullif(F.regexp_extract(c, p, 1), F.lit(""))
    apart = place(0).rlike(r"^[0-9]+$")
    year = F.when(apart, place(0)).otherwise(part(date, r"\b(\d{4})\b"))
    word = F.when(apart, place(1)).otherwise(part(date, r"([A-Za-z]+)"))
    month = F.when(apart & place(1).rlike("^[0-9]{1,2}$"), place(1).cast("string")).otherwise(F.when(word.rlike(r"^[A-Za-z]+\.?$"), _month(word)))
    day = F.when(apart, F.when(place(2).rlike("^[0-9]{1,2}$"), place(2))).otherwise(part(date, r"(?:^| )(\d{1,2})(?: |$)"))
    known = apart | (date.rlike(r"\b\d{4}\b") & date.rlike("[A-Za-z]") & (F.size(F.split(date, " ")).between(2, 3)))
    has = lambda k: F.exists("named", lambda x: x["k"] == k)
    number = F.expr("try_cast(month AS INT)")
    found = calls.where(known).withColumns({"year": year, "month": month, "day": day}).withColumn("m", F.when(number.between(1, 12) & ~has("alt"), number))
    found = found.where(F.col("m").isNotNull() | has("lang") | (F.size("places") > 1))
    # what stands before the call, references and short footnotes blanked
    notes = marked.where("kind = 'tag' AND name = 'ref'").select("id", "s", "e").unionByName(params.where("call = 'sfn'").select("id", "s", "e").distinct())
    bare = E.edited(texts, notes.withColumn("new", F.repeat(F.lit(" "), F.col("e") - F.col("s")))).select("id", F.col("text").alias("bare"))
    last = F.regexp_extract(E.cut(F.col("bare"), F.lit(0), F.col("s")), r"(\S)\s*$", 1)
    low = F.exists("named", lambda x: (x["k"] == "lc") & F.lower(x["v"]).isin(*_YES)) | ~last.isin("", ".", "!", "?", ":")
    said = F.concat(F.when(low, "që").otherwise("Që"), F.lit(" nga "), F.coalesce(F.concat(F.col("day").cast("int").cast("string"), F.lit(" ")), F.lit("")), F.get(_names(LOCAL_MONTHS_DEFINITE), F.col("m") - 1), F.lit(" "), F.col("year"))
    kept = F.filter("named", lambda x: (x["k"] != "lang") & ((x["k"] != "lc") | F.col("m").isNull()))
    rest = F.transform(kept, lambda x: F.concat(x["k"], F.lit("="), x["v"]))
    head = F.when(F.col("m").isNotNull(), F.array(F.col("year"), F.concat(F.lit("alt="), said))).otherwise(F.array("year"))
    new = F.concat(F.lit("{{As of|"), F.array_join(F.concat(head, rest), "|"), F.lit("}}"))
    return E.edited(texts, found.join(bare, "id").select("id", "s", "e", new.alias("new")))


def age_words(texts: DataFrame) -> DataFrame:
    """R14. Calls of two dates become years and days in words, open-ended ones go; 29 February counts as the 28th in common years; calls of impossible dates stay."""
    calls = _childless(E.elements(texts), _listed(E.template_params(texts).where("call IN ('age in years and days', 'age in years and days nts')")))
    own = calls.where((F.size("named") == 0) & (F.size("places") > 0) & F.forall("places", lambda v: v.rlike("^[0-9]{1,6}$")))
    at = lambda i: F.lpad(F.get("places", F.lit(i)).cast("int").cast("string"), 4 if i % 3 == 0 else 2, "0")
    date = lambda i: F.when(at(i) > "0000", F.try_to_date(F.concat_ws("-", at(i), at(i + 1), at(i + 2)), "yyyy-MM-dd"))
    both = own.withColumns({"a": date(0), "b": date(3)})
    years = F.floor(F.months_between(F.trunc("b", "month"), F.trunc("a", "month")) / 12)
    early = (F.month("b") == F.month("a")) & (F.dayofmonth("b") < F.dayofmonth("a"))
    full = both.withColumn("y", (years - F.when(early, 1).otherwise(0)).cast("int"))
    days = F.datediff("b", F.add_months("a", F.col("y") * 12))
    words = F.concat_ws(", ", F.when(F.col("y") != 0, F.concat(F.col("y").cast("string"), F.lit(" vjet"))), F.when((days != 0) | (F.col("y") == 0), F.concat(days.cast("string"), F.lit(" ditë"))))
    new = F.when(F.size("places") != 6, "").otherwise(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), words))
    return E.edited(texts, full.withColumn("new", new).where("new IS NOT NULL").select("id", "s", "e", "new"))


def unnested_ills(texts: DataFrame) -> DataFrame:
    """R10. An interlanguage call does not stand inside a link: as target it takes the label as lt, as label it replaces the link."""
    found = E.kept(E.elements(texts), "elements", texts)
    links = found.where("kind = 'link'").select("id", "s", "e")
    child = found.where("parent.kind = 'link'").groupBy("id", F.col("parent.s").alias("s")).agg(F.count("*").alias("k"), F.min("s").alias("x"), F.min("e").alias("y"), F.min("kind").alias("kind")).where("k = 1 AND kind = 'template'")
    bars = E.separators(texts).where("mark = '|' AND kind = 'link'").groupBy("id", "s").agg(F.min("at").alias("bar"), F.count("*").alias("bars"))
    given = R._values(E.template_params(texts).where("call = 'ill'"), "lt", "1").select("id", F.col("s").alias("x"), "lt", F.col("1").alias("target"))
    calls = given.select("id", "x").join(found.where("parent IS NOT NULL").select("id", F.col("parent.s").alias("x")).distinct(), ["id", "x"], "left_anti")
    own = links.join(child, ["id", "s"]).join(calls, ["id", "x"]).join(given, ["id", "x"]).join(bars, ["id", "s"], "left").where("coalesce(bars, 0) <= 1").join(E.dealt(texts), "id")
    text, end = F.col("text"), F.coalesce("bar", F.col("e") - 2)
    call = E.cut(text, F.col("x"), F.col("y"))
    label = F.when(F.col("bar").isNotNull(), E.trimmed(E.cut(text, F.col("bar") + 1, F.col("e") - 2)))
    labelled = F.when((label != "") & F.col("lt").isNull() & ~F.coalesce(F.col("target") == label, F.lit(False)), F.concat(F.substring(call, F.lit(1), F.length(call) - 2), F.lit("|lt="), label, F.lit("}}")))
    target = (F.col("x") == F.col("s") + 2) & (F.col("y") == end)
    shown = F.col("bar").isNotNull() & (F.col("x") == F.col("bar") + 1) & (F.col("y") == F.col("e") - 2) & (E.trimmed(E.cut(text, F.col("s") + 2, F.col("bar"))) != "")
    new = F.when(target, F.coalesce(labelled, call)).when(shown, call)
    return E.edited(texts, own.withColumn("new", new).where("new IS NOT NULL").select("id", "s", "e", "new"))


def nested_notes(texts: DataFrame) -> DataFrame:
    """R07. A reference on one line that holds references of one level becomes a refn call with its group, name and text; its own bars are written as calls."""
    found = E.kept(E.elements(texts), "elements", texts)
    refs = found.where("kind = 'tag' AND name = 'ref' AND closer <> ''").select("id", "s", "e", "opener", "closer", "parent")
    every = found.where("kind = 'tag' AND name = 'ref'")
    outer = refs.join(R._inside(refs.select("id", F.col("s"), "e"), refs.select("id", F.col("s"), "e").withColumn("s", F.col("s") + 1), texts).select("id", "s"), ["id", "s"], "left_anti")
    inner = every.where("parent.kind = 'tag' AND parent.name = 'ref'").select("id", F.col("parent.s").alias("s"), F.col("s").alias("x"))
    deep = inner.select("id", F.col("x").alias("s")).join(inner.select("id", "s").distinct(), ["id", "s"])
    holds = inner.select("id", "s").distinct().join(inner.join(deep.select("id", F.col("s").alias("x")), ["id", "x"]).select("id", "s").distinct(), ["id", "s"], "left_anti")
    own = outer.join(holds, ["id", "s"]).join(E.dealt(texts), "id")
    text = F.col("text")
    own = E.kept(own.where(~F.contains(E.cut(text, F.col("s"), F.col("e")), F.lit("\n"))), "outer", texts)
    value = lambda k: F.nullif(F.regexp_replace(F.regexp_extract("opener", rf"(?i)\b{k}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'/>]+)", 1), "^[\"']|[\"']$", ""), F.lit(""))
    given = F.concat(*(F.coalesce(F.concat(F.lit(f"|{k}="), value(k)), F.lit("")) for k in ("group", "name")))
    a, b = F.col("s") + F.length("opener"), F.col("e") - F.length("closer")
    body = E.cut(text, a, b)
    lead, tail = F.length(body) - F.length(F.regexp_replace(body, r"^\s+", "")), F.length(body) - F.length(F.regexp_replace(body, r"\s+$", ""))
    edit = lambda s, e, new: F.struct(s.cast("long").alias("s"), e.cast("long").alias("e"), new.alias("new"))
    ends = own.select("id", F.explode(F.array(edit(F.col("s"), a + lead, F.concat(F.lit("{{refn"), given, F.lit("|1="))), edit(b - tail, F.col("e"), F.lit("}}")))).alias("x")).select("id", "x.*")
    marks = E.marks(texts).where("mark = '|'").select("id", F.col("at").alias("s"))
    around = own.select("id", F.col("s"), "e")
    closed = found.where("kind IN ('template', 'link', 'argument', 'tag')").join(own.select("id", "s"), ["id", "s"], "left_anti").select("id", "s", "e")
    bars = R._inside(marks, around, texts).join(R._inside(marks, closed, texts), ["id", "s"], "left_anti").select("id", F.col("s").cast("long").alias("s"), (F.col("s") + 1).cast("long").alias("e"), F.lit("{{!}}").alias("new"))
    out = E.edited(texts, ends.unionByName(bars)).drop("n")
    return out.join(own.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", "text", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def merged_references(texts: DataFrame) -> DataFrame:
    """R18. Of two closing tags of one list with neither heading nor opening tag between them, each alone on its line, the first goes with its line."""
    lines = texts.select("id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line")).withColumn("bare", F.lower(F.trim("line")))
    head = F.trim("line").rlike(r"^=+[^=].*=$")
    event = F.when(head, "heading").when(F.col("bare").rlike(r"<references\b[^>]*(?<!/)>"), "opens").when(F.col("bare") == "</references>", "closes")
    events = lines.select("id", "i", F.length("line").alias("size"), event.alias("event")).where("event IS NOT NULL")
    order = Window.partitionBy("id").orderBy("i")
    lists = events.where("event <> 'heading'").withColumn("first", F.lag("event").over(order) == "opens").where("event = 'closes' AND first").select("id", "i")
    gone = events.withColumn("next", F.lead("event").over(order)).where("event = 'closes' AND next = 'closes'").join(lists, ["id", "i"]).select("id", "i")
    kept = lines.join(gone, ["id", "i"], "left_anti").groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda r: r["line"]), "\n").alias("new"))
    return texts.select("id", "text").join(kept, "id", "left").join(gone.groupBy("id").agg(F.count("*").alias("n")), "id", "left").select("id", F.coalesce("new", "text").alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def without_redirect_notes(texts: DataFrame) -> DataFrame:
    """R17. Templates named redirect… with parameters that stand alone on their lines go, with the line's end."""
    own = R._calls(texts).where(F.col("call").rlike(r"^redirect[\w -]*$") & F.col("bar").isNotNull()).join(E.dealt(texts), "id")
    before, behind = E.cut(F.col("text"), F.lit(0), F.col("s")), F.substring(F.col("text"), F.col("e") + 1, F.length("text"))
    alone = own.where(before.rlike(r"(?:^|\n)[ \t]*\z") & behind.rlike(r"^[ \t]*(?:\n|\z)"))
    lead, tail = F.length(F.regexp_extract(before, r"([ \t]*)\z", 1)), F.length(F.regexp_extract(behind, r"^([ \t]*\n?)", 1))
    return E.edited(texts, alone.select("id", (F.col("s") - lead).alias("s"), (F.col("e") + tail).alias("e"), F.lit("").alias("new")))


def _hatnotes(texts: DataFrame, made: bool, name: str) -> DataFrame:
    """(id, kind, name): the hatnotes of a kind at the top level, in order, as (s, e, targets)."""
    kinds = {call: kind for kind, (own, translated, _) in HATNOTES.items() for call in (translated if made else own)}
    top = R._calls(texts).where("depth = 0").select("id", "s", "e", R._map(kinds)[F.col("call")].alias("kind")).where("kind IS NOT NULL")
    values = E.template_params(texts).where("NOT keyed AND value <> ''").groupBy("id", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"]).alias("targets"))
    both = top.join(values, ["id", "s"], "left").withColumn("targets", F.coalesce("targets", F.array().cast("array<string>")))
    return both.groupBy("id", "kind").agg(F.array_sort(F.collect_list(F.struct("s", "e", "targets"))).alias(name))


def linked_hatnotes(made: DataFrame, source: DataFrame, missing: DataFrame, lang: str = "en") -> DataFrame:
    """J07. Hatnotes of made with a target in missing (id, title), or that is no bare title, become plain ones with interlanguage links.

    Each takes the next source call of its kind with as many targets: a fold
    over the calls that carries the place reached in the source.
    """
    both = _hatnotes(made, True, "ms").join(_hatnotes(source, False, "ss"), ["id", "kind"])
    fold = """aggregate(ms, struct(0 AS at, CAST(array() AS array<struct<s: int, e: int, targets: array<string>, originals: array<string>>>) AS out), (st, m) ->
        aggregate(array(array_position(transform(ss, (x, i) -> i >= st.at AND size(x.targets) = size(m.targets)), true)), st, (q, nth) ->
          if(nth = 0, q, struct(CAST(nth AS INT) AS at, concat(q.out, array(struct(CAST(m.s AS INT) AS s, CAST(m.e AS INT) AS e, m.targets AS targets, ss[CAST(nth AS INT) - 1].targets AS originals))) AS out)))).out"""
    pairs = both.select("id", "kind", F.explode(F.expr(fold)).alias("x")).select("id", "kind", "x.*")
    each = pairs.select("id", "kind", "s", "e", F.posexplode(F.arrays_zip("targets", "originals")).alias("i", "x")).select("id", "kind", "s", "e", "i", F.col("x.targets").alias("title"), F.col("x.originals").alias("original"))
    known = each.join(missing.select("id", "title", F.lit(True).alias("gone")).repartition(E.tasks(made), "id").distinct(), ["id", "title"], "left")
    call = F.contains("title", F.lit("{{"))
    link = F.when(call, F.col("title")).when(F.col("gone"), F.concat(F.lit("{{ill|"), "title", F.lit(f"|{lang}|"), "original", F.lit("}}"))).otherwise(F.concat(F.lit("[["), "title", F.lit("]]")))
    lists = known.groupBy("id", "kind", "s", "e").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", link.alias("link")))), lambda x: x["link"]).alias("links"), F.max(F.coalesce("gone", F.lit(False)) | call).alias("some")).where("some")
    joined = F.when(F.size("links") > 1, F.concat(F.array_join(F.slice("links", 1, F.size("links") - 1), ", "), F.lit(" dhe "), F.element_at("links", -1))).otherwise(F.element_at("links", -1))
    label = R._map({kind: shown for kind, (_, _, shown) in HATNOTES.items()})[F.col("kind")]
    return E.edited(made, lists.select("id", "s", "e", F.concat(F.lit("{{Hatnote|"), label, F.lit(": "), joined, F.lit("}}")).alias("new")))


def expanded_notes(texts: DataFrame) -> DataFrame:
    """J20. (id, text, n, lost, idle): markers (Cref2) become references of the block's notes (Cnote2), and the block a list of their group.

    The first marker of a label holds the note, its own references behind it,
    and later ones reuse it.  n markers are expanded; lost are the labels of
    markers that stay (a label without a note, or inside a reference), idle
    those of notes without a marker.  A text without notes stays as it is.
    """
    calls = E.kept(R._calls(texts).where("call IN ('cref2', 'cnote2', 'cnote2 begin', 'cnote2 end')").select("id", "s", "e", "call"), "calls", texts)
    params = E.kept(E.template_params(texts).where("call IN ('cref2', 'cnote2', 'cnote2 begin')"), "params", texts)
    pairs = R._values(params.where("call = 'cnote2'"), "1", "2").where("`1` IS NOT NULL AND `2` IS NOT NULL")
    notes = pairs.groupBy("id", F.col("1").alias("label")).agg(F.min_by("2", "s").alias("note"), F.min("s").alias("at"))
    block = calls.where("call <> 'cref2'").withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("s")))
    usable = block.where("r = 1 AND call <> 'cnote2 end'").join(notes.select("id").distinct(), "id", "left_semi").select("id")
    style = R._values(params.where("call = 'cnote2 begin'"), "liststyle").groupBy("id").agg(F.lower(F.min_by("liststyle", "s")).alias("style"))
    group = F.when(F.col("style").isin(*LETTER_GROUPS), F.col("style")).otherwise(NOTE_GROUP)
    groups = usable.join(style, "id", "left").select("id", group.alias("group"))
    refs = E.kept(E.elements(texts).where("kind = 'tag' AND name = 'ref'").select("id", "s", "e"), "refs", texts)
    markers = calls.where("call = 'cref2'").join(usable, "id", "left_semi").select("id", "s", "e")
    inside = R._inside(markers, refs, texts).select("id", "s", F.lit(True).alias("inside"))
    labels = params.where("call = 'cref2' AND value <> ''").where(~F.col("keyed") | F.col("name").rlike("^[0-9]+$")).select("id", "s", "n", F.col("value").alias("label"))
    each = markers.join(inside, ["id", "s"], "left").join(labels, ["id", "s"], "left").join(notes.select("id", "label", F.lit(True).alias("known")), ["id", "label"], "left")
    whole = Window.partitionBy("id", "s")
    judged = E.kept(each.withColumn("stays", F.max(F.coalesce("inside", F.lit(False)) | F.col("known").isNull()).over(whole)), "markers", texts)
    lost = judged.where("stays").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "n", F.coalesce("label", F.lit("?")).alias("label")))), lambda x: x["label"]).alias("lost"))
    used = judged.where("NOT stays").withColumn("first", F.row_number().over(Window.partitionBy("id", "label").orderBy("s", "n")) == 1)
    # a note as a text of its own: references taken out, and put behind
    own = notes.select(F.struct("id", "label").alias("id"), F.col("note").alias("text"))
    inner = E.kept(E.elements(own).where("kind = 'tag' AND name = 'ref'").select("id", "s", "e"), "inner", own)
    top = inner.join(R._inside(inner, inner.withColumn("s", F.col("s") + 1), own).select("id", "s"), ["id", "s"], "left_anti").join(own, "id")
    behind = top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", E.cut(F.col("text"), F.col("s"), F.col("e")).alias("ref")))), lambda x: x["ref"]), "").alias("behind"))
    bare = _kept(E.edited(own, top.select("id", "s", "e", F.lit("").alias("new"))).select("id", F.concat(F.lit("<ref>"), E.trimmed(F.col("text")), F.lit("</ref>")).alias("text")), "bodies")
    bodies = R.plain_notes(bare).join(behind, "id", "left").select("id.id", "id.label", F.substring("text", 6, 1 << 30).alias("body"), F.coalesce("behind", F.lit("")).alias("behind"))
    name = F.concat(F.lit('<ref name="cnote-'), F.regexp_replace("label", "[^A-Za-z0-9_-]+", ""), F.lit('" group="'), "group", F.lit('"'))
    shown = used.join(groups, "id").join(bodies, ["id", "label"]).withColumn("new", F.when(F.col("first"), F.concat(name, F.lit(">"), "body", "behind")).otherwise(F.concat(name, F.lit(" />"))))
    marks = shown.groupBy("id", "s", "e").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "new"))), lambda x: x["new"]), "").alias("new"))
    listed = block.join(groups, "id").select("id", "s", "e", F.when(F.col("r") == 1, F.concat(F.lit("{{Reflist|group="), "group", F.lit("}}"))).otherwise("").alias("new"))
    out = E.edited(texts, marks.unionByName(listed)).drop("n")
    # a list of notes right behind the new list, and empty lines left by the block, go
    list_ = r"(\{\{Reflist\|group=(?:upper|lower)-[a-z]+\}\})"
    tidy = F.regexp_replace(F.regexp_replace("text", list_ + r"\s*\n\{\{\s*[Nn]otelist\s*(?:\|[^{}]*)?\}\}", "$1"), list_ + r"\n{3,}", "$1\n\n")
    idle = notes.join(usable, "id", "left_semi").join(used.select("id", "label").distinct(), ["id", "label"], "left_anti").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: x["label"]).alias("idle"))
    none = F.array().cast("array<string>")
    done = out.join(usable.withColumn("done", F.lit(True)), "id", "left").join(marks.groupBy("id").agg(F.count("*").alias("n")), "id", "left").join(lost, "id", "left").join(idle, "id", "left")
    return done.select("id", F.when(F.col("done"), tidy).otherwise(F.col("text")).alias("text"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("lost", none).alias("lost"), F.coalesce("idle", none).alias("idle"))


#: The rewrites that need no source, in their order, each with what a text must hold to be looked at.
STEPS = (
    (R.english_params, r"(?i)\{\{\s*cit"),
    (R.page_params, r"(?i)\{\{\s*(?:sfn|harv)"),
    (nested_notes, r"(?i)<ref"),
    (R.unwrapped_notes, r"(?is)<ref.*\{\{\s*sfn"),
    (R.plain_notes, r"(?is)<ref.*\{\{\s*sfn"),
    (unnested_ills, r"(?i)\{\{\s*ill"),
    (right_dates, r"(?is)\{\{\s*cit.*date"),
    (right_as_of, r"(?i)\{\{\s*as\s+of"),
    (age_words, r"(?i)\{\{\s*age\s+in"),
    (R.without_agencies, r"(?i)agency"),
)


def ordered(texts: DataFrame, steps=STEPS) -> DataFrame:
    """R20. (id, text, steps) after the rewrites that need no source, in their order; steps are the names of those that changed a text.

    A step takes the texts that hold what it looks for; what it makes is
    written to the shared folder, and a step without such texts costs one look.
    """

    def after(now: DataFrame, step) -> DataFrame:
        rewrite, needs = step
        some = now.where(F.col("text").rlike(needs)).select("id", "text")
        if not some.limit(1).count():
            return now
        new = rewrite(some).select("id", F.col("text").alias("new"))
        changed = F.when(F.col("new") != F.col("text"), F.concat("steps", F.array(F.lit(rewrite.__name__)))).otherwise(F.col("steps"))
        return _kept(now.join(new, "id", "left").select("id", F.coalesce("new", "text").alias("text"), changed.alias("steps")), rewrite.__name__)

    return reduce(after, steps, texts.select("id", "text", F.array().cast("array<string>").alias("steps")))
