"""References of translations set right by their sources: texts to rows, the relational operators' decisions, and edits back into the texts.

articles are (article, text, source).  Edge cases: null texts are empty;
articles without anything to mend come back as they are; every edit is on its
own span, so no text is printed anew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import refs
from ..functions.wiki import edited, implicit_note_group
from . import pairing as P, relational as R, wikitext as T


def reference_rows(articles: DataFrame, column: str = "text") -> DataFrame:
    """(article, ord, REFS) of every reference of a column."""
    return T.exploded(articles, refs.references, refs.REFS, [column], ["article"])


def list_rows(articles: DataFrame, column: str = "text") -> DataFrame:
    """(article, ord, LISTS) of every reference list of a column."""
    return T.exploded(articles, refs.lists, refs.LISTS, [column], ["article"])


def rewritten(articles: DataFrame, edits: DataFrame, lines: bool = False) -> DataFrame:
    """articles with edits (article, s, e, new) made in text; with ``lines``, a removed span takes a line it has alone."""
    own = edits.groupBy("article").agg(F.array_sort(F.collect_list(F.concat_ws("\0", F.col("s").cast("string"), F.col("e").cast("string"), F.coalesce("new", F.lit(""))))).alias("edits"))

    def made(text: str, given: list[str] | None) -> tuple:
        spans = [(int(a), int(b), new) for a, b, new in (x.split("\0", 2) for x in given or ())]
        return (edited(text, [(*(refs.whole_line(text, a, b) if lines and not new else (a, b)), new) for a, b, new in spans]),)

    return T.mapped(articles.join(own, "article", "left"), made, "text string", "text", "edits").drop("edits")


def renamed_references(articles: DataFrame) -> DataFrame:
    """J09. Definitions take the name of the one source definition of their print; reuses follow where all definitions of their name agree."""
    made, source = reference_rows(articles), reference_rows(articles, "source")
    defined = made.where("body IS NOT NULL AND name IS NOT NULL AND print <> '#'")
    named = R.restore_names(defined.selectExpr("article", "s AS pos", "print"), source.where("body IS NOT NULL AND name IS NOT NULL").select("article", "print", "name"))
    new = defined.join(named.withColumnsRenamed({"pos": "s", "name": "new"}), ["article", "s"]).where("new <> name")
    every = made.where("body IS NOT NULL AND name IS NOT NULL").groupBy("article", "name").agg(F.count("*").alias("of"))
    agreed = new.groupBy("article", "name").agg(F.min("new").alias("new"), F.max("new").alias("last"), F.count("*").alias("n")).join(every, ["article", "name"]).where("new = last AND n = of")
    reuses = made.where("body IS NULL").join(agreed.select("article", "name", "new"), ["article", "name"])
    edits = new.select("article", "name_s", "name_e", "new").unionByName(reuses.select("article", "name_s", "name_e", "new"))
    return rewritten(articles, edits.toDF("article", "s", "e", "new"))


def regrouped_references(articles: DataFrame) -> DataFrame:
    """J10. Groups that only the translation has become the source's, where it has one or one is swapped; note templates count as lower-alpha."""
    made = reference_rows(articles).where("grp IS NOT NULL")
    source = reference_rows(articles, "source").where("grp IS NOT NULL").select("article", "grp")
    implied = T.mapped(articles.select("article", "source"), lambda x: (implicit_note_group(x),), "implied boolean", "source").where("implied").select("article", F.lit(refs.IMPLICIT_GROUP).alias("grp"))
    mapping = P.group_names(made.select("article", "grp"), source.unionByName(implied))
    groups = dict_edits(made, mapping)
    return rewritten(articles, groups)


def dict_edits(made: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edits of the group attribute of made references by mapping (article, grp, becomes)."""
    hit = made.join(mapping, ["article", "grp"])
    return hit.select("article", F.col("s"), F.col("body_s").alias("e"), F.concat(F.lit("<ref"), F.when(F.col("name").isNotNull(), F.concat(F.lit(' name="'), "name", F.lit('"'))).otherwise(F.lit("")), F.lit(' group="'), "becomes", F.lit('"'), F.when(F.col("body").isNull(), F.lit(" />")).otherwise(F.lit(">"))).alias("new"))


def defined_orphans(articles: DataFrame) -> DataFrame:
    """J12. The first reuse of a name without definition takes the source's first definition."""
    made, source = reference_rows(articles).where("name IS NOT NULL"), reference_rows(articles, "source").where("name IS NOT NULL")
    found = P.orphan_definitions(made.where("body IS NULL").selectExpr("article", "name", "s AS pos"), made.where("body IS NOT NULL").select("article", "name"), source.where("body IS NOT NULL").selectExpr("article", "name", "s AS pos", "body"))
    hit = made.where("body IS NULL").join(found.selectExpr("article", "name", "pos AS s", "body AS new_body"), ["article", "name", "s"])
    group = F.when(F.col("grp").isNotNull(), F.concat(F.lit(' group="'), "grp", F.lit('"'))).otherwise(F.lit(""))
    return rewritten(articles, hit.select("article", "s", "e", F.concat(F.lit('<ref name="'), "name", F.lit('"'), group, F.lit(">"), "new_body", F.lit("</ref>")).alias("new")))


def without_unsupported(articles: DataFrame) -> DataFrame:
    """J13. Reuses without a definition go if the source's text does not hold their name."""
    made = reference_rows(articles).where("name IS NOT NULL")
    gone = P.unsupported_reuses(made.where("body IS NULL").selectExpr("article", "name", "s AS pos"), made.where("body IS NOT NULL").select("article", "name"), articles.select("article", F.coalesce("source", F.lit("")).alias("text")))
    return rewritten(articles, made.join(gone.selectExpr("article", "name", "pos AS s"), ["article", "name", "s"]).select("article", "s", "e", F.lit("").alias("new")))


def collapsed(articles: DataFrame) -> DataFrame:
    """A09. Later definitions of a name that differ from the first become reuses where the source has one body for it."""
    made = reference_rows(articles).where("name IS NOT NULL AND body IS NOT NULL")
    source = reference_rows(articles, "source").where("name IS NOT NULL AND body IS NOT NULL")
    later = P.conflicting_definitions(made.selectExpr("article", "name", "s AS pos", "body"), source.select("article", "name", "body"))
    return rewritten(articles, made.join(later.selectExpr("article", "name", "pos AS s"), ["article", "name", "s"]).select("article", "s", "e", F.concat(F.lit('<ref name="'), "name", F.lit('" />')).alias("new")))


def without_list_copies(articles: DataFrame) -> DataFrame:
    """J14. Body copies of references that the source defines in its list only become reuses where the translation's list defines them too."""
    made = reference_rows(articles).where("name IS NOT NULL AND body IS NOT NULL")
    source = reference_rows(articles, "source").where("name IS NOT NULL AND body IS NOT NULL")
    copies = P.list_duplicates(made.selectExpr("article", "name", "s AS pos", "in_list", "grp"), source.select("article", "name", "in_list"))
    return rewritten(articles, made.join(copies.selectExpr("article", "name", "pos AS s"), ["article", "name", "s"]).select("article", "s", "e", F.concat(F.lit('<ref name="'), "name", F.lit('" />')).alias("new")))


def without_stray_lists(articles: DataFrame) -> DataFrame:
    """A10. Lists of a kind and group beyond as many as the source has go, with their line; those under notes stay first, then the last ones."""
    made, source = list_rows(articles), list_rows(articles, "source")
    stray = P.stray_lists(made.selectExpr("article", "kind", "grp", "s AS pos", "under_notes"), source.select("article", "kind", "grp"))
    return rewritten(articles, made.join(stray.selectExpr("article", "pos AS s"), ["article", "s"]).select("article", "s", "e", F.lit("").alias("new")), lines=True)
